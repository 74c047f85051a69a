"""Column expressions (no UDFs): index conversion, calendar, weather, estimators."""
