"""Readers: landed payloads (JSON/CSV), the feature store, and driver-table bindings."""
