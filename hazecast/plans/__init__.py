"""Composite plans: history builds, preprocessing, scoring."""
