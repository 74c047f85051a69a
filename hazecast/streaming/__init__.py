"""Structured Streaming jobs: ingest, event-time hourly means, stateful change rate, upsert, alerts."""
