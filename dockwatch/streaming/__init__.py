"""Structured Streaming jobs: ingest, registry, alerts, escalations, scoring."""
