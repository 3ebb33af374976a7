"""Structured Streaming jobs: liveness, relays, live counts, ingest and de-duplication."""
