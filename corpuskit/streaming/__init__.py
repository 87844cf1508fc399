"""Structured Streaming jobs: the daily usage ledger and the concept-archive ingest."""
