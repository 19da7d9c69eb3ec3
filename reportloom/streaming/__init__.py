"""Structured Streaming forms of ingestion, daily costs, session activity and context."""
