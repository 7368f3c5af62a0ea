"""Incremental form of the ingest job (Structured Streaming file source)."""
from weblog.streaming.ingest import start_ingest

__all__ = ["start_ingest"]
