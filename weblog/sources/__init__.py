"""Readers and writers: raw text (plain or gzip) and Parquet logs.

JSON benchmark payloads are read by ``weblog.operators.metrics.read_payloads``.
"""
from weblog.sources.logs import committed, read_logs, register_logs, verify_written, write_logs
from weblog.sources.text import read_lines, sample_lines, sample_lines_by_content

__all__ = ["read_lines", "sample_lines", "sample_lines_by_content", "read_logs", "register_logs",
           "write_logs", "verify_written", "committed"]
