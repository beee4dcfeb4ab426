"""Structured Streaming forms of the scan-job operators."""
