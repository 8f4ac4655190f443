"""Structured Streaming operators for cutovers."""
