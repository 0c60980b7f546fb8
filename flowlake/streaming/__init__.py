"""Structured Streaming operators (ST1-ST11)."""
