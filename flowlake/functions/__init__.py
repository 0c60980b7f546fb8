"""Scalar functions: native Spark expressions over columns (net, text, time, bytes)."""
