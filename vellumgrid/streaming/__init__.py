"""Structured Streaming front doors that reuse the batch operators."""
