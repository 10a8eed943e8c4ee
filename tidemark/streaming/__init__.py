"""Structured Streaming jobs that connect sources to destinations."""
