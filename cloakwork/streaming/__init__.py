"""Structured Streaming forms of tokenization and of the request loop."""
