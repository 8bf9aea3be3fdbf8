"""Structured Streaming: packet rows to scored flows."""
