"""Scans, schema contracts, sinks and the model registry."""
