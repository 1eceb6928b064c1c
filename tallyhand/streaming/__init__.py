"""Structured Streaming jobs for growing hand directories."""
