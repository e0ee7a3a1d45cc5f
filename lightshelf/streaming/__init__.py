"""Structured Streaming forms of the log and session operators."""
