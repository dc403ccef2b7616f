"""Structured Streaming: loads by micro-batch."""
