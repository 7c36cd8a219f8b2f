"""Structured Streaming versions of the copy, answer, load, pairing and monitoring flows."""
