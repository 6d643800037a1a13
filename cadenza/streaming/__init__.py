"""Structured Streaming forms of the trial operators."""
