"""Structured Streaming forms of the time-bound operators; each has a batch twin."""
