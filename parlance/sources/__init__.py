"""Readers, file admission and sinks."""
