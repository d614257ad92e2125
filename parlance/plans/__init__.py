"""Whole request flows as one lazy plan each."""
