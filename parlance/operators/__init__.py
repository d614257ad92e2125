"""Batch operators. Each takes and returns DataFrames and keeps ``workspace_id`` as a key."""
