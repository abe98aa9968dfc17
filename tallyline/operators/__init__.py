"""Operators on DataFrames. None of them runs a job, opens a session or calls Python per row."""
