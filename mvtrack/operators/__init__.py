"""Operators over the canonical tables; each takes and returns DataFrames."""
