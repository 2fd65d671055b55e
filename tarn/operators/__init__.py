"""Relational operators over memory tables; each takes and returns DataFrames."""
