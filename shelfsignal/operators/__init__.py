"""Relational operators of the engine; every function takes and returns DataFrames."""
