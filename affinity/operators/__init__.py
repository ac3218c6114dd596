"""Relational and graph operators; every function takes and returns DataFrames."""
