"""Operators over DataFrames: merging, ordering, diagnostics, checks, table care."""
