"""Operators over DataFrames: syntax facts, statements, identity, rollups."""
