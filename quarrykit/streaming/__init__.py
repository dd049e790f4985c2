"""Inspections over folders that files keep arriving in."""
