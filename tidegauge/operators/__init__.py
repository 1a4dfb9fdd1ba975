"""Operators on SeriesFrame, by purpose: each returns a new lazy table."""
