"""The wrapper of a measurement table and the ordered operations that all operators are built from."""

from .series import SeriesFrame, fillmeta, filled, valid

__all__ = ["SeriesFrame", "filled", "fillmeta", "valid"]
