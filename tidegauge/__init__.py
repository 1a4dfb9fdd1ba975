"""Validation, gap filling and reliability measures for sensor time series on Spark."""

__version__ = "0.1.0"
