"""The data behind plots, and counts of what operators removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ranges import in_range
from ..plans.series import SeriesFrame, filled, fillmeta, valid
from .tagging import percent_left


def analysed(s: SeriesFrame, c: str, arange=None, mode: str = "valid") -> DataFrame:
    """(series, time, value, tag): points by tag, or in mode filled by the origin of their filled value."""
    if mode not in ("valid", "filled"):
        raise ValueError(f"mode is valid or filled, not {mode!r}")
    value, tag = (F.col(c), F.col(valid(c))) if mode == "valid" else (F.col(filled(c)), F.col(fillmeta(c)))
    return s.df.where(in_range(s, arange)).select(s.key, s.time, value.alias("value"), tag.alias("tag"))


def wide(s: SeriesFrame, *columns: str, time: str | None = None) -> DataFrame:
    """Time and the columns to draw as lines."""
    return s.df.select(s.key, time or s.time, *columns)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and its number of rows as soon as it has run, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def removed_line(before: int, after: int, what: str = "filter") -> str:
    return f"{what}: {before} rows before, {after} after, {before - after} removed"


__all__ = ["analysed", "observed", "percent_left", "removed_line", "wide"]
