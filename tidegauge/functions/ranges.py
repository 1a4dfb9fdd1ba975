"""The range predicate that nearly all operators share: a label slice, inclusive at both ends."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.series import SeriesFrame

_DAY = re.compile(r"\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})\s*$")


def _bound(value, is_datetime: bool, upper: bool):
    """A literal and whether it is itself part of the range. A day given as text ends at its last moment."""
    if not is_datetime:
        if isinstance(value, (str, date, datetime)):
            raise TypeError(f"the time axis is a number, but the range has {value!r}")
        return float(value), True
    if isinstance(value, (int, float)):
        raise TypeError(f"the time axis has time stamps, but the range has {value!r}")
    if isinstance(value, str):
        if m := _DAY.match(value):
            day = datetime(*map(int, m.groups()))
            return (day + timedelta(1), False) if upper else (day, True)
        value = datetime.fromisoformat(value.replace("/", "-"))
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value, True


def _literal(s: SeriesFrame, value) -> Column:
    return F.lit(value).cast(s.df.schema[s.time].dataType) if s.is_datetime else F.lit(value)


def in_range(s: SeriesFrame, arange, time: Column | None = None) -> Column:
    """None: every row."""
    if arange is None:
        return F.lit(True)
    t = F.col(s.time) if time is None else time
    lo, hi = arange
    (lo, _), (hi, closed) = _bound(lo, s.is_datetime, False), _bound(hi, s.is_datetime, True)
    return F.coalesce((t >= _literal(s, lo)) & (t <= _literal(s, hi) if closed else t < _literal(s, hi)), F.lit(False))


def prior_in_range(s: SeriesFrame, arange, prior: Column) -> Column:
    """For a row in the range: whether the row before it, of time `prior`, is in it too."""
    return prior.isNotNull() & (in_range(s, arange, prior))


def lower(s: SeriesFrame, arange) -> datetime | float:
    return _bound(arange[0], s.is_datetime, False)[0]


def days(s: SeriesFrame, arange) -> tuple[datetime, datetime]:
    """The first day of a range and the day after its last."""
    lo = _bound(arange[0], True, False)[0]
    hi, closed = _bound(arange[1], True, True)
    hi = hi if closed else hi - timedelta(microseconds=1)
    midnight = lambda t: datetime(t.year, t.month, t.day)
    return midnight(lo), midnight(hi) + timedelta(1)
