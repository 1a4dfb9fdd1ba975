"""Laboratory experiments: slopes, removal, peaks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import RN, SeriesFrame
from .tagging import sure


def hours(s: SeriesFrame, time: str | None = None, to: str = "h") -> SeriesFrame:
    """h = 24 t plus the time of the row before; 0 for the first row."""
    t = F.col(time or s.time)
    s = s.previous(__t=(t, False))
    return s.add(**{to: F.coalesce(t * 24 + F.col("__t"), F.lit(0.0))}).drop("__t")


def add_conc(s: SeriesFrame, c: str, x: float, y: float, new_name: str = "default") -> SeriesFrame:
    """Column times x times y, in '<column> mg/L' unless named."""
    return s.add(**{f"{c} mg/L" if new_name == "default" else new_name: F.col(c) * F.lit(float(x)) * F.lit(float(y))})


def check_ph(s: SeriesFrame, ph: str = "pH", thresh: float = 0.4) -> DataFrame:
    """For each series delta_ph (highest less lowest) and whether it is within the threshold."""
    d = F.max(ph) - F.min(ph)
    return s.df.groupBy(s.key).agg(d.alias("delta_ph"), sure(d <= thresh).alias("stable"))


def warn_of_ph(s: SeriesFrame, ph: str = "pH", thresh: float = 0.4) -> None:
    """Warns if any series' pH moved by more than the threshold. Runs a job."""
    if check_ph(s, ph, thresh).where("not stable").limit(1).count():
        warnings.warn(f"the change of {ph} is over {thresh}", stacklevel=2)


def _ends(s: SeriesFrame, columns: tuple[str, ...]) -> DataFrame:
    at = F.struct(s.time, s.seq)
    ends = [f(F.struct(*columns), at).alias(n) for n, f in (("first", F.min_by), ("last", F.max_by))]
    return s.df.groupBy(s.key).agg(*ends).select(s.key, *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for c in columns for e in ("first", "last")])


def in_out(s: SeriesFrame, *columns: str) -> DataFrame:
    """Sum of the first values less sum of the last ones."""
    e = _ends(s, columns)
    return e.select(s.key, (sum(F.col(f"first_{c}") for c in columns) - sum(F.col(f"last_{c}") for c in columns)).alias("in_out"))


def removal(s: SeriesFrame, *columns: str) -> DataFrame:
    """1 less the share of the first values' sum that is left in the last ones."""
    e = _ends(s, columns)
    return e.select(s.key, (1 - F.try_divide(sum(F.col(f"last_{c}") for c in columns), sum(F.col(f"first_{c}") for c in columns))).alias("removal"))


def calc_slope(s: SeriesFrame, *columns: str, time: str = "h") -> SeriesFrame:
    """'<column> slope': fall since the row before over the time since then; positive when falling."""
    s = s.previous(__t=(F.col(time), False), **{f"__p{i}": (F.col(c), False) for i, c in enumerate(columns)})
    new = {f"{c} slope": F.try_divide(F.col(f"__p{i}") - F.col(c), F.col(time) - F.col("__t")) for i, c in enumerate(columns)}
    return s.add(**new).drop("__t", *[f"__p{i}" for i in range(len(columns))])


def drop_peaks(s: SeriesFrame, c: str, cutoff: float) -> SeriesFrame:
    """Without rows whose absolute value is over the cutoff; rows without a value stay."""
    return s.where(~sure(F.abs(c) > cutoff))


def select_slope(s: SeriesFrame, c: str, down: bool = True) -> SeriesFrame:
    """Each series from its (first) maximum on, or before it. A series without values stays whole when down."""
    s = s.positions()
    top = s.df.where(F.col(c).isNotNull()).groupBy(F.col(s.key).alias("__k")).agg(F.max_by(RN, F.struct(F.col(c), -F.col(RN))).alias("__top"))
    df = s.df.join(top, F.col(s.key).eqNullSafe(F.col("__k")), "left")
    at = F.coalesce("__top", F.lit(1))
    return s.with_df(df.where(F.col(RN) >= at if down else F.col(RN) < at).drop("__k", "__top")).done()
