"""Gap filling: operators that write <c>__filled and <c>__fillmeta, the origin of each value.

Every filler starts alike: provenance is created from the tags, or refreshed where it is still original; filled
values start as the original points. Fillers build on each other through the provenance: most fill what is still
`filtered`. clear resets provenance to the tags and keeps filled values, or with clear="all" drops these too.
"""

from __future__ import annotations

import warnings
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import in_range, lower
from ..functions.timeconv import per_unit
from ..plans.scratch import Scratch
from ..plans.series import FILTERED, ORIGINAL, RN, SeriesFrame, filled, fillmeta, valid
from .stats import correlation, daily_profile, runs, tod
from .tagging import add_valid, sure

#: Provenance of each filler.
TAGS = {"interpolation": "filled_interpol", "ratio": "filled_ratio", "correlation": "filled_correlation", "standard": "filled_average_profile", "model": "filled_infl_model", "daybefore": "filled_profile_day_before"}


def reset_fillmeta(s: SeriesFrame, c: str | None = None) -> SeriesFrame:
    """Provenance becomes the tags again."""
    some = [c] if c else [x[: -len("__fillmeta")] for x in s.df.columns if x.endswith("__fillmeta")]
    return s.add(**{fillmeta(x): F.col(valid(x)) for x in some})


def add_filled(s: SeriesFrame, *columns: str) -> SeriesFrame:
    """Filled values, if there are none yet: the original points."""
    s = add_valid(s, *columns)
    return s.add(**{filled(c): F.when(F.col(valid(c)) == ORIGINAL, F.col(c).cast("double")) for c in columns if filled(c) not in s.df.columns})


def add_fillmeta(s: SeriesFrame, c: str) -> SeriesFrame:
    s = add_filled(s, c)
    if fillmeta(c) not in s.df.columns:
        return s.add(**{fillmeta(c): F.col(valid(c))})
    return s.add(**{fillmeta(c): F.when(F.col(fillmeta(c)) == ORIGINAL, F.col(valid(c))).otherwise(F.col(fillmeta(c)))})


def filling_advice(s: SeriesFrame) -> SeriesFrame:
    """Warns once for a series, and those made from it, that small gaps come first."""
    if s.advised:
        return s
    warnings.warn("fill small gaps first and go on to larger ones: later fillers build on what earlier ones gave; this is said once", stacklevel=4)
    return replace(s, advised=True)


def start(s: SeriesFrame, c: str, clear: bool | str = False, arange=None) -> SeriesFrame:
    """What fillers begin with: advice, a look for rain in the range, filled values and their provenance."""
    s = filling_advice(s)
    if arange is not None and s.rain_checks:
        warn_of_rain(s, arange)
    if clear:
        s = add_valid(s, c)
        s = s.drop(filled(c)) if clear == "all" else s
        s = s.add(**{fillmeta(c): F.col(valid(c))})
    return add_fillmeta(s, c)


def _write(s: SeriesFrame, c: str, target: Column, value: Column, how: str, require_value: bool) -> SeriesFrame:
    target = sure(target)
    if require_value:
        target = target & value.isNotNull()
    return s.add(**{filled(c): F.when(target, value).otherwise(F.col(filled(c))), fillmeta(c): F.when(target, F.lit(TAGS[how])).otherwise(F.col(fillmeta(c)))})


def _target(s: SeriesFrame, c: str, arange, only_checked: bool) -> Column:
    inside = in_range(s, arange)
    return inside & sure(F.col(fillmeta(c)) == FILTERED) if only_checked else inside


def fill_interpolation(s: SeriesFrame, c: str, range_: int, arange, clear: bool | str = False, only_targets: bool = False, require_value: bool = False, method: str = "index") -> SeriesFrame:
    """Points still filtered, in runs of filtered tags shorter than range_, get the value on the line between their
    neighbours in time. At most range_ missing values after a known one are filled, so longer gaps get as many values
    too, anywhere in the series, but keep their provenance (only_targets: they stay missing). Leading gaps have no
    value, trailing ones take the last. method: index (line in time), linear (in position), pad, nearest or bfill."""
    s = runs(start(s, c, clear, arange), F.col(valid(c)), arange, "__size")
    target = _target(s, c, arange, True) & sure(F.col("__size") < range_)
    s = s.add(__target=target).add(**{filled(c): F.when(~F.col("__target"), F.col(filled(c)))}).positions()
    x = F.col(RN).cast("double") if method == "linear" else s.micros().cast("double")
    known = F.when(F.col(filled(c)).isNotNull(), F.struct(F.col(filled(c)).alias("v"), x.alias("x"), F.col(RN).alias("n")))
    s = s.previous(__p=(known, True)).following(__f=(known, True))
    p, f = F.col("__p"), F.col("__f")
    if method in ("index", "time", "linear"):
        value = F.when(p.isNull() | f.isNull(), p["v"]).otherwise(p["v"] + (f["v"] - p["v"]) * (x - p["x"]) / (f["x"] - p["x"]))
        reach = F.col(RN) - p["n"] <= range_
    elif method in ("pad", "ffill", "zero"):
        value, reach = p["v"], F.col(RN) - p["n"] <= range_
    elif method in ("bfill", "backfill"):
        value, reach = f["v"], f["n"] - F.col(RN) <= range_
    elif method == "nearest":
        value = F.when(p.isNull() | f.isNull(), F.lit(None).cast("double")).when(x - p["x"] <= f["x"] - x, p["v"]).otherwise(f["v"])
        reach = F.col(RN) - p["n"] <= range_
    else:
        raise ValueError(f"unknown interpolation method {method!r}")
    value = F.when(sure(reach), value)
    if only_targets:
        value = F.when(F.col("__target"), value)
    s = s.add(__value=F.coalesce(F.col(filled(c)), value))
    hit = F.col("__target") & F.col("__value").isNotNull() if require_value else F.col("__target")
    s = s.add(**{filled(c): F.col("__value"), fillmeta(c): F.when(hit, F.lit(TAGS["interpolation"])).otherwise(F.col(fillmeta(c)))})
    return s.drop("__target", "__size", "__p", "__f", "__value").done()


def fill_ratio(s: SeriesFrame, c: str, use: str, ratio: float, arange, only_checked: bool = True, clear: bool | str = False, require_value: bool = False) -> SeriesFrame:
    """Another column's raw value times a ratio."""
    s = start(s, c, clear, arange)
    return _write(s, c, _target(s, c, arange, only_checked), F.col(use) * F.lit(float(ratio)), "ratio", require_value)


def fill_correlation(s: SeriesFrame, c: str, use: str, arange, corr_range, zero_intercept: bool = False, only_checked: bool = True, clear: bool | str = False, require_value: bool = False) -> SeriesFrame:
    """The least-squares line of this column on another, fitted on raw data of corr_range. Targets are the points
    tagged filtered, so what other fillers gave them is replaced."""
    s = start(s, c, clear, arange)
    fit = correlation(s, use, c, corr_range, zero_intercept).select(F.col(s.key).alias("__k"), F.col("slope").alias("__slope"), F.col("intercept").alias("__icpt"))
    s = s.with_df(s.df.join(fit, F.col(s.key).eqNullSafe(F.col("__k")), "left"))
    inside = in_range(s, arange)
    target = inside & sure(F.col(valid(c)) == FILTERED) if only_checked else inside
    return _write(s, c, target, F.col(use) * F.col("__slope") + F.col("__icpt"), "correlation", require_value).drop("__k", "__slope", "__icpt")


def check_keys(profile: DataFrame, wanted: DataFrame) -> None:
    """KeyError if a wanted time of day isn't in the profile. Runs a job."""
    missing = wanted.join(profile.select("tod"), "tod", "left_anti").limit(1).count()
    if missing:
        raise KeyError("the daily profile lacks times of day of the points to fill")


def fill_standard(s: SeriesFrame, c: str, arange, profile: DataFrame | None = None, profile_range=None, only_checked: bool = True, clear: bool | str = False, require_value: bool = False, check: bool = True) -> SeriesFrame:
    """The average day: the profile's mean at the same time of day; on a numeric axis at the nearest one. profile: as
    daily_profile() gives it, else it is made over profile_range. A given one is checked for the times of day of all points
    to fill, which runs a job, unless check is False."""
    s = start(s, c, clear, arange)
    if profile is None:
        check = False
        if profile_range is None:
            raise ValueError("fill_standard needs a profile or a range to make one over")
        profile = daily_profile(s, c, profile_range)
    if not isinstance(profile, DataFrame) or not {s.key, "tod", "avg"} <= set(profile.columns):
        raise TypeError("a profile is a table as daily_profile() gives it")
    s = s.add(__tod=tod(s), __target=_target(s, c, arange, only_checked))
    some = profile.select(F.col(s.key).alias("__k"), F.col("tod").alias("__at"), F.col("avg").alias("__avg"))
    if s.is_datetime:
        if check:
            check_keys(profile, s.df.where("__target").select(F.col("__tod").alias("tod")))
        df = s.df.join(some, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col("__tod") == F.col("__at")), "left")
        s = s.with_df(df.drop("__k", "__at"))
    else:
        s = nearest(s, some, F.col("__tod"), "__k", "__at", "__avg", 1.0)
    return _write(s, c, F.col("__target"), F.col("__avg"), "standard", require_value).drop("__tod", "__target", "__avg")


def nearest(s: SeriesFrame, other: DataFrame, at: Column, other_key: str | None, other_at: str, value: str, width: float) -> SeriesFrame:
    """Adds to each row the value of the other table's row (of its series, or of all) nearest to `at`; of two equally
    near ones the earlier. Both tables are sorted together once and each row looks back and ahead. If the other table
    is for all series, rows are dealt over slices of `width` (a day or a unit in the axis' units), with chunk_rows over
    ranges of series and time; each slice is told the neighbours that lie before and after it."""
    names = s.df.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names])
    left = s.df.select((F.col(s.key) if other_key else F.lit(0)).alias("k"), at.cast("double").alias("at"), F.lit(1).alias("side"), row.alias("row"), F.lit(None).cast("double").alias("v"))
    right = other.where(F.col(other_at).isNotNull() & F.col(value).isNotNull())
    right = right.select((F.col(other_key) if other_key else F.lit(0)).alias("k"), F.col(other_at).cast("double").alias("at"), F.col(value).cast("double").alias("v"))
    right = right.groupBy("k", "at").agg(F.min("v").alias("v")).withColumns({"side": F.lit(0), "row": F.lit(None).cast(left.schema["row"].dataType)})
    both = left.unionByName(right)
    point = F.when(F.col("side") == 0, F.struct("at", "v"))
    if s.chunk_rows or not other_key:
        if s.chunk_rows:  # ranges of (series, time) by a sample, written so that they stay as they are
            scratch = Scratch(s.df.sparkSession, "nearest")
            rows = scratch.save(both, "rows")
            both = scratch.save(rows.repartitionByRange("k", "at", "side").withColumn("slice", F.spark_partition_id()), "dealt")
            scratch.drop("rows")
        else:
            both = both.withColumn("slice", F.coalesce(F.floor(F.col("at") / width), F.lit(0)))
        ends = both.groupBy(F.col("k").alias("__k"), F.col("slice").alias("__s")).agg(F.max(F.when(F.col("side") == 0, F.struct("at", "v"))).alias("hi"), F.min(F.when(F.col("side") == 0, F.struct("at", "v"))).alias("lo"))
        w = Window.partitionBy("__k").orderBy("__s")
        ends = ends.select("__k", "__s", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("far_p"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("far_f"))
        both, part = both.join(ends, F.col("k").eqNullSafe(F.col("__k")) & (F.col("slice") == F.col("__s"))), ["k", "slice"]
    else:
        both, part = both.withColumns({"far_p": F.lit(None).cast("struct<at: double, v: double>"), "far_f": F.lit(None).cast("struct<at: double, v: double>")}), ["k"]
    back = Window.partitionBy(*part).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*part).orderBy("at", "side").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"p": F.coalesce(F.last(point, True).over(back), "far_p"), "f": F.coalesce(F.first(point, True).over(ahead), "far_f")}).where("side = 1")
    p, f = F.col("p"), F.col("f")
    near = F.when(f.isNull() | (F.col("at") - p["at"] <= f["at"] - F.col("at")), p["v"]).otherwise(f["v"])
    return s.with_df(both.select("row.*", F.when(F.col("at").isNull(), F.lit(None)).when(p.isNull(), f["v"]).otherwise(near).alias(value)))


def fill_model(s: SeriesFrame, c: str, model: DataFrame, arange, model_time: str = "time", model_value: str = "value", only_checked: bool = True, unit: str = "d", clear: bool | str = False, require_value: bool = False) -> SeriesFrame:
    """The value of an external model at its nearest time. If the axes differ in kind, a time stamp becomes the time
    since the first one of the data in `unit`, rounded to five places. Untouched rows don't go through the search."""
    s = start(s, c, clear, arange)
    stamped = not str(model.schema[model_time].dataType).startswith(("Double", "Float", "Integer", "Long", "Short", "Decimal"))
    s = s.add(__target=_target(s, c, arange, only_checked))
    if s.is_datetime and not stamped:
        first = s.df.groupBy(F.col(s.key).alias("__k")).agg(F.min(s.time).alias("__first"))
        s = s.with_df(s.df.join(first, F.col(s.key).eqNullSafe(F.col("__k"))).drop("__k"))
        at, width = F.bround((s.micros() - s.micros(F.col("__first"))) / (1e6 * per_unit(unit)), 5), 86_400 / per_unit(unit)
        some = model.select(F.col(model_time).cast("double").alias("__at"), F.col(model_value).alias("__model"))
    else:
        s = s.add(__first=F.lit(None))
        at, width = s.micros(), 86_400e6 if s.is_datetime else 1.0
        some = model.select((F.unix_micros(F.col(model_time).cast("timestamp")) if stamped else F.col(model_time)).alias("__at"), F.col(model_value).alias("__model"))
    hit = nearest(s.where(F.col("__target")), some, at, None, "__at", "__model", width)
    hit = _write(hit, c, F.lit(True), F.col("__model"), "model", require_value)
    rest = s.where(~F.col("__target"))
    return s.with_df(rest.df.unionByName(hit.df.drop("__model"))).drop("__target", "__first")


def fill_daybefore(s: SeriesFrame, c: str, arange, range_to_replace=(1, 4), only_checked: bool = True, clear: bool | str = False, require_value: bool = False) -> SeriesFrame:
    """The filled value at the same time of the day before the range. Runs of filtered points are filled that are
    longer than range_to_replace[0] and shorter than range_to_replace[1] days, in rows of that day; if nothing in the
    range is tagged filtered, the length doesn't matter."""
    s = start(s, c, clear, arange)
    lo = lower(s, arange)
    back = lo - timedelta(1) if isinstance(lo, datetime) else lo - 1
    day = s.df.where(in_range(s, (back, lo)))
    source = day.select(F.col(s.key).alias("__k"), tod(s).alias("__at"), F.col(filled(c)).alias("__v"), s.time, s.seq)
    source = source.groupBy("__k", "__at").agg(F.min_by(F.struct("__v"), F.struct(s.time, s.seq)).alias("__s")).select("__k", "__at", F.col("__s.__v").alias("__before"))
    s = runs(s, F.col(valid(c)), arange, "__size")
    scalars = s.df.groupBy(F.col(s.key).alias("__k2")).agg(F.count_if(in_range(s, (back, lo))).alias("__rows"), F.count_if(in_range(s, arange) & sure(F.col(valid(c)) == FILTERED)).alias("__hits"))
    df = s.df.withColumn("__tod", tod(s)).join(scalars, F.col(s.key).eqNullSafe(F.col("__k2"))).drop("__k2")
    df = df.join(source, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col("__tod") == F.col("__at")), "left")
    s = s.with_df(df)
    length = (F.col("__size") > range_to_replace[0] * F.col("__rows")) & (F.col("__size") < range_to_replace[1] * F.col("__rows"))
    target = _target(s, c, arange, only_checked) & (sure(length) | (F.col("__hits") == 0))
    return _write(s, c, target, F.col("__before"), "daybefore", require_value).drop("__size", "__rows", "__hits", "__tod", "__k", "__at", "__before")


def warn_of_rain(s: SeriesFrame, arange) -> bool:
    """Warns, for treatment-plant data, of a range with more than one high. Runs a job."""
    if s.data_type != "WWTP" or "highs" not in s.df.columns:
        return False
    many = (s.df.where(in_range(s, arange)).agg(F.sum("highs")).first()[0] or 0) > 1
    if many:
        warnings.warn("the range has high values (rain); the fill may be unreliable there", stacklevel=2)
    return many


#: By name, for reliability checks.
FILLERS = {"fill_interpolation": fill_interpolation, "fill_ratio": fill_ratio, "fill_correlation": fill_correlation, "fill_standard": fill_standard, "fill_model": fill_model, "fill_daybefore": fill_daybefore}

__all__ = ["FILLERS", "TAGS", "add_filled", "add_fillmeta", "fill_correlation", "fill_daybefore", "fill_interpolation", "fill_model", "fill_ratio", "fill_standard", "filling_advice", "nearest", "reset_fillmeta", "start", "warn_of_rain"]
