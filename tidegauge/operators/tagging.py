"""Validation: operators that write <c>__valid. Data are never deleted; a point is tagged `filtered` or `original`."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.ranges import in_range, prior_in_range
from ..functions.timeconv import per_unit
from ..plans.series import FILTERED, ORIGINAL, SeriesFrame, valid
from .smoothing import moving_average


def tag_of(s: SeriesFrame, c: str, clear: bool = False) -> Column:
    """The present tag of a column's points; untagged and cleared columns are original."""
    return F.col(valid(c)) if valid(c) in s.df.columns and not clear else F.lit(ORIGINAL)


def sure(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def _tag(condition: Column, otherwise: Column | str = ORIGINAL) -> Column:
    return F.when(condition, FILTERED).otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def add_valid(s: SeriesFrame, *columns: str) -> SeriesFrame:
    """Tag columns for these measurements, all original; those that exist stay."""
    return s.add(**{valid(c): F.lit(ORIGINAL) for c in columns if valid(c) not in s.df.columns})


def reset_valid(s: SeriesFrame, column: str | None = None) -> SeriesFrame:
    """All tag columns dropped, or one of them original again."""
    if column is not None:
        return s.add(**{valid(column): F.lit(ORIGINAL)})
    return s.drop(*[c for c in s.df.columns if c.endswith("__valid")])


def tag_nan(s: SeriesFrame, c: str, arange=None, clear: bool = False, preserve_tags: bool = False) -> SeriesFrame:
    """Missing values are filtered. All others in the range become original, whatever they were; with preserve_tags
    they keep their tags."""
    before = tag_of(s, c, clear)
    rest = before if preserve_tags else F.lit(ORIGINAL)
    new = _tag(F.col(c).isNull(), rest)
    return s.add(**{valid(c): new if arange is None else F.when(in_range(s, arange), new).otherwise(before)})


def tag_doubles(s: SeriesFrame, c: str, bound: float, arange=None, clear: bool = False, final: bool = False, tag_first: bool = True) -> SeriesFrame:
    """A point that differs from the last known value by less than the bound is filtered (a stuck sensor). Missing
    values are passed over and not tagged. The first known value has no predecessor and is tagged, unless tag_first
    is false."""
    s = s.previous(__prev=(F.col(c), True))
    far = sure(F.abs(F.col(c) - F.col("__prev")) >= bound)
    if not tag_first:
        far = far | F.col("__prev").isNull()
    keep = F.col(c).isNull() | far | ~in_range(s, arange)
    s = s.add(**{valid(c): _tag(~keep, tag_of(s, c, clear))}).drop("__prev")
    return blank(s, c) if final else s


def tag_extremes(s: SeriesFrame, c: str, arange=None, limit: float = 0, method: str = "below", clear: bool = False) -> SeriesFrame:
    """Values strictly below or above the limit are filtered, and those that were stay so."""
    if method not in ("below", "above"):
        raise ValueError(f"method is below or above, not {method!r}")
    before = tag_of(s, c, clear)
    out = sure(F.col(c) < limit if method == "below" else F.col(c) > limit)
    new = _tag(out | sure(before == FILTERED))
    return s.add(**{valid(c): new if arange is None else F.when(in_range(s, arange), new).otherwise(before)})


def slope(s: SeriesFrame, y: str, x: str | None, unit: str | None, true_elapsed: bool, prev_x: Column, prev_y: Column) -> Column:
    """Change of y over change of x from the row before; null if either value is missing. Steps in time count whole
    seconds, and in units below a day only those within the day, unless true_elapsed. A step of zero gives an
    infinite slope, or none if y is the same."""
    x = x or s.time
    if x == s.time and s.is_datetime:
        if unit is None:
            raise TypeError("slopes over time stamps need a time unit: sec, min, hr or d")
        k = per_unit(unit)
        step = F.floor((s.micros() - s.micros(prev_x)) / 1e6)
        step = (step if true_elapsed or k == 86_400 else F.pmod(step, F.lit(86_400))) / k
    else:
        step = F.col(x).cast("double") - prev_x.cast("double")
    rise = F.col(y) - prev_y
    return F.when(step == 0, F.when(rise != 0, F.signum(rise) * float("inf"))).otherwise(F.try_divide(rise, step))


def slopes(s: SeriesFrame, y: str, x: str | None = None, time_unit: str | None = None, true_elapsed: bool = False, to: str | None = None) -> SeriesFrame:
    """Adds the slope at each row in column `to`."""
    s = s.previous(__x=(F.col(x or s.time), False), __y=(F.col(y), False))
    return s.add(**{to or f"{y}_slope": slope(s, y, x, time_unit, true_elapsed, F.col("__x"), F.col("__y"))}).drop("__x", "__y")


def moving_slope_filter(s: SeriesFrame, c: str, cutoff: float, arange, x: str | None = None, time_unit: str | None = None, clear: bool = False, final: bool = False, strict_range: bool = False, true_elapsed: bool = False) -> SeriesFrame:
    """Points whose slope within the range is steeper than the cutoff are filtered, as are missing values and earlier
    filtered points; everything outside the range is filtered too, unless strict_range. A point that is blanked makes
    no new slope, so one pass is all there is."""
    s = s.previous(__x=(F.col(x or s.time), False), __y=(F.col(c), False), __t=(F.col(s.time), False))
    steep = prior_in_range(s, arange, F.col("__t")) & sure(F.abs(slope(s, c, x, time_unit, true_elapsed, F.col("__x"), F.col("__y"))) > cutoff)
    return _after_moving(s, c, ~steep, arange, clear, final, strict_range).drop("__x", "__y", "__t")


def moving_average_filter(s: SeriesFrame, c: str, window: int, cutoff_frac: float, arange, clear: bool = False, final: bool = False, strict_range: bool = False) -> SeriesFrame:
    """A point stays if it is within a fraction of the centred moving average; without an average (at the ends), a
    value, or with an average of zero it is filtered. Outside the range as for the slope filter."""
    s = moving_average(s, c, window, to="__smooth")
    near = sure(F.try_divide(F.abs(F.col("__smooth") - F.col(c)), F.col("__smooth")) < cutoff_frac)
    return _after_moving(s, c, near, arange, clear, final, strict_range).drop("__smooth")


def _after_moving(s: SeriesFrame, c: str, keep: Column, arange, clear: bool, final: bool, strict_range: bool) -> SeriesFrame:
    before, inside = tag_of(s, c, clear), in_range(s, arange)
    new = _tag(~keep | F.col(c).isNull() | sure(before == FILTERED))
    outside = before if strict_range else F.lit(FILTERED)
    s = s.add(**{valid(c): F.when(inside, new).otherwise(outside)})
    return blank(s, c) if final else s


def blank(s: SeriesFrame, c: str) -> SeriesFrame:
    """Values of points that aren't original become null."""
    return s.add(**{c: F.when(F.col(valid(c)) == ORIGINAL, F.col(c))})


def get_highs(s: SeriesFrame, c: str, bound_value: float, arange, method: str = "percentile") -> SeriesFrame:
    """Column highs: 1 in the range where the value is above the bound, which is a value, or the quantile of the
    range's values (exact, linear between ranks); 0 elsewhere. Earlier flags are lost."""
    inside = in_range(s, arange)
    if method == "value":
        return s.add(highs=(inside & sure(F.col(c) > bound_value)).cast("int"))
    if method != "percentile":
        raise ValueError(f"method is percentile or value, not {method!r}")
    bound = quantiles(s.where(inside), c, bound_value).withColumnsRenamed({s.key: "__k", "quantile": "__bound"})
    df = s.df.join(bound, F.col(s.key).eqNullSafe(F.col("__k")), "left")
    return s.with_df(df.withColumn("highs", (inside & sure(F.col(c) > F.col("__bound"))).cast("int")).drop("__k", "__bound"))


def quantiles(s: SeriesFrame, c: str, p: float):
    """For each series the exact quantile of a column, linear between ranks. Long series (chunk_rows) are sorted over
    partitions by value, and their two values next to the rank are picked; others are gathered in a buffer each."""
    if not s.chunk_rows:
        return s.df.groupBy(s.key).agg(F.percentile(c, F.lit(p)).alias("quantile"))
    ranged = s.df.select(F.col(s.key).alias("k"), F.col(c).cast("double").alias("v")).where("v is not null").repartitionByRange("k", "v").sortWithinPartitions("k", "v")
    ranged = s.with_df(ranged.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id()})).cut().df
    parts = ranged.groupBy("k", "part").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    by = Window.partitionBy("k")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("k").alias("k2"), F.col("part").alias("part2"), (before - F.col("first")).alias("shift"), (F.lit(float(p)) * (F.sum("n").over(by) - 1)).alias("at"))
    ranked = ranged.join(parts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("part2"))).withColumn("rank", F.col("i") + F.col("shift"))
    at, lo, hi = F.col("at"), F.floor("at"), F.ceil("at")
    near = ranked.where((F.col("rank") == lo) | (F.col("rank") == hi)).groupBy("k").agg(F.max("at").alias("at"), F.min("v").alias("a"), F.max("v").alias("b"))
    return near.select(F.col("k").alias(s.key), F.when(lo == hi, F.col("a")).otherwise((hi - at) * F.col("a") + (at - lo) * F.col("b")).alias("quantile"))


def percent_left(s: SeriesFrame, c: str):
    """For each series the percentage of tagged points that are original."""
    return s.df.groupBy(s.key).agg((F.count_if(F.col(valid(c)) == ORIGINAL) * 100 / F.count(valid(c))).alias("percent_left"))
