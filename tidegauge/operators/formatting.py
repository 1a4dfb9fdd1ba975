"""Formatting: time axes, duplicates, casts, derived columns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timeconv import pattern, per_unit
from ..plans.series import RN, SeriesFrame, filled


def head(s: SeriesFrame, n: int = 5) -> DataFrame:
    return s.df.orderBy(s.time, s.seq).limit(n)


def tail(s: SeriesFrame, n: int = 5) -> DataFrame:
    return s.df.orderBy(F.desc(s.time), F.desc(s.seq)).limit(n).orderBy(s.time, s.seq)


def replace_value(df: DataFrame, old, new) -> DataFrame:
    """Exact matches in all columns of the value's kind."""
    if new is None or isinstance(old, str):
        return df.withColumns({f.name: F.when(F.col(f.name) == old, F.lit(new)).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType) == isinstance(old, str)})
    return df.replace(old, new)


def to_float(df: DataFrame, *columns: str, lenient: bool = False) -> DataFrame:
    """Casts to double; text that is no number is an error, or null if lenient. NaN becomes null."""
    columns = columns or tuple(f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType)))
    cast = lambda c: F.col(c).try_cast("double") if lenient else F.col(c).cast("double")
    return df.withColumns({c: F.when(~F.isnan(cast(c)), cast(c)) for c in columns})


def to_datetime(df: DataFrame, c: str, time_format: str | None = None, unit: str = "D") -> DataFrame:
    """Text by a strptime format, or numbers in a unit since 1970, as time stamps without zone."""
    if isinstance(df.schema[c].dataType, T.StringType):
        if not time_format:
            raise ValueError("text needs a time format such as %d-%m-%y %H:%M")
        return df.withColumn(c, F.to_timestamp(F.col(c), pattern(time_format)).cast("timestamp_ntz"))
    return df.withColumn(c, F.timestamp_micros((F.col(c).cast("double") * per_unit(unit) * 1e6).cast("long")).cast("timestamp_ntz"))


def set_index(s: SeriesFrame, c: str, drop: bool = True, verify_integrity: bool = False) -> SeriesFrame:
    """Another column as the time axis; the former one stays as prev_index. verify_integrity runs a job."""
    if c == s.time:
        raise ValueError(f"{c} is the time axis already")
    if isinstance(s.df.schema[c].dataType, T.StringType):
        raise TypeError("a time axis can't be text; parse it first (to_datetime)")
    if verify_integrity and s.df.groupBy(s.key, c).count().where("count > 1").limit(1).count():
        raise ValueError(f"{c} has values more than once")
    df = s.df.withColumnRenamed(s.time, "prev_index")
    df = df if drop else df.withColumn(f"{c}_data", F.col(c))
    return replace(s, df=df, time=c)


def relative_time(s: SeriesFrame, unit: str = "d", decimals: int = 5, inplace: bool = True, save_abs: bool = True, start=None) -> SeriesFrame:
    """Time since the series' first row (or `start`), rounded half to even. inplace: it becomes the time axis and the
    former one is time_abs if save_abs; else it is the column time_rel."""
    if start is None:
        first = s.df.groupBy(F.col(s.key).alias("__k")).agg(F.min(s.time).alias("__first"))
        s = s.with_df(s.df.join(first, F.col(s.key).eqNullSafe(F.col("__k"))).drop("__k"))
    else:
        s = s.add(__first=F.lit(start).cast(s.df.schema[s.time].dataType))
    rel = F.bround((s.micros() - s.micros(F.col("__first"))) / (1e6 * per_unit(unit)), decimals) if s.is_datetime else F.bround(F.col(s.time) - F.col("__first"), decimals)
    s = s.add(time_rel=rel).drop("__first")
    if not inplace:
        return s
    df = s.df.withColumnRenamed(s.time, "time_abs") if save_abs else s.df.drop(s.time)
    return replace(s, df=df.withColumnRenamed("time_rel", s.time), time_unit=unit)


#: Steps of a regular axis that one row makes, at most.
SPINE_ROWS = 10_000


def _steps(ends: DataFrame, n: Column) -> DataFrame:
    """ends with a row for each of n steps (__i from 0), made in blocks that are dealt over tasks."""
    blocks = ends.withColumn("__n", n.cast("long")).where("__n > 0").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / SPINE_ROWS))))
    first = F.col("__b") * SPINE_ROWS
    return blocks.repartition("__k", "__b").withColumn("__i", F.explode(F.sequence(first, F.least(first + SPINE_ROWS, F.col("__n")) - 1))).drop("__b", "__n")


def fill_index(s: SeriesFrame, arange, keep_existing: bool = False) -> SeriesFrame:
    """A regular axis on [lo, hi) with the step from the first time to the next one; on a numeric axis the range over the
    rows of its first unit. Rows inside lose their values unless keep_existing; the row at hi itself goes too. A series of
    one moment has no step, and no rows in the range then."""
    from ..functions.ranges import _bound, _literal

    lo, hi = (_literal(s, _bound(b, s.is_datetime, False)[0]) for b in arange)
    t = F.col(s.time)
    first = s.df.groupBy(F.col(s.key).alias("__k")).agg(F.min(s.time).alias("__t0"))
    joined = s.df.select(s.key, s.time).join(first, F.col(s.key).eqNullSafe(F.col("__k")))
    if s.is_datetime:
        step = joined.where(t > F.col("__t0")).groupBy("__k").agg((F.min(s.micros()) - F.min(s.micros(F.col("__t0")))).alias("__step"))
        lo_n, hi_n = (F.unix_micros(x.cast("timestamp")) for x in (lo, hi))
        spine = _steps(step, F.ceil((hi_n - lo_n) / F.col("__step"))).select("__k", F.timestamp_micros(lo_n + F.col("__i") * F.col("__step")).cast(s.df.schema[s.time].dataType).alias("__t"))
    else:
        n = joined.where(t < F.col("__t0") + 1).groupBy("__k").agg(F.count("*").alias("__rows"))
        spine = _steps(n, F.col("__rows")).select("__k", (lo + F.col("__i") * ((hi - lo) / F.col("__rows"))).alias("__t"))
    outer = s.df.where((t < lo) | (t > hi))
    names = [c for c in s.df.columns if c not in (s.key, s.time)]
    if keep_existing:
        inner = spine.join(s.df, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col("__t") == t), "left").select(F.col("__k").alias(s.key), F.col("__t").alias(s.time), *names)
    else:
        inner = spine.select(F.col("__k").alias(s.key), F.col("__t").alias(s.time), *[F.lit(None).cast(s.df.schema[c].dataType).alias(c) for c in names])
    inner = inner.withColumn(s.seq, F.coalesce(s.seq, F.lit(0).cast(s.df.schema[s.seq].dataType)))
    return s.with_df(outer.unionByName(inner))


def drop_duplicates(s: SeriesFrame, how: str = "first_row") -> SeriesFrame:
    """One row for each time: the first whole row, or for each column its first value that isn't missing."""
    if how == "first_row":
        w = Window.partitionBy(s.key, s.time).orderBy(s.seq)
        return s.with_df(s.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))
    if how != "first_nonnull":
        raise ValueError(f"how is first_row or first_nonnull, not {how!r}")
    rest = [c for c in s.df.columns if c not in (s.key, s.time, s.seq)]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(s.seq))).alias(c)
    return s.with_df(s.df.groupBy(s.key, s.time).agg(F.min(s.seq).alias(s.seq), *map(first, rest)).select(s.df.columns))


def total_proportional(s: SeriesFrame, total: str, flows: list[str], concentrations: list[str], new_name: str = "new", unit: str = "mg/l", use_filled: bool = False) -> SeriesFrame:
    """Flow-weighted mean concentration: the sum of flow times concentration over the total flow. Missing if any part
    is, or if the total is zero."""
    if len(flows) != len(concentrations):
        raise ValueError("as many flows as concentrations are needed")
    c: Column = lambda n: F.col(filled(n) if use_filled else n)
    load = sum((c(q) * c(x) for q, x in zip(flows, concentrations)), F.lit(0.0))
    out = s.add(**{filled(new_name) if use_filled else new_name: F.try_divide(load, c(total))})
    return replace(out, units={**s.units, new_name: unit})


def split_by(df: DataFrame, c: str) -> dict[object, DataFrame]:
    """A table for each value of a column, without it. To process series, keep them together as a key instead; this
    collects the distinct values."""
    return {r[0]: df.where(F.col(c).eqNullSafe(F.lit(r[0]))).drop(c) for r in df.select(c).distinct().orderBy(c).collect()}


def reindex_times(s: SeriesFrame, others: DataFrame) -> SeriesFrame:
    """The series at the times of another table (key and time), rows without data included; their tags are !!."""
    times = others.select(F.col(s.key).alias("__k"), F.col(s.time).alias("__t")).distinct()
    both = times.join(s.df, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col(s.time) == F.col("__t")), "left")
    names = [c for c in s.df.columns if c not in (s.key, s.time)]
    new = {c: F.coalesce(c, F.lit("!!")) for c in names if c.endswith(("__valid", "__fillmeta"))} | {s.seq: F.coalesce(s.seq, F.lit(0).cast(s.df.schema[s.seq].dataType))}
    return s.with_df(both.select(F.col("__k").alias(s.key), F.col("__t").alias(s.time), *[new.get(c, F.col(c)).alias(c) for c in names]))
