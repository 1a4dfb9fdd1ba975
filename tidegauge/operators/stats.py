"""Aggregates: averages, ratios, correlations, daily values."""

from __future__ import annotations

import math
from functools import lru_cache, reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import days, in_range
from ..functions.timeconv import DAY, micros_of_day
from ..plans.scratch import Scratch
from ..plans.series import FILTERED, ORIGINAL, SeriesFrame, valid


def checked(s: SeriesFrame, c: str) -> Column:
    """The value of points that aren't filtered."""
    return F.when(F.col(valid(c)) != FILTERED, F.col(c)) if valid(c) in s.df.columns else F.col(c)


def averages(s: SeriesFrame, *columns: str, only_checked: bool = True) -> DataFrame:
    """For each series the mean of each column, in a column of its name."""
    columns = columns or tuple(s.columns)
    return s.df.groupBy(s.key).agg(*[F.avg(checked(s, c) if only_checked else F.col(c)).alias(c) for c in columns])


def deviations(s: SeriesFrame, *columns: str, only_checked: bool = True) -> DataFrame:
    """For each series the sample standard deviation of each column; of one value there is none."""
    columns = columns or tuple(s.columns)
    return s.df.groupBy(s.key).agg(*[F.stddev_samp(checked(s, c) if only_checked else F.col(c)).alias(c) for c in columns])


def _both_original(s: SeriesFrame, a: str, b: str) -> Column:
    return (F.col(valid(a)) == ORIGINAL) & (F.col(valid(b)) == ORIGINAL)


def _pairs(s: SeriesFrame, a: str, b: str, arange, only_checked: bool) -> DataFrame:
    rows = s.df.where(in_range(s, arange))
    return rows.where(_both_original(s, a, b)) if only_checked else rows


def _ratio(a: str, b: str) -> Column:
    """a / b; a positive value over zero counts as missing, a negative one as minus infinity."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.when(y == 0, F.when(x < 0, F.lit(float("-inf")))).otherwise(x / F.nullif(y, F.lit(0.0)))


def calc_ratio(s: SeriesFrame, a: str, b: str, arange, only_checked: bool = False) -> DataFrame:
    """For each series mean and sample standard deviation of a / b in the range."""
    r = _pairs(s, a, b, arange, only_checked).withColumn("__r", _ratio(a, b))
    return r.groupBy(s.key).agg(F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("std"))


def compare_ratio(s: SeriesFrame, a: str, b: str, length: int, only_checked: bool = False) -> DataFrame:
    """Of consecutive windows of `length` days from the series' start, or on a numeric axis windows of that length
    moved by one, the one where the ratio a / b varies least for its mean: (start, mean, std). Both ends of a window
    belong to it, and only windows within the data count."""
    t = F.expr(f"unix_micros(CAST({s.time} AS TIMESTAMP)) / {DAY}D") if s.is_datetime else F.col(s.time).cast("double")
    rows = s.df.withColumn("__t", t)
    span = rows.groupBy(F.col(s.key).alias("__k")).agg(F.min("__t").alias("__t0"), F.max("__t").alias("__t1"))
    step = length if s.is_datetime else 1
    whole = F.floor(F.col("__t1") - F.col("__t0")) if s.is_datetime else F.col("__t1") - F.col("__t0")
    last = F.floor((whole - length) / step)  # of the windows, from 0
    rows = rows.where(_both_original(s, a, b)) if only_checked else rows
    rows = rows.join(span, F.col(s.key).eqNullSafe(F.col("__k"))).withColumn("__r", _ratio(a, b)).withColumn("__at", F.col("__t") - F.col("__t0"))
    lo = F.greatest(F.ceil((F.col("__at") - length) / step), F.lit(0))
    hi = F.least(F.floor(F.col("__at") / step), last)
    rows = rows.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi)))
    each = rows.groupBy(s.key, "window").agg(F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("std"))
    each = each.withColumn("__rel", F.try_divide("std", "mean")).where("__rel is not null")
    return each.groupBy(s.key).agg(F.min_by(F.struct("window", "mean", "std"), F.struct("__rel", "window")).alias("b")).select(s.key, "b.*")


def correlation(s: SeriesFrame, a: str, b: str, arange, zero_intercept: bool = False, only_checked: bool = False) -> DataFrame:
    """Least squares of b on a, for each series: slope, intercept, r_squared (uncentred without intercept), n and the
    sums that prediction intervals need."""
    rows = _pairs(s, a, b, arange, only_checked).select(s.key, F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).where("x is not null and y is not null")
    common = [F.count("*").alias("n"), F.avg("x").alias("mean_x"), F.regr_sxx("y", "x").alias("sxx"), F.sum(F.col("x") * F.col("x")).alias("sum_xx")]
    xy, xx, yy = (F.sum(F.col(p) * F.col(q)) for p, q in ("xy", "xx", "yy"))
    if zero_intercept:
        fit = [F.try_divide(xy, xx).alias("slope"), F.lit(0.0).alias("intercept"), F.try_divide(xy * xy, xx * yy).alias("r_squared"), (yy - F.try_divide(xy * xy, xx)).alias("sse")]
    else:
        syy, sxy, sxx = F.regr_syy("y", "x"), F.regr_sxy("y", "x"), F.regr_sxx("y", "x")
        fit = [F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"), (syy - F.try_divide(sxy * sxy, sxx)).alias("sse")]
    return rows.groupBy(s.key).agg(*fit, *common)


@lru_cache(None)
def t_quantile(p: float, df: int) -> float:
    """Of Student's distribution, p over a half: by bisection over the angle whose tangent is t / sqrt(df), of which the
    integral is a finite sum."""

    def within(angle: float) -> float:
        """The chance of less than t on either side."""
        sin, cos = math.sin(angle), math.cos(angle)
        term, total = (cos if df % 2 else 1.0), 0.0
        for k in range(2 + df % 2, df + 1, 2):
            total += term
            term *= cos * cos * (k - 1) / k
        return 2 / math.pi * (angle + sin * total) if df % 2 else sin * total

    lo, hi = 0.0, math.pi / 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if within(mid) < 2 * p - 1 else (lo, mid)
    return math.sqrt(df) * math.tan(hi)


def prediction_interval(s: SeriesFrame, a: str, b: str, arange, zero_intercept: bool = False, only_checked: bool = False, level: float = 0.95) -> DataFrame:
    """Each row of the range with fit, lower and upper bound of b; without degrees of freedom no bounds. These differ
    between series: up to 30 of them their quantile is exact, above it comes from an expansion in the normal one."""
    fit = correlation(s, a, b, arange, zero_intercept, only_checked).withColumnRenamed(s.key, "__k")
    f = F.col("n") - (1 if zero_intercept else 2)
    p = (1 + level) / 2
    z = NormalDist().inv_cdf(p)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92_160]
    far = F.lit(z) + g[0] / f + g[1] / (f * f) + g[2] / (f * f * f) + g[3] / (f * f * f * f)
    few = F.array(*[F.lit(t_quantile(p, i)) for i in range(1, 31)])
    t = F.when(f > 30, far).when(f > 0, F.element_at(few, F.greatest(F.least(f, F.lit(30)), F.lit(1)).cast("int")))
    x = F.col(a).cast("double")
    spread = 1 + F.try_divide(x * x, F.col("sum_xx")) if zero_intercept else 1 + 1 / F.col("n") + F.try_divide((x - F.col("mean_x")) * (x - F.col("mean_x")), F.col("sxx"))
    rows = _pairs(s, a, b, arange, only_checked).join(fit, F.col(s.key).eqNullSafe(F.col("__k")))
    half = t * F.sqrt(F.greatest(F.try_divide("sse", f), F.lit(0.0))) * F.sqrt(spread)
    mid = x * F.col("slope") + F.col("intercept")
    return rows.select(s.key, s.time, F.col(a).alias("x"), mid.alias("fit"), (mid - half).alias("lower"), (mid + half).alias("upper"))


def tod(s: SeriesFrame, c: Column | None = None) -> Column:
    """Time of day: microseconds, or on a numeric axis the fraction of the day."""
    c = F.col(s.time) if c is None else c
    return micros_of_day(c) if s.is_datetime else c.cast("double") - F.floor(c)


#: Of percentile_approx: ranks are off by a thousandth of the values, at most; groups of no more values are taken whole.
ACCURACY = 1000


def group_quantiles(rows: DataFrame, keys: list[str], v: str, ps: dict[str, float]) -> DataFrame:
    """(keys, and for each name the exact quantile, on the line between the two values next to its rank), without a buffer
    of a group's values: a first pass brackets each quantile by a sketch, a second one counts what lies below the bracket,
    and the values within it, counted by value before the shuffle, are put in order. Reads rows three times."""
    eps = 4 / ACCURACY
    known = rows.where(F.col(v).isNotNull()).select(*keys, F.col(v).cast("double").alias("__v"))
    ends = F.array(*[F.lit(min(max(x, 0.0), 1.0)) for p in ps.values() for x in (p - eps, p + eps)])
    first = known.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__n"), F.percentile_approx("__v", ends, F.lit(ACCURACY)).alias("__b"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    joined = known.join(first, on).drop(*keys)
    groups, few = [f"__k{i}" for i in range(len(keys))], F.col("__n") <= ACCURACY
    low, high = (lambda i: F.get("__b", F.lit(2 * i))), (lambda i: F.get("__b", F.lit(2 * i + 1)))
    below = joined.groupBy(*groups).agg(*[F.count_if(~few & (F.col("__v") < low(i))).alias(f"__below{i}") for i in range(len(ps))])
    inside = F.array_compact(F.array(*[F.when(few | F.col("__v").between(low(i), high(i)), F.lit(i)) for i in range(len(ps))]))
    some = joined.select(*groups, "__n", F.explode(inside).alias("__i"), "__v").groupBy(*groups, "__n", "__i", "__v").agg(F.count("*").alias("__m"))
    upto = F.sum("__m").over(Window.partitionBy(*groups, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    both = reduce(lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups])
    ranked = some.withColumn("__upto", upto).alias("r").join(below.alias("b"), both).drop(*[F.col(f"b.{g}") for g in groups])
    out = []
    for i, (name, p) in enumerate(ps.items()):
        place = F.lit(p) * (F.col("__n") - 1)
        at = lambda n: F.min(F.when((F.col("__i") == i) & (F.col(f"__below{i}") + F.col("__upto") > n), F.col("__v")))  # noqa: B023, E731
        out += [at(F.floor(place)).alias(f"__lo{i}"), at(F.least(F.floor(place) + 1, F.col("__n") - 1)).alias(f"__hi{i}"), F.max(place - F.floor(place)).alias(f"__part{i}")]
    found = ranked.groupBy(*[F.col(g) for g in groups]).agg(*out)
    line = lambda i: F.col(f"__lo{i}") + F.col(f"__part{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))
    return found.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], *[line(i).alias(name) for i, name in enumerate(ps)])


def daily_profile(s: SeriesFrame, c: str, arange, quantile: float = 0.9, only_checked: bool = False, positional: bool = False) -> DataFrame:
    """For each series and time of day (tod): mean, sample std and the two quantiles over the days of the range, its
    last day whole. only_checked: of original points alone, so neither filtered nor added ones count. positional: by
    position within the day, labelled with the times of the first day."""
    if s.is_datetime:
        lo, hi = days(s, arange)
        t = F.col(s.time)
        rows = s.df.where((t >= F.lit(lo).cast(s.df.schema[s.time].dataType)) & (t < F.lit(hi).cast(s.df.schema[s.time].dataType)))
        day = F.date_trunc("day", t)
    else:
        t = F.col(s.time)
        rows, day = s.df.where((t >= math.floor(arange[0])) & (t < math.floor(arange[1]) + 1)), F.floor(t)
    value = F.when(F.col(valid(c)) == ORIGINAL, F.col(c)) if only_checked and valid(c) in s.df.columns else F.col(c)
    rows = rows.select(s.key, s.time, s.seq, tod(s).alias("tod"), day.alias("__day"), value.cast("double").alias("v"))
    if positional:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(s.key, "__day").orderBy(s.time, s.seq)))
        one = rows.groupBy(F.col(s.key).alias("__k")).agg(F.min("__day").alias("__one"))
        label = F.max(F.when(F.col("__day") == F.col("__one"), F.col("tod"))).over(Window.partitionBy(s.key, "__n"))
        rows = rows.join(one, F.col(s.key).eqNullSafe(F.col("__k"))).withColumn("tod", label).where("tod IS NOT NULL")  # positions that the first day lacks go
    if s.chunk_rows:  # a time of day may have any number of values
        rows = Scratch(s.df.sparkSession, "profile").save(rows.select(s.key, "tod", "v"), "rows")
        means = rows.groupBy(F.col(s.key).alias("__k"), F.col("tod").alias("__t")).agg(F.avg("v").alias("avg"), F.stddev_samp("v").alias("std"))
        q = group_quantiles(rows, [s.key, "tod"], "v", {"q_upper": quantile, "q_lower": 1 - quantile})
        joined = means.join(q, F.col(s.key).eqNullSafe(F.col("__k")) & F.col("tod").eqNullSafe(F.col("__t")), "left")
        return joined.select(F.col("__k").alias(s.key), F.col("__t").alias("tod"), "avg", "std", "q_upper", "q_lower")
    q = lambda p: F.percentile("v", F.lit(p))
    return rows.groupBy(s.key, "tod").agg(F.avg("v").alias("avg"), F.stddev_samp("v").alias("std"), q(quantile).alias("q_upper"), q(1 - quantile).alias("q_lower"))


def daily_average(s: SeriesFrame, c: str, arange=None) -> DataFrame:
    """For each series and day mean and sample std; days without rows between the first and the last have nulls. On a
    numeric axis a day is [x, x + 1] from the first row on, both ends included."""
    rows = s.df.where(in_range(s, arange))
    if s.is_datetime:
        got = rows.groupBy(s.key, F.date_trunc("day", s.time).cast("timestamp_ntz").alias("day")).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
        ends = got.groupBy(F.col(s.key).alias("__k")).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
        spine = ends.select("__k", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("__d"))
        both = spine.join(got, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col("day") == F.col("__d")), "left")
        return both.select(F.col("__k").alias(s.key), F.col("__d").alias("day"), "mean", "std")
    ends = rows.groupBy(F.col(s.key).alias("__k")).agg(F.min(s.time).alias("lo"), F.max(s.time).alias("hi"))
    rows = rows.join(ends, F.col(s.key).eqNullSafe(F.col("__k"))).withColumn("__at", F.col(s.time) - F.col("lo"))
    n = F.greatest(F.floor(F.col("hi") - F.col("lo")), F.lit(1))
    last = F.floor("__at")
    first = F.when((F.col("__at") == last) & (last > 0), last - 1).otherwise(last)
    rows = rows.withColumn("__d", F.explode(F.sequence(first, F.least(last, n - 1)))).where(F.col("__d") >= 0)
    return rows.groupBy(s.key, (F.col("lo") + F.col("__d")).alias("day")).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))


def runs(s: SeriesFrame, tag: Column, arange, to: str = "run_size") -> SeriesFrame:
    """Adds the length of the run of equal tags that a row of the range is in; null outside."""
    s = s.add(__tag=F.when(in_range(s, arange), tag), __in=in_range(s, arange))
    s = s.previous(__pt=(F.col("__tag"), False), __pi=(F.col("__in"), False))
    changed = ~(F.col("__tag").eqNullSafe(F.col("__pt")) & F.col("__in").eqNullSafe(F.col("__pi")))
    s = s.running_sum("__run", changed.cast("int"))
    s = s.cut() if s.chunk_rows else s
    size = s.df.groupBy(F.col(s.key).alias("__k"), F.col("__run").alias("__r")).agg(F.count("*").alias(to)) if s.chunk_rows else None
    if size is None:
        df = s.df.withColumn(to, F.count("*").over(Window.partitionBy(s.key, "__run")))
    else:  # a run may be as long as its series
        df = s.df.join(size, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col("__run") == F.col("__r"))).drop("__k", "__r")
    return s.with_df(df.withColumn(to, F.when(F.col("__in"), F.col(to))).drop("__tag", "__in", "__pt", "__pi", "__run"))

