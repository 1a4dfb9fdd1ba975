"""The engine's queries on the test tables, with the same in SQL for DuckDB."""

from __future__ import annotations

import io
import tempfile
import warnings
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .api import LabExperiment, LabSeries, OnlineSeries
from .functions import timeconv
from .operators import formatting, report, smoothing, stats
from .operators.reliability import check_filling_error, filling_error
from .plans.scratch import Scratch
from .plans.series import SeriesFrame, filled, fillmeta, valid
from .sources import excel, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KINDS = ("click", "error", "purchase", "signup", "view")
RANGE = ("2024/1/5", "2024/1/20")
R = "(time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-21')"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# -- series of the test tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    """Means of amounts are taken over whole cents, so they don't depend on the order of rows."""
    return (F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count(c)) / 100.0


def hourly(spark: SparkSession, sf_dir: str, minutes: int = 60, chunk_rows: int | None = None) -> OnlineSeries:
    """A row for every hour of 30 days and the mean event value of each kind; hours without events have nulls."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    lo, hi = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    spine = spark.range(1).select(F.explode(F.sequence(lo, hi - step, step)).alias("time"))
    ev = _table(spark, sf_dir, "events").select(F.window("ts", f"{minutes} minutes").getField("start").cast("timestamp_ntz").alias("time"), "event_type", "value")
    cells = ev.groupBy("time").pivot("event_type", list(KINDS)).agg(_cents("value"))
    return OnlineSeries.wrap(spine.join(cells, "time", "left").withColumn("seq", F.lit(0).cast("long")), "time", chunk_rows=chunk_rows)


def events(spark: SparkSession, sf_dir: str, chunk_rows: int | None = None) -> OnlineSeries:
    """Raw events, a series for each kind."""
    ev = _table(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("series_key"), F.col("event_id").alias("seq"), F.col("value").alias("v"))
    return OnlineSeries.wrap(ev, "time", "series_key", "seq", chunk_rows)


def daily_orders(spark: SparkSession, sf_dir: str) -> LabExperiment:
    """Total and number of orders by day."""
    o = _table(spark, sf_dir, "orders")
    total = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100.0
    df = o.groupBy(F.col("o_orderdate").alias("time")).agg(total.alias("total"), F.count("*").cast("double").alias("n"))
    return LabExperiment.wrap(df.withColumn("seq", F.lit(0).cast("long")), "time")


def experiment(spark: SparkSession, sf_dir: str) -> LabExperiment:
    """Daily orders on a numeric time axis, in days."""
    s = daily_orders(spark, sf_dir)
    day = F.datediff(F.col("time"), F.lit("1995-01-01").cast("date")).cast("double")
    return LabExperiment.wrap(s.df.withColumn("time", day), "time")


HOURLY = f"""
spine AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS time),
cells AS (SELECT date_trunc('hour', ts) AS h, event_type, (sum(round(value * 100)::BIGINT)::DOUBLE / count(value)) / 100.0 AS v FROM events GROUP BY ALL),
hourly AS (SELECT time, {', '.join(f"max(v) FILTER (event_type = '{k}') AS {k}" for k in KINDS)} FROM spine LEFT JOIN cells ON h = time GROUP BY time)"""
EV = "ev AS (SELECT ts AS time, event_type AS series_key, event_id AS seq, value AS v FROM events)"
ORDERS = "daily AS (SELECT o_orderdate AS time, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100.0 AS total, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)"
LAB = ORDERS + ", lab AS (SELECT date_diff('day', TIMESTAMP '1995-01-01', time)::DOUBLE AS time, total, n FROM daily)"


def _tagged(s: SeriesFrame, c: str) -> DataFrame:
    return s.df.select("time", F.round(c, 6).alias("value"), F.col(valid(c)).alias("tag"))


def _tagged_ev(s: SeriesFrame) -> DataFrame:
    return s.df.select("series_key", "time", F.round("v", 6).alias("value"), F.col(valid("v")).alias("tag"))


def _filled(s: SeriesFrame, c: str) -> DataFrame:
    return s.df.select("time", F.round(filled(c), 6).alias("value"), F.col(fillmeta(c)).alias("origin"))


# -- tags

_NAN = "CASE WHEN click IS NULL THEN 'filtered' ELSE 'original' END"


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS value, {_NAN} AS tag FROM hourly")
def tag_nan(spark, sf):
    return _tagged(hourly(spark, sf).tag_nan("click"), "click")


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS value, CASE WHEN {R} THEN {_NAN} ELSE 'original' END AS tag FROM hourly")
def tag_nan_range(spark, sf):
    return _tagged(hourly(spark, sf).tag_nan("click", RANGE), "click")


@query(ORACLES["tag_nan"])
def tag_nan_resets_tags(spark, sf):
    return _tagged(hourly(spark, sf).tag_extremes("click", limit=60, method="above").tag_nan("click"), "click")


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS value, CASE WHEN click IS NULL OR click > 60 THEN 'filtered' ELSE 'original' END AS tag FROM hourly")
def tag_nan_preserves_tags(spark, sf):
    return _tagged(hourly(spark, sf).tag_extremes("click", limit=60, method="above").tag_nan("click", preserve_tags=True), "click")


_LAST = "last_value({} IGNORE NULLS) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_DOUBLES = f"WITH {HOURLY}, p AS (SELECT *, {_LAST.format('click')} AS prev FROM hourly)"
_STUCK = "click IS NOT NULL AND NOT coalesce(abs(click - prev) >= 2.0, false)"


@query(f"{_DOUBLES} SELECT time, round(click, 6) AS value, CASE WHEN {_STUCK} THEN 'filtered' ELSE 'original' END AS tag FROM p")
def tag_doubles(spark, sf):
    return _tagged(hourly(spark, sf).tag_doubles("click", 2.0), "click")


@query(f"{_DOUBLES} SELECT time, round(click, 6) AS value, CASE WHEN {R} AND {_STUCK} THEN 'filtered' ELSE 'original' END AS tag FROM p")
def tag_doubles_range(spark, sf):
    return _tagged(hourly(spark, sf).tag_doubles("click", 2.0, RANGE), "click")


@query(f"{_DOUBLES} SELECT time, round(CASE WHEN NOT ({_STUCK}) THEN click END, 6) AS value, CASE WHEN {_STUCK} THEN 'filtered' ELSE 'original' END AS tag FROM p")
def tag_doubles_final(spark, sf):
    return _tagged(hourly(spark, sf).tag_doubles("click", 2.0, final=True), "click")


@query(f"{_DOUBLES} SELECT time, round(click, 6) AS value, CASE WHEN {_STUCK} AND prev IS NOT NULL THEN 'filtered' ELSE 'original' END AS tag FROM p")
def tag_doubles_keep_first(spark, sf):
    return _tagged(hourly(spark, sf).tag_doubles("click", 2.0, tag_first=False), "click")


@query(ORACLES["tag_doubles"])
def tag_doubles_chunked(spark, sf):
    return _tagged(hourly(spark, sf, chunk_rows=50).tag_doubles("click", 2.0).done(), "click")


@query(f"WITH {EV} SELECT series_key, time, round(v, 6) AS value, CASE WHEN v < 1.5 THEN 'filtered' ELSE 'original' END AS tag FROM ev")
def tag_extremes_below(spark, sf):
    return _tagged_ev(events(spark, sf).tag_extremes("v", limit=1.5))


@query(f"WITH {EV} SELECT series_key, time, round(v, 6) AS value, CASE WHEN v < 1.5 OR ({R} AND v > 200) THEN 'filtered' ELSE 'original' END AS tag FROM ev")
def tag_extremes_above_range(spark, sf):
    return _tagged_ev(events(spark, sf).tag_extremes("v", limit=1.5).tag_extremes("v", RANGE, limit=200, method="above"))


@query(f"WITH {HOURLY} SELECT time, coalesce({R} AND view > 80, false)::INT AS highs FROM hourly")
def highs_value(spark, sf):
    return hourly(spark, sf).get_highs("view", 80, RANGE, "value").df.select("time", "highs")


@query(f"WITH {HOURLY}, b AS (SELECT quantile_cont(view, 0.9) AS bound FROM hourly WHERE {R}) SELECT time, coalesce({R} AND view > bound, false)::INT AS highs FROM hourly, b")
def highs_percentile(spark, sf):
    return hourly(spark, sf).get_highs("view", 0.9, RANGE).df.select("time", "highs")


# -- slopes

_PREV_EV = "p AS (SELECT *, lag(v) OVER w AS pv, lag(time) OVER w AS pt, floor((epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6) AS dt FROM ev WINDOW w AS (PARTITION BY series_key ORDER BY time, seq))"


def _slope_sql(dt: str, dy: str = "(v - pv)") -> str:
    return f"CASE WHEN {dt} = 0 THEN CASE WHEN {dy} <> 0 THEN sign({dy}) * 'inf'::DOUBLE END ELSE {dy} / {dt} END"


def _finite(c: str):
    return F.round(F.when(F.abs(c) < float("inf"), F.col(c)), 6)


@query(f"WITH {ORDERS}, p AS (SELECT *, lag(total) OVER (ORDER BY time) AS py, date_diff('second', lag(time) OVER (ORDER BY time), time) / 86400.0::DOUBLE AS dt FROM daily) SELECT time, round((total - py) / dt, 6) AS slope FROM p")
def slopes_day_unit(spark, sf):
    return daily_orders(spark, sf).slopes("total", time_unit="d", to="slope").df.select("time", F.round("slope", 6).alias("slope"))


@query(f"WITH {EV}, {_PREV_EV}, q AS (SELECT *, {_slope_sql('((dt::BIGINT % 86400) / 1.0::DOUBLE)')} AS s FROM p) SELECT series_key, time, round(CASE WHEN isfinite(s) THEN s END, 6) AS slope FROM q")
def slopes_sec_wrap(spark, sf):
    return events(spark, sf).slopes("v", time_unit="sec", to="slope").df.select("series_key", "time", _finite("slope").alias("slope"))


@query(f"WITH {EV}, {_PREV_EV}, q AS (SELECT *, {_slope_sql('(dt / 60.0::DOUBLE)')} AS s FROM p) SELECT series_key, time, round(CASE WHEN isfinite(s) THEN s END, 6) AS slope FROM q")
def slopes_true_elapsed(spark, sf):
    return events(spark, sf).slopes("v", time_unit="min", true_elapsed=True, to="slope").df.select("series_key", "time", _finite("slope").alias("slope"))


@query(f"WITH {LAB}, p AS (SELECT *, total - lag(total) OVER w AS dy, n - lag(n) OVER w AS dx FROM lab WINDOW w AS (ORDER BY time)) SELECT time, round(CASE WHEN dx <> 0 THEN dy / dx END, 6) AS slope FROM p")
def slopes_raw(spark, sf):
    return experiment(spark, sf).slopes("total", "n", to="slope").df.select("time", _finite("slope").alias("slope"))


_STEEP = f"WITH {EV}, {_PREV_EV}, q AS (SELECT *, coalesce({R.replace('time', 'pt')} AND {R} AND abs({_slope_sql('((dt::BIGINT % 86400) / 60.0::DOUBLE)')}) > 30, false) AS steep FROM p)"


@query(f"{_STEEP} SELECT series_key, time, round(v, 6) AS value, CASE WHEN {R} AND NOT steep AND v IS NOT NULL THEN 'original' ELSE 'filtered' END AS tag FROM q")
def moving_slope_filter(spark, sf):
    return _tagged_ev(events(spark, sf).moving_slope_filter("v", 30, RANGE, time_unit="min"))


@query(f"{_STEEP} SELECT series_key, time, round(CASE WHEN {R} AND NOT steep THEN v END, 6) AS value, CASE WHEN {R} AND NOT steep THEN 'original' ELSE 'filtered' END AS tag FROM q")
def moving_slope_filter_final(spark, sf):
    return _tagged_ev(events(spark, sf).moving_slope_filter("v", 30, RANGE, time_unit="min", final=True))


@query(f"{_STEEP} SELECT series_key, time, round(v, 6) AS value, CASE WHEN steep THEN 'filtered' ELSE 'original' END AS tag FROM q")
def moving_slope_filter_range(spark, sf):
    return _tagged_ev(events(spark, sf).moving_slope_filter("v", 30, RANGE, time_unit="min", strict_range=True))


# -- smoothing


def _line_sql(c: str, source: str = "hourly") -> str:
    """Positional interpolation, in CTEs up to `line` with column i."""
    return f"""pos AS (SELECT *, row_number() OVER (ORDER BY time) AS rn FROM {source}),
near AS (SELECT *, last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pn, last_value({c} IGNORE NULLS) OVER b AS pv,
    first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS fn, first_value({c} IGNORE NULLS) OVER f AS fv
  FROM pos WINDOW b AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
line AS (SELECT *, CASE WHEN {c} IS NOT NULL THEN {c} WHEN pn IS NOT NULL AND fn IS NOT NULL THEN pv + (fv - pv) * (rn - pn) / (fn - pn) ELSE pv END AS i FROM near)"""


_SMOOTH = f"WITH {HOURLY}, {_line_sql('click')}, sma AS (SELECT *, CASE WHEN count(i) OVER w = 12 THEN avg(i) OVER w END AS s FROM line WINDOW w AS (ORDER BY time ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))"
_CLOSE = "coalesce(abs(s - click) / nullif(s, 0) < 0.4, false)"


@query(f"{_SMOOTH} SELECT time, round(s, 9) AS value FROM sma WHERE {R}")
def moving_average_centered(spark, sf):
    return hourly(spark, sf).moving_average("click", 12, arange=RANGE).df.select("time", F.round("click", 9).alias("value"))


@query(ORACLES["moving_average_centered"])
def moving_average_chunked(spark, sf):
    return hourly(spark, sf, chunk_rows=50).moving_average("click", 12, arange=RANGE).df.select("time", F.round("click", 9).alias("value"))


@query(f"WITH {HOURLY}, sma AS (SELECT time, CASE WHEN count(error) OVER w = 3 THEN avg(error) OVER w END AS s FROM hourly WINDOW w AS (ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT time, round(s, 9) AS value FROM sma")
def moving_average_without_interpolation(spark, sf):
    return hourly(spark, sf).moving_average("error", 3, interpolate=False).df.select("time", F.round("error", 9).alias("value"))


@query(f"{_SMOOTH} SELECT time, round(click, 6) AS value, CASE WHEN {R} AND {_CLOSE} THEN 'original' ELSE 'filtered' END AS tag FROM sma")
def moving_average_filter(spark, sf):
    return _tagged(hourly(spark, sf).moving_average_filter("click", 12, 0.4, RANGE), "click")


@query(f"{_SMOOTH} SELECT time, round(click, 6) AS value, CASE WHEN NOT {R} OR {_CLOSE} THEN 'original' ELSE 'filtered' END AS tag FROM sma")
def moving_average_filter_range(spark, sf):
    return _tagged(hourly(spark, sf).moving_average_filter("click", 12, 0.4, RANGE, strict_range=True), "click")


# Published weights of the quadratic polynomial over seven points, at its first three places and its middle.
_HAT = {0: ([32, 15, 3, -4, -6, -3, 5], 42), 1: ([5, 4, 3, 2, 1, 0, -1], 14), 2: ([1, 3, 4, 4, 3, 1, -2], 14), 3: ([-2, 3, 6, 7, 6, 3, -2], 21)}
_HAT |= {6 - i: (w[::-1], d) for i, (w, d) in list(_HAT.items())[:3]}
_W = lambda i: "[" + ", ".join(f"{w}::DOUBLE / {_HAT[i][1]}" for w in _HAT[i][0]) + "]"
_SAVGOL = f"""WITH {HOURLY}, {_line_sql('view')},
f AS (SELECT time, rn, count(*) OVER () AS n, list(i) OVER (ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l, first_value(rn) OVER (ORDER BY time) AS one FROM line),
ends AS (SELECT list(i ORDER BY rn) FILTER (rn <= 7) AS head, list(i ORDER BY rn) FILTER (rn > n - 7) AS tail FROM (SELECT *, count(*) OVER () AS n FROM line)),
dots AS (SELECT time, rn, CASE rn WHEN 1 THEN list_dot_product(head, {_W(0)}) WHEN 2 THEN list_dot_product(head, {_W(1)}) WHEN 3 THEN list_dot_product(head, {_W(2)})
    WHEN n - 2 THEN list_dot_product(tail, {_W(4)}) WHEN n - 1 THEN list_dot_product(tail, {_W(5)}) WHEN n THEN list_dot_product(tail, {_W(6)}) ELSE list_dot_product(l, {_W(3)}) END AS s FROM f, ends)"""


def _savgol(spark, sf, chunk_rows=None):
    s = hourly(spark, sf, chunk_rows=chunk_rows)
    s = smoothing.interpolated(s, "view", "i").done()
    return s.savgol("i", 7, 2).positions().df


@query(f"{_SAVGOL} SELECT time, round(s, 5) AS value FROM dots WHERE rn > 3 AND rn <= 717")
def savgol_interior(spark, sf):
    return _savgol(spark, sf).where("__rn > 3 and __rn <= 717").select("time", F.round("i", 5).alias("value"))


@query(f"{_SAVGOL} SELECT time, round(s, 5) AS value FROM dots WHERE rn <= 3 OR rn > 717")
def savgol_edges(spark, sf):
    return _savgol(spark, sf, 100).where("__rn <= 3 or __rn > 717").select("time", F.round("i", 5).alias("value"))


# -- statistics


@query(f"WITH {EV} SELECT series_key, round(avg(CASE WHEN NOT v < 1.5 THEN v END), 6) AS avg_v FROM ev GROUP BY ALL")
def avg_checked(spark, sf):
    return events(spark, sf).tag_extremes("v", limit=1.5).averages("v").select("series_key", F.round("v", 6).alias("avg_v"))


@query(f"WITH {EV} SELECT series_key, round(stddev_samp(CASE WHEN NOT v < 1.5 THEN v END), 6) AS std_v FROM ev GROUP BY ALL")
def std_checked(spark, sf):
    return events(spark, sf).tag_extremes("v", limit=1.5).deviations("v").select("series_key", F.round("v", 6).alias("std_v"))


@query(f"WITH {HOURLY} SELECT " + ", ".join(f"round(avg({k}), 6) AS {k}" for k in KINDS) + " FROM hourly")
def avg_all_columns(spark, sf):
    return hourly(spark, sf).averages(only_checked=False).select(*[F.round(k, 6).alias(k) for k in KINDS])


@query(f"WITH {HOURLY} SELECT round(avg(click / view), 6) AS mean, round(stddev_samp(click / view), 6) AS std FROM hourly WHERE {R}")
def ratio_stats(spark, sf):
    return hourly(spark, sf).calc_ratio("click", "view", RANGE).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {HOURLY} SELECT round(avg(click / view), 6) AS mean, round(stddev_samp(click / view), 6) AS std FROM hourly WHERE {R} AND click <= 60 AND view >= 40")
def ratio_checked(spark, sf):
    s = hourly(spark, sf).tag_extremes("click", limit=60, method="above").tag_extremes("view", limit=40)
    s = s.tag_nan("click", preserve_tags=True).tag_nan("view", preserve_tags=True)
    return s.calc_ratio("click", "view", RANGE, only_checked=True).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {HOURLY}, t AS (SELECT epoch_us(time) / 86400e6::DOUBLE - (SELECT min(epoch_us(time)) / 86400e6::DOUBLE FROM hourly) AS tx, click / view AS r FROM hourly),
n AS (SELECT floor((max(floor(tx)) - 4) / 4) AS top_ FROM t), w AS (SELECT unnest(range(0, top_::BIGINT + 1)) AS "window" FROM n),
e AS (SELECT "window", avg(r) AS mean, stddev_samp(r) AS std FROM w JOIN t ON tx >= "window" * 4 AND tx <= "window" * 4 + 4 GROUP BY ALL)
SELECT "window"::BIGINT AS "window", round(mean, 6) AS mean, round(std, 6) AS std FROM e WHERE std / mean IS NOT NULL ORDER BY std / mean, "window" LIMIT 1""")
def best_ratio_window(spark, sf):
    return hourly(spark, sf).compare_ratio("click", "view", 4).select("window", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_LI = "l_extendedprice / l_quantity"


@query(f"SELECT l_returnflag, round(avg({_LI}), 6) AS mean, round(stddev_samp({_LI}), 6) AS std FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL")
def ratio_volume(spark, sf):
    li = _table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity")
    s = OnlineSeries.wrap(li.withColumn("seq", F.lit(0)), "l_shipdate", "l_returnflag", "seq")
    return s.calc_ratio("l_extendedprice", "l_quantity", ("1996/1/1", "1998/12/31")).select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {HOURLY} SELECT round(regr_slope(view, click), 6) AS slope, round(regr_intercept(view, click), 6) AS intercept, round(regr_r2(view, click), 6) AS r_squared, regr_count(view, click)::BIGINT AS n FROM hourly WHERE {R}")
def correlation(spark, sf):
    return hourly(spark, sf).correlation("click", "view", RANGE).select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared")], "n")


@query(f"WITH {HOURLY}, p AS (SELECT click AS x, view AS y FROM hourly WHERE {R} AND click IS NOT NULL AND view IS NOT NULL) SELECT round(sum(x * y) / sum(x * x), 6) AS slope, 0.0::DOUBLE AS intercept, round(sum(x * y) ** 2 / (sum(x * x) * sum(y * y)), 6) AS r_squared, count(*) AS n FROM p")
def correlation_zero_intercept(spark, sf):
    return hourly(spark, sf).correlation("click", "view", RANGE, zero_intercept=True).select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared")], "n")


# Student's quantile by Simpson's rule over its density in steps of 1e-4, and the rest of a step by the density half way.
_DENSITY = lambda x: f"pow(1 + ({x}) * ({x}) / f, -(f + 1) / 2)"
_T = f"""area AS (SELECT i, f, sum({_DENSITY('i * 1e-4')} + 4 * {_DENSITY('(i + 0.5) * 1e-4')} + {_DENSITY('(i + 1) * 1e-4')}) OVER (ORDER BY i) * (1e-4 / 6) AS upto FROM g, range(400000) AS r(i)),
goal AS (SELECT 0.95::DOUBLE * max(upto) AS goal FROM area),
cell AS (SELECT max(f) AS f, (max(i) + 1) * 1e-4::DOUBLE AS x, max(goal) - max(upto) AS rest FROM area, goal WHERE upto <= goal),
t AS (SELECT x + rest / {_DENSITY(f"x + rest / (2 * {_DENSITY('x')})")} AS t FROM cell)"""

@query(f"""WITH {HOURLY}, p AS (SELECT time, click AS x, view AS y FROM hourly WHERE {R}),
g AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_count(y, x)::DOUBLE AS n, (regr_count(y, x) - 2)::DOUBLE AS f, regr_avgx(y, x) AS m, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS sse FROM p), {_T}
SELECT time, round(a * x + b, 5) AS fit, round(a * x + b - t * sqrt(sse / f) * sqrt(1 + 1 / n + (x - m) ** 2 / sxx), 5) AS lower, round(a * x + b + t * sqrt(sse / f) * sqrt(1 + 1 / n + (x - m) ** 2 / sxx), 5) AS upper FROM p, g, t""")
def prediction_interval(spark, sf):
    return hourly(spark, sf).prediction_interval("click", "view", RANGE).select("time", *[F.round(c, 5).alias(c) for c in ("fit", "lower", "upper")])


@query(f"WITH {EV} SELECT series_key, date_trunc('day', time) AS day, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM ev GROUP BY ALL")
def daily_average(spark, sf):
    return events(spark, sf).daily_average("v").select("series_key", "day", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {EV}, big AS (SELECT * FROM ev WHERE v > 180), d AS (SELECT series_key, unnest(generate_series(min(date_trunc('day', time)), max(date_trunc('day', time)), INTERVAL 1 DAY)) AS day FROM big GROUP BY series_key)
SELECT d.series_key, d.day, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM d LEFT JOIN big ON big.series_key = d.series_key AND date_trunc('day', time) = d.day GROUP BY ALL""")
def daily_average_with_empty_days(spark, sf):
    s = events(spark, sf)
    return s.where(F.col("v") > 180).daily_average("v").select("series_key", "day", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_TOD = "(epoch_us(time) % 86400000000)"
_PROFILE = "round(avg(v), 6) AS avg, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.9), 6) AS q_upper, round(quantile_cont(v, 0.1), 6) AS q_lower"


def _profile(df):
    return df.select("tod", *[F.round(c, 6).alias(c) for c in ("avg", "std", "q_upper", "q_lower")])


@query(f"WITH {HOURLY}, p AS (SELECT {_TOD} AS tod, view AS v FROM hourly WHERE {R}) SELECT tod, {_PROFILE} FROM p GROUP BY tod")
def daily_profile(spark, sf):
    return _profile(hourly(spark, sf).daily_profile("view", RANGE))


@query(f"WITH {HOURLY}, p AS (SELECT {_TOD} AS tod, CASE WHEN NOT view > 90 THEN view END AS v FROM hourly WHERE {R}) SELECT tod, {_PROFILE} FROM p GROUP BY tod")
def daily_profile_checked(spark, sf):
    return _profile(hourly(spark, sf).tag_extremes("view", limit=90, method="above").daily_profile("view", RANGE, only_checked=True))


@query(f"WITH {HOURLY}, h AS (SELECT * FROM hourly WHERE time >= TIMESTAMP '2024-01-05 03:00:00'), p AS (SELECT time, view AS v, row_number() OVER (PARTITION BY date_trunc('day', time) ORDER BY time) AS k FROM h WHERE {R}) SELECT (k + 2) * 3600000000 AS tod, {_PROFILE} FROM p WHERE k <= 21 GROUP BY k")
def daily_profile_positional(spark, sf):
    s = hourly(spark, sf)
    return _profile(s.where(F.col("time") >= F.lit("2024-01-05 03:00:00").cast("timestamp_ntz")).daily_profile("view", RANGE, positional=True))


# -- gaps


def _runs_sql(c: str, extra: str = "") -> str:
    """CTEs up to `runs`: time, v, tag, inr and size, the length of the run of tags within the range."""
    return f"""t0 AS (SELECT *, {c} AS v, CASE WHEN {c} IS NULL {extra} THEN 'filtered' ELSE 'original' END AS tag, {R} AS inr FROM hourly),
t1 AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER o OR inr IS DISTINCT FROM lag(inr) OVER o THEN 1 ELSE 0 END AS ch FROM t0 WINDOW o AS (ORDER BY time)),
t2 AS (SELECT *, sum(ch) OVER (ORDER BY time) AS run FROM t1),
runs AS (SELECT *, CASE WHEN inr THEN count(*) OVER (PARTITION BY inr, run) END AS size, row_number() OVER (ORDER BY time) AS rn FROM t2)"""


@query(f"WITH {HOURLY}, {_runs_sql('click')} SELECT time, tag, size FROM runs")
def gap_runs(spark, sf):
    s = hourly(spark, sf).tag_nan("click")
    return stats.runs(s, F.col(valid("click")), RANGE, "size").df.select("time", F.col(valid("click")).alias("tag"), "size")


def _interpol_sql(limit: int, only: bool = False) -> str:
    """CTEs up to `done` with columns fill and origin."""
    value = f"CASE WHEN k IS NOT NULL THEN k WHEN rn - pn <= {limit} {'AND target' if only else ''} THEN CASE WHEN fn IS NULL THEN pv ELSE pv + (fv - pv) * (x - px) / (fx - px) END END"
    return f"""{_runs_sql('click')}, g AS (SELECT *, inr AND tag = 'filtered' AND size < {limit} AS target, epoch_us(time)::DOUBLE AS x FROM runs),
k AS (SELECT *, CASE WHEN tag = 'original' AND NOT target THEN v END AS k FROM g),
n AS (SELECT *, {', '.join(f"last_value(CASE WHEN k IS NOT NULL THEN {e} END IGNORE NULLS) OVER b AS {p}, first_value(CASE WHEN k IS NOT NULL THEN {e} END IGNORE NULLS) OVER f AS {q}" for e, p, q in (('rn', 'pn', 'fn'), ('k', 'pv', 'fv'), ('x', 'px', 'fx')))}
  FROM k WINDOW b AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (ORDER BY time ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
done AS (SELECT *, {value} AS fill, CASE WHEN target THEN 'filled_interpol' ELSE tag END AS origin FROM n)"""


@query(f"WITH {HOURLY}, {_interpol_sql(2)} SELECT time, round(fill, 6) AS value, origin FROM done")
def fill_interpolation(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_interpolation("click", 2, RANGE), "click")


@query(ORACLES["fill_interpolation"])
def fill_interpolation_chunked(spark, sf):
    return _filled(hourly(spark, sf, chunk_rows=50).tag_nan("click").fill_interpolation("click", 2, RANGE), "click")


@query(f"WITH {HOURLY}, {_interpol_sql(3, True)} SELECT time, round(fill, 6) AS value, origin FROM done")
def fill_interpolation_only_targets(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_interpolation("click", 3, RANGE, only_targets=True), "click")


_GAP = f"(click IS NULL AND {R})"


@query(f"WITH {HOURLY} SELECT time, round(CASE WHEN {_GAP} THEN view * 1.1 ELSE click END, 6) AS value, CASE WHEN {_GAP} THEN 'filled_ratio' WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM hourly")
def fill_ratio(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_ratio("click", "view", 1.1, RANGE), "click")


@query(f"WITH {HOURLY} SELECT time, round(CASE WHEN {R} THEN view * 1.1 ELSE click END, 6) AS value, CASE WHEN {R} THEN 'filled_ratio' WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM hourly")
def fill_ratio_all(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_ratio("click", "view", 1.1, RANGE, only_checked=False), "click")


@query(f"""WITH {HOURLY}, g AS (SELECT regr_slope(click, view) AS a, regr_intercept(click, view) AS b FROM hourly WHERE time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-26')
SELECT time, round(CASE WHEN {_GAP} THEN view * a + b ELSE click END, 6) AS value, CASE WHEN {_GAP} THEN 'filled_correlation' WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM hourly, g""")
def fill_correlation(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_correlation("click", "view", RANGE, ("2024/1/2", "2024/1/25")), "click")


@query(f"""WITH {HOURLY}, p AS (SELECT {_TOD} AS tod, avg(click) AS a FROM hourly WHERE time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-26' GROUP BY ALL)
SELECT time, round(CASE WHEN {_GAP} THEN a ELSE click END, 6) AS value, CASE WHEN {_GAP} THEN 'filled_average_profile' WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM hourly LEFT JOIN p ON {_TOD} = tod""")
def fill_profile(spark, sf):
    s = hourly(spark, sf).tag_nan("click")
    return _filled(s.fill_standard("click", RANGE, s.daily_profile("click", ("2024/1/2", "2024/1/25"))), "click")


def _model(spark):
    at = F.timestamp_micros(F.lit(1_704_067_980_000_000) + F.col("id") * 25_200_000_000).cast("timestamp_ntz")
    return spark.range(100).select(at.alias("time"), (F.col("id") * 1.5).alias("value"))


_MODEL = "model AS (SELECT TIMESTAMP '2024-01-01 00:13:00' + INTERVAL (i * 7) HOUR AS mt, i * 1.5::DOUBLE AS mv FROM range(100) AS r(i))"
_NEAREST = f"""{_MODEL}, pre AS (SELECT h.*, m.mt AS pt, m.mv AS pv FROM hourly h ASOF LEFT JOIN model m ON h.time >= m.mt), sides AS (SELECT p.*, m.mt AS ft, m.mv AS fv FROM pre p ASOF LEFT JOIN model m ON p.time <= m.mt),
near AS (SELECT *, CASE WHEN pt IS NULL THEN fv WHEN ft IS NULL OR time - pt <= ft - time THEN pv ELSE fv END AS m FROM sides)"""


@query(f"WITH {HOURLY}, {_NEAREST} SELECT time, round(CASE WHEN {_GAP} THEN m ELSE click END, 6) AS value, CASE WHEN {_GAP} THEN 'filled_infl_model' WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM near")
def fill_model_nearest(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_model("click", _model(spark), RANGE), "click")


@query(ORACLES["fill_model_nearest"])
def fill_model_nearest_chunked(spark, sf):
    return _filled(hourly(spark, sf, chunk_rows=100).tag_nan("click").fill_model("click", _model(spark), RANGE), "click")


@query(f"""WITH {HOURLY}, m AS (SELECT i / 3.0::DOUBLE AS mt, i * 2.0::DOUBLE AS mv FROM range(90) AS r(i)), h AS (SELECT *, round((epoch_us(time) - (SELECT min(epoch_us(time)) FROM hourly)) / 86400e6::DOUBLE, 5) AS tx FROM hourly),
pre AS (SELECT h.*, m.mt AS pt, m.mv AS pv FROM h ASOF LEFT JOIN m ON h.tx >= m.mt), sides AS (SELECT p.*, m.mt AS ft, m.mv AS fv FROM pre p ASOF LEFT JOIN m ON p.tx <= m.mt),
near AS (SELECT *, CASE WHEN pt IS NULL THEN fv WHEN ft IS NULL OR tx - pt <= ft - tx THEN pv ELSE fv END AS m FROM sides)
SELECT time, round(CASE WHEN {_GAP} THEN m ELSE click END, 6) AS value, CASE WHEN {_GAP} THEN 'filled_infl_model' WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM near""")
def fill_model_elapsed(spark, sf):
    model = spark.range(90).select((F.col("id") / 3.0).alias("t"), (F.col("id") * 2.0).alias("v"))
    return _filled(hourly(spark, sf).tag_nan("click").fill_model("click", model, RANGE, "t", "v"), "click")


_R2 = "(time >= TIMESTAMP '2024-01-10' AND time < TIMESTAMP '2024-01-11')"


@query(f"""WITH {HOURLY}, g AS (SELECT *, CASE WHEN {_R2} THEN NULL ELSE click END AS c FROM hourly), src AS (SELECT {_TOD} AS tod, first(c ORDER BY time) AS b FROM g WHERE time >= TIMESTAMP '2024-01-09' AND time <= TIMESTAMP '2024-01-10' GROUP BY ALL)
SELECT time, round(CASE WHEN {_R2} THEN b ELSE c END, 6) AS value, CASE WHEN {_R2} THEN 'filled_profile_day_before' WHEN c IS NULL THEN 'filtered' ELSE 'original' END AS origin FROM g LEFT JOIN src ON {_TOD} = tod""")
def fill_day_before(spark, sf):
    s = hourly(spark, sf)
    day = F.lit("2024-01-10").cast("timestamp_ntz")
    s = s.add(click=F.when((F.col("time") < day) | (F.col("time") >= day + F.expr("interval 1 day")), F.col("click"))).tag_nan("click")
    return _filled(s.fill_daybefore("click", ("2024/1/10", "2024/1/10"), (0.5, 4)), "click")


@query(f"""WITH {HOURLY}, {_interpol_sql(2)}, c AS (SELECT *, CASE WHEN inr AND origin = 'filtered' THEN view * 1.1 ELSE fill END AS f2, CASE WHEN inr AND origin = 'filtered' AND view IS NOT NULL THEN 'filled_ratio' ELSE origin END AS o2 FROM done),
p AS (SELECT {_TOD} AS tod, avg(click) AS a FROM hourly WHERE {R} GROUP BY ALL)
SELECT time, round(CASE WHEN inr AND o2 = 'filtered' THEN a WHEN o2 = 'filled_ratio' THEN view * 1.1 ELSE fill END, 6) AS value, CASE WHEN inr AND o2 = 'filtered' THEN 'filled_average_profile' ELSE o2 END AS origin FROM c LEFT JOIN p ON {_TOD} = tod""")
def fill_chain(spark, sf):
    s = hourly(spark, sf).tag_nan("click").fill_interpolation("click", 2, RANGE).fill_ratio("click", "view", 1.1, RANGE, require_value=True)
    return _filled(s.fill_standard("click", RANGE, profile_range=RANGE), "click")


# -- reliability

_FIXED = [(0, 30, 3), (0, 100, 5), (1, 200, 4), (1, 202, 6), (2, 500, 1)]
_GAPS = ", ".join(f"({i}, {a}, {n})" for i, a, n in _FIXED)


@query(f"""WITH {HOURLY}, pos AS (SELECT *, row_number() OVER (ORDER BY time) AS rn FROM hourly), gaps(it, a, n) AS (VALUES {_GAPS}),
spots AS (SELECT DISTINCT it, unnest(range(a, a + n)) AS rn FROM gaps) SELECT it::INT AS iteration, round(avg(abs(click - view * 1.1) / nullif(click, 0)) * 100, 6) AS error_pct FROM spots JOIN pos USING (rn) GROUP BY it""")
def filling_error_fixed_gaps(spark, sf):
    gaps = spark.createDataFrame(_FIXED, "iteration int, start int, size int")
    return filling_error(hourly(spark, sf), "click", "fill_ratio", gaps, use="view", ratio=1.1, arange=("2024/1/1", "2024/1/30")).select("iteration", F.round("error_pct", 6).alias("error_pct"))


@query()
def filling_error_random(spark, sf):
    options = {"nr_small_gaps": 10, "max_size_small_gaps": 4, "nr_large_gaps": 2, "max_size_large_gaps": 20, "seed": 7}
    return check_filling_error(hourly(spark, sf), 20, "click", "fill_interpolation", ("2024/1/3", "2024/1/28"), range_=30, arange=("2024/1/3", "2024/1/28"), null_gaps=True, **options)


# -- formatting


@query(f"WITH {HOURLY} SELECT time, round((click * error + view * signup) / nullif(purchase, 0), 6) AS value FROM hourly")
def total_proportional(spark, sf):
    s = hourly(spark, sf).total_proportional("purchase", ["click", "view"], ["error", "signup"], "conc")
    return s.df.select("time", F.round("conc", 6).alias("value"))


@query("SELECT ts AS time, round_even((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 86400e6::DOUBLE, 5) AS time_rel FROM events")
def relative_time(spark, sf):
    ev = _table(spark, sf, "events").select(F.col("ts").alias("time"), "value")
    return OnlineSeries.wrap(ev, "time").relative_time(inplace=False).df.select("time", "time_rel")


_FI = "time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-06'"


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS value FROM hourly WHERE NOT ({_FI}) UNION ALL SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05 23:00:00', INTERVAL 1 HOUR)), NULL")
def fill_index(spark, sf):
    return hourly(spark, sf).fill_index(("2024/1/5", "2024/1/6")).df.select("time", F.round("click", 6).alias("value"))


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS value FROM hourly WHERE time <> TIMESTAMP '2024-01-06'")
def fill_index_keep_existing(spark, sf):
    return hourly(spark, sf).fill_index(("2024/1/5", "2024/1/6"), keep_existing=True).df.select("time", F.round("click", 6).alias("value"))


def _doubled(spark, sf):
    o = _table(spark, sf, "orders").select(F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("v"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("c"))
    return OnlineSeries.wrap(o, "time", seq="seq")


_DOUBLED = "o AS (SELECT o_orderdate AS time, o_orderkey AS seq, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS c FROM orders)"


@query(f"WITH {_DOUBLED} SELECT time, v, c FROM o QUALIFY row_number() OVER (PARTITION BY time ORDER BY seq) = 1")
def drop_duplicates_first_row(spark, sf):
    return _doubled(spark, sf).drop_duplicates().df.select("time", "v", "c")


@query(f"WITH {_DOUBLED} SELECT time, arg_min(v, seq) FILTER (v IS NOT NULL) AS v, arg_min(c, seq) FILTER (c IS NOT NULL) AS c FROM o GROUP BY time")
def drop_duplicates_first_nonnull(spark, sf):
    return _doubled(spark, sf).drop_duplicates("first_nonnull").df.select("time", "v", "c")


@query(f"WITH {EV} SELECT series_key, time, v FROM ev ORDER BY time, seq LIMIT 7")
def head(spark, sf):
    return events(spark, sf).head(7).select("series_key", "time", "v")


@query(f"WITH {EV} SELECT series_key, time, v FROM ev ORDER BY time DESC, seq DESC LIMIT 7")
def tail(spark, sf):
    return events(spark, sf).tail(7).select("series_key", "time", "v")


@query("SELECT event_id, CASE WHEN value > 1 THEN value END AS v, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS kind FROM events")
def clean_text_values(spark, sf):
    ev = _table(spark, sf, "events").select("event_id", F.when(F.col("value") > 1, F.col("value").cast("string")).otherwise("Bad").alias("v"), F.col("event_type").alias("kind"))
    return formatting.to_float(formatting.replace_value(formatting.replace_value(ev, "Bad", "NaN"), "view", "seen"), "v")


@query("SELECT event_id, date_trunc('minute', ts) AS time FROM events")
def to_datetime(spark, sf):
    ev = _table(spark, sf, "events").select("event_id", F.date_format("ts", "dd-MM-yy HH:mm").alias("time"))
    return formatting.to_datetime(ev, "time", "%d-%m-%y %H:%M")


@query(f"WITH {HOURLY} SELECT time, CASE WHEN click IS NULL THEN 'filtered' ELSE 'original' END AS tag FROM hourly WHERE {R} UNION ALL SELECT TIMESTAMP '2024-01-31' + INTERVAL (i) HOUR, '!!' FROM range(5) AS r(i)")
def reindex_sentinel(spark, sf):
    s = hourly(spark, sf).tag_nan("click")
    extra = spark.range(5).select(F.lit(0).alias("series_key"), F.timestamp_micros(F.lit(1_706_659_200_000_000) + F.col("id") * 3_600_000_000).cast("timestamp_ntz").alias("time"))
    times = s.df.where((F.col("time") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("time") < F.lit("2024-01-21").cast("timestamp_ntz"))).select("series_key", "time")
    return s.reindex_times(times.unionByName(extra)).df.select("time", F.col(valid("click")).alias("tag"))


@query("SELECT event_type, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY ALL")
def split_by_key(spark, sf):
    parts = formatting.split_by(_table(spark, sf, "events").select("event_type", "value"), "event_type")
    one = [df.agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top")).select(F.lit(k).alias("event_type"), "n", "top") for k, df in parts.items()]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out


# -- export and report


@query(f"WITH {LAB} SELECT 0 AS ord, '#d' AS \"#t\", 'g/d' AS Q, '-' AS N UNION ALL SELECT 1, time::BIGINT::VARCHAR, (total * 100)::BIGINT::VARCHAR, n::BIGINT::VARCHAR FROM (SELECT time, round(total * 100) / 100 AS total, n FROM lab)")
def west_export(spark, sf):
    s = experiment(spark, sf)
    s = s.with_df(s.df.select("series_key", "seq", F.col("time").cast("long").alias("time"), F.round(F.col("total") * 100).cast("long").alias("total"), F.col("n").cast("long").alias("n")))
    return sinks.to_west(s, {"total": ("Q", "g/d"), "n": ("N", "-")})


@query(f"WITH {HOURLY} SELECT time, CASE WHEN click <= 60 THEN click END AS click, error, purchase, signup, view FROM hourly")
def export_filtered(spark, sf):
    return sinks.written(hourly(spark, sf).tag_extremes("click", limit=60, method="above"), "filtered")


@query(f"WITH {EV} SELECT series_key, round(100.0 * count(*) FILTER (v >= 1.5) / count(*), 6) AS percent_left FROM ev GROUP BY ALL")
def tags_percent_left(spark, sf):
    return events(spark, sf).tag_extremes("v", limit=1.5).percent_left("v").select("series_key", F.round("percent_left", 6).alias("percent_left"))


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS value, {_NAN} AS tag FROM hourly WHERE {R}")
def analysed_points(spark, sf):
    return hourly(spark, sf).tag_nan("click").analysed("click", RANGE).select("time", F.round("value", 6).alias("value"), "tag")


# -- laboratory


@query(f"WITH {LAB} SELECT time, total, n FROM lab WHERE NOT coalesce(abs(total) > 700000, false)")
def drop_peaks(spark, sf):
    from .operators import lab

    return lab.drop_peaks(experiment(spark, sf), "total", 700_000).df.select("time", "total", "n")


_TOP = f"WITH {LAB}, p AS (SELECT *, row_number() OVER (ORDER BY time) AS rn FROM lab), top AS (SELECT rn AS k FROM p ORDER BY total DESC, rn LIMIT 1)"


@query(f"{_TOP} SELECT time, total FROM p, top WHERE rn >= k")
def slope_down(spark, sf):
    from .operators import lab

    return lab.select_slope(experiment(spark, sf), "total").df.select("time", "total")


@query(f"{_TOP} SELECT time, total FROM p, top WHERE rn < k")
def slope_up(spark, sf):
    from .operators import lab

    return lab.select_slope(experiment(spark, sf), "total", down=False).df.select("time", "total")


@query(f"WITH {LAB} SELECT round(arg_min(total, time) + arg_min(n, time) - arg_max(total, time) - arg_max(n, time), 6) AS in_out FROM lab")
def in_out(spark, sf):
    return experiment(spark, sf).in_out("total", "n").select(F.round("in_out", 6).alias("in_out"))


@query(f"WITH {LAB} SELECT round(1 - (arg_max(total, time) + arg_max(n, time)) / (arg_min(total, time) + arg_min(n, time)), 6) AS removal FROM lab")
def removal(spark, sf):
    return experiment(spark, sf).removal("total", "n").select(F.round("removal", 6).alias("removal"))


@query(f"WITH {LAB} SELECT time, round((lag(total) OVER w - total) / (time - lag(time) OVER w), 6) AS slope FROM lab WINDOW w AS (ORDER BY time)")
def lab_slope(spark, sf):
    return experiment(spark, sf).calc_slope("total", time="time").df.select("time", F.round("total slope", 6).alias("slope"))


@query(f"WITH {LAB} SELECT max(n) - min(n) AS delta_ph, max(n) - min(n) <= 0.4 AS stable FROM lab")
def ph_range(spark, sf):
    return experiment(spark, sf).check_ph("n").select("delta_ph", "stable")


@query(f"WITH {LAB} SELECT time, coalesce(time * 24 + lag(time) OVER (ORDER BY time), 0) AS h FROM lab")
def lab_hours(spark, sf):
    return experiment(spark, sf).hours().df.select("time", "h")


@query(f"WITH {LAB} SELECT time, round(n * 2.5 * 14.0, 6) AS \"n mg/L\" FROM lab")
def add_conc(spark, sf):
    return experiment(spark, sf).add_conc("n", 2.5, 14.0).df.select("time", F.round("n mg/L", 6).alias("n mg/L"))


# -- scalar time functions


@query("SELECT o_orderkey, CAST(make_timestamp((-2209161600000000 + (floor((o_orderkey % 50000 + 0.25) * 86400) * 1000000))::BIGINT) AS TIMESTAMP) AS t FROM orders")
def windows_serial_exact(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", timeconv.days_from_windows_serial(F.col("o_orderkey") % 50_000 + 0.25, exact=True).alias("t"))


@query("""WITH s AS (SELECT o_orderkey, (o_orderkey % 50000 + 0.25)::DOUBLE AS s FROM orders), y AS (SELECT *, floor(s / 365.25) AS y FROM s), d AS (SELECT *, least(floor(s - y * 365.25), 364)::INT AS n FROM y)
SELECT o_orderkey, make_timestamp(1900 + y::BIGINT, month(DATE '2023-01-01' + n), day(DATE '2023-01-01' + n), 0, 0, 0.0) + INTERVAL 6 HOUR AS t FROM d""")
def windows_serial_to_timestamp(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", timeconv.days_from_windows_serial(F.col("o_orderkey") % 50_000 + 0.25).alias("t"))


_EL = "(epoch_us(ts) - 1704067200000000)"


@query(f"SELECT event_id, floor({_EL} / 1e6) AS sec, floor({_EL} / 1e6) / 60 AS min, floor({_EL} / 1e6) / 3600 AS hr, floor({_EL} / 1e6) / 86400 AS d, {_EL} / 1e6 AS total FROM events")
def timedelta_units(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    ev = _table(spark, sf, "events")
    return ev.select("event_id", *[timeconv.elapsed(micros, u).alias(u) for u in ("sec", "min", "hr", "d")], timeconv.total_seconds(micros).alias("total"))


@query("SELECT DISTINCT dayofyear(o_orderdate)::BIGINT - 1 AS n, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day FROM orders WHERE year(o_orderdate) = 1995")
def month_days(spark, sf):
    """The days of the year that orders were made on, 1995 being a common year."""
    days = timeconv.month_days(spark)
    made = _table(spark, sf, "orders").where(F.year("o_orderdate") == 1995).select((F.dayofyear("o_orderdate") - 1).cast("long").alias("n")).distinct()
    return days.join(made, "n")


@query("SELECT event_id, date_trunc('minute', ts) AS t FROM events")
def parse_short_dates(spark, sf):
    return _table(spark, sf, "events").select("event_id", timeconv.parse_short(F.date_format("ts", "dd-MM-yy HH:mm:ss")).alias("t"))


# -- files


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, "files").path(name)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def read_csv(spark, sf):
    path = _folder(spark, "orders")
    _table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.option("header", True).option("sep", ";").csv(path)
    kinds = {f.name: f.dataType for f in _table(spark, sf, "orders").schema}
    return sources.read_text(spark, path, "csv", ";", schema=", ".join(f"{c} {kinds[c].simpleString()}" for c in ("o_orderkey", "o_custkey", "o_totalprice")))


@query("SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind, count(*) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def read_csv_widths(spark, sf):
    """Every fifth line is short and stays, every seventh has a value too many and goes."""
    path, i = _folder(spark, "events"), F.col("event_id")
    rest = F.when(i % 7 == 0, F.concat(F.col("event_type"), F.lit(",x"))).otherwise(F.when(i % 5 != 0, F.col("event_type")))
    line = F.when(rest.isNull(), i.cast("string")).otherwise(F.concat_ws(",", i.cast("string"), rest))
    lines = spark.createDataFrame([(-2, "# a comment"), (-1, "id,kind")], "n long, value string").unionByName(_table(spark, sf, "events").select(i.cast("long").alias("n"), line.alias("value")))
    lines.coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return sources.read_text(spark, sources.list_files(spark, path, "text")[0], "csv").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS id, c_name || chr(10) || '\"' || c_mktsegment || '\", ' AS note FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'id', 'note' FROM customer WHERE c_custkey % 5 = 0")
def read_csv_quoted(spark, sf):
    """Values with line ends, quotes and separators, after a byte-order mark; every fifth line is like the header."""
    path, i = _folder(spark, "quoted"), F.col("c_custkey")
    record = F.concat(i.cast("string"), F.lit(',"'), "c_name", F.lit('\n""'), "c_mktsegment", F.lit('"", "'))
    lines = _table(spark, sf, "customer").select(i.alias("n"), F.when(i % 5 == 0, F.lit("id,note")).otherwise(record).alias("value"))
    top = spark.createDataFrame([(-2, "\ufeff# by place"), (-1, "id,note")], "n long, value string")
    top.unionByName(lines).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return sources.read_text(spark, path, "csv")


def _books(pdf):
    """A workbook of the customers of a nation, as bytes."""
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda x: f"<c><v>{x}</v></c>" if isinstance(x, (int, float)) else f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    lines = [("c_custkey", "c_name", "c_acctbal"), *zip(pdf["c_custkey"].tolist(), pdf["c_name"], pdf["c_acctbal"].tolist())]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/a.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{"".join(map(cell, x))}</row>" for x in lines)}</sheetData></worksheet>')
    return type(pdf)({"path": [str(pdf["c_nationkey"].iloc[0])], "content": [out.getvalue()]})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_workbooks(spark, sf):
    """The customers of each nation in a workbook, made by tasks and read by tasks."""
    made = _table(spark, sf, "customer").groupBy("c_nationkey").applyInPandas(_books, "path string, content binary")
    kinds = {f.name: f.dataType.simpleString() for f in _table(spark, sf, "customer").schema}
    names = ["c_custkey", "c_name", "c_acctbal"]
    return excel.table(made, names, schema=", ".join(f"{n} {kinds[n]}" for n in names))


@query("SELECT n_regionkey, 1 AS files, count(*)::INT AS header FROM nation GROUP BY ALL")
def files_of_a_kind(spark, sf):
    """A folder for each region, with a file that has a comment line for each nation and then one more line."""
    path = _folder(spark, "texts")
    names = _table(spark, sf, "nation").select("n_regionkey", F.concat(F.lit("# "), "n_name").alias("value"))
    names.unionAll(names.select("n_regionkey", F.lit("t\tv")).distinct()).coalesce(1).sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(path)
    keys = [r[0] for r in _table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    found = {k: sources.list_files(spark, f"{path}/n_regionkey={k}", "text") for k in keys}
    return spark.createDataFrame([(k, len(f), sources.header_length(spark, f[0])) for k, f in found.items()], "n_regionkey int, files int, header int")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey::VARCHAR END AS n_regionkey FROM nation")
def join_files(spark, sf):
    """Two files, one of which lacks a column."""
    n = _table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    paths = []
    for k, some in enumerate((n.where("n_regionkey % 2 = 0"), n.where("n_regionkey % 2 = 1").drop("n_regionkey"))):
        path = _folder(spark, f"n{k}")
        some.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
        paths.append(path)
    return sources.join_files(spark, paths, "text").select("n_nationkey", "n_name", "n_regionkey")


@query(f"WITH {HOURLY} SELECT time, round(click, 6) AS click FROM hourly WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in KINDS))
def remove_empty_lines(spark, sf):
    return sources.remove_empty_lines(hourly(spark, sf).df).select("time", F.round("click", 6).alias("click"))


@query("SELECT replace(event_type, 'i', 'I.') AS value, count(*) AS n FROM events GROUP BY ALL")
def find_and_replace(spark, sf):
    path, to = _folder(spark, "in"), _folder(spark, "out")
    _table(spark, sf, "events").select("event_type").write.text(path)
    sources.find_and_replace(spark, path, to, ("i", "I."))
    return spark.read.text(to).groupBy("value").agg(F.count("*").alias("n"))


@query(f"WITH {LAB} SELECT time AS \"#.t\", n AS \".sewer.N\" FROM lab")
def read_model_output(spark, sf):
    path = _folder(spark, "model")
    rows = experiment(spark, sf).df.select(F.concat_ws("\t", "time", "n").alias("value"), F.lit(2).alias("ord"))
    top = spark.createDataFrame([("#.t\t.sewer.N", 0), ("d\tg/m3", 1)], "value string, ord int")
    top.unionByName(rows).coalesce(1).sortWithinPartitions("ord").select("value").write.text(path)
    return sources.read_model_output(spark, path)


@query(f"WITH {HOURLY} SELECT time, click, error, purchase, signup, view FROM hourly")
def export_all(spark, sf):
    return sinks.written(hourly(spark, sf).tag_nan("click"), "all")


@query(f"WITH {EV} SELECT series_key, time, CASE WHEN v >= 1.5 THEN v END AS v FROM ev")
def export_series(spark, sf):
    """Several series: the key is written beside the time."""
    return sinks.written(events(spark, sf).tag_extremes("v", limit=1.5), "filtered")


@query(f"WITH {EV} SELECT 'extremes: ' || count(*) || ' rows before, ' || count(*) FILTER (v >= 1.5) || ' after, ' || count(*) FILTER (v < 1.5) || ' removed' AS line FROM ev WHERE v IS NOT NULL")
def log_removed(spark, sf):
    """The line that a log on the driver gets."""
    s = events(spark, sf)
    s = s.where(F.col("v").isNotNull()).tag_extremes("v", limit=1.5)
    n = s.df.agg(F.count("*").alias("before"), F.count_if(F.col(valid("v")) == "original").alias("after")).first()
    with tempfile.NamedTemporaryFile("r", encoding="utf-8") as log:
        sinks.log_removed(log.name, n.before, n.after, "extremes")
        return spark.createDataFrame([(line.rstrip("\n"),) for line in log], "line string")


@query(f"WITH {EV} SELECT series_key, 'plant 7' AS tag, 'min' AS time_unit, 'm3/h' AS unit, count(*) AS n FROM ev GROUP BY ALL")
def set_metadata(spark, sf):
    """Tag and units go with the series through its operators, and with them all its rows."""
    s = events(spark, sf).set_tag("plant 7").set_time_unit("min").set_units({"v": "m3/h"}).tag_nan("v").tag_extremes("v", limit=1.5)
    return s.df.groupBy("series_key").agg(F.count("*").alias("n")).select("series_key", F.lit(s.tag).alias("tag"), F.lit(s.time_unit).alias("time_unit"), F.lit(s.units["v"]).alias("unit"), "n")


@query(f"WITH {HOURLY} SELECT count(*) FILTER (click IS NULL) AS missing, 1 AS warnings FROM hourly")
def filling_warning(spark, sf):
    """Two fillers of a series, one piece of advice."""
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        s = hourly(spark, sf).tag_nan("click")
        s.fill_interpolation("click", 4, RANGE).fill_ratio("click", "view", 1.0, RANGE)
    return s.df.agg(F.count_if(F.col("click").isNull()).alias("missing")).withColumn("warnings", F.lit(sum("small gaps" in str(w.message) for w in said)))


@query(f"WITH {HOURLY} SELECT hour(time)::INT AS hour, true AS refused FROM hourly WHERE hour(time) < 3 GROUP BY ALL")
def check_daily_profile(spark, sf):
    """A profile that lacks an hour of the points to fill is refused."""
    s, out = hourly(spark, sf).tag_nan("click"), []
    profile = s.daily_profile("click", RANGE)
    for hour in range(3):
        try:
            s.fill_standard("click", RANGE, profile.where(F.col("tod") != hour * 3_600_000_000), only_checked=False)
            out.append((hour, False))
        except KeyError:
            out.append((hour, True))
    return spark.createDataFrame(out, "hour int, refused boolean")


@query(f"WITH {HOURLY} SELECT time, round(CASE WHEN click <= 60 THEN click END, 9) AS click FROM hourly")
def export_filled(spark, sf):
    return sinks.written(hourly(spark, sf).tag_extremes("click", limit=60, method="above").add_filled("click"), "filled").select("time", F.round("click", 9).alias("click"))


@query(f"WITH {LAB} SELECT 0 AS ord, '#.t' || chr(9) || 'n' AS value UNION ALL SELECT 1, '#d' || chr(9) || 'g/m3' UNION ALL SELECT 2, time::BIGINT::VARCHAR || chr(9) || n::BIGINT::VARCHAR FROM lab")
def west_file(spark, sf):
    """Written, and read back by the order of part files."""
    s, path = experiment(spark, sf), _folder(spark, "west")
    s = s.with_df(s.df.select("series_key", "seq", F.col("time").cast("long").alias("time"), F.col("n").cast("long").alias("n")))
    sinks.write_west(s, path, ["g/m3"], ["n"])
    kind = F.when(F.col("value").startswith("#.t"), 0).when(F.col("value").startswith("#d"), 1).otherwise(2)
    return spark.read.text(path).select(kind.alias("ord"), "value")


@query(f"WITH {EV} SELECT 'extremes: ' || count(*) || ' rows before, ' || count(*) FILTER (v >= 1.5) || ' after, ' || count(*) FILTER (v < 1.5) || ' removed' AS line FROM ev")
def removed_rows(spark, sf):
    s = events(spark, sf).tag_extremes("v", limit=1.5)
    n = s.df.agg(F.count("*").alias("before"), F.count_if(F.col(valid("v")) == "original").alias("after")).first()
    return spark.createDataFrame([(report.removed_line(n.before, n.after, "extremes"),)], "line string")


# -- axes, metadata and flags


@query(f"WITH {LAB} SELECT n, time AS prev_index, total FROM lab")
def set_index(spark, sf):
    return experiment(spark, sf).set_index("n").df.select("n", "prev_index", "total")


@query("SELECT ts AS time, round_even((epoch_us(ts) - 1704067200000000) / 3600e6::DOUBLE, 5) AS time_rel FROM events")
def relative_time_from_start(spark, sf):
    ev = _table(spark, sf, "events").select(F.col("ts").alias("time"), "value")
    return OnlineSeries.wrap(ev, "time").relative_time("hr", inplace=False, start="2024-01-01 00:00:00").df.select("time", "time_rel")


@query(f"WITH {LAB}, k AS (SELECT count(*) AS k FROM lab WHERE time < (SELECT min(time) FROM lab) + 1) SELECT time, total FROM lab WHERE time < 10 OR time > 20 UNION ALL SELECT 10 + i * (10.0::DOUBLE / k), NULL FROM k, range(1000) AS r(i) WHERE i < k")
def fill_index_numeric(spark, sf):
    return experiment(spark, sf).fill_index((10, 20)).df.select("time", "total")


@query("SELECT o_orderkey, make_timestamp((o_orderkey % 40000) * 86400000000) AS t FROM orders")
def to_datetime_numeric(spark, sf):
    df = _table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 40_000).alias("t"))
    return formatting.to_datetime(df, "t", unit="D")


@query(f"""WITH {LAB}, t AS (SELECT time - min(time) OVER () AS x, time, total FROM lab), d AS (SELECT unnest(range(0, greatest(floor(max(x)), 1)::BIGINT)) AS d FROM t)
SELECT d + (SELECT min(time) FROM lab) AS day, round(avg(total), 3) AS mean, round(stddev_samp(total), 3) AS std FROM d JOIN t ON x >= d AND x <= d + 1 GROUP BY d""")
def daily_average_numeric(spark, sf):
    return stats.daily_average(experiment(spark, sf), "total").select("day", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query(f"""WITH {LAB}, t AS (SELECT time - min(time) OVER () AS x, total / n AS r FROM lab), w AS (SELECT unnest(range(0, (max(x) - 30)::BIGINT + 1)) AS "window" FROM t),
e AS (SELECT "window", avg(r) AS mean, stddev_samp(r) AS std FROM w JOIN t ON x >= "window" AND x <= "window" + 30 GROUP BY ALL)
SELECT "window"::BIGINT AS "window", round(mean, 6) AS mean, round(std, 6) AS std FROM e ORDER BY std / mean, "window" LIMIT 1""")
def best_ratio_window_numeric(spark, sf):
    return experiment(spark, sf).compare_ratio("total", "n", 30).select("window", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {HOURLY} SELECT time, 'original' AS tag FROM hourly")
def reset_tags(spark, sf):
    return hourly(spark, sf).tag_nan("click").reset_valid("click").df.select("time", F.col(valid("click")).alias("tag"))


@query(f"WITH {HOURLY} SELECT time, round(CASE WHEN {_GAP} THEN view * 1.1 ELSE click END, 6) AS value, {_NAN} AS origin FROM hourly")
def reset_provenance(spark, sf):
    return _filled(hourly(spark, sf).tag_nan("click").fill_ratio("click", "view", 1.1, RANGE).reset_fillmeta("click"), "click")


@query(f"WITH {HOURLY} SELECT count(*) FILTER ({R} AND view > 80) > 1 AS rain FROM hourly")
def rain_in_range(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rain = hourly(spark, sf).get_highs("view", 80, RANGE, "value").warn_of_rain(RANGE)
    return spark.createDataFrame([(bool(rain),)], "rain boolean")


@query(f"WITH {HOURLY} SELECT time, round((coalesce(click, view * 1.1) * error) / nullif(purchase, 0), 6) AS value FROM hourly")
def total_proportional_filled(spark, sf):
    s = hourly(spark, sf).tag_nan("click").fill_ratio("click", "view", 1.1, ("2024/1/1", "2024/1/31")).add_filled("error", "purchase")
    return s.total_proportional("purchase", ["click"], ["error"], "conc", use_filled=True).df.select("time", F.round(filled("conc"), 6).alias("value"))


@query(f"WITH {LAB} SELECT time, total, n FROM lab")
def lab_lines(spark, sf):
    return LabSeries.wrap(experiment(spark, sf).df, "time").wide("total", "n").select("time", "total", "n")


@query(f"WITH {LAB} SELECT time, total FROM lab WHERE abs(total) <= 700000")
def lab_sensor_peaks(spark, sf):
    return LabSeries.wrap(experiment(spark, sf).df, "time").drop_peaks("total", 700_000).df.select("time", "total")


# -- reliability with ranges, tags and random gaps

_HALF = ("2024/1/3", "2024/1/15")


@query("SELECT 'click' AS \"column\", 0.0::DOUBLE AS imputation_error_pct")
def filling_error_of_an_exact_filler(spark, sf):
    """The filler works in half of the test range and is exact there."""
    s = hourly(spark, sf)
    s = s.add(twin=F.col("click"))
    return check_filling_error(s, 5, "click", "fill_ratio", ("2024/1/2", "2024/1/30"), 10, 5, 2, 30, seed=3, use="twin", ratio=1.0, arange=_HALF)


@query(ORACLES["filling_error_fixed_gaps"])
def filling_error_after_tags(spark, sf):
    """Earlier tags and fills don't matter."""
    s = hourly(spark, sf).tag_nan("click").tag_extremes("click", limit=60, method="above").fill_ratio("click", "view", 9.0, RANGE)
    gaps = spark.createDataFrame(_FIXED, "iteration int, start int, size int")
    return filling_error(s, "click", "fill_ratio", gaps, use="view", ratio=1.1, arange=("2024/1/1", "2024/1/30")).select("iteration", F.round("error_pct", 6).alias("error_pct"))


@query(f"""WITH {HOURLY}, part AS (SELECT *, row_number() OVER (ORDER BY time) AS rn FROM hourly WHERE time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-31'),
ends AS (SELECT min(rn) AS a, max(rn) AS z FROM part WHERE time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-16'),
draws AS (SELECT seed, id, id // number AS it, most, ('0x' || substr(md5(seed || '|start|' || id || '|0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5(seed || '|size|' || id || '|0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v
  FROM (VALUES (10, 6, 5), (11, 2, 30)) AS k(seed, number, most), range(60) AS r(id) WHERE id < 5 * number),
gaps AS (SELECT it, a + floor(u * greatest(z - a, 1)) AS s, floor(v * most) AS n, z FROM draws, ends),
spots AS (SELECT DISTINCT it, unnest(range(s::BIGINT, least(s + n, z + 1)::BIGINT)) AS rn FROM gaps),
each AS (SELECT it, avg(abs(click - view * 1.1) / nullif(click, 0)) * 100 AS e FROM spots JOIN part USING (rn) GROUP BY it)
SELECT 'click' AS "column", round(avg(e), 6) AS imputation_error_pct FROM each""")
def filling_error_random_ratio(spark, sf):
    found = check_filling_error(hourly(spark, sf), 5, "click", "fill_ratio", ("2024/1/2", "2024/1/30"), 6, 5, 2, 30, seed=5, use="view", ratio=1.1, arange=_HALF)
    return found.select("column", F.round("imputation_error_pct", 6).alias("imputation_error_pct"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, then fills, a month of one sensor: time, value, tag, filled value and its origin."""
    s = hourly(spark, sf_dir).tag_nan("click").tag_doubles("click", 0.05).tag_extremes("click", limit=200, method="above").fill_interpolation("click", 4, ("2024/1/1", "2024/1/30"))
    return s.df.select("time", "click", F.col(valid("click")).alias("tag"), F.col(filled("click")).alias("filled"), F.col(fillmeta("click")).alias("origin"))
