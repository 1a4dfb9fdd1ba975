"""Hand-made series with their expected tags and fills; order, chunks and properties."""

from __future__ import annotations

import math
import random
import warnings
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.api import LabExperiment, LabSeries, OnlineSeries
from tidegauge.operators import filling, formatting, lab, reliability, report, smoothing, stats, tagging
from tidegauge.plans.series import filled, fillmeta, valid

T0 = datetime(2024, 1, 1)


def series(spark, values, minutes=5, chunk_rows=None, start=T0, partitions=1, **more):
    rows = [(start + timedelta(minutes=minutes * i), i, float(v) if v is not None else None, *[x[i] for x in more.values()]) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    kinds = "".join(f", {k} double" for k in more)
    return OnlineSeries.wrap(spark.createDataFrame(rows, f"time timestamp_ntz, seq long, v double{kinds}").repartition(partitions), chunk_rows=chunk_rows)


def tags(s, c="v"):
    return "".join(r[0][0] for r in s.df.orderBy("time", "seq").select(valid(c)).collect())


def column(s, c):
    return [r[0] for r in s.df.orderBy("time", "seq").select(c).collect()]


def test_tag_nan(spark):
    s = series(spark, [1, None, 3]).tag_extremes("v", limit=2)
    assert tags(s) == "foo" and tags(s.tag_nan("v")) == "ofo" and tags(s.tag_nan("v", preserve_tags=True)) == "ffo"


def test_tag_doubles(spark):
    s = series(spark, [5, 5.01, None, 5.02, 9])
    assert tags(s.tag_doubles("v", 0.05)) == "ffofo" and tags(s.tag_doubles("v", 0.05, tag_first=False)) == "ofofo"
    assert column(s.tag_doubles("v", 0.05, final=True), "v") == [None, None, None, None, 9]


def test_tag_extremes(spark):
    s = series(spark, [0, 5, 11, None, 100])
    assert tags(s.tag_extremes("v", limit=5)) == "foooo" and tags(s.tag_extremes("v", limit=11, method="above")) == "oooof"
    with pytest.raises(ValueError):
        s.tag_extremes("v", method="beside")


def test_moving_filters(spark):
    s = series(spark, [1, 2, 50, 3, 4])
    whole = (T0, T0 + timedelta(hours=1))
    assert tags(s.moving_slope_filter("v", 5, whole, time_unit="min")) == "ooffo"
    part = (T0 + timedelta(minutes=10), T0 + timedelta(minutes=15))
    assert tags(s.moving_slope_filter("v", 5, part, time_unit="min")) == "ffoff"
    assert tags(s.moving_slope_filter("v", 5, part, time_unit="min", strict_range=True)) == "ooofo"
    with pytest.raises(TypeError):
        s.slopes("v")
    with pytest.raises(ValueError):
        s.slopes("v", time_unit="weeks")


@pytest.mark.parametrize("window", [3, 4, 12])
def test_moving_average(spark, window):
    values = [float(i * i) for i in range(30)]
    got = column(series(spark, values).moving_average("v", window), "v")
    want = pd.Series(values).rolling(window, center=True).mean().tolist()
    assert got == pytest.approx(want, nan_ok=True) or [g is None for g in got] == [w != w for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w == w])


def test_interpolation_limits(spark):
    values = [None] * 3 + [1, None, 3] + [None] * 3 + [7, 8] + [None] * 6 + [15] + [None] * 4
    whole = (T0, T0 + timedelta(days=1))
    s = series(spark, values).tag_nan("v").fill_interpolation("v", 4, whole)
    want = pd.Series(values, dtype=float).interpolate(limit=4).tolist()
    assert column(s, filled("v")) == pytest.approx([None if w != w else w for w in want])
    origin = column(s, fillmeta("v"))
    assert origin[:6] == ["filled_interpol"] * 3 + ["original", "filled_interpol", "original"] and set(origin[11:17]) == {"filtered"} and set(origin[18:]) == {"filtered"}
    t = series(spark, values).tag_nan("v").fill_interpolation("v", 4, whole, require_value=True, only_targets=True)
    assert column(t, fillmeta("v"))[0] == "filtered" and column(t, filled("v"))[11] is None


@pytest.mark.parametrize("seed", range(2))
def test_chunks_change_nothing(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, None, float(rng.randrange(20))]) for _ in range(200)]
    whole = (T0, T0 + timedelta(days=9))

    def chain(chunk, partitions):
        s = series(spark, values, 60, chunk, partitions=partitions, u=[float(i % 7) for i in range(200)]).tag_nan("v").tag_doubles("v", 2.0)
        s = s.moving_slope_filter("v", 9, whole, time_unit="hr", true_elapsed=True, strict_range=True).fill_interpolation("v", 3, whole)
        s = smoothing.moving_average(s, "v", 7, to="m").moving_average_filter("u", 4, 0.5, whole).done()
        s = stats.runs(s, F.col(valid("v")), whole, "size").done()
        return s.df.orderBy("time").select("time", "v", valid("v"), filled("v"), fillmeta("v"), "m", valid("u"), "size").collect()

    plain = chain(None, 1)
    for chunk, partitions in ((16 if seed else 64, 3),):
        for a, b in zip(plain, chain(chunk, partitions)):
            assert a[:3] == b[:3] and a[4] == b[4] and a[6:] == b[6:] and a[3] == pytest.approx(b[3]) and a[5] == pytest.approx(b[5])


def test_daily_profile(spark):
    s = series(spark, [1, 2, None, 4, 3, 4, 5, 6], 360)
    got = {r.tod // 3_600_000_000: r for r in s.daily_profile("v", ("2024/1/1", "2024/1/2")).collect()}
    assert got[0].avg == 2 and got[0].std == pytest.approx(2**0.5) and got[12].avg == 5 and got[12].std is None and got[18].q_upper == pytest.approx(5.8)
    bypos = {r.tod // 3_600_000_000: r.avg for r in s.daily_profile("v", ("2024/1/1", "2024/1/2"), positional=True).collect()}
    assert bypos == {h: r.avg for h, r in got.items()}


def test_duplicates(spark):
    df = spark.createDataFrame([(T0, 0, None, 5.0), (T0, 1, 1.0, 6.0)], "time timestamp_ntz, seq long, a double, b double")
    s = OnlineSeries.wrap(df)
    assert s.drop_duplicates().df.select("a", "b").first() == (None, 5.0) and s.drop_duplicates("first_nonnull").df.select("a", "b").first() == (1.0, 5.0)


def test_correlation(spark):
    u = [float(i) for i in range(20)]
    s = series(spark, [2 * x + 1 for x in u], u=u)
    whole = (T0, T0 + timedelta(days=1))
    r = s.correlation("u", "v", whole).first()
    assert (r.slope, r.intercept, r.r_squared) == pytest.approx((2, 1, 1))
    z = s.correlation("u", "v", whole, zero_intercept=True).first()
    x, y = np.array(u), 2 * np.array(u) + 1
    assert (z.slope, z.r_squared) == pytest.approx(((x @ y) / (x @ x), (x @ y) ** 2 / ((x @ x) * (y @ y))))
    # fixed values: the published quantiles of Student's distribution
    for df, t in {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 10: 2.2281, 30: 2.0423, 60: 2.0003, 120: 1.9799}.items():
        assert stats.t_quantile(0.975, df) == pytest.approx(t, abs=5e-5)


@pytest.mark.parametrize("n", [3, 4, 5, 12, 40])
def test_prediction_interval(spark, n):
    """Against the formula with published quantiles, from one degree of freedom on."""
    t = {1: 12.7062, 2: 4.3027, 3: 3.1824, 10: 2.2281, 38: 2.0244}[n - 2]
    x = [float(i) for i in range(n)]
    y = [2 * v + (-1) ** i for i, v in enumerate(x)]
    s = series(spark, y, u=x)
    rows = sorted(s.prediction_interval("u", "v", (T0, T0 + timedelta(days=1))).collect(), key=lambda r: r.x)
    slope, intercept = np.polyfit(x, y, 1)
    rest = np.array(y) - (slope * np.array(x) + intercept)
    half = t * np.sqrt((rest @ rest) / (n - 2)) * np.sqrt(1 + 1 / n + (np.array(x) - np.mean(x)) ** 2 / ((np.array(x) - np.mean(x)) ** 2).sum())
    assert [r.upper - r.fit for r in rows] == pytest.approx(half, rel=1e-4) and [r.fit - r.lower for r in rows] == pytest.approx(half, rel=1e-4)


def test_profile_of_original_points(spark):
    """Added rows (!!) count no more than filtered ones."""
    s = series(spark, [1, 2, 3, 4], 720).tag_extremes("v", limit=4, method="above")
    extra = spark.createDataFrame([(0, T0 + timedelta(hours=h)) for h in (0, 12, 24, 36, 48)], "series_key int, time timestamp_ntz")
    more = s.reindex_times(extra).add(v=F.coalesce("v", F.lit(99.0)))
    got = {r.tod: r.avg for r in more.daily_profile("v", ("2024/1/1", "2024/1/3"), only_checked=True).collect()}
    assert sorted(got.values()) == [2, 3]


def test_quantiles_of_long_series(spark):
    rng = random.Random(3)
    values = [rng.choice([None, float(rng.randrange(20)), rng.random()]) for _ in range(300)]
    known = pd.Series(values, dtype=float).dropna()
    for p in (0, 0.1, 0.5, 0.9, 1):
        plain, cut = (tagging.quantiles(series(spark, values, chunk_rows=k, partitions=3), "v", p).first().quantile for k in (None, 50))
        assert plain == pytest.approx(known.quantile(p)) and cut == pytest.approx(plain)


def test_chunked_by_input_size(spark, tmp_path, monkeypatch):
    from tidegauge.plans import series as plans

    df = spark.range(1000).select(F.col("id").cast("double").alias("time"), F.rand(1).alias("v"))
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert OnlineSeries.wrap(read).chunk_rows is None and 5_000 < plans.input_bytes(read) < 100_000
    monkeypatch.setattr(plans, "AUTO_BYTES", 1000)
    assert OnlineSeries.wrap(read).chunk_rows == plans.AUTO_ROWS and OnlineSeries.wrap(read, chunk_rows=None).chunk_rows is None
    assert OnlineSeries.wrap(read).previous(p=(F.col("v"), False)).df.where("p is null").count() == 1


def test_nearest(spark):
    s = OnlineSeries.wrap(spark.createDataFrame([(5.0, 0, None), (6.0, 1, None), (-3.0, 2, None), (99.0, 3, None)], "time double, seq long, v double"))
    model = spark.createDataFrame([(0.0, 1.0), (10.0, 2.0)], "time double, value double")
    assert column(s.tag_nan("v").fill_model("v", model, (-10, 100)), filled("v")) == [1, 1, 2, 2]


def test_slope_wraps(spark):
    s = OnlineSeries.wrap(spark.createDataFrame([(T0, 0, 0.0), (T0 + timedelta(days=1, seconds=10), 1, 5.0)], "time timestamp_ntz, seq long, v double"))
    get = lambda **k: column(s.slopes("v", to="s", **k), "s")[1]
    assert get(time_unit="sec") == 0.5 and get(time_unit="sec", true_elapsed=True) == pytest.approx(5 / 86410) and get(time_unit="d") == pytest.approx(5 / (1 + 10 / 86400))


def test_ratio_with_zero(spark):
    s = series(spark, [1, 2, 3], u=[1.0, 0.0, 2.0])
    r = s.calc_ratio("v", "u", (T0, T0 + timedelta(hours=1))).first()
    assert r.mean == pytest.approx(1.25) and r.std == pytest.approx(np.std([1, 1.5], ddof=1))


def test_filling_error(spark):
    s = series(spark, [10, 0, 20, 40, 50], u=[11.0, 1.0, 22.0, 44.0, 55.0])
    gaps = spark.createDataFrame([(0, 1, 3), (1, 5, 1)], "iteration int, start int, size int")
    got = {r.iteration: r.error_pct for r in s.filling_error("v", "fill_ratio", gaps, use="u", ratio=1.0, arange=(T0, T0 + timedelta(hours=1))).collect()}
    assert got == pytest.approx({0: 10, 1: 10})
    with pytest.raises(ValueError):
        s.filling_error("v", "fill_magic", gaps)
    with pytest.raises(ValueError):
        s.check_filling_error(3, "v", "fill_ratio", (T0, T0 + timedelta(hours=1)))
    zero = reliability.create_gaps(s, gaps, "v")
    assert zero.df.where("__gap and v != 0").count() == 0 and zero.df.count() == 10


def test_filling_error_ranges_and_tags(spark):
    """Gaps lie where the filler works, so one that is exact has no error; earlier tags don't matter."""
    n = 60
    s = series(spark, [float(10 + i % 7) for i in range(n)], u=[float(10 + i % 7) for i in range(n)])
    whole, half = (T0, T0 + timedelta(minutes=5 * n)), (T0, T0 + timedelta(minutes=5 * n // 2))
    exact = s.check_filling_error(8, "v", "fill_ratio", whole, 5, 6, seed=3, use="u", ratio=1.0, arange=half).first()
    assert exact.imputation_error_pct == 0
    gaps = reliability.random_gaps(s, 8, 50, 40, half, 3).collect()
    assert all(1 <= g.start <= 30 and g.start + g.size <= 32 for g in gaps) and max(g.start + g.size for g in gaps) == 32
    gap = spark.createDataFrame([(0, 20, 6)], "iteration int, start int, size int")
    plain = s.filling_error("v", "fill_interpolation", gap, range_=10, arange=whole).first().error_pct
    tagged = s.tag_extremes("v", limit=12).tag_nan("v", preserve_tags=True).fill_ratio("v", "u", 2.0, whole)
    assert plain > 0 and tagged.filling_error("v", "fill_interpolation", gap, range_=10, arange=whole).first().error_pct == plain


def test_filling_warnings(spark):
    """Advice once for a series and its descendants; rain at every filler, unless switched off."""
    whole = (T0, T0 + timedelta(hours=1))
    s = series(spark, [1, None, 3, 4], u=[1.0, 2.0, 3.0, 4.0]).tag_nan("v")
    with pytest.warns(UserWarning, match="small gaps first"):
        t = s.fill_ratio("v", "u", 1.0, whole)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        t.fill_interpolation("v", 2, whole)
    wet = t.get_highs("u", 1, whole, "value")
    for _ in range(2):
        with pytest.warns(UserWarning, match="rain"):
            wet.fill_ratio("v", "u", 1.0, whole)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        replace(wet, rain_checks=False).fill_ratio("v", "u", 1.0, whole)
        wet.check_filling_error(1, "v", "fill_ratio", whole, 1, 2, use="u", ratio=1.0, arange=whole).collect()
    with pytest.raises(TypeError):
        t.fill_standard("v", whole, {"tod": 1})


def test_nearest_of_many_series(spark):
    """One model for all series: each row takes the value nearest in time, whatever its series and slice."""
    rng = random.Random(4)
    rows = [(f"k{i % 3}", T0 + timedelta(minutes=rng.randrange(9 * 1440)), i, None) for i in range(60)]
    model = sorted((T0 + timedelta(minutes=rng.randrange(9 * 1440)), float(i)) for i in range(12))
    s = OnlineSeries.wrap(spark.createDataFrame(rows, "time_key string, time timestamp_ntz, seq long, v double"), key="time_key").tag_nan("v")
    got = s.fill_model("v", spark.createDataFrame(model, "time timestamp_ntz, value double"), (T0, T0 + timedelta(days=10)))
    for r in got.df.collect():
        best = min(model, key=lambda m: (abs(m[0] - r.time), m[0]))
        assert r[filled("v")] == best[1]


def test_scratch_tables_are_released(spark):
    import os

    from tidegauge.plans.scratch import Scratch, released

    outer = Scratch(spark, "outer")
    kept = outer.save(spark.range(3).toDF("a"), "t")
    with released():
        inner = Scratch(spark, "inner")
        inner.save(kept, "t")
        path = inner.top.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_data_never_change(spark):
    s = series(spark, [1, None, 1.01, 50, 2, None])
    whole = (T0, T0 + timedelta(hours=1))
    t = s.tag_nan("v").tag_doubles("v", 0.1).tag_extremes("v", limit=10, method="above").moving_slope_filter("v", 3, whole, time_unit="min").fill_interpolation("v", 3, whole)
    assert column(t, "v") == column(s, "v")
    for r in t.df.collect():
        assert r[fillmeta("v")] != "original" or r[valid("v")] == "original"


def test_day_before_and_profile_errors(spark):
    s = series(spark, [1] * 24 + [None] * 24, 60).tag_nan("v")
    got = s.fill_daybefore("v", ("2024/1/2", "2024/1/2"), (0.5, 4))
    assert set(column(got, fillmeta("v"))[24:]) == {"filled_profile_day_before"} and column(got, filled("v"))[25] == 1
    short = s.fill_daybefore("v", ("2024/1/2", "2024/1/2"))
    assert set(column(short, fillmeta("v"))[24:]) == {"filtered"}
    with pytest.raises(ValueError):
        s.fill_standard("v", ("2024/1/2", "2024/1/2"))
    profile = s.daily_profile("v", ("2024/1/1", "2024/1/1")).where("tod > 0")
    with pytest.raises(KeyError):
        s.fill_standard("v", ("2024/1/2", "2024/1/2"), profile, check=True)


def test_savgol(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=40).cumsum()
    got = column(series(spark, y).savgol("v", 9, 3), "v")
    want = [np.polyval(np.polyfit(np.arange(9), y[max(0, min(i - 4, 31)) :][:9], 3), i - max(0, min(i - 4, 31))) for i in range(40)]
    assert got == pytest.approx(want)
    assert column(series(spark, y[:5]).savgol("v", 9, 3), "v") == [None] * 5


def test_ranges(spark):
    s = series(spark, range(48), 60)
    assert stats.averages(s.where(tagging.in_range(s, ("2024/1/2", "2024/1/2"))), "v").first().v == pytest.approx(35.5)
    with pytest.raises(TypeError):
        s.get_highs("v", 1, (1, 2), "value")
    x = OnlineSeries.wrap(spark.createDataFrame([(1.0, 1.0)], "time double, v double"))
    with pytest.raises(TypeError):
        x.get_highs("v", 1, ("2024/1/1", "2024/1/2"), "value")
    with pytest.raises(TypeError):
        OnlineSeries.wrap(spark.createDataFrame([("a", 1.0)], "time string, v double"))
    with pytest.raises(ValueError):
        OnlineSeries.wrap(spark.createDataFrame([(1.0, "x")], "time double, v__valid string"))


def test_nan_is_missing(spark):
    s = OnlineSeries.wrap(spark.createDataFrame([(0.0, float("nan")), (1.0, 2.0)], "time double, v double"))
    assert tags(s.tag_nan("v")) == "fo" and s.averages("v").first().v == 2


def test_numeric_axis(spark):
    s = OnlineSeries.wrap(spark.createDataFrame([(i / 4, float(i)) for i in range(9)], "time double, v double"))
    days = {r.day: r.mean for r in s.daily_average("v").collect()}
    assert days == {0.0: 2.0, 1.0: 6.0}
    got = s.fill_standard("v", (0, 2), s.daily_profile("v", (0, 1)), only_checked=False)
    assert column(got, filled("v"))[:2] == [2, 3]
    assert {r.window for r in s.compare_ratio("v", "time", 1).collect()} <= {0, 1}
    assert column(s.fill_index((0.5, 1.5)), "v")[:2] == [0, 1]


def test_lab(spark):
    df = spark.createDataFrame([(0.0, 7.0, 4.0), (1.0, 7.5, 2.0), (3.0, 7.2, 1.0)], "time double, pH double, c double")
    s = LabExperiment.wrap(df)
    assert s.in_out("c").first().in_out == 3 and s.removal("c").first().removal == 0.75
    assert column(s.calc_slope("c", time="time"), "c slope") == [None, 2.0, 0.5]
    assert column(s.hours(), "h") == [0, 24, 73] and column(s.add_conc("c", 2, 3), "c mg/L") == [24, 12, 6]
    with pytest.warns(UserWarning):
        s.warn_of_ph()
    t = LabSeries.wrap(df)
    assert t.drop_peaks("pH", 7.2).df.count() == 2 and column(t.select_slope("pH"), "pH") == [7.5, 7.2] and column(lab.select_slope(t, "pH", down=False), "pH") == [7.0]


def test_metadata_and_index(spark):
    s = series(spark, [1, 2]).set_tag("a").set_time_unit("d").set_units({"v": "m"})
    assert (s.tag, s.time_unit, s.units) == ("a", "d", {"v": "m"}) and OnlineSeries.wrap(s.df).units == {}
    t = s.relative_time("hr")
    assert column(t, "time") == pytest.approx([0, 0.08333]) and t.time_unit == "hr" and "time_abs" in t.df.columns
    assert s.set_index("v").time == "v"
    with pytest.raises(ValueError):
        s.set_index("time")
    assert formatting.head(s, 1).count() == 1 and report.wide(s, "v").columns == ["series_key", "time", "v"]


def test_observation(spark):
    df, seen = report.observed(series(spark, [1, None, 3]).df.where("v > 1"), "kept")
    df.collect()
    assert seen.get["rows"] == 1 and "2 removed" in report.removed_line(3, 1)


def test_rain(spark):
    s = series(spark, [1, 2, 3, 4]).get_highs("v", 1, (T0, T0 + timedelta(hours=1)), "value")
    with pytest.warns(UserWarning):
        assert filling.warn_of_rain(s, (T0, T0 + timedelta(hours=1)))


def _polynomials(values, window, order):
    """Savitzky-Golay by a least-squares fit of each window."""
    half, n = window // 2, len(values)
    if n < window:
        return [None] * n
    out = []
    for i in range(n):
        centre = min(max(i, half), n - half - 1)
        some = values[centre - half : centre + half + 1]
        if None in some:
            out.append(None)
            continue
        x = (np.arange(window) - half) / max(half, 1)
        out.append(float(np.polyval(np.polyfit(x, some, order), (i - centre) / max(half, 1))))
    return out


@pytest.mark.parametrize("chunk, window, order", [(None, 7, 2), (40, 7, 3), (None, 101, 2), (40, 101, 4), (40, 5, 0)])
def test_savgol_by_moments(spark, chunk, window, order):
    """Series with null and other keys, missing values, and fewer rows than a window."""
    rng = random.Random(window)
    long = [1e3 + 50 * math.sin(i / 9) + rng.random() for i in range(260)]
    long[150] = None
    given = {None: long, "b": [float(i * i) for i in range(window)], "c": [1.0, 2.0, 3.0], "d": [5.0] * 130}
    rows = [(k, float(i), v) for k, values in given.items() for i, v in enumerate(values)]
    s = OnlineSeries.wrap(spark.createDataFrame(rows, "k string, t double, v double").repartition(3), time="t", key="k", chunk_rows=chunk)
    got = {(r.k, r.t): r.m for r in s.savgol("v", window, order, to="m").df.collect()}
    want = {(k, float(i)): m for k, values in given.items() for i, m in enumerate(_polynomials(values, window, order))}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(m, rel=1e-9, abs=1e-7) if m is not None else got[k] is None for k, m in want.items())


@pytest.mark.parametrize("window", [5, 33, 64, 90])
def test_frames_of_any_length(spark, window):
    """A frame may be longer than a chunk; chunks and running sums change nothing."""
    rng = random.Random(window)
    values = [rng.choice([None, 5.0, 1e6, rng.random()]) if 100 < i < 140 else rng.random() * 1e3 for i in range(200)]
    plain = pd.Series(values, dtype=float)
    lead = plain.rolling(window).mean().shift(-((window - 1) // 2))
    for chunk in (None, 16, 64):
        s = series(spark, values, chunk_rows=chunk, partitions=3)
        got = [r.m for r in s.moving_average("v", window, to="m", interpolate=False).df.orderBy("time").collect()]
        assert [x is None for x in got] == lead.isna().tolist() and np.allclose([x for x in got if x is not None], lead.dropna(), rtol=1e-11)
        tops = s.framed(window - 1, 0, top=lambda frame: F.max("v").over(frame)).df.orderBy("time").collect()
        assert [r.top for r in tops] == [max((v for v in values[max(0, i - window + 1) : i + 1] if v is not None), default=None) for i in range(200)]


def test_positions_of_one_moment(spark):
    """All rows in one day, even at one time, are dealt over partitions and still numbered in order."""
    rows = [("a", datetime(2024, 1, 1), i, float(i)) for i in range(3_000)] + [(None, datetime(2024, 1, 1, 0, i % 7), i, 1.0) for i in range(100)]
    s = OnlineSeries.wrap(spark.createDataFrame(rows, "k string, time timestamp_ntz, seq long, v double").repartition(5), key="k", seq="seq", chunk_rows=100)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        got = s.positions().df
        assert [r["__rn"] for r in got.where("k = 'a'").orderBy("seq").collect()] == list(range(1, 3_001))
        assert [r["__rn"] for r in got.where("k IS NULL").orderBy("time", "seq").collect()] == list(range(1, 101))
        assert got.where("__chunk <> floor((__rn - 1) / 100)").count() == 0
    finally:
        spark.conf.unset(conf)


def test_null_keys_stay(spark):
    """A series with a null key is a series: no operator that joins loses its rows."""
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=h), float(h % 24)) for k in (None, "b") for h in range(72)]
    s = OnlineSeries.wrap(spark.createDataFrame(rows, "k string, time timestamp_ntz, v double"), key="k")
    for chunk in (None, 10):
        t = replace(s, chunk_rows=chunk)
        for out in (t.savgol("v", 5), t.moving_average("v", 3), t.moving_average("v", 40), t.tag_nan("v").tag_doubles("v", 0.5), t.moving_average_filter("v", 4, 0.5, ("2024/1/1", "2024/1/3"))):
            assert out.df.groupBy("k").count().where("count = 72").count() == 2
    for positional in (False, True):
        got = s.daily_profile("v", ("2024/1/1", "2024/1/3"), positional=positional)
        assert got.groupBy("k").count().where("count = 24").count() == 2 and got.where("avg <> tod / 3600e6").count() == 0


def test_axis_in_blocks(spark, monkeypatch):
    """A spine of many steps is made in blocks; equal first times don't make a step of zero."""
    rows = [(k, T0 + timedelta(seconds=s), i, 1.0) for k in (None, "b") for i, s in enumerate((0, 0, 10, 25))] + [("one", T0, 0, 1.0)]
    s = OnlineSeries.wrap(spark.createDataFrame(rows, "k string, time timestamp_ntz, seq long, v double"), key="k", seq="seq")
    plain = s.fill_index(("2024/1/2", "2024/1/3")).df.where("time >= '2024-01-02'")
    assert plain.groupBy("k").count().where("count = 8640").count() == 2 and plain.where("k = 'one'").count() == 0
    monkeypatch.setattr(formatting, "SPINE_ROWS", 1000)
    cut = s.fill_index(("2024/1/2", "2024/1/3")).df.where("time >= '2024-01-02'")
    assert cut.exceptAll(plain).count() == 0 and plain.exceptAll(cut).count() == 0


def test_exports_of_several_series(spark, tmp_path):
    """The key is written, and rows of equal time are in order of seq within their series."""
    rows = [(k, T0 + timedelta(hours=h // 2), h, float(h)) for k in ("b", "a") for h in range(6)]
    s = OnlineSeries.wrap(spark.createDataFrame(rows, "k string, time timestamp_ntz, seq long, v double").repartition(4), key="k", seq="seq")
    s.write_series(str(tmp_path / "one"), single_file=True)
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "one")).collect()
    assert got[0].asDict().keys() == {"k", "time", "v"} and [(r.k, float(r.v)) for r in got] == [(k, float(h)) for k in "ab" for h in range(6)]


def test_group_quantiles(spark):
    """Exact in groups of any size: one value, ties, a group that is much larger than the sketch is exact for."""
    rng = random.Random(6)
    groups = {(None, 1): [3.0], ("a", 1): [1.0, 2.0], ("a", 2): [5.0] * 700 + [6.0] * 800, ("a", None): [rng.gauss(0, 9) for _ in range(20_000)], ("b", 1): [float(rng.randrange(30)) for _ in range(5_000)], ("c", 1): [rng.random() for _ in range(1_001)]}
    rows = [(*k, v) for k, some in groups.items() for v in some] + [("a", 1, None), ("d", 1, None)]
    table = spark.createDataFrame(rows, "k string, n int, v double").repartition(5)
    ps = {"low": 0.1, "mid": 0.5, "high": 0.9, "all": 1.0, "least": 0.0}
    got = {(r.k, r.n): r for r in stats.group_quantiles(table, ["k", "n"], "v", ps).collect()}
    assert got.keys() == groups.keys()
    for k, some in groups.items():
        assert [got[k][name] for name in ps] == pytest.approx([float(np.quantile(some, p)) for p in ps.values()], rel=1e-12)


def test_profile_of_chunks(spark):
    """With chunks, quantiles come from brackets; the profile is the same."""
    rng = random.Random(2)
    values = [rng.choice([None, rng.random() * 9]) if i % 5 == 0 else rng.random() for i in range(288 * 12)]
    plain, cut = (series(spark, values, chunk_rows=n, partitions=3).daily_profile("v", ("2024/1/1", "2024/1/12")).orderBy("tod").collect() for n in (None, 500))
    assert len(plain) == 288 and [tuple(r)[1] for r in plain] == [tuple(r)[1] for r in cut]
    assert np.allclose([tuple(r)[2:] for r in plain], [tuple(r)[2:] for r in cut])


def test_nearest_in_ranges(spark):
    """With chunks, a day with all rows is dealt over ranges; null keys stay, and nothing changes."""
    rng = random.Random(12)
    rows = [(k, T0 + timedelta(seconds=rng.randrange(3_000)), i, rng.choice([None, 1.0])) for i in range(300) for k in (None, "b")]
    frame = spark.createDataFrame(rows, "k string, time timestamp_ntz, seq long, v double").repartition(4)
    model = spark.createDataFrame([(T0 + timedelta(seconds=17 * i), float(i)) for i in range(150)], "time timestamp_ntz, value double")
    plain, cut = (OnlineSeries.wrap(frame, key="k", seq="seq", chunk_rows=n).tag_nan("v").fill_model("v", model, ("2024/1/1", "2024/1/2")) for n in (None, 40))
    get = lambda s: sorted(map(str, s.df.select("k", "time", "seq", filled("v"), fillmeta("v")).collect()))
    assert len(get(cut)) == 600 and get(plain) == get(cut)
    profile = spark.createDataFrame([(k, i / 10, float(i)) for k in (None, "b") for i in range(10)], "k string, tod double, avg double")
    numbers = spark.createDataFrame([(k, i / 7, i, None if i % 3 else 1.0) for k in (None, "b") for i in range(70)], "k string, t double, seq long, v double")
    plain, cut = (OnlineSeries.wrap(numbers, time="t", key="k", seq="seq", chunk_rows=n).tag_nan("v").fill_standard("v", (0, 9), profile) for n in (None, 20))
    get = lambda s: sorted(map(str, s.df.select("k", "t", filled("v"), fillmeta("v")).collect()))
    assert len(get(cut)) == 140 and get(plain) == get(cut)
    counts = [sum(f"k={k}" in x and "average_profile" in x for x in get(cut)) for k in ("None", "'b'")]
    assert counts[0] == counts[1] > 30
