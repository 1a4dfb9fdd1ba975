from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.api import OnlineSeries
from tidegauge.streaming import daily_average_stream, last_value_stream, slope_filter_stream, slopes_stream, tag_stream


@pytest.fixture
def stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    for part in range(3):
        rows = [(t0 + timedelta(hours=6 * i), "ab"[i % 2], float(i // 4)) for i in range(part * 8, part * 8 + 8)]
        spark.createDataFrame(rows, "time timestamp, k string, v double").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    return spark.readStream.schema("time timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_tags(spark, stream, tmp_path):
    got = run(spark, tag_stream(stream, "v", F.col("v") > 3), "tagged", tmp_path)
    assert len(got) == 24 and all((r.v > 3) == (r.v__valid == "filtered") for r in got)


def test_daily(spark, stream, tmp_path):
    got = run(spark, daily_average_stream(stream, "time", "k", "v", "1 hour"), "daily", tmp_path)
    assert got and all(r.mean == (r.day - datetime(2024, 1, 1)).days for r in got)


def test_last_value(spark, stream, tmp_path):
    got = sorted(run(spark, last_value_stream(stream, "time", "k", "v", lambda v, last: abs(v - last) >= 0.5), "stuck", tmp_path), key=lambda r: (r.k, r.time))
    assert [r.v__valid[0] for r in got if r.k == "a"] == ["f", "f"] + ["o", "f"] * 5


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


KINDS = "time timestamp_ntz, k string, seq long, v double"


def shuffled_stream(spark, tmp_path, rows, parts, late_by=3):
    """Rows in micro-batches that are out of order by a few places, and a last row far ahead, which moves the watermark."""
    rng = random.Random(9)
    some = [r for _, r in sorted((i + rng.uniform(0, late_by), r) for i, r in enumerate(rows))]
    size = -(-len(some) // parts)
    for at in range(0, len(some), size):
        batch = some[at : at + size]
        rng.shuffle(batch)
        spark.createDataFrame(batch, KINDS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    for i in range(2):
        spark.createDataFrame([(rows[-1][0] + timedelta(days=9 + i), "end", 0, 0.0)], KINDS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_slopes_in_order(spark, rocks, tmp_path):
    """Late and shuffled micro-batches give the batch operators' slopes and tags, null keys and missing values included."""
    rng = random.Random(3)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=5 * (i // 3)), ("a", "b", None)[i % 3], i, rng.choice([None, 1.0, 2.0, 9.0])) for i in range(120)]
    rows += [(rows[-1][0] + timedelta(minutes=1), "a", 200 + i, float(i)) for i in range(3)]
    batch = OnlineSeries.wrap(spark.createDataFrame(rows, KINDS), key="k", seq="seq")
    want = {(r.k, r.seq): r.v_slope for r in batch.slopes("v", time_unit="min").df.collect()}
    tags = {(r.k, r.seq): r.v__valid for r in batch.moving_slope_filter("v", 0.9, ("2024/1/1", "2024/1/2"), time_unit="min").df.collect()}
    stream = shuffled_stream(spark, tmp_path, rows, 6)
    got = run(spark, slopes_stream(stream, "time", "k", "v", "min", "seq", "40 minutes"), "slopes", tmp_path)
    assert {(r.k, r.seq): r.v_slope for r in got if r.k != "end"} == want
    got = run(spark, slope_filter_stream(stream, "time", "k", "v", 0.9, "min", "seq", "40 minutes"), "steep", tmp_path / "2")
    assert {(r.k, r.seq): r.v__valid for r in got if r.k != "end"} == tags


def test_series_expire(spark, rocks, tmp_path):
    """A series that has been quiet for longer than `idle` starts anew."""
    t0 = datetime(2024, 1, 1)
    for batch in ([(t0, "a", 0, 1.0)], [(t0 + timedelta(days=1), "b", 1, 1.0)], [(t0 + timedelta(days=2), "b", 2, 2.0)], [(t0 + timedelta(days=3), "a", 3, 5.0)], [(t0 + timedelta(days=4), "b", 4, 2.0)], [(t0 + timedelta(days=9), "end", 5, 0.0)], [(t0 + timedelta(days=10), "end", 6, 0.0)]):
        spark.createDataFrame(batch, KINDS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.seq: r.v_slope for r in run(spark, slopes_stream(stream, "time", "k", "v", "d", "seq", "1 minute", idle_seconds=100_000), "expired", tmp_path)}
    assert got[0] is None and got[2] == 1.0 and got[3] is None
