"""Streams in order of event time: slopes and the slope filter, which need the row before.

Rows wait in state until the watermark has passed their time; then timers release them in order of time and, at one
time, of seq, and each is compared with the row released before it. So shuffled and late micro-batches give what the
batch operators give on the same rows. State is a series' waiting rows and one last row, which goes when the
watermark is `idle` beyond it: a series that was quiet for longer starts anew. Rows older than the watermark are dropped.

The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.series import FILTERED, ORIGINAL, valid


class InOrder(StatefulProcessor):
    """(key, time, seq, value) with the time and value of the row before, in order of time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, seq bigint, n bigint", "v double")
        self.last = handle.getValueState("last", "at bigint, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        times = set()
        for some in rows:
            for at, seq, v in zip(some["at"], some["seq"], some["v"]):
                if last is not None and at < last[0]:
                    continue  # its place has been passed
                n = 0
                while self.waiting.containsKey((int(at), int(seq), n)):
                    n += 1
                self.waiting.updateValue((int(at), int(seq), n), (None if pd.isna(v) else float(v),))
                times.add(-(-int(at) // 1000))
        for ms in times:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        last = self.last.get() if self.last.exists() else None
        ready = sorted(k for k in self.waiting.keys() if k[0] <= upto)
        out = []
        for k in ready:
            v = self.waiting.getValue(k)[0]
            last = last if last and k[0] - last[0] <= self.idle_ms * 1000 else None
            out.append((key[0], k[0], k[1], v, last[0] if last else None, last[1] if last else None))
            last = (k[0], v)
            self.waiting.removeKey(k)
        if ready:
            self.last.update(last)
            self.handle.registerTimer(-(-last[0] // 1000) + self.idle_ms)
        elif last and last[0] + self.idle_ms * 1000 <= upto and not any(True for _ in self.waiting.keys()):
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["k", "at", "seq", "v", "before_at", "before_v"]).astype({"at": "int64", "seq": "int64", "v": "float64", "before_at": "Int64", "before_v": "float64"})


def _ordered(stream: DataFrame, time: str, key: str, seq: str | None, c: str, late: str, idle_seconds: int) -> DataFrame:
    stamped = F.col(time).cast("timestamp")
    order = F.col(seq).cast("long") if seq else F.xxhash64(time, c)
    rows = stream.select(F.col(key).alias("k"), stamped.alias("stamp"), F.unix_micros(stamped).alias("at"), order.alias("seq"), F.col(c).cast("double").alias("v")).withWatermark("stamp", late)
    kind = stream.schema[key].dataType.simpleString()
    out = f"k {kind}, at bigint, seq bigint, v double, before_at bigint, before_v double"
    return rows.groupBy("k").transformWithStateInPandas(statefulProcessor=InOrder(idle_seconds * 1000), outputStructType=out, outputMode="Append", timeMode="EventTime")


def _slope(unit: str, true_elapsed: bool) -> Column:
    from ..functions.timeconv import per_unit

    k = per_unit(unit)
    step = F.floor((F.col("at") - F.col("before_at")) / 1e6)
    step = (step if true_elapsed or k == 86_400 else F.pmod(step, F.lit(86_400))) / k
    rise = F.col("v") - F.col("before_v")
    return F.when(step == 0, F.when(rise != 0, F.signum(rise) * float("inf"))).otherwise(F.try_divide(rise, step))


def slopes_stream(stream: DataFrame, time: str, key: str, c: str, unit: str, seq: str | None = None, late: str = "1 hour", idle_seconds: int = 7 * 86_400, true_elapsed: bool = False) -> DataFrame:
    """(key, time, seq, c, c_slope): the slope at each row, from the row before it in time, once the watermark has passed
    both."""
    got = _ordered(stream, time, key, seq, c, late, idle_seconds)
    return got.select(F.col("k").alias(key), F.timestamp_micros("at").alias(time), F.col("seq").alias(seq or "seq"), F.col("v").alias(c), _slope(unit, true_elapsed).alias(f"{c}_slope"))


def slope_filter_stream(stream: DataFrame, time: str, key: str, c: str, cutoff: float, unit: str, seq: str | None = None, late: str = "1 hour", idle_seconds: int = 7 * 86_400, true_elapsed: bool = False) -> DataFrame:
    """(key, time, seq, c, c__valid): points with a steeper slope than the cutoff are filtered, as are missing values."""
    got = slopes_stream(stream, time, key, c, unit, seq, late, idle_seconds, true_elapsed)
    steep = F.coalesce(F.abs(F.col(f"{c}_slope")) > cutoff, F.lit(False)) | F.col(c).isNull()
    return got.withColumn(valid(c), F.when(steep, FILTERED).otherwise(ORIGINAL)).drop(f"{c}_slope")
