"""Structured Streaming adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.series import FILTERED, ORIGINAL, valid


def tag_stream(stream: DataFrame, c: str, wrong: Column) -> DataFrame:
    """Tags without state: filtered where the condition holds, original elsewhere."""
    return stream.withColumn(valid(c), F.when(F.coalesce(wrong, F.lit(False)), FILTERED).otherwise(ORIGINAL))


def daily_average_stream(stream: DataFrame, time: str, key: str, c: str, late: str = "1 day") -> DataFrame:
    """(key, day, mean, std): a day comes out once the watermark has passed it; later rows are dropped."""
    w = F.window(time, "1 day")
    got = stream.withWatermark(time, late).groupBy(w.alias("__w"), key).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"))
    return got.select(key, F.col("__w.start").alias("day"), "mean", "std")


def last_value_stream(stream: DataFrame, time: str, key: str, c: str, keep: Callable[[float, float], bool]) -> DataFrame:
    """(key, time, c, c__valid): each value against the last known one of its series, which is the state: one number
    and time a series. A value is filtered if keep(value, last) is false or there is no last one; rows of a batch are
    taken in order of time, and a row that is older than its series' state is left as it is (original)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        tags = []
        for t, v in zip(rows[time], rows[c]):
            if pd.isna(v) or at is not None and t.value < at:
                tags.append(ORIGINAL)
                continue
            tags.append(ORIGINAL if last is not None and keep(v, last) else FILTERED)
            last, at = float(v), t.value
        if last is not None:
            state.update((last, at))
        yield rows.assign(**{valid(c): tags})[[key, time, c, valid(c)]]

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{key} {kind[key]}, {time} {kind[time]}, {c} {kind[c]}, {valid(c)} string"
    return stream.select(key, time, c).groupBy(key).applyInPandasWithState(step, out, "last double, at long", "append", GroupStateTimeout.NoTimeout)
