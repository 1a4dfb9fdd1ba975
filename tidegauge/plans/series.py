"""SeriesFrame: a lazy table of measurements with its time axis, and what depends on the order of its rows.

Tags and fills are companion columns of the row they belong to (<c>__valid, <c>__filled, <c>__fillmeta), so nothing
is ever aligned by a join. All ordered operations of a table share one partitioning and one sort.

Long series: with chunk_rows set, a series is cut into chunks of that many rows. For positions the rows are dealt by
ranges of (series, time, order) from a sample and sorted, and a row's place in its partition is added to what the
partitions before hold of its series: neither a series nor a day need fit a task. Each ordered operation works within
chunks, with what it needs from other chunks carried over from one summary row a chunk, joined by position, or from
copies of the neighbouring rows. So no task holds more than a chunk of one series; the summaries are as many rows as
there are chunks. The rows are written before each such summary, so a chain's plan stays as long as one operator's. Unless told otherwise, a table is chunked if
what it is read from is larger than AUTO_BYTES; results are the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Bytes of input from which series are chunked, and the rows of a chunk then.
AUTO_BYTES, AUTO_ROWS = 256 << 20, 1_000_000
ORIGINAL, FILTERED, ADDED = "original", "filtered", "!!"
KEY, SEQ, RN, CHUNK = "series_key", "seq", "__rn", "__chunk"


def valid(c: str) -> str:
    return f"{c}__valid"


def filled(c: str) -> str:
    return f"{c}__filled"


def fillmeta(c: str) -> str:
    return f"{c}__fillmeta"


def input_bytes(df: DataFrame) -> int:
    """Of all files and ranges that the plan reads, by the optimizer's statistics; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


@dataclass(frozen=True)
class SeriesFrame:
    """Immutable; every operator returns a new one.

    time: a timestamp_ntz, timestamp or numeric column. key: what tells series apart; without one all rows are a
    single series. seq: order of rows of equal time; without one a hash of the row. chunk_rows: None for series that
    fit a task each. advised: fillers have said that small gaps come first. rain_checks: fillers look whether the
    range has more than one high, if highs were flagged; that runs a job each time. single: the key is wrap()'s own, as all
    rows are one series.
    """

    df: DataFrame
    time: str = "time"
    key: str = KEY
    seq: str = SEQ
    chunk_rows: int | None = None
    data_type: str = "WWTP"
    tag: str = "No tag given"
    time_unit: str | None = None
    units: dict = field(default_factory=dict)
    advised: bool = False
    rain_checks: bool = True
    single: bool = False

    @classmethod
    def wrap(cls, df: DataFrame, time: str = "time", key: str | None = None, seq: str | None = None, chunk_rows: int | str | None = "auto", **meta) -> SeriesFrame:
        """NaN becomes NULL: the engine knows one kind of missing value."""
        if time not in df.columns:
            raise ValueError(f"no column {time}")
        if isinstance(df.schema[time].dataType, T.StringType):
            raise TypeError("a time axis can't be text; parse it first (to_datetime)")
        clash = [c for c in df.columns if c.endswith(("__valid", "__filled", "__fillmeta"))]
        if clash:
            raise ValueError(f"these names are kept for tags and fills: {clash}")
        out = df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
        single = key is None and KEY not in df.columns
        if single:
            out = out.withColumn(KEY, F.lit(0))
        if seq is None and SEQ not in df.columns:
            out = out.withColumn(SEQ, F.xxhash64(*df.columns))
        if chunk_rows == "auto":
            chunk_rows = AUTO_ROWS if input_bytes(df) > AUTO_BYTES else None
        return cls(out, time, key or KEY, seq or SEQ, chunk_rows, single=single, **meta)

    # -- small helpers

    def with_df(self, df: DataFrame) -> SeriesFrame:
        return replace(self, df=df)

    def add(self, **columns: Column) -> SeriesFrame:
        return self.with_df(self.df.withColumns(columns))

    def drop(self, *columns: str) -> SeriesFrame:
        return self.with_df(self.df.drop(*columns))

    def where(self, condition: Column) -> SeriesFrame:
        return self.with_df(self.df.where(condition))

    @property
    def columns(self) -> list[str]:
        """The measurement columns."""
        hidden = {self.time, self.key, self.seq, RN, CHUNK, "highs"}
        return [c for c in self.df.columns if c not in hidden and not c.endswith(("__valid", "__filled", "__fillmeta"))]

    @property
    def is_datetime(self) -> bool:
        return isinstance(self.df.schema[self.time].dataType, (T.TimestampNTZType, T.TimestampType))

    def seconds(self, c: Column | None = None) -> Column:
        """Time as a number: seconds for a time stamp, else the axis's own unit."""
        c = F.col(self.time) if c is None else c
        return self.micros(c) / 1e6 if self.is_datetime else c.cast("double")

    def micros(self, c: Column | None = None) -> Column:
        c = F.col(self.time) if c is None else c
        return F.unix_micros(c.cast("timestamp")) if self.is_datetime else c

    def window(self):
        return Window.partitionBy(self.key).orderBy(self.time, self.seq)

    # -- ordered operations

    def positions(self) -> SeriesFrame:
        """Adds the row's position in its series, from 1, and with chunk_rows its chunk."""
        if RN in self.df.columns:
            return self
        if not self.chunk_rows:
            return self.add(**{RN: F.row_number().over(self.window())})
        scratch, order = Scratch(self.df.sparkSession, "series"), [self.key, self.time, self.seq]
        rows = scratch.save(self.df, "rows")  # the sample is a reading of its own
        at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
        df = scratch.save(at, "dealt").withColumn("__part", F.shiftright("__at", 33))
        scratch.drop("rows")
        counts = df.groupBy(self.key, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(self.key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(F.col(self.key).alias("__k"), F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__add"))
        df = df.join(counts, F.col(self.key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p"))).withColumn(RN, F.col("__at") + F.col("__add"))
        return self.with_df(df.withColumn(CHUNK, F.floor((F.col(RN) - 1) / self.chunk_rows)).drop("__at", "__part", "__k", "__p", "__add"))

    def cut(self) -> SeriesFrame:
        """Written to the shared folder and read from there: for long chains, as operators that join a series with a
        summary of itself have it in their plan twice. The table goes when the driver's Python ends."""
        return self.with_df(Scratch(self.df.sparkSession, "series").save(self.df, "rows"))

    def _inner(self):
        return Window.partitionBy(self.key, CHUNK).orderBy(RN)

    def _carry(self, df: DataFrame, aggs: dict[str, Column], spread: dict[str, Column]) -> DataFrame:
        """Joins what other chunks know: aggs make a row for each chunk, spread goes over a series' chunks in order."""
        df = self.with_df(df).cut().df
        some = df.groupBy(self.key, CHUNK).agg(*[c.alias(n) for n, c in aggs.items()]).withColumns(spread)
        some = some.select(F.col(self.key).alias("__k"), F.col(CHUNK).alias("__c"), *spread)
        return df.join(some, F.col(self.key).eqNullSafe(F.col("__k")) & (F.col(CHUNK) == F.col("__c"))).drop("__k", "__c")

    def _neighbour(self, new: dict[str, tuple[Column, bool]], back: bool) -> SeriesFrame:
        if not self.chunk_rows:
            w = self.window()
            frame = w.rowsBetween(Window.unboundedPreceding, -1) if back else w.rowsBetween(1, Window.unboundedFollowing)
            pick, step = (F.last, F.lag) if back else (F.first, F.lead)
            return self.add(**{n: pick(v, ignorenulls=True).over(frame) if skip else step(v, 1).over(w) for n, (v, skip) in new.items()})
        s = self.positions()
        w, chunks = s._inner(), Window.partitionBy(s.key).orderBy(CHUNK)
        frame, far = (x.rowsBetween(Window.unboundedPreceding, -1) if back else x.rowsBetween(1, Window.unboundedFollowing) for x in (w, chunks))
        pick, step, edge = (F.last, F.lag, F.max_by) if back else (F.first, F.lead, F.min_by)
        df = s.df.withColumns({f"__v{i}": F.struct(v.alias("x")) for i, (v, _) in enumerate(new.values())})
        aggs, spread, near = {}, {}, {}
        for i, (n, (_, skip)) in enumerate(new.items()):
            v = F.when(F.col(f"__v{i}.x").isNotNull(), F.col(f"__v{i}")) if skip else F.col(f"__v{i}")
            aggs[f"__a{i}"] = edge(v, F.when(v.isNotNull(), F.col(RN)))
            spread[f"__s{i}"] = pick(f"__a{i}", ignorenulls=True).over(far) if skip else step(f"__a{i}", 1).over(chunks)
            near[n] = F.coalesce(pick(v, ignorenulls=True).over(frame) if skip else step(v, 1).over(w), F.col(f"__s{i}"))["x"]
        df = s._carry(df, aggs, spread)
        return s.with_df(df.withColumns(near).drop(*[f"__{k}{i}" for i in range(len(new)) for k in "vs"]))

    def previous(self, **new: tuple[Column, bool]) -> SeriesFrame:
        """For each name (value, skip): the value of the row before, or with skip of the last row before that has one."""
        return self._neighbour(new, True)

    def following(self, **new: tuple[Column, bool]) -> SeriesFrame:
        return self._neighbour(new, False)

    def running_sum(self, name: str, value: Column) -> SeriesFrame:
        if not self.chunk_rows:
            return self.add(**{name: F.sum(value).over(self.window().rowsBetween(Window.unboundedPreceding, 0))})
        s = self.positions()
        df = s.df.withColumn("__v", value)
        before = F.coalesce(F.sum("__a").over(Window.partitionBy(s.key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        df = s._carry(df, {"__a": F.sum("__v")}, {"__s": before})
        inner = F.sum("__v").over(s._inner().rowsBetween(Window.unboundedPreceding, 0))
        return s.with_df(df.withColumn(name, F.col("__s") + F.coalesce(inner, F.lit(0))).drop("__v", "__s"))

    def framed(self, before: int, after: int, **new) -> SeriesFrame:
        """For each name a function from a row frame (a WindowSpec) to a column, over `before` rows back to `after` on.
        Chunks have copies of the bordering rows that their frames reach, from as many chunks as these span."""
        if not self.chunk_rows:
            frame = self.window().rowsBetween(-before, after)
            return self.add(**{n: f(frame) for n, f in new.items()})
        s, size = self.positions(), self.chunk_rows
        home, reach = F.col(CHUNK), lambda n: F.floor((F.col(RN) - 1 + n) / size)
        df = s.df.withColumn("__to", F.explode(F.sequence(F.greatest(reach(-after), F.lit(0)), reach(before))))
        frame = Window.partitionBy(s.key, "__to").orderBy(RN).rowsBetween(-before, after)
        return s.with_df(df.withColumns({n: f(frame) for n, f in new.items()}).where(F.col("__to") == home).drop("__to"))

    def shifted(self, **new: tuple[Column, int]) -> SeriesFrame:
        """For each name (value, n): the value of the row n rows on, or with a negative n back. Chunks are joined by position."""
        if not self.chunk_rows:
            return self.add(**{name: F.lead(v, n).over(self.window()) if n >= 0 else F.lag(v, -n).over(self.window()) for name, (v, n) in new.items()})
        s = self.positions().add(**{f"__v{i}": v for i, (v, _) in enumerate(new.values())}).cut()
        df = s.df.drop(*[f"__v{i}" for i in range(len(new))])
        for i, (name, (_, n)) in enumerate(new.items()):
            far = s.df.select(F.col(s.key).alias("__k"), (F.col(RN) - n).alias("__r"), F.col(f"__v{i}").alias(name))
            df = df.join(far, F.col(s.key).eqNullSafe(F.col("__k")) & (F.col(RN) == F.col("__r")), "left").drop("__k", "__r")
        return s.with_df(df)

    def frame_moments(self, name: str, value: Column, before: int, after: int, order: int = 0) -> SeriesFrame:
        """Adds name, a struct for the frame from `before` rows back to `after` on, where the series has all of these: n,
        its values, and m, for each k to the order the sum of x ** k * value, x being rows from here over the longer side.

        The work for a row doesn't grow with the frame: rows are in blocks of the frame's length, so a frame is the end of
        a block and the beginning of the next, and of both there are running sums, with x from the block's start. So
        sums are of a frame's size, and as exact as if each frame were summed. A task holds a block's rows."""
        size, scale = before + after + 1, float(max(before, after, 1))
        s = self.positions()
        at, v = F.col(RN) - 1, F.col("__v")
        s = s.add(__v=value.cast("double"), __b=F.floor(at / size))
        x = (at - F.col("__b") * size) / scale
        sums = lambda w: F.struct(F.count("__v").over(w).alias("n"), F.array(*[F.coalesce(F.sum(v if not k else F.pow(x, F.lit(k)) * v).over(w), F.lit(0.0)) for k in range(order + 1)]).alias("m"))
        up, down = (Window.partitionBy(s.key, "__b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(RN), F.desc(RN)))
        s = s.add(__up=sums(up), __down=sums(down)).drop("__v", "__b").shifted(__e=(F.col("__up"), after), __s=(F.col("__down"), -before))
        first = at - before  # of the frame; it is a block's first, or else the end of that block and the start of the next
        origin = first - F.pmod(first, F.lit(size))
        one = F.pmod(first, F.lit(size)) == 0

        def from_here(m: Column, start: Column) -> list[Column]:
            d = (start - at) / scale
            return [sum((m[j] * (math.comb(k, j) * (F.lit(1.0) if k == j else F.pow(d, F.lit(k - j)))) for j in range(k + 1)), F.lit(0.0)) for k in range(order + 1)]

        e, b = F.col("__e"), F.col("__s")
        whole, end, start = from_here(e["m"], origin), from_here(b["m"], origin), from_here(e["m"], origin + size)
        both = F.struct(F.when(one, e["n"]).otherwise(b["n"] + e["n"]).alias("n"), F.array(*[F.when(one, w).otherwise(x + y) for w, x, y in zip(whole, end, start)]).alias("m"))
        return s.add(**{name: F.when(e.isNotNull() & b.isNotNull(), both)}).drop("__up", "__down", "__e", "__s")

    def done(self) -> SeriesFrame:
        """Without the positions."""
        return self.drop(RN, CHUNK)
