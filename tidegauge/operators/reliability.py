"""Reliability of fillers: artificial gaps, filled again, compared with what was there. All iterations are one job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import in_range
from ..plans.series import CHUNK, FILTERED, ORIGINAL, RN, SeriesFrame, filled, fillmeta, valid
from .filling import FILLERS
from .tagging import get_highs


def random_gaps(s: SeriesFrame, iterations: int, number: int, max_size: int, arange, seed: int) -> DataFrame:
    """(gap_key, iteration, start, size): positions of the series, starts among those in the range but its last, sizes
    below max_size. A gap that goes on beyond the range ends with it. The same for every seed."""
    ranked = s.done().positions()
    inside = ranked.where(in_range(s, arange)).df.groupBy(F.col(s.key).alias("gap_key")).agg(F.min(RN).alias("first"), F.max(RN).alias("last"))
    draws = inside.withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations * number - 1).cast("long"))))
    drawn = lambda what: F.md5(F.concat_ws("|", F.lit(f"{seed}|{what}"), F.col("id").cast("string"), F.col("gap_key").cast("string")))
    unit = lambda what: F.conv(F.substring(drawn(what), 1, 8), 16, 10).cast("double") / float(1 << 32)
    start = F.col("first") + F.floor(unit("start") * F.greatest(F.col("last") - F.col("first"), F.lit(1)))
    size = F.least(F.floor(unit("size") * max_size), F.col("last") - start + 1)
    return draws.select("gap_key", F.floor(F.col("id") / number).alias("iteration"), start.cast("long").alias("start"), size.cast("long").alias("size"))


def create_gaps(s: SeriesFrame, gaps: DataFrame, *columns: str, null_gaps: bool = False, iterations: list[int] | None = None) -> SeriesFrame:
    """The series once for each iteration (column iteration, part of the key): in the gaps, positions start to
    start + size - 1, values are zero (or null) and their tags filtered; column __gap marks them. Earlier tags and
    fills are gone: all else is original.

    gaps: (iteration, start, size) and optionally gap_key. Gaps may overlap; positions beyond the series are none.
    iterations: their numbers, if they are known; else they are collected from gaps."""
    s = s.done().positions()
    s = s.drop(*[x for x in s.df.columns if x.endswith(("__valid", "__filled", "__fillmeta"))])
    keyed = "gap_key" in gaps.columns
    spots = gaps.where("size > 0").withColumn("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    spots = spots.select(F.col("iteration").alias("__i"), "at", *["gap_key"] * keyed).distinct()
    if iterations is None:
        iterations = sorted(r[0] for r in gaps.select("iteration").distinct().collect())
    kind = gaps.schema["iteration"].dataType
    copies = F.explode(F.array(*[F.lit(i).cast(kind) for i in iterations]))  # a copy of the series for each iteration is what is asked for
    df = s.df.drop("iteration").withColumn("iteration", copies)
    on = (F.col("iteration") == F.col("__i")) & (F.col(RN) == F.col("at"))
    on = on & F.col(s.key).eqNullSafe(F.col("gap_key")) if keyed else on
    df = df.join(spots.withColumn("__hit", F.lit(True)), on, "left").drop("__i", "at", "gap_key")
    df = df.withColumn("__gap", F.coalesce("__hit", F.lit(False))).drop("__hit")
    key = F.struct(F.col(s.key).alias("series"), F.col("iteration"))
    change = {c: F.when(F.col("__gap"), F.lit(None if null_gaps else 0).cast("double")).otherwise(F.col(c).cast("double")) for c in columns}
    change |= {valid(c): F.when(F.col("__gap"), FILTERED).otherwise(ORIGINAL) for c in columns}
    df = df.withColumns({f"__orig_{c}": F.col(c).cast("double") for c in columns}).withColumns(change).withColumn(s.key, key)
    return replace(s.with_df(df.drop(RN, CHUNK)), chunk_rows=None, advised=True, rain_checks=False)


def filling_error(s: SeriesFrame, c: str, filler: str, gaps: DataFrame, null_gaps: bool = False, iterations: list[int] | None = None, **options) -> DataFrame:
    """For each iteration the mean of |original - filled| / original in percent over the gaps' points; points whose
    original is zero or missing, or that got no value, don't count. An error of exactly 100 counts as none."""
    if filler not in FILLERS:
        raise ValueError(f"no filler {filler!r}; one of {sorted(FILLERS)}")
    needed = [x for x in (s.time, s.key, s.seq, RN, CHUNK, c, options.get("use"), "highs") if x in s.df.columns]
    g = create_gaps(s.with_df(s.df.select(*dict.fromkeys(needed))), gaps, c, null_gaps=null_gaps, iterations=iterations)
    g = g.add(**{filled(c): F.col(c), fillmeta(c): F.col(valid(c))})
    done = FILLERS[filler](g, c, **options)
    o, f = F.col(f"__orig_{c}"), F.col(filled(c))
    error = F.when(o != 0, F.abs(o - f) / F.nullif(o, F.lit(0.0)))
    each = done.df.where("__gap").groupBy("iteration").agg((F.avg(error) * 100).alias("error_pct"))
    return each.select("iteration", F.nullif("error_pct", F.lit(100.0)).alias("error_pct"))


def check_filling_error(s: SeriesFrame, nr_iterations: int, c: str, filler: str, test_data_range, nr_small_gaps: int = 0, max_size_small_gaps: int = 0, nr_large_gaps: int = 0, max_size_large_gaps: int = 0, seed: int = 0, **options) -> DataFrame:
    """(column, imputation_error_pct): the mean error over iterations with seeded random gaps. The data are those of
    test_data_range, without their tags; gaps lie in options["arange"], where the filler works (all of the data if the
    filler has none)."""
    if not (nr_small_gaps and max_size_small_gaps) and not (nr_large_gaps and max_size_large_gaps):
        raise ValueError("no gaps are asked for: give numbers and sizes of small or large gaps")
    part = s.where(in_range(s, test_data_range))
    part = get_highs(part, c, 0.9, test_data_range)
    kinds = [(n, m, seed * 2 + i) for i, (n, m) in enumerate(((nr_small_gaps, max_size_small_gaps), (nr_large_gaps, max_size_large_gaps))) if n and m]
    gaps = None
    for n, m, k in kinds:
        some = random_gaps(part, nr_iterations, n, m, options.get("arange"), k)
        gaps = some if gaps is None else gaps.unionByName(some)
    each = filling_error(part, c, filler, gaps, iterations=list(range(nr_iterations)), **options)
    return each.agg(F.avg("error_pct").alias("imputation_error_pct")).select(F.lit(c).alias("column"), "imputation_error_pct")
