"""What the operators of this subpackage share: scratch tables, bounded Arrow batches and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

#: Bytes of an Arrow batch that goes to a Python worker, at most (but for one longer row).
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(), with the session's batches bounded to BATCH_BYTES, as rows can hold very long texts: a batch is
    in the JVM's direct memory, in the worker's and, as strings, in the worker's once more."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(work, schema)


def grouped(sizes: np.ndarray, most: int):
    """From and up to which texts of these sizes groups go that have most bytes, or one text."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, upto
        at = upto


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    edges: columns a, b (bigint, no nulls; loops and repeats are allowed). Returns (node, root): a row for each
    node of an edge that isn't the smallest of its component, root being that smallest one. Every step is a
    combinable min per node and a join on the node, so a hub of any degree is split like any skewed join;
    nothing is collected but two numbers a round.
    """
    stars = scratch.save(_oriented(edges), f"{tag}-0")
    seen, n = _mark(stars), 0
    while True:
        n += 1
        both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        stars = scratch.save(small.where("a != b").distinct(), f"{tag}-{n}")
        now = _mark(stars)
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        scratch.drop(f"{tag}-{n - 1}")
        seen = now


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(stars: DataFrame) -> tuple:
    """Equal for equal edge sets, and with near certainty for these only."""
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def null_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def own(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


__all__ = ["BATCH_BYTES", "Scratch", "components", "grouped", "in_arrow", "null_text", "own"]
