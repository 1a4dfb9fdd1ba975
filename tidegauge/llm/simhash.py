"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 of both. Every distinct fingerprint emits its variants
within half the radius, variants are shuffled, and those that meet there are within r of each other (which is
verified), so one link to the smallest of them joins them all. A 64-bit variant has at most 2,081 fingerprints
within 2 bits, which bounds every group, whatever the input.

Most of these variants can meet nothing, and a lossless test finds them first: of two fingerprints within 4 bits,
one half of 32 bits differs by at most 2, so they share one of the 33 variants within one bit of that half. A
fingerprint goes on only with the half variants that another one shares, and adds the bits of the other half.

Fingerprints: of word shingles (see sketch()). Null and blank texts have the fingerprint zero, linked like any
other; texts with fewer words than a shingle are one shingle. Rows with a null id link like others, but
give no component its name. Repeated rows are equal fingerprints.
Other columns, of any name, pass through keep(). Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, in_arrow, null_text, own

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
RADIUS = 4
#: Shingles hashed at once, so that memory is bounded for a text of any length.
BLOCK = 1 << 16


def hashes(text: str | None, width: int = 4):
    """The shingles' XXH64 in order, in arrays of at most BLOCK; none for a blank text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate(([0], ends[: max(len(words) - width, 0)] + 1)).tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, len(begins), BLOCK):
        yield np.array([xxh64_intdigest(line[b:e], SEED) for b, e in zip(begins[at : at + BLOCK], ends[at : at + BLOCK])], "<u8")


def sketch(text: str | None, width: int = 4) -> int:
    """The fingerprint, as a signed 64-bit integer: a bit is 1 if over half of the shingles' XXH64 have it."""
    return sketched(hashes(text, width))


def sketched(blocks) -> int:
    """The fingerprint of what hashes() gave."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sketch(t.as_py(), width) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return in_arrow(docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), null_text(f"`{text}`").alias("body")), work, "doc_id long, fp long")


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _exploded(masks: list[int]):
    return F.explode(F.array(*[F.lit(_long(m)) for m in masks]))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) fingerprints, linked pairs that join all those within RADIUS bits; prints: distinct (fp).

    A half's key holds its 32 bits on top and the side below. Rows are two numbers wide, as 66 of them go through a
    shuffle for each fingerprint; the join is told to sort, since Spark takes its sides for as small as the table
    that they are exploded from, and would broadcast them.
    """
    high, low = F.lit(_long(0xFFFFFFFF00000000)), F.lit(0xFFFFFFFF)
    swap = lambda c: F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32))
    side = lambda n, c: F.struct(F.lit(n).cast("long").alias("side"), c.alias("turned"))
    # turned: the fingerprint with the half in question on top; side 1 is the lower half
    sides = prints.select(F.explode(F.array(side(0, F.col("fp")), side(1, swap(F.col("fp"))))).alias("s")).select("s.*")
    key = lambda mask: F.col("turned").bitwiseXOR(mask).bitwiseAND(high).bitwiseOR(F.col("side"))
    masks = F.array(*[F.struct(F.lit(_long(m << 32)).alias("mask"), F.lit(1 << i).alias("place")) for i, m in enumerate(_masks(32, 1))])
    half = sides.select("side", "turned", F.explode(masks).alias("m")).select("turned", F.col("m.place").alias("place"), key(F.col("m.mask")).alias("key"))
    # a half variant is of use to two fingerprints that reach it differently, or that both have it as it is
    reached = half.groupBy("key").agg(F.bit_or("place").alias("places")).where(F.bit_count("places") > 1).select("key")
    equal = sides.groupBy(key(F.lit(0)).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = half.select("turned", "key").join(reached.unionAll(equal).hint("merge"), "key", "left_semi")
    near, far = (F.array(*[F.lit(m) for m in _masks(32, most)]) for most in (1, 2))
    own_half = F.col("turned").bitwiseXOR(F.col("key")).bitwiseAND(high) == 0
    ball = shared.select("turned", "key", F.explode(F.when(own_half, far).otherwise(near)).alias("bits"))
    meet = F.col("key").bitwiseAND(high).bitwiseOR(F.col("turned").bitwiseAND(low).bitwiseXOR(F.col("bits")))
    lower = F.col("key").bitwiseAND(F.lit(1)) == 1
    back = lambda c: F.when(lower, swap(c)).otherwise(c)
    ball = ball.select(back(meet).alias("meet"), back(F.col("turned")).alias("fp"))
    met = ball.withColumn("hub", F.min("fp").over(Window.partitionBy("meet"))).where("fp != hub")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the smallest id reachable over links."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(docs, ident, text, width), "prints")
    reps = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = components(scratch, scratch.save(links(reps.select("fp")), "links"))
    rooted = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component those with the smallest id, and those without an id."""
    found = near_duplicates(spark, docs.where(F.col(f"`{ident}`").isNotNull()), ident, text, width)
    name = own(docs, "gone")
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col(f"`{ident}`") == F.col(name), "left_anti")
