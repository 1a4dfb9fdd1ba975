"""Near copies by the real similarity of whole texts, for the corpus pipeline.

Two documents are linked if the Jaccard similarity of their sets of WIDTH-word shingles is LEAST or more. Most links
are found early, from two sources: fingerprints of the same shingles within simhash.RADIUS bits (all of them), and
equal bands of min-wise hashes, since at a similarity of 0.8 two 64-bit fingerprints differ in about ten bits, where a
ball lookup no longer tells near from chance. A pair of similarity s shares at least one of BANDS bands of ROWS with
chance 1 - (1 - s^ROWS)^BANDS: 0.997 at 0.8, more above. Every candidate is verified on both texts, so no link is wrong.

The documents of a band are paired with up to three of them (the smallest id, the largest, one by hash), so the
number of pairs grows with the documents, not with the square of a band's. Each document's first candidate is
verified before the others, and what that has joined already isn't verified again.

What these miss is found exactly, by prefixes: in an order of all shingles, two similar texts have one in common among
the first n - ceil(LEAST n) + 1 of each of them, n being a text's number of shingles, and of the shorter one among the
first n - ceil(8/9 n) + 1. Pairs of texts that are in one group already aren't made, so large groups of copies cost no
pairs within them. Nor are those made that can't reach LEAST by what follows the shared shingle in both texts, or by
how many of PARITY bits, each flipped by the shingles that fall on it, differ: every one takes a shingle that only one
of the two has. The rest is verified. So no link between groups is lost, by any chance. The order is by hash, with
shingles of many texts last: which ones these are is taken from a sample of texts, and only the cost depends on it.
Texts that are nearly similar by one passage, in different groups, are still compared with each other.

Null and blank texts are copies of each other; texts with fewer words than a shingle are one shingle. Rows with a
null id stay. Rows of a repeated id stay or go together. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, components, in_arrow, null_text, own

#: Where the exact part counts, it has LEAST as four fifths.
WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 8
#: Shingles put through all min-wise hashes at once.
BLOCK = 1 << 10
#: Bits of a text's parities.
PARITY = 512
#: Shingles that come last in the order, at most: those met OFTEN times or more in one of SAMPLE texts.
FREQUENT, OFTEN, SAMPLE = 1 << 19, 2, 32
#: Ids that are broadcast to find their texts, at most.
SPREAD = 1 << 20

_ODD, _MIX = np.random.default_rng(simhash.SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_ODD |= np.uint64(1)


def _distinct(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks or [np.zeros(1, np.uint64)]))


def _shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return _distinct(list(simhash.hashes(text, WIDTH)))


def bands(blocks: list[np.ndarray]) -> list[int]:
    """A signed 64-bit key for each band of a text, from the hashes of its shingles."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for h in blocks:
        for at in range(0, len(h), BLOCK):
            np.minimum(least, ((h[at : at + BLOCK] ^ _MIX) * _ODD).min(1), out=least)
    keys = [xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first of a text's distinct shingles, as many as a similar text can't lack: frequent ones (sorted) come after
    the others."""
    late = np.zeros(len(found), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
    n = len(found) - _needed(len(found)) + 1
    return np.concatenate((found[~late], found[late]))[:n]


def parity(found: np.ndarray) -> np.ndarray:
    """PARITY bits, in signed 64-bit integers: whether an odd number of a text's distinct shingles falls on each."""
    odd = np.bincount((found % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _needed(n: int) -> int:
    """How many of n shingles a similar text has."""
    return (4 * n + 4) // 5


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _frequent(scratch: Scratch, docs: DataFrame) -> np.ndarray:
    """Shingles of many texts, sorted."""

    def work(batches):
        for b in batches:
            found = np.concatenate([np.zeros(0, np.uint64), *map(_shingles, b.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("body")
    counts = in_arrow(some, work, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    counts = scratch.save(counts.select("key", F.length(F.bin("n")).alias("level")), "frequent")
    level, held = 64, 0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > FREQUENT:
            break
        level = r.level
    keys = counts.where(F.col("level") >= level).select("key").toArrow().column(0).to_numpy()
    return np.sort(keys.astype(np.int64).view(np.uint64))


def _marked(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    def work(batches):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                blocks = list(simhash.hashes(t, WIDTH))
                found = _distinct(blocks)
                rows.append((simhash.sketched(blocks), bands(blocks), len(found), parity(found), prefix(found, frequent)))
            prints, keys, sizes, odds, firsts = zip(*rows) if rows else [()] * 5
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            firsts = np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)
            columns = [pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(odds, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(firsts))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "fp", "keys", "n", "parity", "prefix"])

    return in_arrow(docs, work, "id long, fp long, keys array<long>, n long, parity array<long>, prefix array<long>")


def _pairs(scratch: Scratch, marked: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates, each once."""
    keyed = marked.select("id", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("id", F.xxhash64("id", "key")).alias("some")).where("first < last")
    hubs = scratch.save(hubs, "hubs")
    banded = keyed.join(hubs, "key").select("id", F.explode(F.array("first", "last", "some")).alias("hub"))
    reps = scratch.save(marked.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    same = marked.join(reps, "fp").select("id", F.col("rep").alias("hub"))
    links = scratch.save(simhash.links(reps.select("fp")), "links")
    near = links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("id")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("hub")), "b").select("id", "hub")
    both = banded.unionAll(same).unionAll(near).where("id != hub")
    return both.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _rest(scratch: Scratch, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b), a < b: all pairs that can be similar, of documents that aren't in one group.

    The first common shingle of such a pair is within the longer text's prefix, and within a shorter one of the other.
    """
    alike = Window.partitionBy("key")
    differ = lambda df, c: df.withColumns({"least": F.min(c).over(alike), "most": F.max(c).over(alike)}).where("least < most").drop("least", "most")
    shared = scratch.save(differ(marked.select("id", F.posexplode("prefix").alias("at", "key")), "id"), "shared")
    known = marked.select("id", "n", "parity").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    met = _met(scratch.save(differ(shared.join(known, "id"), "root"), "crossing"))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "root_a", "root_b").distinct()


def _met(crossing: DataFrame) -> DataFrame:
    """(id_a, id_b, root_a, root_b) for shared shingles of texts that can be similar, a being the longer one.

    If a shingle is the first that two texts share, they have no more in common than follows it in either, itself
    included; 8/9 of the shorter text at least, as the longer one's size is no less.
    """
    columns = ("id", "root", "n", "at", "parity")
    longer, shorter = (df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in columns)) for df, x in ((crossing, "a"), (crossing.where("at <= n - (8 * n + 8) div 9"), "b")))
    least = "(4 * (n_a + n_b) + 8) div 9"
    apart = " + ".join(f"bit_count(parity_a[{i}] ^ parity_b[{i}])" for i in range(PARITY // 64))
    order = "root_a != root_b AND 5 * n_b >= 4 * n_a AND (n_a > n_b OR n_a = n_b AND id_a > id_b)"
    met = longer.join(shorter, "key").where(f"{order} AND least(n_a - at_a, n_b - at_b) >= {least} AND {apart} <= n_a + n_b - 2 * ({least})")
    return met.select("id_a", "id_b", "root_a", "root_b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs whose texts are similar."""

    def work(batches):
        last, seen = None, None
        for batch in batches:
            right = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a = a.as_py()
                if seen is None or a != last:
                    last, seen = a, _shingles(a)
                right.append(similarity(seen, _shingles(b.as_py())) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(right, pa.bool_()))

    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("body").alias("right")), "b").join(texts.select(F.col("id").alias("a"), F.col("body").alias("left")), "a")
    return in_arrow(joined.select("a", "b", "left", "right"), work, "a long, b long")


def groups(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root): for each document that isn't the smallest id of its group, that smallest one."""
    scratch = Scratch(spark, "near")
    given = docs.where(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").cast("long").alias("id"), null_text(f"`{text}`").alias("body"))
    marked = scratch.save(_marked(given, _frequent(scratch, given)), "marked")
    pairs = scratch.save(_pairs(scratch, marked), "pairs")
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = scratch.save(given.join(ids, "id", "left_semi"), "texts")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = scratch.save(_verified(first, texts), "first")
    roots = components(scratch, links, "first-cc")
    left = pairs.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        left = left.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    left = scratch.save(left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "left")
    roots = components(scratch, links.unionAll(scratch.save(_verified(left, texts), "second")), "cc")
    for name in ("texts", "hubs", "links"):
        scratch.drop(name)
    return _joined(scratch, given, roots, scratch.save(_rest(scratch, marked, roots).join(pairs, ["a", "b"], "left_anti"), "rest"))


def _joined(scratch: Scratch, given: DataFrame, roots: DataFrame, rest: DataFrame) -> DataFrame:
    """roots, with the groups joined whose documents in rest are similar."""
    ids = scratch.save(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "rest-ids")
    texts = scratch.save(given.join(F.broadcast(ids) if ids.count() <= SPREAD else ids, "id", "left_semi"), "rest-texts")
    found = _verified(rest.select("a", "b"), texts).join(rest, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    tops = components(scratch, scratch.save(found.distinct(), "third"), "rest-cc")
    up = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return scratch.save(up.select("node", F.coalesce("top", "root").alias("root")).unionAll(tops), "groups")


def keep(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group those with the smallest id, and those without an id."""
    name = own(docs, "gone")
    gone = groups(spark, docs, ident, text).select(F.col("node").alias(name))
    return docs.join(gone, F.col(f"`{ident}`") == F.col(name), "left_anti")
