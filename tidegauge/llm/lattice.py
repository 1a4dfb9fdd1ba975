"""Embedding near-dedup by lattice hashing.

Equal vectors of a label are one class. Each of TABLES tables projects a unit vector to PARTS groups of eight
numbers and decodes each group to its nearest point of the E8 lattice; the points together are the vector's cell.
A vector also probes the cells that lie next to its own, one part moved by the minimal lattice vectors closest to
its residue. Vectors meet in a cell that one of them owns; their cosine is computed in double precision. Links are
counted in one cell each, the first of the two vectors' common ones, and every block of a cell gives a spanning
forest of its links: pairs are never rows.

Counts for each cell come first (combined before the shuffle), so rows of cells that nobody shares go no further. A
cell's members are dealt by hash into blocks of about BLOCK, each pair of blocks is a group of its own, so no task
holds a large cell. Of n members each is sent n / BLOCK times, which is less work than comparing them with each other.
Recall is tested against brute force, also in bands just above the threshold (over 0.99 at a cosine of 0.93).

Vectors that are null, empty or zero, or hold null or non-finite components, and vectors without a label, link with
nothing, not even with equal ones; vectors of different lengths don't link. Labels are equal as their own type has it,
be they numbers or texts. Classes have numbers of their own, so ids
may be null or repeated: every row counts as a vector, a null id gives no component its name (one of null ids alone
has the null one) and rows of a component's smallest id are all kept. Other columns are not passed on. Empty tables
give empty results.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, in_arrow

COSINE = 0.93
TABLES, PARTS, PROBES, SCALE = 8, 2, 4, 0.5
#: Vectors of a block, about: a pair of blocks is compared at a task's leisure, and each is sent to every other one of its cell.
BLOCK = 1024
#: Rows compared at once.
STRIP = 256
SEED = 20_240_117


@lru_cache(1)
def _shortest() -> np.ndarray:
    """The 240 minimal vectors of E8, doubled."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


def _d8(y: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum: if the sum is odd, the worst rounded one goes the other way."""
    out = np.rint(y)
    off = y - out
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return out


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2, doubled."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b).__mul__(2).astype(np.int64)


@lru_cache(8)
def _frame(dim: int):
    rng = np.random.default_rng([SEED, dim])
    planes = rng.normal(size=(TABLES, PARTS, dim, 8)) * SCALE
    words = rng.integers(-(1 << 62), 1 << 62, size=(TABLES, PARTS, 8), dtype=np.int64) | 1
    salt = rng.integers(-(1 << 62), 1 << 62, size=TABLES, dtype=np.int64)
    return planes, words, salt


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors (n, dim): own cells (n, TABLES) and probed ones (n, TABLES, PARTS * PROBES)."""
    planes, words, salt = _frame(unit.shape[1])
    n, short = len(unit), _shortest()
    own, probes = np.zeros((n, TABLES), np.int64), np.zeros((n, TABLES, PARTS * PROBES), np.int64)
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            steps = []
            own[:, t] = salt[t]
            for p in range(PARTS):
                y = unit @ planes[t, p]
                point = decode(y)
                own[:, t] += (point * words[t, p]).sum(1)
                near = np.argpartition((point / 2 - y) @ short.T, PROBES - 1, axis=1)[:, :PROBES]
                steps.append((short * words[t, p]).sum(1)[near])
            probes[:, t] = own[:, t, None] + np.concatenate(steps, 1)
    return own, probes


def _units(column) -> np.ndarray:
    """Of an Arrow list column whose lists have one length."""
    x = np.stack([np.asarray(v, float) for v in column.to_pylist()]) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _emit(batches):
    for b in batches:
        lengths = np.array([len(v) for v in b.column(1)])
        for dim in np.unique(lengths):
            some = b.filter(pa.array(lengths == dim))
            own, probes = cells(_units(some.column(1)))
            all_ = np.concatenate([own[:, :, None], probes], 2)
            per = all_.shape[1] * all_.shape[2]
            mine = np.zeros(all_.shape, bool)
            mine[:, :, 0] = True
            which = pa.array(np.repeat(np.arange(len(own)), per))
            yield pa.RecordBatch.from_arrays([some.column(0).take(which), pa.array(np.full(len(which), int(dim), np.int32)), some.column(2).take(which), pa.array(all_.ravel()), pa.array(mine.ravel())], names=["rep", "dim", "label", "cell", "own"])


def _first_common(own_a, probes_a, own_b, probes_b):
    """The cell that counts a pair: in the first table where they meet, their common own cell, else the smaller of the met ones."""
    n, found = len(own_a), np.zeros(len(own_a), np.int64)
    open_ = np.ones(n, bool)
    top = np.iinfo(np.int64).max
    for t in range(own_a.shape[1]):
        same = own_a[:, t] == own_b[:, t]
        a_met = (probes_b[:, t] == own_a[:, t, None]).any(1)
        b_met = (probes_a[:, t] == own_b[:, t, None]).any(1)
        cell = np.where(same, own_a[:, t], np.minimum(np.where(a_met, own_a[:, t], top), np.where(b_met, own_b[:, t], top)))
        now = open_ & (same | a_met | b_met)
        found[now] = cell[now]
        open_ &= ~now
    return found, ~open_


def _joined(label: np.ndarray, row: int, others: np.ndarray) -> list[tuple[int, int]]:
    """Makes the classes of row and others one, in label; pairs of members that join the classes."""
    classes = np.unique(label[np.append(others, row)])
    if len(classes) > 1:
        label[np.isin(label, classes[1:])] = classes[0]
    return [(classes[0], c) for c in classes[1:]]


def _verify(cosine: float):
    def group(cell: int, i: int, j: int, rep, block, own, many, unit):
        """Links of one pair of blocks: (rep, partner, 0) of a forest and (rep, null, number of vectors linked to it).

        A strip of rows is compared at a time, so memory doesn't grow with the number of links."""
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return []
        strips = [left[at : at + STRIP] for at in range(0, len(left), STRIP)]

        def hits(some: np.ndarray) -> np.ndarray:
            hit = unit[some] @ unit[right].T >= cosine
            hit &= own[some][:, None] | own[right][None]
            return hit & (some[:, None] < right[None]) if i == j else hit

        used = np.zeros(len(rep), bool)
        for some in strips:
            hit = hits(some)
            used[some] |= hit.any(1)
            used[right] |= hit.any(0)
        if not used.any():
            return []
        place = np.cumsum(used) - 1
        mine, probes = cells(unit[used])
        label, count, out = np.arange(len(rep)), np.zeros(len(rep), np.int64), []
        for some in strips:
            u, v = np.nonzero(hits(some))
            x, y = some[u], right[v]
            keep = np.zeros(len(x), bool)
            for s in range(0, len(x), 20_000):
                a, b = place[x[s : s + 20_000]], place[y[s : s + 20_000]]
                first, ok = _first_common(mine[a], probes[a], mine[b], probes[b])
                keep[s : s + 20_000] = ok & (first == cell)
            x, y = x[keep], y[keep]
            np.add.at(count, x, many[y])
            np.add.at(count, y, many[x])
            ends = np.flatnonzero(np.diff(x, append=-1)) + 1
            for s, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                out += [(int(rep[a]), int(rep[b]), 0) for a, b in _joined(label, x[s], y[s:e])]
        return out + [(int(rep[k]), None, int(count[k])) for k in np.flatnonzero(count)]

    def rows(batches):
        """Groups are adjacent; the last one of a batch waits for the next batch."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = np.stack([t[c].to_numpy() for c in ("cell", "i", "j", "dim", "label_no")], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(cut):
                held = t
                continue
            yield t.slice(0, cut[-1]), keys[: cut[-1]], cut[:-1]
            held = t.slice(cut[-1])
        if held is not None and held.num_rows:
            keys = np.stack([held[c].to_numpy() for c in ("cell", "i", "j")], 1)
            yield held, keys, np.array([], int)

    def work(batches):
        for t, keys, cut in rows(batches):
            out = []
            rep, block, own, many = (t[c].to_numpy() for c in ("rep", "block", "own", "many"))
            edges = [0, *cut.tolist(), t.num_rows]
            vectors = t["embedding"].combine_chunks()
            for s, e in zip(edges, edges[1:]):
                if e - s > 1:
                    out += group(*map(int, keys[s, :3]), rep[s:e], block[s:e], own[s:e], many[s:e], _units(vectors.slice(s, e - s)))
            a, b, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return work


def near_duplicates(spark: SparkSession, vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    scratch = Scratch(spark, "lattice")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(f"`{ident}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("given"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    usable = F.coalesce(F.col("given").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    kinds = rows.where("usable").groupBy("given", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    kinds = scratch.save(kinds.withColumn("rep", F.monotonically_increasing_id()), "kinds")  # written, so a class keeps its number
    labels = scratch.save(kinds.select("given").distinct().withColumn("label", F.monotonically_increasing_id()), "labels")
    kinds = kinds.join(labels, "given")
    cells_ = scratch.save(in_arrow(kinds.select("rep", "embedding", "label"), _emit, "rep long, dim int, label long, cell long, own boolean"), "cells")
    shared = cells_.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max("own").alias("owned")).where("owned and size > 1")
    shared = shared.select("label", "dim", "cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = cells_.join(shared, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    full = met.join(kinds.select("rep", "many", "embedding"), "rep").withColumnRenamed("label", "label_no")
    keys = ["cell", "i", "j", "dim", "label_no"]
    dealt = full.select(*keys, "rep", "block", "own", "many", "embedding").repartition(*keys).sortWithinPartitions(*keys, "rep")
    links = scratch.save(in_arrow(dealt, _verify(cosine), "a long, b long, n long"), "links")
    roots = components(scratch, links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    rooted = kinds.select("rep", "least", "many").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").join(counts, "rep", "left").select("rep", (F.coalesce("others", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    known = kinds.select("rep", "given", "embedding").join(known, "rep").drop("rep")
    found = rows.where("usable").join(known, ["given", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
