"""Toxicity by maximum-scoring segments.

Every word has the log-odds of being in toxic rather than in other documents, under an informative Dirichlet prior:
PRIOR documents dealt as those of all words with its first ROOT characters, and these as all documents. It scores its
log-odds less Z of their standard deviations, or -DRIFT where that isn't above zero, so weak evidence counts for
little and none is cut off. A word's evidence is that of the whole word or else of its first STEMS characters, so
inflected forms count. A linear-time scan finds all maximal segments of positive score of a document, its passages;
equal ones count once, since lines repeat.

The chance that a document of the background has a score of s or more in n words follows the extreme-value law
1 - exp(-K n exp(-lambda s)). K and lambda are fitted to the labelled documents that aren't toxic, each scored by
words learned from the other FOLDS - 1 folds: lambda by the excesses over their TAIL quantile, counted up to the
quantile NOISE, as beyond it wrong labels stand; K by the number of excesses. A passage is significant if its chance
is at most SIGNIFICANT. A document's score is 1 / (1 + chance / ALPHA), with the chance of all its passages' sum.

The table is learned from at most SAMPLE labelled rows (those whose hashed ids come first; equal texts count once).
Spark counts the words, and those that score reach the driver: words of several toxic rows each, so SAMPLE bounds
them. Whole texts are read; language, source and id are never inputs. Null texts count as empty; a text without a
passage has the score 0. Without labelled rows of both kinds nothing is toxic. Rows with null ids are scored; repeated
rows get equal scores. Input columns other than id and text aren't read and may have any names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Scratch, in_arrow, null_text

SAMPLE = 40_000
STEMS, ROOT = (6, 5), 4
PRIOR, Z = 15.0, 2.3
DRIFT = 1.0
FOLDS, TAIL, NOISE = 4, 0.9, 0.99
SIGNIFICANT, ALPHA, THRESHOLD = 0.05, 0.005, 0.5
_WORD = re.compile(r"[^\W\d_]+")
#: Entries that a worker remembers of words it has looked up.
MEMO = 100_000


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall((text or "").lower())


def terms(found: list[str]) -> set[str]:
    """Distinct words, and their first characters with a * after them."""
    kinds = set(found)
    return kinds | {f"{w[:k]}*" for w in kinds for k in (*STEMS, ROOT) if len(w) > k}


class _Memo(dict):
    """The scores of words looked up so far, at most MEMO."""

    def __init__(self, table: dict[str, float]):
        self.table = table

    def __missing__(self, w: str) -> float:
        found = self.table.get(w)
        for k in STEMS:
            if found is None and len(w) > k:
                found = self.table.get(f"{w[:k]}*")
        if len(self) >= MEMO:
            self.clear()
        self[w] = found or 0.0
        return found or 0.0


class Segments:
    """The table of words and stems (a stem has a * at its end), and the law of its segments' scores."""

    def __init__(self, table: dict[str, float], decay: float, factor: float):
        self.table, self.decay, self.factor = table, decay, factor
        self.memo = _Memo(table)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words; all maximal segments as (first word, word after the last, score), from left to right."""
        found = words(text)
        return len(found), self._segments(found)

    def total(self, text: str | None) -> tuple[int, float]:
        """The number of words; the sum of scores of all maximal segments, equal ones once."""
        found = words(text)
        return len(found), self._sum(found, self._segments(found))

    @staticmethod
    def _sum(found: list[str], parts: list[tuple[int, int, float]]) -> float:
        return sum({tuple(found[a:b]): s for a, b, s in parts}.values())

    def _segments(self, found: list[str]) -> list[tuple[int, int, float]]:
        """Runs of words without a score are stepped over at once. Each segment on the stack has the total before it
        and after it; a new one takes in those before it from the last that starts lower, if it ends higher."""
        hits = [(i, s) for i, s in enumerate(map(self.memo.__getitem__, found)) if s]
        stack: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, last with a lower start
        total, at = 0.0, 0
        for i, s in hits:
            total -= DRIFT * (i - at)
            low, first, at = total, i, i + 1
            total += s
            j = len(stack) - 1
            while True:
                while j >= 0 and stack[j][2] >= low:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= total:
                    break
                first, low, k = stack[j][0], stack[j][2], stack[j][4]
                del stack[j:]
                j = k
            stack.append((first, at, low, total, j))
        return [(a, b, after - low) for a, b, low, after, _ in stack]

    def chance(self, n: int, score: float) -> float:
        return -math.expm1(-self.factor * max(n, 1) * math.exp(-self.decay * score)) if score > 0 else 1.0

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The document's score; its passages with the chance of each."""
        found = words(text)
        n, parts = len(found), self._segments(found)
        all_ = self._sum(found, parts)
        return 1 / (1 + self.chance(n, all_) / ALPHA) if all_ > 0 else 0.0, [(a, b, s, self.chance(n, s)) for a, b, s in parts]

    def score(self, text: str | None) -> float:
        return self.judged(text)[0]


def law(n: np.ndarray, total: np.ndarray) -> tuple[float, float]:
    """lambda and K of the background's documents: their numbers of words and scores."""
    order = np.lexsort((n, total))
    n, total = np.maximum(n[order].astype(float), 1), total[order]
    least, most = np.quantile(total, TAIL), np.quantile(total, NOISE)
    over = total > least
    if not over.any() or most <= least:
        return 1.0, 1 / n.sum()
    decay = float((over & (total < most)).sum() / np.minimum(total[over] - least, most - least).sum())
    lo, hi = 1e-12, 1e6
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if -np.expm1(-mid * n * math.exp(-decay * least)).sum() < over.sum() else (lo, mid)
    return decay, hi


def _tables(scratch: Scratch, given: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """given: (y, fold, body). The table of all rows, and for each fold that of the others."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(terms(words(t.as_py()))) for t in b.column(2)], pa.list_(pa.string()))], names=["y", "fold", "terms"])

    parts = range(FOLDS)
    both = lambda y: [F.sum(y).alias("all"), *[F.sum(F.when(F.col("fold") != k, y).otherwise(0)).alias(f"f{k}") for k in parts]]
    counts = [c.alias(f"{side}_{name}") for side, y in (("t", F.col("y")), ("c", 1 - F.col("y"))) for c, name in zip(both(y), ("all", *parts))]
    size = given.agg(*counts).first()
    found = in_arrow(given.select("y", "fold", "body"), work, "y int, fold int, terms array<string>")
    seen = scratch.save(found.select("y", "fold", F.explode("terms").alias("w")).groupBy("w").agg(*counts), "terms")
    is_root = (F.length("w") == ROOT + 1) & F.col("w").endswith("*")
    root = seen.where(is_root).select(F.col("w").alias("root"), *[F.col(c).alias(f"root_{c}") for c in seen.columns[1:]])
    stem = F.when(F.length(F.rtrim("w", F.lit("*"))) > ROOT, F.concat(F.substring("w", 1, ROOT), F.lit("*")))
    own = seen.where(~is_root).join(root, stem == F.col("root"), "left")

    def value(k) -> Column:
        t, c = size[f"t_{k}"] or 0, size[f"c_{k}"] or 0
        base = (t + 1) / (t + c + 2)
        rt, rc = F.col(f"root_t_{k}"), F.col(f"root_c_{k}")
        share = F.coalesce((rt + PRIOR * base) / (rt + rc + PRIOR), F.lit(base))
        x, y = F.col(f"t_{k}") + PRIOR * share, F.col(f"c_{k}") + PRIOR * (1 - share)
        return F.ln(x / y) - math.log(base / (1 - base)) - Z * F.sqrt(1 / x + 1 / y)

    values = [value(k).alias(f"s_{k}") for k in ("all", *parts)]
    rows = own.select("w", *values).where(F.greatest(*[F.col(f"s_{k}") for k in ("all", *parts)]) > 0).collect()
    table = lambda k: {r.w: r[f"s_{k}"] for r in rows if r[f"s_{k}"] > 0}
    return table("all"), [table(k) for k in parts]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Segments:
    """labels: the rows to learn from, (doc_id, toxic)."""
    scratch = Scratch(spark, "toxicity")
    some = labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull()).select(F.col(ident).alias("id"), (F.col(label) > 0).cast("int").alias("y"))
    some = F.broadcast(some.orderBy(F.xxhash64("id"), "id", "y").limit(sample))  # at most `sample` rows of 12 bytes
    given = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), null_text(f"`{text}`").alias("body")).join(some, "id")
    given = given.select("y", F.pmod(F.xxhash64("body"), F.lit(FOLDS)).cast("int").alias("fold"), "body", F.sha2("body", 256).alias("same"))
    given = scratch.save(given.dropDuplicates(["same", "y"]).drop("same"), "sample")
    kinds = given.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("other")).first()
    if not kinds.toxic or not kinds.other:
        return Segments({}, 1.0, 1.0)
    table, others = _tables(scratch, given)

    def work(batches):
        folds = [Segments(t, 1.0, 1.0) for t in others]
        for b in batches:
            found = [folds[k].total(t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["n", "s"])

    background = in_arrow(given.where("y = 0").select("fold", "body"), work, "n long, s double").toArrow()  # two numbers for each of at most `sample` rows
    return Segments(table, *law(background["n"].to_numpy(), background["s"].to_numpy()))


def score(docs: DataFrame, model: Segments, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(doc_id, score, passages) for every row; passages: all maximal segments as (first word, word after the last,
    score, chance of as high a score in the document's length)."""
    table, decay, factor = model.table, model.decay, model.factor

    def work(batches):
        m = Segments(table, decay, factor)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
        for b in batches:
            found = [m.judged(t.as_py()) for t in b.column(1)]
            parts = [[{"first": x, "after": y, "score": s, "chance": p} for x, y, s, p in some] for _, some in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(parts, kind)], names=["doc_id", "score", "passages"])

    part = StructType([StructField("first", LongType()), StructField("after", LongType()), StructField("score", DoubleType()), StructField("chance", DoubleType())])
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), StructField("passages", ArrayType(part))])
    return in_arrow(docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), null_text(f"`{text}`").alias("body")), work, schema)
