"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one binned feature at a time are boosted in a cycle over all features, then quadrant trees on the
pairs of features that explain most of what is left; the trees of a feature or pair add up to one lookup table. A
score is the logistic function of the sum of a document's table entries: vectorised bin additions, one pass, no
shuffle. The model is fitted on the driver from the features of at most SAMPLE labelled rows, those whose hashed
ids come first; features are taken from whole texts. Language, source and id are never inputs.

Null texts count as empty; an empty text has a score like any other. Rows with a null id are scored. Without any
labelled row every score is 0.5. Repeated rows get equal scores; other columns pass.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_arrow, null_text

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.7

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "blank": (9, 11, 12, 13, 32), "line": (10,),
    "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "mark": b"$%&*#@^~", "bracket": b"<>{}[]()\\/=_+", "control": [*range(9), *range(14, 32), 127],
}
_ROWS = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _ROWS[list(_c), _i] = 1
FEATURES = [*_CLASSES, "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "plain_words", "words_by_line", "kinds", "kinds_by_root", "pair_kinds", "top_word", "line_kinds", "same_line", "entropy", "capital_words", "letters_by_word"]


def features(text: str | None) -> list[float]:
    """Of a whole text; all finite, all zero for an empty one."""
    raw = (text or "").encode()
    words, n = raw.split(), len(raw)
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = (counts @ _ROWS) / n
    p = counts[counts > 0] / n
    w = len(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds = len(set(lines))
    pairs = len(set(zip(words, words[1:]))) / max(1, w - 1)
    return [
        *share.tolist(), math.log1p(n), math.log1p(w), float(lengths.mean()), float((lengths <= 3).mean()), float((lengths > 12).mean()),
        sum(map(bytes.isalpha, words)) / w, w / len(lines), len(seen) / w, len(seen) / math.sqrt(w), pairs, max(seen.values()) / w, kinds / len(lines), 1 - kinds / len(lines),
        float(-(p * np.log2(p)).sum()), sum(map(bytes.isupper, words)) / w, float(share[0] + share[1] + share[3]) * n / w,
    ]


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AdditiveModel:
    """Lookup tables over binned features and pairs of them."""

    def __init__(self, bins: int = 64, coarse: int = 12, rounds: int = 120, pairs: int = 10, pair_rounds: int = 40, rate: float = 0.12, least: int = 15, ridge: float = 2.0):
        self.bins, self.coarse, self.rounds, self.pairs, self.pair_rounds, self.rate, self.least, self.ridge = bins, coarse, rounds, pairs, pair_rounds, rate, least, ridge
        self.base, self.cuts, self.wide, self.tables, self.pair_tables = 0.0, [], [], [], {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(rate / (1 - rate))
        cut = lambda n: [np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1])) for v in x.T]
        self.cuts, self.wide = cut(self.bins), cut(self.coarse)
        at = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        total = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for table, b in zip(self.tables, at):
                p = _logistic(total)
                step = self.rate * self._tree(b, y - p, p * (1 - p), len(table))
                table += step
                total += step[b]
        wide = [np.searchsorted(c, v, side="right") for c, v in zip(self.wide, x.T)]
        p = _logistic(total)
        gains = [(self._quadrants(wide[i], wide[j], y - p, p * (1 - p), len(self.wide[i]) + 1, len(self.wide[j]) + 1)[0], -i, -j) for i, j in combinations(range(x.shape[1]), 2)]
        self.pair_tables = {(-i, -j): np.zeros((len(self.wide[-i]) + 1, len(self.wide[-j]) + 1)) for g, i, j in sorted(gains, reverse=True)[: self.pairs] if g > 0}
        for _ in range(self.pair_rounds):
            for (i, j), table in self.pair_tables.items():
                p = _logistic(total)
                step = self.rate * self._quadrants(wide[i], wide[j], y - p, p * (1 - p), *table.shape)[1]
                table += step
                total += step[wide[i], wide[j]]
        return self

    def _tree(self, b, g, h, n) -> np.ndarray:
        """A tree of at most three leaves over the bins: the best cut, then the best cut of either side."""
        g, h, c = np.bincount(b, g, n), np.bincount(b, h, n), np.bincount(b, minlength=n)
        value, parts = np.zeros(n), [(0, n)]
        for _ in range(2):
            best = max(((self._cut(g[a:z], h[a:z], c[a:z]), a, z) for a, z in parts if z - a > 1), default=None, key=lambda s: s[0][0])
            if best is None or best[0][0] <= 0:
                break
            (_, k), a, z = best
            parts.remove((a, z))
            parts += [(a, a + k), (a + k, z)]
        if len(parts) > 1:
            for a, z in parts:
                value[a:z] = g[a:z].sum() / (h[a:z].sum() + self.ridge)
        return value

    def _cut(self, g, h, c) -> tuple[float, int]:
        left, right = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        few = np.cumsum(c)[:-1]
        score = left**2 / (right + self.ridge) + (g.sum() - left) ** 2 / (h.sum() - right + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
        score[(few < self.least) | (c.sum() - few < self.least)] = -1
        k = int(np.argmax(score))
        return float(score[k]), k + 1

    def _quadrants(self, a, b, g, h, n, m) -> tuple[float, np.ndarray]:
        """The best tree that cuts both features of a pair once: its gain and its values."""
        value = np.zeros((n, m))
        if n < 2 or m < 2:
            return 0.0, value
        sums = []
        for w in (g, h, np.ones(len(g))):
            s = np.bincount(a * m + b, w, n * m).reshape(n, m).cumsum(0).cumsum(1)
            ll, up, lt, all_ = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
            sums.append(np.stack(np.broadcast_arrays(ll, up - ll, lt - ll, all_ - up - lt + ll)))
        gs, hs, cs = sums
        gain = (gs**2 / (hs + self.ridge)).sum(0) - g.sum() ** 2 / (h.sum() + self.ridge)
        gain[(cs < self.least).any(0)] = -1
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[i, j] <= 0:
            return 0.0, value
        q = gs[:, i, j] / (hs[:, i, j] + self.ridge)
        value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = q
        return float(gain[i, j]), value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for c, t, v in zip(self.cuts, self.tables, x.T):
            total += t[np.searchsorted(c, v, side="right")]
        for (i, j), t in self.pair_tables.items():
            total += t[np.searchsorted(self.wide[i], x[:, i], side="right"), np.searchsorted(self.wide[j], x[:, j], side="right")]
        return _logistic(total)


def _matrix(column) -> np.ndarray:
    return np.array([features(t.as_py()) for t in column]).reshape(len(column), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """labels: the rows to learn from, (doc_id, quality)."""
    some = labels.where(F.col(ident).isNotNull() & F.col(label).isNotNull()).select(F.col(ident).alias("id"), F.col(label).cast("int").alias("y"))
    some = F.broadcast(some.orderBy(F.xxhash64("id"), "id", "y").limit(sample))  # at most `sample` rows of 12 bytes

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_matrix(b.column(2)).tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    given = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), null_text(f"`{text}`").alias("body")).join(some, "id").select("id", "y", "body")
    rows = in_arrow(given, work, "id long, y int, x array<double>").toArrow()
    ids, y = rows["id"].to_numpy(), rows["y"].to_numpy().astype(float)
    x = np.array(rows["x"].to_pylist()).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, ids))
    return AdditiveModel().fit(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in column `to`."""
    names = [c for c in docs.columns if c != to]

    def work(batches):
        for b in batches:
            found = model.score(_matrix(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[f"c{i}" for i in range(b.num_columns - 1)] + ["s"])

    schema = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)] + [StructField("s", DoubleType())])
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], null_text(f"`{text}`").alias("body"))
    return in_arrow(given, work, schema).toDF(*names, to)
