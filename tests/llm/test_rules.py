"""Quality rules against a plain version and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidegauge.llm import queries, rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, common int, kept string, body long, chars double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng, out = random.Random(2), []
    usual = ["the", "and", "of", "to", "a"] * 6 + [f"{a}{b}" for a in ("tide", "gauge", "water", "level") for b in "abcdefgh"]
    for i in range(160):
        ws = [rng.choice(usual) for _ in range(rng.randrange(40, 400))]
        out.append((("x", "y", None)[i % 3] if i % 20 else "rare", " ".join(ws) + rng.choice(["", ".\n\nA line.\n A line.\nA line.", "\t \x0b\f end"])))
    out += [("x", " ".join(f"{w}$$$" for w in t.split())) for _, t in out[:4]] + [("y", t.upper()) for _, t in out[4:8]]
    out += [("x", t) for t in (None, "", " ", "one", "a b c", "a b c a", "a a a a", "ab ab ab ab ab", "é日😀 ﬁ#|" * 40, "same words here " * 30, "w " * 5_000 + "x" * 50_000, "\n".join(["# mark"] * 60))]
    return [(i, t, lang, "s", 1, "k", 2, 0.5) for i, (lang, t) in enumerate(out)] + [(3, out[3][1], out[3][0], None, None, None, None, None), (None, out[5][1], "x", None, None, None, None, None)]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + d for at in places.values() if len(at) > 1 for i in at for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in rules.SYMBOLS), dup, len(covered)


def histograms(text, common):
    w, classes = Counter(WORD.findall(text or "")), [len(re.findall(c, text or "")) for c in rules.CLASSES]
    picks = [w[c] for c in common] + [0] * (rules.COMMON - len(common))
    return classes + [len(text or "") - sum(classes)], picks + [sum(w.values()) - sum(picks)]


def entropy(p):
    return -sum(x * math.log2(x) for x in p if x > 0)


def distance(counts, typical):
    p = [c / max(sum(counts), 1) for c in counts]
    return math.sqrt(max(entropy([(a + b) / 2 for a, b in zip(p, typical)]) - (entropy(p) + entropy(typical)) / 2, 0))


def brute(rows):
    docs = defaultdict(Counter)
    for _, t, lang, *_ in rows:
        docs[lang].update(set(WORD.findall(t or "")))
    common = {g: sorted(c, key=lambda w: (-c[w], w.encode()))[: rules.COMMON] for g, c in docs.items()}
    found, means = [], defaultdict(list)
    for i, t, lang, *_ in rows:
        b = base(t)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        h = histograms(t, common.get(lang, []))
        found.append((i, lang, b, failed, h))
        if not failed:
            means[lang].append(h)
    typical = {g: [[sum(h[k][j] / max(sum(h[k]), 1) for h in hs) / len(hs) for j in range(len(hs[0][k]))] for k in (0, 1)] for g, hs in means.items()}
    for i, lang, b, failed, h in found:
        kept = not failed
        if kept and len(means[lang]) >= rules.LEAST_DOCS:
            far = [distance(h[k], typical[lang][k]) for k in (0, 1)]
            kept = far[0] <= math.sqrt(rules.CLASS_LIMIT + rules.CLASS_NOISE / b[0]) and (b[0] < rules.WORDS_FROM or far[1] <= math.sqrt(rules.WORD_LIMIT + rules.WORD_NOISE / b[0]))
        yield i, *b, failed, kept


def query(spark, docs):
    return rules.judge(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_rules(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, want = sorted(map(tuple, query(spark, docs).collect()), key=str), sorted(brute(rows), key=str)
    assert got == want
    kept = {r[0]: r[-1] for r in got}
    assert not any(kept[i] for i in range(160, 168)) and sum(kept[i] for i in range(160)) > 140
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(con.execute(rules.ORACLE).fetchall(), key=str) == want


def test_few_documents_and_none(spark):
    docs = spark.createDataFrame(texts()[:12], SCHEMA)
    assert all(r.kept != r.base_failed for r in query(spark, docs).collect())
    assert query(spark, docs.limit(0)).count() == 0


def test_copies_do_not_move_the_limits(spark):
    """A third of all documents are one: the others are judged as before."""
    rows = [r for r in texts()[:160] if r[2] == "x"]
    before = {r.doc_id: r.kept for r in query(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    more = rows + [(1000 + i, *rows[0][1:]) for i in range(len(rows) // 2)]
    after = {r.doc_id: r.kept for r in query(spark, spark.createDataFrame(more, SCHEMA)).collect()}
    assert {i: after[i] for i in before} == before


@pytest.mark.parametrize("node", ["Python", "Arrow", "Pandas"])
def test_native(spark, node):
    assert node not in queries.op12_quality_rules(spark, SF)._jdf.queryExecution().toString()
