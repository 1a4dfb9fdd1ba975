"""Each operator against a brute-force version or SQL, with nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import date
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, lattice, licences, mix, pieces, quality, queries, simhash, token_files, toxicity, url_filter
from tidegauge.llm.common import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, part int, ids array<int>, score double"
WORDS = "tide gauge water level sensor pump basin flow storm rain river delta weir sluice canal lock pool bank".split()


def texts() -> list[tuple]:
    rng = random.Random(3)
    some = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 120))) for _ in range(40)]
    near = [f"{t} and one word more at its end" for t in some[:6]] + [t.replace("tide", "TIDE") for t in some[6:9]]
    odd = [None, "", " ", "a", "a  b\t\n", "▁▁ x", "<s> </s> <|endoftext|>", "é é ﬁ　日本 😀", "word " * 3000 + "end", "x" * 20_000]
    rows = [*some, *near, *odd, *odd, *some[:5], *[some[0]] * 30]
    out = [(i, t, None, (None, "", "b", "a", "z")[i % 5], None) for i, t in enumerate(rows)]
    return out + [out[0], (None, "a null id", None, "a", None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, True, 1, [1], 0.5) for r in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def piece_model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(docs, none, piece_model):
    got = pieces.digests(docs).collect()
    want = []
    for i, t, *_ in texts():
        ids = piece_model.encode(t or "")
        whole = [1, *ids, 2]
        want.append((i, len(whole), hashlib.sha256(np.array(whole, "<u4").tobytes()).hexdigest(), hashlib.sha256(piece_model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = pieces.encode(docs)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "kept", "part", "score", "ids"]
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert all(back[i] == piece_model.decode(piece_model.encode(t or "")) for i, t, *_ in texts() if i is not None)
    assert pieces.digests(none).count() == 0 and pieces.encode(none).count() == 0


def test_pieces_random(piece_model):
    rng, table = random.Random(5), pieces.load(None)
    assert table.marked
    some = ["".join(rng.choice(" ▁ ab\n\té日　\x00ﬁ😀<s>") for _ in range(rng.randrange(25))) for _ in range(3000)]
    for t, ids in zip(some, table.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == [1, *piece_model.encode(t), 2] and table.decode(ids) == piece_model.decode(piece_model.encode(t))


def test_pieces_table_is_bounded(piece_model, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_BYTES", 10 * pieces.ENTRY)
    table = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    some = [t or "" for _, t, *_ in texts()][:70]
    assert [np.frombuffer(i, "<u4").tolist()[1:-1] for i in table.encode(some)] == piece_model.encode(some)
    assert table.ids
    table.forget()
    assert not table.ids and not table.held


def test_pieces_decode_reads_the_ids(spark, piece_model, monkeypatch):
    """Another id in a document gives another decoded text: texts are decoded from ids, not from what they were."""
    given = spark.createDataFrame([(1, "a tide gauge"), (2, "water level")], "doc_id long, text string")
    table, wrong = pieces.load(None), piece_model.piece_to_id("▁pump")
    ids = np.frombuffer(next(table.encode(["a tide gauge"])), "<u4").copy()
    ids[-2] = wrong
    assert table.decode(ids.tobytes()) == piece_model.decode([*piece_model.encode("a tide gauge")[:-1], wrong])
    coded = pieces.encode(given)
    changed = coded.withColumn("ids", F.transform("ids", lambda x: F.when(x == int(piece_model.encode("a tide gauge")[-1]), wrong).otherwise(x)))
    assert {r.doc_id: r.text for r in pieces.decode(changed).collect()} == {1: table.decode(ids.tobytes()), 2: "water level"}


def test_pieces_whole_texts(piece_model):
    """A model whose chunks can't be cut is given whole texts."""
    table = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    table.marked = False
    some = [t or "" for _, t, *_ in texts()][:70]
    assert [np.frombuffer(i, "<u4").tolist()[1:-1] for i in table.encode(some)] == piece_model.encode(some) and not table.ids


def duck(sql: str, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).to_arrow_table()


def same(got, want):
    assert sorted(got.columns) == sorted(want.column_names)
    rows = lambda d: sorted(repr(sorted(r.items())) for r in d.to_pylist())
    assert rows(got.toArrow()) == rows(want)


def urls():
    rng = random.Random(1)
    out = [None, "", "no scheme", "://", "http://", "HTTP://COM/en/", "x://Example.COM/en/7?q", "http://a.example.com/en/79#t", "https://example.net/de/8x", "http://net/de/", "http://xnet/de/", "http://org/es", "http://é.org/es/Ä", "a://b://c/d"]
    out += [f"https://{rng.choice(['www', 'm', 'spam-farm', 'blog'])}.{rng.choice(['tide', 'flood'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(999)}" for _ in range(400)]
    out += ["https://www.tide.example.org/fr/" + "long/" * 4_000, "x://" + "a" * 10_000 + ".com/en/"]
    return [(i, u, "h", "x") for i, u in enumerate(out)] + [(3, out[3], None, "x"), (None, "http://example.com/en/1", None, None)]


def test_url_filter(spark):
    pages = spark.createDataFrame(urls(), "page_id long, url string, html string, rule string").repartition(3)
    got = url_filter.verdicts(spark, pages)
    same(got, duck(url_filter.ORACLE, pages=pages))
    by = {r.page_id: r for r in got.collect()}
    assert (by[6].host, by[6].path, by[6].rule, by[6].verdict) == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert by[7].rule == "example.com/en/7" and by[8].verdict == "block" and by[9].rule == "net/de/" and by[10].rule is None and by[11].rule is None
    assert by[0].host == by[2].host == "" and by[0].verdict == "block"
    assert url_filter.verdicts(spark, pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.verdicts(spark, pages.where("page_id = 10")).collect()} == {"allow"}


def test_url_threshold_is_held_out(spark):
    """Held-out urls don't teach the models: their words give no ratio."""
    pages = spark.createDataFrame([(i, f"http://net/de/{i}") for i in range(40)], "page_id long, url string")
    urls = url_filter.judged(pages, url_filter.RULES)
    held = {r.page_id for r in urls.where("held").collect()}
    assert 0 < len(held) < 20 and urls.where("said != 'allow'").count() == 0
    odd = next(i for i in held)
    rows = [(i, f"http://net/de/{i}") for i in range(40) if i not in held] + [(odd, f"http://net/de/{odd}")]
    got = {r.page_id: r for r in url_filter.verdicts(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()}
    rest = {r.page_id: r for r in url_filter.verdicts(spark, spark.createDataFrame(rows[:-1], "page_id long, url string")).collect()}
    assert all(got[i].ratio == rest[i].ratio for i in rest)


def test_mix(spark, docs, none):
    got = mix.taken(spark, docs)
    same(got, duck(mix.ORACLE, documents=docs.select("doc_id", "text", "source")))
    assert all(r.taken <= 3 * r.size for r in got.collect())
    mixed = mix.mix(spark, docs)
    assert set(docs.columns) <= set(mixed.columns)
    words = mixed.select(mix.words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == got.agg(F.sum("taken")).first()[0]
    assert mixed.where("shard is null or place is null").count() == 0 and 1 < mixed.select("shard").distinct().count() <= 1 << mix.LEVELS
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mix.mix(spark, docs.repartition(2)).collect()))
    assert mix.mix(spark, docs, shard=None, place=None).columns == docs.columns
    assert mix.taken(spark, none).count() == 0 and mix.mix(spark, none).count() == 0
    clash = docs.withColumnsRenamed({"lang": "__source", "n_chars": "__held", "part": "__shard", "score": "_plan", "kept": "shard"})
    assert mix.shuffled(mix.mix(spark, clash)).count() == mixed.count()


def _many(spark, sources=5, rows=6000):
    return spark.range(rows).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.least(F.pmod(F.xxhash64("id"), F.lit(9)), F.lit(sources - 1))).alias("source"))


def test_mix_tree(spark):
    """Quotas are exact at every node, halves are even, shards hold disjoint blocks in the sources' proportions, and
    what the leaves hold is what op3 takes."""
    docs = _many(spark)
    sized = mix.sizes(docs)
    levels, bits = mix.shape(sized.agg(F.sum("size")).first()[0], 2000)
    assert levels == 7 and bits == 12
    leaf, rows, nodes = 1 << levels, {}, mix.tree(mix.quotas(sized, bits), levels)
    for node, held in sorted(map(tuple, nodes.collect())):
        for q in held:
            rows.setdefault(q.source, []).append(q.quota)
    for held in rows.values():
        assert len(held) == 2 * leaf - 1 and all(held[n - 1] == held[2 * n - 1] + held[2 * n] for n in range(1, leaf))
    table = mix.dealt(nodes, levels, bits).collect()
    taken = Counter((r.source, shard) for r in table for shard in r.shards)
    assert all(taken[s, n] == held[leaf - 1 + n] for s, held in rows.items() for n in range(leaf))
    total = [sum(h[n] for h in rows.values()) for n in range(2 * leaf - 1)]
    assert all(total[2 * n - 1] == total[n - 1] // 2 for n in range(1, leaf))
    mixed = mix.mix(spark, docs, shard_words=2000).withColumn("block", mix.block(mix.spot(F.col("doc_id")), bits))
    deal = mixed.groupBy("source", "shard").agg(F.countDistinct("block").alias("n")).collect()
    assert all(r.n <= rows[r.source][leaf - 1 + r.shard] for r in deal)
    counts = mixed.groupBy("doc_id", "source", "block").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("m")).collect()
    quota = {s: h[0] for s, h in rows.items()}
    assert all(r.n == sum(i * 4096 + r.block < quota[r.source] for i in range(3)) for r in counts)
    got = mix.taken(spark, docs, shard_words=2000)
    assert got.agg(F.sum("taken")).first()[0] == mixed.agg(F.sum(mix.words(F.col("text")))).first()[0]


def test_mix_table_is_joined(spark, monkeypatch):
    """However many shards there are, a document's row carries its own alone; large tables are merged, not broadcast."""
    docs = _many(spark, rows=800)
    few, many = (mix.mix(spark, docs, shard_words=n)._jdf.queryExecution().optimizedPlan().toString().lower() for n in (100_000, 100))
    assert few.count("array") == many.count("array") and "held" not in many and "quota" not in many
    want = sorted(map(str, mix.mix(spark, docs, shard_words=100).collect()))
    monkeypatch.setattr(mix, "BROADCAST_ROWS", 0)
    merged = mix.mix(spark, docs, shard_words=100)
    assert "strategy=merge" in merged._jdf.queryExecution().optimizedPlan().toString() and sorted(map(str, merged.collect())) == want
    assert mix.taken(spark, docs).agg(F.sum("taken")).first()[0] > 0


def test_mix_takes_through_the_tree(spark, monkeypatch):
    """Without the tree's leaves nothing is taken."""
    docs = _many(spark, rows=500)
    assert mix.taken(spark, docs).agg(F.sum("taken")).first()[0] > 0
    whole = mix.tree
    monkeypatch.setattr(mix, "tree", lambda goal, levels: whole(goal, levels).withColumn("held", F.when(F.col("node") < 1 << levels, F.col("held")).otherwise(F.transform("held", lambda q: q.withField("quota", F.lit(0).cast("long"))))))
    assert mix.taken(spark, docs).agg(F.sum("taken")).first()[0] == 0


def test_hypergeometric(spark):
    """Quantiles against exact fractions."""
    rng, rows = random.Random(4), []
    for most in (30, 400, 5000):
        for _ in range(150):
            n = rng.randrange(most)
            rows.append((n, rng.randint(0, n), rng.randint(0, n), rng.randrange(1 << 52) / (1 << 52)))

    def exact(n, k, d, u):
        at, seen = Fraction(u) * math.comb(n, d), 0
        for x in range(max(0, d - n + k), min(d, k) + 1):
            seen += math.comb(k, x) * math.comb(n - k, d - x)
            if at < seen:
                return x

    given = spark.createDataFrame(rows, "n long, k long, d long, u double")
    got = given.select("*", F.expr(mix.hypergeometric("n", "k", "d", "u")).alias("x")).collect()
    assert all(r.x == exact(r.n, r.k, r.d, r.u) for r in got)


def test_mix_targets(spark):
    sizes = {"a": 100, "b": 7, "c": 1000, "d": 0, None: 300}
    got = {r.source: r.target for r in mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, held, left = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        share = {s: (left - sum(held.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not above:
            break
        held |= above
    assert got == pytest.approx(held | share)


def test_mix_near_targets(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}") for i in range(6000)]
    got = mix.taken(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.002 * r.target + 50


def brute_components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def slow_sketch(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("table", ["fixture", "sf0.01"])
def test_simhash(spark, docs, table):
    given = docs if table == "fixture" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(spark, given).collect()
    prints = {i: slow_sketch(t) for i, t in rows if i is not None}
    assert all(r.fp % 2**64 == prints[r.doc_id] for r in got if r.doc_id is not None) and len(got) == len(rows)
    kinds = sorted({*prints.values(), *(slow_sketch(t) for i, t in rows if i is None)})
    near = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert near
    roots = brute_components(kinds, near)
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(i, least[roots[f]]) for i, f in prints.items()}
    stays = simhash.keep(spark, given.withColumn("__gone", F.lit(1))).drop("__gone")
    assert stays.columns == given.columns and {r.doc_id for r in stays.collect() if r.doc_id is not None} == set(least.values())


def test_simhash_ball(spark):
    """All pairs within the radius of random fingerprints are joined, at every distance and in either half; no others."""
    rng = random.Random(9)
    rows = []
    for n in range(150):
        f = rng.getrandbits(64)
        rows += [f, f ^ sum(1 << b for b in rng.sample(range(64), n % 8))]
    rows = sorted(set(rows))
    got = simhash.links(spark.createDataFrame([(simhash._long(f),) for f in rows], "fp long")).collect()
    roots = brute_components(rows, [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if (a ^ b).bit_count() <= 4])
    assert brute_components(rows, [(r.a % 2**64, r.b % 2**64) for r in got]) == roots
    assert simhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup(spark, docs, none):
    got = exact_dedup.annotate(spark, docs)
    assert {"lang", "source", "n_chars", "part", "score"} < set(got.columns)
    groups = {}
    for i, t, *_ in texts():
        groups.setdefault(t or "", []).append(i)
    most = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = sorted(((i, most[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in texts()), key=str)
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "text_sha256").collect()), key=str) == want
    assert got.where("kept").count() == len(groups)
    stays = exact_dedup.keep(spark, docs)
    assert stays.columns == docs.columns and sorted(((r.text or "", r.doc_id) for r in stays.collect()), key=str) == sorted(most.items(), key=str)
    assert exact_dedup.annotate(spark, none).count() == 0 and exact_dedup.keep(spark, none).count() == 0


def test_exact_dedup_over_partitions(spark):
    """A text that most rows share goes over many partitions."""
    rows = [(i, "same text" if i % 3 else f"text {i % 100}") for i in range(3000)]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(exact_dedup.annotate(spark, given), duck(queries.ORACLES["op9_exact_dedup"], documents=given))
        assert exact_dedup.keep(spark, given).count() == len({t for _, t in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_quality(spark, docs, none):
    got = queries.op5_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    n = got.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("predicted")).alias("right"), F.expr("count_if(quality = 1 and predicted = 0)").alias("lost"), F.expr("count_if(quality = 1)").alias("clean")).first()
    assert n.right >= 0.97 * n.n and n.lost <= 0.01 * n.clean
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    scored = quality.score(docs, model)
    assert set(scored.columns) == set(docs.columns) and scored.where("score != 0.5 or score is null").count() == 0 and scored.count() == docs.count()
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (2, None), (999, 1)], "doc_id long, quality int"))
    assert quality.score(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, model).count() == 0 and not any(quality.features(None)) and np.isfinite(quality.features("a " * 99_999)).all()


def test_quality_model():
    """Bins, trees' tables and scores against plain loops."""
    rng = np.random.default_rng(6)
    x = np.stack([rng.normal(size=300), rng.integers(0, 4, 300), np.zeros(300)], 1).astype(float)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 2)).astype(float)
    model = quality.AdditiveModel(bins=8, coarse=4, rounds=3, pairs=1, pair_rounds=2).fit(x, y)
    assert [len(c) + 1 for c in model.cuts] == [len(t) for t in model.tables] and model.tables[2].tolist() == [0] * len(model.tables[2])
    for row, got in zip(x, model.score(x)):
        total = model.base
        for v, cuts, table in zip(row, model.cuts, model.tables):
            total += table[sum(c <= v for c in cuts)]
        for (i, j), table in model.pair_tables.items():
            total += table[sum(c <= row[i] for c in model.wide[i]), sum(c <= row[j] for c in model.wide[j])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    # one round over one feature: the best of all trees with three leaves grown cut by cut
    bins, p = np.searchsorted(model.cuts[0], x[:, 0], side="right"), 1 / (1 + math.exp(-model.base))
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda some: g[some].sum() ** 2 / (h[some].sum() + model.ridge)
    parts = [bins >= 0]
    for _ in range(2):
        best = max(((gain(a & (bins < k)) + gain(a & (bins >= k)) - gain(a), i, k) for i, a in enumerate(parts) for k in range(1, 8) if min((a & (bins < k)).sum(), (a & (bins >= k)).sum()) >= model.least), key=lambda t: t[0])
        a = parts.pop(best[1])
        parts += [a & (bins < best[2]), a & (bins >= best[2])]
    want = np.zeros(len(model.tables[0]))
    for a in parts:
        want[np.unique(bins[a])] = g[a].sum() / (h[a].sum() + model.ridge)
    assert model._tree(bins, g, h, len(want)) == pytest.approx(want)


def test_quality_rows(spark):
    """Repeated rows and null ids are scored; columns of any name pass."""
    rows = [(1, "a tide gauge", 0.1), (1, "a tide gauge", 0.1), (None, "a tide gauge", 0.1), (2, None, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, body double").withColumns({"s": F.lit(1), "c0": F.lit("x")})
    got = quality.score(given, quality.train(given, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int"))).collect()
    assert len(got) == 4 and len({r.score for r in got if r.text}) == 1 and all(r.s == 1 and r.c0 == "x" for r in got)


def slow_segments(scores):
    """Maximal scoring subsequences by their definition, recursively; of equal ones the shortest."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9 or at and total > best - 1e-9 and j + 1 - i < at[1] - at[0]:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return slow_segments(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in slow_segments(scores[b:])]


def test_segments():
    rng = random.Random(2)
    model = toxicity.Segments({"bad": 3.5, "awful": 6.25, "nasty*": 0.75}, 1.0, 0.5)
    for _ in range(300):
        words = [rng.choice(["bad", "awful", "nastyyy", "a", "b", "c", "d", "e"]) for _ in range(rng.randrange(30))]
        n, got = model.passages(" ".join(words))
        value = {"bad": 3.5, "awful": 6.25, "nastyyy": 0.75}
        want = slow_segments([value.get(w) or -toxicity.DRIFT for w in words])
        assert n == len(words) and sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert max((s for *_, s in got), default=0) == pytest.approx(max((s for *_, s in want), default=0))
    assert model.score(None) == model.score("") == 0 and model.score("awful awful") > model.score("bad")


def test_toxicity(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    n = got.agg(F.expr("count_if(toxic = 1)").alias("toxic"), F.expr("count_if(toxic = 1 and predicted = 1)").alias("hit"), F.expr("count_if(toxic = 0)").alias("clean"), F.expr("count_if(toxic = 0 and predicted = 1)").alias("wrong")).first()
    assert n.hit >= 0.9 * n.toxic and n.wrong <= 0.01 * n.clean
    model = toxicity.train(spark, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score != 0").count() == 0
    assert toxicity.score(none, model).count() == 0
    model = toxicity.train(spark, none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert model.table == {}


def _table(rows):
    """Words' scores from (words, toxic) by the docstring's formula."""
    size = Counter(y for _, y in rows)
    seen = {0: Counter(), 1: Counter()}
    for found, y in rows:
        kinds = set(found)
        for k in (4, 5, 6):
            kinds |= {w[:k] + "*" for w in found if len(w) > k}
        seen[y].update(kinds)
    base, out = (size[1] + 1) / (size[0] + size[1] + 2), {}
    for w in {*seen[0], *seen[1]}:
        if len(w) == 5 and w[-1] == "*":
            continue
        share, root = base, w.rstrip("*")[:4] + "*"
        if len(w.rstrip("*")) > 4:
            share = (seen[1][root] + toxicity.PRIOR * base) / (seen[1][root] + seen[0][root] + toxicity.PRIOR)
        x, y = seen[1][w] + toxicity.PRIOR * share, seen[0][w] + toxicity.PRIOR * (1 - share)
        value = math.log(x / y) - math.log(base / (1 - base)) - toxicity.Z * math.sqrt(1 / x + 1 / y)
        if value > 0:
            out[w] = value
    return out


def test_toxicity_learning(spark):
    """The table, the folds' background and every score against plain Python; nulls, ties, repeated rows, odd columns."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumns({"same": F.lit("x"), "y": F.lit(2), "fold": F.lit(9)})
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    extra = docs.limit(3).unionByName(spark.createDataFrame([(None, "idiot scum trash"), (10**9, None), (10**9 + 1, "scum " * 30_000)], "doc_id long, text string").withColumns({"same": F.lit("x"), "y": F.lit(2), "fold": F.lit(9)}))
    given = docs.unionByName(extra)
    more = labels.unionByName(spark.createDataFrame([(10**9, 0), (None, 1), (5, None)], "doc_id long, toxic int"))
    model = toxicity.train(spark, given, more)
    text = {r.doc_id: r.text for r in given.collect()}
    fold = {r.doc_id: r.f for r in given.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(4)).alias("f")).collect()}
    rows = {(text[r.doc_id] or "", int(r.toxic > 0)): fold[r.doc_id] for r in more.collect() if r.toxic is not None and r.doc_id in text and r.doc_id is not None}
    words = [(re.findall(r"[^\W\d_]+", t.lower()), y, f) for (t, y), f in rows.items()]
    assert model.table == pytest.approx(_table([(w, y) for w, y, _ in words])) and len(model.table) > 5
    folds = [toxicity.Segments(_table([(w, y) for w, y, f in words if f != k]), 1.0, 1.0) for k in range(4)]
    background = [(len(w), sum({tuple(w[a:b]): s for a, b, s in folds[f].passages(" ".join(w))[1]}.values())) for w, y, f in words if not y]
    decay, factor = toxicity.law(*map(np.array, zip(*background)))
    assert (model.decay, model.factor) == pytest.approx((decay, factor))
    for r in toxicity.score(given, model).collect():
        w = re.findall(r"[^\W\d_]+", (text[r.doc_id] or "").lower())
        total = sum({tuple(w[a:b]): s for a, b, s in model.passages(" ".join(w))[1]}.values())
        chance = 1 - math.exp(-factor * len(w) * math.exp(-decay * total))
        assert r.score == pytest.approx(1 / (1 + chance / toxicity.ALPHA) if total else 0)


def test_toxicity_law():
    """Totals drawn by the law give back its lambda; the number over the quantile is met by K."""
    rng = np.random.default_rng(2)
    n = rng.integers(20, 400, 40_000)
    drawn = np.maximum(-np.log(-np.log(rng.random(len(n))) / (1e-3 * n)) / 1.7, 0)
    decay, factor = toxicity.law(n, drawn)
    assert decay == pytest.approx(1.7, rel=0.1) and factor == pytest.approx(1e-3, rel=0.15)
    assert toxicity.law(np.array([5, 7]), np.zeros(2)) == (1.0, 1 / 12)


def test_e8():
    rng = np.random.default_rng(4)
    y = rng.normal(size=(300, 8)) * 3
    got = lattice.decode(y)
    near = np.concatenate([np.zeros((1, 8), int), lattice._shortest()])
    assert len(lattice._shortest()) == 240
    assert ((got % 2 == 0).all(1) | (got % 2 == 1).all(1)).all() and (got.sum(1) % 4 == 0).all()
    others = (((got[:, None] + near) / 2 - y[:, None]) ** 2).sum(2)
    assert np.allclose(others.min(1), others[:, 0])


def vectors():
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for g in range(120):
        u = rng.normal(size=32)
        for c in rng.uniform(0.9, 1.0, size=rng.integers(1, 5)):
            w = rng.normal(size=32)
            w -= w @ u / (u @ u) * u
            w *= np.linalg.norm(u) / np.linalg.norm(w)
            rows.append((i, (c * u + np.sqrt(1 - c * c) * w).astype(np.float32).tolist(), g % 3))
            i += 1
    hub = rng.normal(size=32)
    for _ in range(700):
        rows.append((i, (hub + 0.1 * rng.normal(size=32)).astype(np.float32).tolist(), 7))
        i += 1
    rows += [(i + k, rows[5][1], rows[5][2]) for k in range(40)]
    i += 40
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows += [(i + k, v, 1) for k, v in enumerate(odd)] + [(i + 20, rows[0][1], None), (i + 21, rows[0][1], None)]
    return rows


def test_lattice(spark):
    rows = vectors()
    given = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    got = {r.vec_id: r for r in lattice.near_duplicates(spark, given).collect()}
    assert len(got) == len(rows)
    links = {i: set() for i, *_ in rows}
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for n, (i, u, l) in enumerate(good):
        for j, v, m in good[n + 1 :]:
            if l == m and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    total = sum(map(len, links.values()))
    found = sum(r.n_links for r in got.values())
    assert total > 10_000 and 0.95 * total <= found <= total and all(got[i].n_links <= len(s) for i, s in links.items())
    loose = {i for i in links if i < 400}
    assert sum(got[i].n_links for i in loose) >= 0.9 * sum(len(links[i]) for i in loose)
    roots = brute_components(list(links), [(i, j) for i, s in links.items() for j in s])
    assert np.mean([got[i].component_id == r for i, r in roots.items()]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert lattice.near_duplicates(spark, given.limit(0)).count() == 0


def test_lattice_ids(spark):
    """Repeated and null ids don't mix classes."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (None, [0.0, 3.0], 1), (None, [-1.0, 0.0], 1), (None, None, 1), (7, [0.0, 1.0], None), (7, [0.0, 1.0], None)]
    got = lattice.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_lattice_labels(spark):
    """Labels of any type: texts, and fractions that aren't the same whole number."""
    v = [1.0] * 16
    for kind, some in {"string": ["a", "b", "a", None], "double": [1.2, 1.7, 1.2, None], "date": [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 1), None]}.items():
        near = [v, v, [*v[:-1], 1.01], v]
        got = lattice.near_duplicates(spark, spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(near, some))], f"vec_id long, embedding array<double>, label {kind}")).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 0, 1), (2, 1, 0), (3, 0, 3)], kind


def test_lattice_blocks(spark, monkeypatch):
    """Many small blocks and strips give what one block gives."""
    rows = [r for r in vectors() if r[2] == 7][:300]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    whole = sorted(map(tuple, lattice.near_duplicates(spark, given).collect()))
    monkeypatch.setattr(lattice, "BLOCK", 64)
    monkeypatch.setattr(lattice, "STRIP", 10)
    assert sorted(map(tuple, lattice.near_duplicates(spark, given).collect())) == whole and sum(r[1] for r in whole) > 10_000


@pytest.mark.parametrize("cosine", [0.93, 0.94, 0.96])
def test_lattice_recall(cosine):
    """Pairs at a cosine share a cell that one of them owns."""
    rng = np.random.default_rng(3)
    u, w = rng.normal(size=(2, 1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    ok = lattice._first_common(*lattice.cells(u), *lattice.cells(cosine * u + np.sqrt(1 - cosine**2) * w))[1]
    assert ok.mean() >= 0.98


def test_licences(spark, docs, none):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "x. Licensed under the Apache License, Version 2.0; and"),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
        (7, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        (8, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.\nlicensed under cc by 4.0"), (9, "the mit license is named in passing"), (None, "Released under the MIT License."),
        (10, "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation. " + "word. " * 9 + "either version 3 of the License, or (at your option) any later version."), (11, "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; filler here. Either version 3 of the License, or (at your option) any later version."),
    ]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.scan(given)
    assert {r.doc_id: r.licences for r in got.collect()} == {1: "MIT", 2: "CC-BY-NC-4.0", 3: "", 4: "", 5: "Apache-2.0", 6: "BSD-2-Clause", 7: "", 8: "CC-BY-4.0,GPL-3.0", 9: "", None: "MIT", 10: "", 11: "GPL-3.0"}
    same(got, duck(licences.ORACLE, documents=given))
    same(licences.scan(docs), duck(licences.ORACLE, documents=docs.select("doc_id", "text")))
    assert licences.scan(none).count() == 0


def signed_hash(text):
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) * (h >> 63)


def test_token_files_of_one_id(spark):
    """Rows of one id, and of none, are dealt over shards; starts go on from one to the next."""
    rows = [(None, f"no id {i}") for i in range(1500)] + [(7, f"one id {i} {'word ' * (i % 9)}") for i in range(1500)] + [(9, "last")]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        shards = token_files.encode(given).groupBy("doc_id").agg(F.countDistinct("shard").alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b")).collect()
        got = token_files.round_trip(spark, given).orderBy("start").collect()
    finally:
        spark.conf.unset(conf)
    by = {r.doc_id: r for r in shards}
    assert by[None].n > 1 and by[7].n > 1 and by[None].b <= by[7].a and by[7].b <= by[9].a
    assert [r.doc_id for r in got] == [None] * 1500 + [7] * 1500 + [9]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.round_trip(spark, docs).collect()
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1])))
    at, want = 0, []
    for i, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    token_files.write(docs, str(tmp_path / "ids"))
    back = token_files.read(spark, str(tmp_path / "ids")).where("doc_id = 7").collect()
    assert [r.ids for r in back] == [[*model.encode(texts()[7][1], add_special_tokens=False).ids, 1]]
    assert token_files.round_trip(spark, none).count() == 0


def test_token_file_layout(spark, tmp_path, monkeypatch):
    """Files have stripes, row indexes and Bloom filters on the ids alone, and a filter on an id reads few rows."""
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 1 << 16)
    monkeypatch.setattr(token_files, "INDEX_STRIDE", 1000)
    rng = random.Random(8)
    rows = [(2 * i, " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(12))) for i in range(30_000)]
    path = str(tmp_path / "ids")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    jvm, kinds, stripes, strides = spark._jvm, set(), 0, set()
    for f in sorted((tmp_path / "ids").glob("part-*.orc")):
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows_, found = reader.rows(), reader.getStripes()
        stripes += found.size()
        strides.add(reader.getRowIndexStride())
        for i in range(found.size()):
            streams = rows_.readStripeFooter(found.get(i)).getStreamsList()
            kinds |= {(str(streams.get(j).getKind()), streams.get(j).getColumn()) for j in range(streams.size())}
    assert stripes > len(list((tmp_path / "ids").glob("part-*.orc"))) and strides == {1000} and ("ROW_INDEX", 1) in kinds
    assert {c for k, c in kinds if k.startswith("BLOOM_FILTER")} == {1}

    def scanned(ident):
        q = token_files.read(spark, path).where(F.col("doc_id") == ident).select("ids")
        n = len(q.collect())
        leaves = q._jdf.queryExecution().executedPlan().collectLeaves()
        return n, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    n, read = scanned(8000)
    assert n == 1 and read <= 1000
    assert scanned(8001) == (0, 0)  # within the statistics' range, but not in the Bloom filters


def test_token_settings(tmp_path):
    """Other steps than the known ones mean whole texts."""
    import json

    d = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    assert token_files.settings(public_tokenizers.path("word_bpe_49k.json")) == (True, True)
    assert token_files.settings(public_tokenizers.path("byte_bpe_50k.json"))[0] is False
    d["normalizer"]["normalizers"].append({"type": "StripAccents"})
    (tmp_path / "a.json").write_text(json.dumps(d), encoding="utf-8")
    assert token_files.settings(str(tmp_path / "a.json")) == (False, True)
    words = token_files.Words(str(tmp_path / "a.json"))
    assert np.frombuffer(next(words.encode(["Été tide"])), "<u4").tolist() == words.model.encode("Été tide", add_special_tokens=False).ids


def test_token_table_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_BYTES", 20 * token_files.ENTRY)
    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"))
    some = [t or "" for _, t, *_ in texts()][:70] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(some)] == [words.model.encode(t, add_special_tokens=False).ids for t in some]


def test_token_words():
    from tokenizers import Tokenizer

    rng, words = random.Random(6), token_files.load(None)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert words.cut and words.low
    some = ["".join(rng.choice(" abAB'S\n\té\u0301日　\x1c\x85.,!<|endoftext|>") for _ in range(rng.randrange(25))) for _ in range(2000)] + ["It'S <|ENDOFTEXT|> <|endoftext|>X"]
    for t, ids in zip(some, words.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_token_words_are_looked_up_once():
    """A word's occurrences in some texts cost one lookup, not one each."""

    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"))
    words.ids = Counted()
    some = [" tide Gauge\t" * 500, "", " \n", "gauge <|endoftext|> Tide"]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(some)] == [words.model.encode(t, add_special_tokens=False).ids for t in some]
    assert Counted.n < 50


def test_token_words_with_marks():
    """Letters have one entry, whatever marks come after them."""
    import pyarrow as pa

    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"))

    def ids(texts):
        return [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)]

    def whole(texts):
        return [words.model.encode(t, add_special_tokens=False).ids for t in texts]

    some = ["Tide, tide. né! gauge,\ttide", "", "tide$$$"]
    assert ids(some) == whole(some)
    assert set(words.ids) == {b"tide", "né".encode(), b"gauge", b",", b".", b"!", b"$$$"}
    assert ids(["", " ", "\n\n"]) == [[], [], []] and ids([]) == []
    rng = random.Random(9)
    parts = "a Tide É é ß ÷ × · 日 \u0301 \u0338 İ K Å 's 'LL ' 1 23 . , = < > | _ $ <|endoftext|> <|ENDOFTEXT|>".split(" ") + [" ", " ", "\n", "\x0b", "\x1c", "\xa0"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)]
    assert ids(some) == whole(some)
    assert ids(pa.array(some, pa.large_string()).slice(100, 900)) == whole(some[100:1000])
