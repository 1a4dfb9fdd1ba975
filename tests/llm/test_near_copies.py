"""The pipeline's near-dedup stage against brute force over whole texts."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import near_copies, simhash


def shingles(text):
    words = (text or "").encode().translate(simhash.LOWER).split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """The smallest ids of the groups, and the number of similar pairs."""
    post, up, n = {}, {}, 0
    for i, t in sorted(rows):
        up[i], mine, shared = i, shingles(t), Counter()
        for s in mine:
            shared.update(post.setdefault(s, []))
            post[s].append((i, len(mine)))
        for (j, size), both in shared.items():
            if both / (len(mine) + size - both) >= 0.8:
                n += 1
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    return {i for i in up if up[i] == i}, n


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    want, n = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert n >= 5 and {r.doc_id for r in got.collect()} == want


def test_changed_words(spark):
    """Texts with one and two of a hundred words and ten of a thousand changed; a large group; odd texts."""
    rng, rows = random.Random(7), []
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for n, changes in [(100, 1), (100, 2), (1000, 10)] * 60:
        words = fresh(n)
        rows.append(" ".join(words))
        for i in rng.sample(range(n), changes):
            words[i] = "changed"
        rows.append(" ".join(words))
    base = fresh(200)
    rows += [" ".join(base[:150] + fresh(1) + base[151:]) for _ in range(300)]
    rows += ["", " ", None, "a b", "A  b", "a b c", "x " * 20_000]
    rows = list(enumerate(rows))
    want, n = brute(rows)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(5)
    docs = docs.withColumns({"__gone": F.lit(1), "_plan": F.lit(2)})
    stays = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert stays.columns == docs.columns
    got = [r.doc_id for r in stays.collect()]
    assert n > 300 and None in got and want <= set(got)
    # pairs are found by chance, 0.997 at a similarity of 0.8
    assert len(got) - 1 <= len(want) + 3


def test_pairs_without_a_band(spark):
    """Similar pairs whose bands and fingerprints tell nothing are linked; of a thousand pairs two or three are so."""
    rng, pairs = random.Random(3), []
    keys = lambda t: set(near_copies.bands(list(simhash.hashes(t, 5))))
    while len(pairs) < 4:
        words = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        a, b = " ".join(words), " ".join([*words[:25], "changed", *words[26:]])
        if (simhash.sketch(a, 5) ^ simhash.sketch(b, 5)).bit_count() > 4 and keys(a).isdisjoint(keys(b)):
            pairs += [a, b]
    rows = list(enumerate(pairs))
    want, n = brute(rows)
    assert n == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == want == {0, 2}


def test_pairs_apart_from_a_bands_hubs(spark):
    """Texts that share two thirds with all others, and with one each four fifths, as brute force has them."""
    rng, rows = random.Random(5), []
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = fresh(160)
    for _ in range(150):
        one = [*base, *fresh(40)]
        other = [*one[:190], *fresh(rng.randrange(8, 25))]
        rows += [" ".join(one), " ".join(other)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, n = brute(rows)
    assert n >= 140 and len(want) >= 140
    docs = spark.createDataFrame([*rows, (3, "another text of this id"), (None, rows[0][1])], "doc_id long, text string").repartition(5)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert None in got and set(got) - {None} == want


def _crossing(spark, texts):
    """What _rest() and _met() give for texts that are each a group."""
    scratch = near_copies.Scratch(spark, "near-test")
    marked = scratch.save(near_copies._marked(spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(4), near_copies._frequent(scratch, spark.createDataFrame(list(enumerate(texts)), "id long, body string"))), "marked")
    pairs = near_copies._rest(scratch, marked, spark.createDataFrame([], "node long, root long")).collect()
    return {(r.a, r.b) for r in pairs}, near_copies._met(spark.read.parquet(scratch.path("crossing")))


def test_common_passage_makes_few_pairs(spark):
    """Texts that share a passage of more than four fifths of their shingles, and none of which are similar."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    base = fresh(154)
    texts = [" ".join([*base, *fresh(rng.randrange(24, 30))]) for _ in range(300)]
    assert brute(list(enumerate(texts)))[1] == 0
    pairs, met = _crossing(spark, texts)
    assert met.count() < 300 and len(pairs) < 300


def test_no_similar_pair_is_left_out(spark):
    """Every pair of 0.8 or more, also of 0.8 exactly and of texts of unequal sizes, without any help of the bands."""
    rng, texts = random.Random(12), []
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    base = fresh(90)
    for n in (1, 4, 5, 8, 9, 10, 13, 40, 104, 300, 900):
        for _ in range(12):
            words = fresh(n)
            texts += [" ".join(words), " ".join(words + fresh(round(n / 4 * rng.random()))), " ".join(fresh(n // 9) + words), " ".join(words[: max(1, n - n // 9)])]
            texts += [" ".join(words + fresh((n - 4) // 4)), " ".join([*base[: rng.randrange(70, 90)], *fresh(rng.randrange(12))])]
    texts += ["", "x " * 5_000, "x " * 4]
    texts = list(dict.fromkeys(texts))
    sets = [shingles(t) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    exact = sum(5 * len(sets[i] & sets[j]) == 4 * len(sets[i] | sets[j]) for i, j in want)
    pairs, _ = _crossing(spark, texts)
    assert len(want) > 500 and exact > 10 and want <= pairs
