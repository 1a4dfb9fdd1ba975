"""Alignment of two tokenizers' tokens against whole texts tokenised by the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tidegauge.llm import alignment, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block long, n_a int, pairs string, kind int"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, decoders.ByteLevel()


def ends(sizes):
    out, n = [], 0
    for s in sizes:
        out.append(n := n + s)
    return out


def plain(text, libraries):
    """(A ids, B ids, groups, links) of a whole text, or None."""
    a, b, _ = libraries
    if not text:
        return None
    whole, values = (" " + text).encode(), alignment.byte_values()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    bytes_a = [bytes(values[c] for c in t) for t in ids_a.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, b.encode(text, out_type=str))]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    end_a, end_b = ends(map(len, bytes_a)), ends(map(len, bytes_b))
    cuts, groups, last = sorted(set(end_a) & set(end_b)), [], 0
    for c in cuts:
        groups.append(tuple(",".join(str(i) for i, e in zip(ids, es) if last < e <= c) for ids, es in ((ids_a.ids, end_a), (ids_b, end_b))))
        last = c
    spans = [[(i, e - len(t), e) for i, e, t in zip(ids, es, ts)] for ids, es, ts in ((ids_a.ids, end_a, bytes_a), (ids_b, end_b, bytes_b))]
    links, j = [], 0
    for i, s, e in spans[0]:
        while spans[1][j][2] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < e:
            links.append((i, spans[1][k][0]))
            k += 1
    return ids_a.ids, ids_b, groups, links


def brute(rows, libraries):
    found = [(i, plain(t, libraries)) for i, t in rows]
    n = Counter(p for _, f in found if f for p in set(f[3]))
    most = defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    for i, f in found:
        if f is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
            continue
        text = ";".join(f"{a}|{b}" for a, b in f[2])
        yield i, len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(n[p] == most[p[0]] for p in f[3]), sum(n[p] for p in f[3]), hashlib.sha256(text.encode()).hexdigest()


def texts():
    rng = random.Random(8)
    words = "tide gauge Water level's naïve 日本語 😀 don't it'll 12345 x=1; ﬁne thin a　b <|endoftext|> <s> </s> (foo) ... --- ÄÖÜ été".split(" ")
    out = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", " \r", "\x1c", "\x85", "\xa0", "᠎ ", "​ ", "   \n"]) for _ in range(rng.randrange(1, 60))) for _ in range(250)]
    out += ["".join(rng.choice(" \n\t\r\xa0\x0b\x0cab.'1é日\x00\x1f ") for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    out += [None, "", " ", "\n", "  ", "a", " a", "a ", "▁", "a ▁b", "x▁ y\nz", "\x00", "x" * 20_000, "word and more " * 3_000, " " * 500 + "end", "﻿mark ﻿ x"]
    return list(enumerate(out)) + [(3, out[3]), (None, "A null id."), (None, None)]


def test_segments_compose(libraries):
    """Segments' tokens, one after the other, are those of whole texts."""
    aligner = alignment.Aligner(A, B)
    assert aligner.breaks == " \n"
    for _, t in texts():
        (places,) = aligner.places([t])
        want = plain(t, libraries)
        got = b";".join(aligner.groups[p] for p in places).decode()
        assert got == (";".join(f"{a}|{b}" for a, b in want[2]) if want else "")


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, libraries, small):
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in texts()], SCHEMA).repartition(5)
    bounds = {"block_pairs": 300, "table_bytes": 20 * alignment.ENTRY} if small else {}
    got = alignment.counted(spark, docs, **bounds)
    blocks = alignment.align(docs, **bounds).select("block").distinct().count()
    assert blocks > 10 if small else blocks <= 5
    want = brute(texts(), libraries)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)


def test_bounds(libraries):
    """Tables are emptied and blocks closed as they fill; both give the same numbers."""
    aligner, composer = alignment.Aligner(A, B), alignment.Composer()
    some = [t for _, t in texts()][:200]
    places = aligner.places(some)
    composer.add(aligner, list(range(200)), places)
    for n, t in enumerate(some):
        want = plain(t, libraries)
        pairs = Counter(a << 32 | b for a, b in want[3]) if want else Counter()
        assert dict(zip(composer.pairs[n].tolist(), composer.times[n].tolist())) == pairs
    aligner.forget()
    assert not aligner.at and not aligner.held and list(map(len, aligner.places(["a tide"]))) == [2]


def test_whole_texts(libraries):
    """Vocabularies that can't be cut are given whole texts."""
    aligner = alignment.Aligner(A, B)
    aligner.breaks = ""
    assert [len(p) for p in aligner.places(["a tide gauge", None, "x ▁"])] == [1, 0, 0]


def test_empty_and_query(spark, libraries):
    assert alignment.counted(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_alignment(spark, SF)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(brute(rows, libraries))


def test_segments_are_looked_up_once():
    """A group's segments are numbered before the table is asked, and new ones go to the tokenizers in lines, of any letters."""

    class Counting(dict):
        asked = 0

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            Counting.asked += 1
            return super().__contains__(key)

    aligner, given = alignment.Aligner(A, B), []
    aligner.at, tokens = Counting(), aligner._tokens
    aligner._tokens = lambda new: given.extend(new) or tokens(new)
    (found,) = aligner.places(["tide gauge née" + " tide gauge née" * 5_000])
    assert len(found) == 15_003 and len(set(found)) == 3 and Counting.asked <= 20
    aligner.places([" ".join(f"étai{n}é" for n in range(3_000))])
    assert len(given) <= 15 and not aligner.off


def test_texts_of_slices(libraries):
    """Texts may come as a slice of an Arrow array, with nulls, of any type of string."""
    import pyarrow as pa

    aligner, some = alignment.Aligner(A, B), [t for _, t in texts()]
    want = [list(p) for p in aligner.places(some)]
    for kind in (pa.string(), pa.large_string()):
        assert [list(p) for p in aligner.places(pa.array(some, kind).slice(200))] == want[200:]
    assert [list(p) for p in aligner.places(pa.array([None, "", None], pa.string()))] == [[], [], []] and aligner.places([]) == []
