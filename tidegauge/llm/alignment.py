"""Two tokenizers' tokens aligned by segments.

A byte-level tokenizer (A) and a SentencePiece model (B) are given the same bytes: a space and the text. It is cut
before runs of whitespace at places that no token of either can cross, as their vocabularies show: pieces of B have a
marker only at their start, other whitespace that may begin a run is in no piece of several characters, A's own pattern
ends a token there. Segments of some texts at a time are cut and numbered by Arrow; each distinct one is tokenised and
aligned once for a task's table, which is emptied at TABLE_BYTES, and its groups and links are joined back by position: a
document's alignment is that of its segments, one after the other. A table for the whole corpus would shuffle every word
of every document with its place. Vocabularies that don't allow cuts are given whole texts.

Groups end where tokens of A and B both end; links are all pairs of tokens with common bytes. How many documents hold a
pair linked is counted corpus-wide: documents go into blocks with their distinct pairs, coded by place in the block's
list; lists are counted together, and each block gets the counts of its own list back. So nothing that grows with the
corpus is held or broadcast, and texts are read once and never shuffled; only counts by A id, one row for each
id of its vocabulary, may be broadcast.

Null and empty texts have no tokens, nor do texts that one of the two tokenizers doesn't give back byte for byte: all
numbers are zero and the digest is ''. Texts of any length are read whole; a long one is a block of its own. Rows with
null or repeated ids are documents like others; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, grouped, in_arrow
from .pieces import MARK, marked

#: Bytes of a task's table, at most (but for the segments of one group); a segment takes about ENTRY besides its bytes, groups and links.
TABLE_BYTES, ENTRY = 96 << 20, 240
#: A group of texts, cut and looked up at once, has a GROUP-th of the table's bytes (or one text).
GROUP = 96
#: Segments that are composed at once, and pairs of a block, about.
COMPOSED, BLOCK = 400_000, 4_000_000
#: Segments tokenised in one line, and lines put into the table at once.
LINE, LINES = 300, 100
#: Whitespace that a cut may come before, if the vocabularies allow it.
BREAKS = " \n"

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = StructType([StructField("block", LongType()), StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in NUMBERS), StructField("groups_sha256", StringType()), StructField("pairs", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType())), StructField("listed", ArrayType(LongType())), StructField("docs", ArrayType(IntegerType()))])
RESULT = StructType([StructField("doc_id", LongType()), *(StructField(n, LongType()) for n in (*NUMBERS, "n_best", "count_sum")), StructField("groups_sha256", StringType())])


def byte_values() -> dict[str, int]:
    """What a byte-level vocabulary's characters stand for: visible Latin-1 characters for themselves, 256 and on for the rest."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spellings:
    """Byte strings that each end in a separator, which counts for strings put together but isn't part of one alone."""

    def __init__(self):
        self.data, self.ends = bytearray(), array("q", [0])

    def put(self, data: bytes, ends: np.ndarray) -> None:
        """Strings that follow each other in data, where they end."""
        self.ends.frombytes((ends + len(self.data)).astype(np.int64).tobytes())
        self.data += data

    def __getitem__(self, n: int) -> bytes:
        return bytes(self.data[self.ends[n] : self.ends[n + 1]])[:-1]

    def together(self, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The strings of these numbers, one after the other, and their sizes."""
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends), pa.py_buffer(self.data)])
        return spelled(every, at), np.diff(np.frombuffer(self.ends, np.int64))[at]


def spelled(parts: pa.LargeBinaryArray, at: np.ndarray) -> memoryview:
    """The parts of these numbers, one after the other."""
    found = parts.take(pa.array(at, pa.int64()))
    _, ends, data = found.buffers()
    return memoryview(data or b"").cast("B")[: np.frombuffer(ends, np.int64)[len(at)] if len(at) else 0]


class Aligner:
    """Two tokenizers and the table of segments: what a document is composed of."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        values, entries = byte_values(), {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(values[c] for c in entries.get(i, "")) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.parts_a, self.parts_b = (pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b))
        words = [f"{i}{end}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]
        self.words, self.word_sizes = pa.array(words, pa.large_binary()), np.array(list(map(len, words)), np.int64)
        self.mark = self.b.piece_to_id(MARK)
        self.breaks = self._breaks(path_a, path_b, pieces)
        self.odd = re.compile(rf"[^\S{self.breaks}]|[\u180e\u200b\ufeff]")  # whitespace, by some definition, that is no break
        self.kinds = np.zeros(256, np.uint8)  # of bytes: 1 is a break, 2 may begin an odd character
        self.kinds[[c.encode()[0] for c in map(chr, range(1 << 16)) if self.odd.match(c)]] = 2
        self.kinds[list(self.breaks.encode())] = 1
        self.forget()

    def _breaks(self, path_a: str, path_b: str, pieces: list[str]) -> str:
        """Whitespace that texts can be cut before, by both vocabularies and the tokenizers' settings."""
        with open(path_a, encoding="utf-8") as f:
            d = json.load(f)
        first = d.get("pre_tokenizer") or {}
        known = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not d.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"])
        if not known or not marked(path_b):
            return ""
        inner = [t.decode(errors="replace").lstrip() for t in self.bytes_a]
        return "".join(c for c in BREAKS if not any(c in t for t in inner) and (c == " " or not any(c in p for p in pieces if len(p) > 1)))

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.numbers = [array("q") for _ in NUMBERS]
        self.groups = Spellings()
        self.links, self.ends, self.off = array("q"), array("q", [0]), set()
        self.held = 0

    def segments(self, given: str) -> list[str]:
        """given, cut before the runs of whitespace that begin with a break; those that begin otherwise don't end a segment."""
        found = re.findall(r"\s+\S*", given)
        out = [found[0]]
        for s in found[1:]:
            if s[0] in self.breaks and not self.odd.match(out[-1][-1]):
                out.append(s)
            else:
                out[-1] += s
        return out

    def _starts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where segments start in texts that follow each other, by their bytes; texts with odd whitespace are cut by segments()."""
        kinds = self.kinds[raw]
        start = kinds == 1
        start[1:] &= kinds[:-1] != 1
        if not self.breaks:
            start[:] = False
        start[edges[:-1]] = True
        if self.breaks:
            for n in np.unique(np.searchsorted(edges, np.flatnonzero(kinds == 2), "right") - 1).tolist():
                x, y = edges[n], edges[n + 1]
                if self.odd.search(given := raw[x:y].tobytes().decode()):
                    start[x:y] = False
                    sizes = [len(s.encode()) for s in self.segments(given)]
                    start[x + np.cumsum([0, *sizes[:-1]])] = True
        return np.flatnonzero(start)

    def _tokens(self, new: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for texts that begin with whitespace. B puts a space before what it is given."""
        a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in new], num_threads=1)
        return a, [y if s[0] == " " else y[1:] if y[:1] == [self.mark] else [] for s, y in zip(new, b)]

    def _whole(self, s: bytes) -> bool:
        """Whether a segment begins with a break and ends in a visible character."""
        return self.kinds[s[0]] == 1 and (s[-1] < 128 and not self.kinds[s[-1]] or s[-1] >= 128 and not self.odd.match(s.decode()[-1]))

    def learn(self, new: list[bytes]) -> None:
        """Segments that end in a visible character are tokenised in lines of many, which are cut where segments end."""
        lines, rest = [], []
        for s in new:
            (lines if self._whole(s) else rest).append(s)
        for at in range(0, len(lines), LINES * LINE):
            if not self._lines(some := lines[at : at + LINES * LINE]):
                for x in range(0, len(some), LINE):
                    if not self._lines(some[x : x + LINE]):
                        rest += some[x : x + LINE]
        if rest:
            sizes = list(map(len, rest))
            a, b = self._tokens([s.decode() for s in rest])
            for n, s in enumerate(rest):
                if b"".join(map(self.bytes_a.__getitem__, a[n])) != s or b"".join(map(self.bytes_b.__getitem__, b[n])) != s:
                    self.off.add(len(self.at) + n)
                    sizes[n], a[n], b[n] = 0, [], []
            self._keep(rest, *(np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)), sizes)

    def _lines(self, some: list[bytes]) -> bool:
        """False if the tokens of a line don't give its bytes, or don't end where its segments do."""
        given, sizes = b"".join(some), list(map(len, some))
        edges = np.cumsum([0, *sizes])[[*range(0, len(some), LINE), len(some)]]
        found = []
        for ids, size, parts in zip(self._tokens([given[x:y].decode() for x, y in zip(edges, edges[1:])]), (self.size_a, self.size_b), (self.parts_a, self.parts_b)):
            line = np.fromiter(chain.from_iterable(ids), np.int64)
            upto = np.cumsum(np.concatenate(([0], size[line])))[np.cumsum([0, *map(len, ids)])]
            if not np.array_equal(upto, edges) or spelled(parts, line) != given:
                return False
            found.append(line)
        return self._keep(some, *found, sizes)

    def _keep(self, some: list[bytes], a: np.ndarray, b: np.ndarray, sizes: list[int]) -> bool:
        """Puts segments, whose tokens follow each other, into the table. Every stretch of bytes between two ends of tokens,
        of A or of B, is common to one token of each: a link. Nothing is put if a segment's end isn't one of both."""
        ends_a, ends_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(sizes)
        at_a, at_b = np.zeros(ends[-1] + 1, bool), np.zeros(ends[-1] + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        both, any_ = at_a & at_b, at_a | at_b
        if not both[ends[ends > 0]].all():
            return False
        upto_a, upto_b, upto_both, upto_any = (np.cumsum(x) for x in (at_a, at_b, both, any_))  # of ends up to a byte's
        common, every = np.flatnonzero(both), np.flatnonzero(any_)
        links = a[upto_a[every - 1]] << 32 | b[upto_b[every - 1]]
        upto = [x[ends] for x in (upto_a, upto_b, upto_both, upto_any)]
        for kept, n in zip(self.numbers, upto):
            kept.frombytes(np.diff(n, prepend=0).tobytes())
        self.ends.frombytes((upto[3] + len(self.links)).tobytes())
        self.links.frombytes(links.tobytes())
        first_a, first_b = (np.concatenate(([0], x[common])) for x in (upto_a, upto_b))  # a group's first tokens
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + first_b[upto_both[ends_a - 1]]] = 3 * a + both[ends_a]
        words[np.arange(len(b)) + first_a[upto_both[ends_b - 1] + 1]] = 3 * b + 2 * both[ends_b]
        groups = spelled(self.words, words)
        self.groups.put(groups, np.concatenate(([0], np.cumsum(self.word_sizes[words])))[upto[0] + upto[1]])
        self.at.update(zip(some, range(len(self.at), len(self.at) + len(some))))
        self.held += ENTRY * len(some) + sum(map(len, some)) + len(groups) + links.nbytes
        return True

    def places(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """For each text the table's numbers of its segments; none if it has no tokens."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out = [np.empty(0, np.int64)] * len(texts)
        some = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        if not len(some):
            return out
        given = pc.binary_join_element_wise(" ", texts.take(pa.array(some)), "")
        edges = np.frombuffer(given.buffers()[1], np.int32)[: len(given) + 1]
        raw = np.frombuffer(given.buffers()[2], np.uint8)[: edges[-1]]
        starts = self._starts(raw, edges)
        cut = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut), given.buffers()[2]]).dictionary_encode()
        kinds, ends = coded.dictionary.buffers()[2].to_pybytes(), np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].tolist()
        found = [kinds[x:y] for x, y in zip(ends, ends[1:])]
        if new := [s for s in found if s not in self.at]:
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, found), np.int64, len(found))[coded.indices.to_numpy()]
        cuts = np.searchsorted(starts, edges).tolist()
        for n, x, y in zip(some.tolist(), cuts, cuts[1:]):
            out[n] = at[x:y]
        if self.off:
            for n in np.unique(np.searchsorted(cuts, np.flatnonzero(np.isin(at, list(self.off))), "right") - 1).tolist():  # the bytes of a segment differ: the whole text decides
                text = raw[edges[n] : edges[n + 1]].tobytes()
                if text not in self.at:
                    self.learn([text])
                whole = self.at[text]
                out[some[n]] = np.array([] if whole in self.off else [whole], np.int64)
        return out


@lru_cache(1)
def load(path_a: str | None, path_b: str | None) -> Aligner:
    """In a worker: two tokenizers for all its tasks, whose table each of them empties at its end."""
    import public_tokenizers

    return Aligner(path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))


class Composer:
    """Documents of a block: their numbers, and their distinct pairs with how often each is linked."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, aligner: Aligner, idents: list, places: list[np.ndarray]) -> None:
        """Segments of documents, counted, become pairs, counted."""
        sizes = np.array([len(p) for p in places])
        doc = np.repeat(np.arange(len(places)), sizes)
        at = np.concatenate([np.empty(0, np.int64), *places])
        ends, links = np.frombuffer(aligner.ends, np.int64), np.frombuffer(aligner.links, np.int64) if aligner.links else np.empty(0, np.int64)
        sums = [np.bincount(doc, np.frombuffer(n, np.int64)[at], len(places)).astype(np.int64) for n in aligner.numbers] if len(at) else [np.zeros(len(places), np.int64)] * len(NUMBERS)
        coded = pa.array(links).dictionary_encode()
        known, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        keys, times = np.unique(doc * len(aligner.at) + at, return_counts=True)
        doc, at = keys // max(len(aligner.at), 1), keys % max(len(aligner.at), 1)
        wide = ends[at + 1] - ends[at]
        inner = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        found = code[np.repeat(ends[at], wide) + inner] if len(inner) else np.empty(0, np.int64)
        keys, back = np.unique(np.repeat(doc, wide) * max(len(known), 1) + found, return_inverse=True)
        many = np.bincount(back, np.repeat(times, wide), len(keys)).astype(np.int32)
        doc, pair = keys // max(len(known), 1), known[keys % max(len(known), 1)] if len(keys) else np.empty(0, np.int64)
        edges = np.searchsorted(doc, np.arange(len(places) + 1))
        groups, wide = aligner.groups.together(np.concatenate([np.empty(0, np.int64), *places]))
        cuts = np.concatenate(([0], np.cumsum(wide)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        for n, ident in enumerate(idents):
            sha = hashlib.sha256(groups[cuts[n] : cuts[n + 1] - 1]).hexdigest() if sizes[n] else ""
            self.rows.append((ident, *(int(s[n]) for s in sums), sha))
            self.pairs.append(pair[edges[n] : edges[n + 1]])
            self.times.append(many[edges[n] : edges[n + 1]])
        self.held += len(pair)
        del links, ends, coded, known, code  # the table's arrays can't grow while these look at them

    def batches(self, block: int, schema: pa.Schema, size: int = 1_000):
        """The block's list of pairs, then its documents."""
        every = np.concatenate([*self.pairs, np.empty(0, np.int64)])
        listed, code, docs = np.unique(every, return_inverse=True, return_counts=True)
        if len(listed):
            row = {n: [None] for n in schema.names} | {"block": [block], "listed": [listed.tolist()], "docs": [docs.tolist()]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)
        ends = np.cumsum([0] + [len(p) for p in self.pairs])
        for at in range(0, len(self.rows), size):
            rows = self.rows[at : at + size]
            upto = ends[at : at + len(rows) + 1]
            lists = [pa.ListArray.from_arrays(pa.array((upto - upto[0]).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (code[upto[0] : upto[-1]], np.concatenate([*self.times[at : at + size], np.empty(0, np.int32)]))]
            none = [pa.nulls(len(rows), schema.field(n).type) for n in ("listed", "docs")]
            columns = [pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(len(NUMBERS) + 2)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), *columns, *lists, *none], schema=schema)


def align(docs: DataFrame, ident: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, block_pairs: int = BLOCK, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """ALIGNED: for each block a row with its list of pairs and in how many of its documents each is linked, and its
    documents, whose pairs are places in that list."""
    arrow = to_arrow_schema(ALIGNED)

    def work(batches):
        from pyspark import TaskContext

        aligner, composer = load(path_a, path_b), Composer()
        block = TaskContext.get().partitionId() << 32
        idents, places, n = [], [], 0

        def compose():
            nonlocal n
            if idents:
                composer.add(aligner, idents, places)
                idents.clear()
                places.clear()
                n = 0

        try:
            for b in batches:
                sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
                for at, upto in grouped(sizes, table_bytes // GROUP):
                    ids, found = b.column(0).slice(at, upto - at).to_pylist(), aligner.places(b.column(1).slice(at, upto - at))
                    idents += ids
                    places += found
                    n += sum(map(len, found))
                    full = aligner.held > table_bytes
                    if n >= COMPOSED or full:
                        compose()
                    if full:
                        aligner.forget()
                    if composer.held >= block_pairs:
                        yield from composer.batches(block, arrow)
                        block, composer = block + 1, Composer()
            compose()
            if composer.rows:
                yield from composer.batches(block, arrow)
        finally:
            aligner.forget()

    return in_arrow(docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("body")), work, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n): in how many documents each pair is linked."""
    each = aligned.where("listed IS NOT NULL").select(F.explode(F.arrays_zip("listed", "docs")).alias("p"))
    n = each.groupBy(F.col("p.listed").alias("pair")).agg(F.sum("p.docs").alias("n"))
    return n.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n")


def counted(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, block_pairs: int = BLOCK, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """RESULT for every row of docs."""
    scratch = Scratch(spark, "alignment")
    aligned = scratch.save(align(docs, ident, text, path_a, path_b, block_pairs, table_bytes), "aligned")
    counts = scratch.save(pair_counts(aligned), "counts")
    most = counts.groupBy(F.col("a").alias("a_")).agg(F.max("n").alias("most"))
    counts = counts.join(most, F.col("a") == F.col("a_")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    listed = aligned.where("listed IS NOT NULL").select("block", F.posexplode("listed").alias("place", "pair"))
    listed = listed.select("block", "place", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).join(counts, ["a", "b"])
    kept = ["doc_id", *NUMBERS, "groups_sha256", "pairs", "times"]
    empty = [F.lit(None).cast(ALIGNED[c].dataType).alias(c) for c in kept]
    lists = listed.select("block", F.lit(0).alias("kind"), "place", "n", "best", *empty)
    rows = aligned.where("listed IS NULL").select("block", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), *kept)
    arrow = to_arrow_schema(RESULT)

    def work(batches):
        block, n, best = None, array("q"), array("b")
        for b in batches:
            out = []
            for at, kind, r in zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), range(b.num_rows)):
                if at != block:
                    block, n, best = at, array("q"), array("b")
                if kind == 0:
                    n.append(b.column("n")[r].as_py())
                    best.append(b.column("best")[r].as_py())
                    continue
                pairs, times = (np.asarray(b.column(c)[r].values, np.int64) for c in ("pairs", "times"))
                sums = [int((np.frombuffer(x, k)[pairs] * times).sum()) if len(pairs) else 0 for x, k in ((best, np.int8), (n, np.int64))]
                out.append((*(b.column(c)[r].as_py() for c in ("doc_id", *NUMBERS)), *sums, b.column("groups_sha256")[r].as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return in_arrow(lists.unionAll(rows).repartition("block").sortWithinPartitions("block", "kind", "place"), work, RESULT)
