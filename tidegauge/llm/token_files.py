"""Token ids in ORC files: stripes with run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id and a hash of the text, from a sample, and sorted, so the files, in order of
their shard, hold them in ascending order, and rows of one id, or of none, may be in several shards; each worker tokenises its own rows and adds up where they start within the shard. Readers
take stripes in parallel, skip those whose statistics or Bloom filter exclude an id, and add what the shards before
hold: one number for each shard.

Words are cut at ASCII blanks, which every token of these tokenizers ends at, and at marks after Latin letters, and
numbered by Arrow for some texts at a time; each distinct word is encoded once for a table that a Python worker keeps,
bounded in bytes; letters A-Z of texts without <| count as lower-case, as the tokenizer's own first step has it. Both are read from the tokenizer's settings: one with other steps is given whole
texts instead.

Null texts count as empty: the end id alone. Null ids come first, rows of equal ids in order of their texts' hash.
Repeated rows, which alone must share a shard, are written as often as they come. Texts of any length are encoded
whole. An empty table gives an empty folder.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import Scratch, grouped, in_arrow, null_text

END = 1
#: Bytes of a worker's table, at most (but for the words of one GROUP); it keeps two of them. An entry takes about ENTRY
#: besides its word and ids.
TABLE_BYTES, ENTRY = 112 << 20, 180
#: Fixed value: the pattern of tokens, none of which has a blank in it.
TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts whose words are numbered and looked up at once: bytes, at most (or one text).
GROUP = 4 << 20
STRIPE_BYTES, INDEX_STRIDE = 64 << 20, 10_000
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("shard", IntegerType()), StructField("start_in_shard", LongType()), StructField("ids", ArrayType(IntegerType()))])


#: Marks and digits that Latin letters before them are parted from: the tokenizer's own pattern parts them too.
MARKS = b"!\"#$%&()*+,-./0123456789:;=?@[\\]^_`{}~"
BLANKS = b" \t\n\r\v\f"
#: Words encoded in one line, and lines encoded at once.
LINE, LINES = 500, 60


def _plain(word: bytes) -> bool:
    return word.isalpha() or bool(word) and (text := word.decode()).isalpha() and max(text) < "\u0250" and "\u0130" not in text


def settings(path: str) -> tuple[bool, bool]:
    """Whether texts can be cut at blanks, and whether case is dropped, by the tokenizer's steps."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    first, second = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    steps = first.get("normalizers", [first] if first else [])
    parts = second.get("pretokenizers", [second] if second else [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(x["type"] in ("NFC", "Lowercase") or x == blanks for x in steps)
    split = {"type": "Split", "pattern": {"Regex": TOKENS}, "behavior": "Removed", "invert": True}
    within = bool(parts) and parts[0] == split and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in parts[1:])
    added = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"])
    return plain and within and added and not d.get("post_processor"), {"type": "Lowercase"} in steps


class Words:
    """A tokenizer and its table: words, whose ids follow each other in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.forget()
        self.older = self.ids, self.line, self.upto  # what a full table held: words still met move back
        self.cut, self.low = settings(path)
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(self.model.get_vocab_size())])
        self.kinds = np.zeros(256, np.uint8)  # of bytes: 1 is a blank, 2 a letter, 3 a mark
        self.kinds[list(BLANKS)] = 1
        if not any(set(t.content) & set(MARKS.decode()) for t in self.model.get_added_tokens_decoder().values()):
            self.kinds[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
            self.kinds[list(MARKS)] = 3

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.line, self.upto = array("I"), array("q", [0])
        self.held = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The words of texts that are cut, and how many are in the texts before each. Words end at blanks, and at marks that
        an ASCII letter, or one of U+00C0 to U+00FF, is before."""
        given = texts.take(pa.array(np.arange(len(texts))))
        if self.low:
            low = pc.ascii_lower(given)
            marked = pc.match_substring(given, "<|")
            given = pc.if_else(marked, given, low) if pc.any(marked).as_py() else low
        edges = np.frombuffer(given.buffers()[1], np.int32)[: len(given) + 1]
        raw = np.frombuffer(given.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        kinds = self.kinds[raw]
        shown, start = kinds != 1, np.zeros(len(raw), bool)
        start[edges[:-1][np.diff(edges) > 0]] = True
        start[1:] |= kinds[:-1] == 1
        at = np.flatnonzero(kinds == 3)
        at = at[at > 1]
        letter = (kinds[at - 1] == 2) | (raw[at - 2] == 0xC3) & (raw[at - 1] != 0x97) & (raw[at - 1] != 0xB7) & (raw[at - 1] >= 0x80)
        start[at[letter]] = True
        start &= shown
        kept = raw[shown]
        begins = np.append(np.flatnonzero(start[shown]), len(kept)).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(kept)]), np.searchsorted(np.flatnonzero(start), edges)

    def _put(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words, whose ids follow each other, into the table."""
        self.ids.update(zip(words, range(len(self.upto) - 1, len(self.upto) - 1 + len(words))))
        self.upto.frombytes((len(self.line) + np.cumsum(sizes, dtype=np.int64)).tobytes())
        self.line.frombytes(ids.astype(np.uint32).tobytes())
        self.held += ENTRY * len(words) + sum(map(len, words)) + 4 * len(ids)

    def learn(self, new: list[bytes]) -> None:
        """Letters are encoded in lines of many words, cut again where a token ends a word."""
        letters, rest = [], []
        for w in new:
            (letters if _plain(w) else rest).append(w)
        for at in range(0, len(letters), LINES * LINE):
            some = [letters[x : x + LINE] for x in range(at, min(at + LINES * LINE, len(letters)), LINE)]
            found = self._encode([b" ".join(x).decode() for x in some])
            for words, ids in zip(some, found):
                ids = np.array(ids, np.int64)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(words) and ends[-1] == len(ids):
                    self._put(words, ids, np.diff(ends, prepend=0))
                else:
                    rest += words
        if rest:
            found = self._encode([w.decode() for w in rest])
            self._put(rest, np.fromiter(chain.from_iterable(found), np.int64), np.array(list(map(len, found))))

    def _recall(self, new: list[bytes]) -> list[bytes]:
        """Moves words back from the older table; the others are new."""
        ids, line, upto = self.older
        at = np.fromiter(map(ids.get, new, repeat(-1)), np.int64, len(new))
        known = at >= 0
        if not known.any():
            return new
        begins, sizes = (x[at[known]] for x in (np.frombuffer(upto, np.int64), np.diff(np.frombuffer(upto, np.int64))))
        self._put([new[i] for i in np.flatnonzero(known).tolist()], _gathered(np.frombuffer(line, np.uint32), begins, sizes), sizes)
        return [new[i] for i in np.flatnonzero(~known).tolist()]

    def encode(self, texts: list[str] | pa.Array):
        """For each text its ids as little-endian 32-bit integers."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.cut:
            yield from (np.array(ids, "<u4").tobytes() for ids in self._encode(texts.to_pylist()))
            return
        for at, upto in grouped(pc.binary_length(texts).to_numpy(), GROUP):
            yield from self._group(texts.slice(at, upto - at))

    def _group(self, some: pa.Array):
        cut, edges = self.words(some)
        if not len(cut):
            yield from [b""] * len(some)
            return
        coded = cut.dictionary_encode()
        at, raw = np.frombuffer(coded.dictionary.buffers()[1], "<i4")[: len(coded.dictionary) + 1].tolist(), bytes(coded.dictionary.buffers()[2] or b"")
        words = [raw[x:y] for x, y in zip(at, at[1:])]
        if self.held > TABLE_BYTES:
            self.older = self.ids, self.line, self.upto
            self.forget()
        found = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if new := [words[i] for i in missing.tolist()]:
            self.learn(self._recall(new))
            found[missing] = np.fromiter(map(self.ids.__getitem__, new), np.int64, len(new))
        found = found[coded.indices.to_numpy()]
        upto = np.frombuffer(self.upto, np.int64)
        begins, sizes = upto[found], np.diff(upto)[found]
        line = _gathered(np.frombuffer(self.line, np.uint32), begins, sizes).astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(sizes)))[edges]).tolist()
        del upto  # the table's arrays can't grow while this looks at them
        for x, y in zip(cuts, cuts[1:]):
            yield line[x:y]


def _gathered(line: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of line, one after the other."""
    before = np.cumsum(sizes) - sizes
    return line[np.repeat(begins - before, sizes) + np.arange(sizes.sum())]


@lru_cache(1)
def load(path: str | None) -> Words:
    """In a worker: one tokenizer and table for all its tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Words(path)


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, shard, start_in_shard, ids) in ascending order of doc_id, over the partitions and within each."""

    def work(batches):
        from pyspark import TaskContext

        words, shard, start = load(path), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            found = [ids + last for ids in words.encode(b.column(1))]
            ends = np.cumsum([0] + [len(x) // 4 for x in found], dtype=np.int64)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(found), shard, np.int32)), pa.array(start + ends[:-1]), ids], names=SCHEMA.names)
            start += int(ends[-1])

    given = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), null_text(f"`{text}`").alias("body"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("body")]
    return in_arrow(given.repartitionByRange(*order).sortWithinPartitions(*order, "body"), work, SCHEMA)


def write(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", end: int = END, tokenizer: str | None = None) -> None:
    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_STRIDE, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    encode(docs, ident, text, end, tokenizer).write.options(**{k: str(v) for k, v in options.items()}).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start_in_shard, ids). Filters on doc_id skip stripes by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): the number of ids in all shards before. One row for each shard goes through one task."""
    n = read(spark, path).select("shard", (F.col("start_in_shard") + F.size("ids")).alias("upto")).groupBy("shard").agg(F.max("upto").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def checks(ids: Column) -> Column:
    """(n_tokens, ids_crc32) of an ids column."""

    @F.pandas_udf("struct<n_tokens: long, ids_crc32: long>")
    def crc(s):
        import pandas as pd

        return pd.DataFrame({"n_tokens": [len(x) for x in s], "ids_crc32": [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in s]}, columns=["n_tokens", "ids_crc32"]).astype("int64")

    return crc(ids)


def round_trip(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes docs to the shared folder and returns (doc_id, start, n_tokens, ids_crc32) from the files."""
    scratch = Scratch(spark, "tokens")
    path = scratch.path("ids")
    write(docs, path, ident, text)
    offsets = scratch.save(starts(spark, path), "starts")
    found = read(spark, path).join(offsets, "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), checks(F.col("ids")).alias("c"))
    return found.select("doc_id", "start", "c.n_tokens", "c.ids_crc32")
