"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of the model has a whitespace marker after another character, no merge crosses the place before a
marker: a text is cut there, each distinct marked word is segmented once by the library, and its ids are joined
back by position. The table belongs to a task: it is emptied at TABLE_BYTES and when the task ends, so memory is
bounded and nothing outlives a stage. A table over the whole corpus would need every occurrence of every word
shuffled with its position, several times the input; this needs no shuffle at all. Decoding is the library's, from a
document's ids. A model whose pieces do cross markers, or that normalises, is given whole texts instead; both are
read from the model's own settings.

Null texts count as empty: no pieces, so just the begin and end ids. Texts of any length are cut whole. Rows with
null or repeated ids are encoded like others; other columns pass through encode() and decode().
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import in_arrow, null_text

#: Bytes of a task's table, at most (but for the chunks of one GROUP); an entry takes about ENTRY besides its characters.
TABLE_BYTES, ENTRY = 64 << 20, 200
#: Texts whose new chunks are segmented in one call.
GROUP = 64
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def marked(path: str) -> bool:
    """Whether chunks can be segmented on their own, by the model's settings: texts stay as they are but for one marker
    put first and blanks made markers, and no piece has a marker after another character."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    as_it_is = not n.precompiled_charsmap and not n.remove_extra_whitespaces
    return as_it_is and n.add_dummy_prefix and n.escape_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix and not any(MARK in x.piece.lstrip(MARK) for x in m.pieces)


class Pieces:
    """A model and its table: chunk -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.marked = marked(path)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """Without the marker that each chunk begins with."""
        if not text:
            return []
        line = MARK + text.replace(" ", MARK)
        if MARK + MARK not in line:
            return line[1:].split(MARK)
        return [c[1:] for c in _CHUNK.findall(line)]

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        mark = [self.model.piece_to_id(MARK)]
        found = self.model.encode([c.replace(MARK, " ") for c in new], num_threads=1)
        self.ids.update((c, self._bytes(ids if c else mark)) for c, ids in zip(new, found))
        self.held += sum(ENTRY + len(c) + 4 * len(ids) for c, ids in zip(new, found))

    def encode(self, texts: list[str]):
        """For each text its ids with begin and end, as bytes."""
        for at in range(0, len(texts), GROUP):
            some = texts[at : at + GROUP]
            if not self.marked:
                for ids in self.model.encode(some, num_threads=1):
                    yield self.begin + self._bytes(ids) + self.end
                continue
            cut = [self.chunks(t) for t in some]
            if self.held > TABLE_BYTES:
                self.forget()
            new = list({c for chunks in cut for c in chunks if c not in self.ids})
            if new:
                self.learn(new)
            for chunks in cut:
                yield b"".join([self.begin, *map(self.ids.__getitem__, chunks), self.end])

    def decode(self, ids: bytes) -> str:
        """What the library decodes ids to."""
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(1)
def load(path: str | None) -> Pieces:
    """In a worker: one model for all its tasks, whose table each of them empties at its end."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces(path)


def _passed(df: DataFrame, names: list[str]):
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], [StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(names)]


def encode(docs: DataFrame, text: str = "text", to: str = "ids", path: str | None = None) -> DataFrame:
    """docs with its text replaced by ids, an array of integers with the begin and end ids."""
    names = [c for c in docs.columns if c not in (text, to)]
    columns, fields = _passed(docs, names)

    def work(batches):
        pieces = load(path)
        try:
            for b in batches:
                found = list(pieces.encode(b.column(b.num_columns - 1).to_pylist()))
                ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found], dtype=np.int64))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*b.schema.names[:-1], "ids"])
        finally:
            pieces.forget()

    schema = StructType([*fields, StructField("ids", ArrayType(IntegerType()))])
    return in_arrow(docs.select(*columns, null_text(f"`{text}`").alias("body")), work, schema).toDF(*names, to)


def decode(coded: DataFrame, ids: str = "ids", to: str = "text", path: str | None = None) -> DataFrame:
    """coded with its ids replaced by the text that the library decodes them to; null ids give an empty text."""
    names = [c for c in coded.columns if c not in (ids, to)]
    columns, fields = _passed(coded, names)

    def work(batches):
        model = load(path).model
        for b in batches:
            texts = [model.decode(x.as_py() or []) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "body"])

    schema = StructType([*fields, StructField("body", StringType())])
    return in_arrow(coded.select(*columns, F.col(f"`{ids}`").cast("array<int>").alias("ids")), work, schema).toDF(*names, to)


def digests(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), made where the ids are, so that neither ids nor texts travel.
    Every document is decoded from its own ids."""

    def digest(pieces: Pieces, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()

    def work(batches):
        pieces = load(path)
        kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        try:
            for b in batches:
                found = [digest(pieces, ids) for ids in pieces.encode(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds.values()))], names=["doc_id", *kinds])
        finally:
            pieces.forget()

    schema = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return in_arrow(docs.select(F.col(f"`{ident}`").cast("long"), null_text(f"`{text}`").alias("body")), work, schema)
