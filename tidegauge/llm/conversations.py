"""Conversations repaired by error-correcting Earley parsing.

The grammar of roles is right-linear: (s?(ua)+)?. Every production ends in its only nonterminal, so a completed one
hands its result up unchanged, and an item needs no origin: it is the nonterminal still to derive, with the least
(cost, audit) of all ways to get there. Scanning a row keeps, reroles or deletes it, prediction may insert a turn, and
the items of the last column that derive the empty rest give the repair. Of two different audits of the same rows and
cost neither begins the other, so the lesser of two stays the lesser when both go on.

A conversation may be of any length. Rows are reduced to what parsing needs (turn, role, hash of text, faults), equal
ones counted and combined before any shuffle, then range-partitioned and sorted; each run of at most SEGMENT rows is
parsed from every item that it may begin with. A conversation's runs are then chained, one small row a run, and its
texts, shuffled once, pass by in order, a batch at a time, while the edits are applied. Only this last pass has one task
for a conversation, as its digest is sequential; it holds the audit and never the texts.

Rows are in order of turn (nulls first), those of one turn by role and hash of text. Null roles and texts are one
space, which makes a blank text and a role outside the grammar; so is an empty role. Conversations with a null id are
one conversation. Repeated rows are duplicates. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, in_arrow

#: The productions by nonterminal (a role's initial, then the nonterminal that follows; "": done), costs.
GRAMMAR = {"talk": (("", ""), ("s", "opened"), ("u", "asked")), "opened": (("u", "asked"),), "asked": (("a", "answered"),), "answered": (("", ""), ("u", "asked"))}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Roles that can be given or inserted.
GIVEN = {"u": "user", "a": "assistant"}
#: Neighbours' initials that are no fault.
FOLLOW = {"su", "ua", "au"}
#: Rows of a run, at most.
SEGMENT = 4096
START = "start"

_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_STEP = StructType([StructField("begin", StringType()), StructField("end", StringType()), StructField("cost", LongType()), StructField("audit", StringType())])
RUN = [StructField("part", IntegerType()), *(StructField(c, LongType()) for c in ("run", *_COUNTS)), StructField("first", StringType()), StructField("last", StringType()), *(StructField(c, LongType()) for c in ("turns", "least", "most")), StructField("paths", ArrayType(_STEP))]
RESULT = [*(StructField(c, LongType()) for c in ("gaps", *_COUNTS, "cost")), StructField("audit", StringType()), StructField("repaired_sha256", StringType())]
REPAIRED = [StructField("place", LongType()), *(StructField(c, StringType()) for c in ("role", "text", "edit"))]

Chart = dict[str, tuple[int, str]]


def _offer(column: Chart, item: str, cost: int, audit: str) -> bool:
    if item in column and column[item] <= (cost, audit):
        return False
    column[item] = (cost, audit)
    return True


def predict(column: Chart) -> Chart:
    """With the items that insertions lead to."""
    todo = list(column)
    while todo:
        item = todo.pop()
        cost, audit = column[item]
        todo += [then for first, then in GRAMMAR[item] if first in GIVEN and _offer(column, then, cost + INSERT, audit + "I")]
    return column


def scan(column: Chart, row: str) -> Chart:
    """The next column: row is "x" if it must go, else its role's initial (or "-"), as a capital if it is truncated."""
    out: Chart = {}
    initial, more = row.lower(), TRUNCATED if row.isupper() or row == "_" else 0
    for item, (cost, audit) in column.items():
        _offer(out, item, cost + DELETE, audit + "D")
        for first, then in GRAMMAR[item] if row != "x" else ():
            if first and first == initial:
                _offer(out, then, cost + KEEP + more, audit + "K")
            elif first in GIVEN:
                _offer(out, then, cost + REROLE + more, audit + "R")
    return predict(out)


def parse(rows: str, begin: str) -> Chart:
    """The chart's last column after rows, from the item begin, or from the grammar's start with what it predicts."""
    column = predict({"talk": (0, "")}) if begin == START else {begin: (0, "")}
    for row in rows:
        column = scan(column, row)
    return column


_short = lru_cache(20_000)(parse)  # most conversations are short and alike


def paths(rows: str, begins: list[str]) -> list[dict]:
    found = _short if len(rows) <= 32 else parse
    return [{"begin": b, "end": e, "cost": c, "audit": a} for b in begins for e, (c, a) in found(rows, b).items()]


class Chain:
    """Runs of a conversation, put together: for each item its cost and, as links back, its audit, a link for each run."""

    def __init__(self):
        self.live = {e: (c, (None, a)) for e, (c, a) in parse("", START).items()}
        self.fresh = True

    @staticmethod
    def _less(x, y) -> bool:
        a, b = [], []
        while x is not y:
            a.append(x[1])
            b.append(y[1])
            x, y = x[0], y[0]
        return "".join(reversed(a)) < "".join(reversed(b))

    def add(self, steps: list[dict]) -> None:
        out: dict = {}
        for s in steps:
            if self.fresh != (s["begin"] == START) or not self.fresh and s["begin"] not in self.live:
                continue
            cost, link = (0, None) if self.fresh else self.live[s["begin"]]
            cost, link = cost + s["cost"], (link, s["audit"])
            if (had := out.get(s["end"])) is None or cost < had[0] or cost == had[0] and self._less(link, had[1]):
                out[s["end"]] = (cost, link)
        self.live, self.fresh = out, False

    def repair(self) -> tuple[int, str]:
        """The least (cost, audit) of items that need nothing more."""
        best = None
        for item, (cost, link) in self.live.items():
            if ("", "") in GRAMMAR[item] and (best is None or cost < best[0] or cost == best[0] and self._less(link, best[1])):
                best = (cost, link)
        cost, link = best
        audit = []
        while link is not None:
            audit.append(link[1])
            link = link[0]
        return cost, "".join(reversed(audit))


class Edits:
    """Applies an audit to a conversation's rows as they pass; yields (edit, role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.n, self.shift = audit, 0, 0, 0

    def _due(self) -> str:
        return GIVEN["ua"[(self.n - self.shift) % 2]]

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", self._due(), ""
            self.at, self.n = self.at + 1, self.n + 1

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if not self.n and edit == "K" and role[:1] == "s":
            self.shift = 1
        yield edit, role if edit == "K" else self._due(), text
        self.n += 1


def spaced(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))


def given(talks: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of a table of conversations."""
    return talks.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """given() rows with the damage that a hash of conversation and turn decides: one in twenty each is dropped, emptied,
    without ends of sentences, repeated, or the user's."""
    kind = F.pmod(F.crc32(F.concat_ws(":", spaced("conv"), spaced("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"))


def marks(rows: DataFrame) -> DataFrame:
    """given() rows reduced to (conv, turn, role, hash, n, blank, open): open texts lack a sentence's end."""
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r")), F.lit(1))
    narrow = rows.select("conv", "turn", "role", F.unhex(F.sha2(F.col("text"), 256)).alias("hash"), "copies", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    return narrow.groupBy("conv", "turn", "role", "hash").agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open"))


def with_repeats(marked: DataFrame) -> DataFrame:
    """Adds again: whether an earlier turn of the conversation has the same role and text."""
    first = marked.groupBy("conv", "role", "hash").agg(F.min(F.struct("turn")).alias("at")).toDF("c", "r", "h", "at")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    return marked.join(first, same).withColumn("again", ~F.col("turn").eqNullSafe(F.col("at.turn"))).drop("c", "r", "h", "at")


class Run:
    """Rows of a conversation that follow each other, on their way to one row of runs()."""

    def __init__(self, talk, part: int, number: int, whole: bool):
        self.row = {"conv": talk, "part": part, "run": number, **dict.fromkeys(_COUNTS, 0), "first": None, "last": None, "turns": 0, "least": None, "most": None}
        self.codes: list[str] = []
        self.whole = whole

    def add(self, role: str, turn: int | None, fault: str | None) -> None:
        row, initial = self.row, role[:1]
        if fault:
            row[fault] += 1
        if self.codes:
            row["illegal"] += row["last"] + initial not in FOLLOW
        else:
            row["first"] = initial
        row["last"] = initial
        if turn is not None and turn != row["most"]:
            row["turns"] += 1
            row["least"] = turn if row["least"] is None else row["least"]
            row["most"] = turn
        code = initial if initial in ("s", "u", "a") else "-"
        self.codes.append(code if fault is None else "x" if fault != "truncated" else "_" if code == "-" else code.upper())

    def done(self) -> dict:
        return self.row | {"paths": paths("".join(self.codes), [START] if self.whole else [START, *GRAMMAR])}


def runs(marked: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, and RUN): counts and chart paths of runs of rows, in order of part and run within a conversation. Only the
    first conversation of a partition may have begun before it: the others are parsed from the grammar's start alone."""
    schema = StructType([marked.schema["conv"], *RUN])
    arrow = to_arrow_schema(schema)

    def work(batches):
        from pyspark import TaskContext

        part, number, seen, run, out = TaskContext.get().partitionId(), 0, 0, None, []
        for b in batches:
            for r in b.to_pylist():
                same = run is not None and r["conv"] == run.row["conv"]
                for i in range(r["n"]):
                    if not same or len(run.codes) >= segment:
                        if run is not None:
                            out.append(run.done())
                        number += 1
                        seen += not same
                        run, same = Run(r["conv"], part, number, not same and seen > 1), True
                    run.add(r["role"], r["turn"], "blank" if r["blank"] else "duplicate" if i or r["again"] else "truncated" if r["open"] else None)
                    if len(out) >= 1_000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
        if run is not None:
            yield pa.RecordBatch.from_pylist([*out, run.done()], schema=arrow)

    order = ["conv", "turn", "role", "hash"]
    return in_arrow(marked.select(*order, "n", "blank", "open", "again").repartitionByRange(*order).sortWithinPartitions(*order), work, schema)


class Talk:
    """A conversation as its rows pass: first its runs, then its texts."""

    def __init__(self, conv):
        self.conv, self.chain, self.edits, self.last_run = conv, Chain(), None, None
        self.counts, self.turns, self.least, self.most = dict.fromkeys(_COUNTS, 0), 0, None, None

    def run(self, r: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += r[c]
        if self.last_run is not None:
            self.counts["illegal"] += self.last_run["last"] + r["first"] not in FOLLOW
        if r["least"] is not None:
            self.turns += r["turns"] - (self.most == r["least"])
            self.least, self.most = r["least"] if self.least is None else self.least, r["most"]
        self.chain.add(r["paths"])
        self.last_run = {"last": r["last"]}

    def ready(self) -> Edits:
        if self.edits is None:
            self.cost, audit = self.chain.repair() if self.last_run else (0, "")
            self.edits = Edits(audit)
        return self.edits

    def row(self) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.edits.audit}


def _stream(spark: SparkSession, rows: DataFrame, talks: DataFrame, segment: int) -> DataFrame:
    """For every conversation of talks, in one partition: a row of its own, its runs, and its texts in order."""
    scratch = Scratch(spark, "talks")
    marked = scratch.save(marks(rows), "marks")
    found = runs(with_repeats(marked), segment)
    names = [f.name for f in RUN]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in RUN]
    texts = [F.lit(None).cast(k).alias(n) for n, k in (("turn", "long"), ("role", "string"), ("hash", "binary"), ("text", "string"), ("copies", "int"))]
    head = talks.select("conv").distinct().select("conv", F.lit(0).alias("kind"), *empty, *texts)
    middle = found.select("conv", F.lit(1).alias("kind"), *names, *texts)
    tail = rows.select("conv", F.lit(2).alias("kind"), *empty, "turn", "role", F.unhex(F.sha2(F.col("text"), 256)).alias("hash"), "text", "copies")
    return head.unionAll(middle).unionAll(tail).repartition("conv").sortWithinPartitions("conv", "kind", "part", "run", "turn", "role", "hash")


def _talks(batches, open_talk, row, close):
    """Calls open_talk(talk), row(edit, role, text) and close(talk) for the conversations of a _stream(), in order."""
    talk = None

    def end():
        for e in talk.ready().inserted():
            row(*e)
        close(talk)

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == 0:
                if talk is not None:
                    end()
                talk = Talk(r["conv"])
                open_talk(talk)
            elif r["kind"] == 1:
                talk.run(r)
            else:
                for _ in range(r["copies"]):
                    for e in talk.ready().row(r["role"], r["text"]):
                        row(*e)
        yield
    if talk is not None:
        end()
        yield


def digests(spark: SparkSession, rows: DataFrame, talks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, and RESULT) for every conversation of talks (conv), by its given() rows: what was wrong, the edits, and
    the SHA-256 of the repaired conversation."""
    schema = StructType([talks.schema["conv"], *RESULT])
    arrow = to_arrow_schema(schema)

    def work(batches):
        out, sha = [], None

        def open_talk(talk):
            nonlocal sha
            sha = None

        def row(edit, role, text):
            nonlocal sha
            line = f"{role}:{text}".encode()
            if sha is None:
                sha = hashlib.sha256(line)
            else:
                sha.update(b"\n")
                sha.update(line)

        def close(talk):
            out.append(talk.row() | {"repaired_sha256": (sha or hashlib.sha256()).hexdigest()})

        for _ in _talks(batches, open_talk, row, close):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()

    return in_arrow(_stream(spark, rows, talks, segment), work, schema).withColumnRenamed("conv", "conv_id")


def repaired(spark: SparkSession, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations of given() rows, row by row; edit is K for kept, R
    for reroled, I for inserted."""
    schema = StructType([rows.schema["conv"], *REPAIRED])
    arrow = to_arrow_schema(schema)

    def work(batches):
        out, talk_now = [], None

        def open_talk(talk):
            nonlocal talk_now
            talk_now = talk

        def row(edit, role, text):
            out.append({"conv": talk_now.conv, "place": talk_now.edits.n, "role": role, "text": text, "edit": edit})

        for _ in _talks(batches, open_talk, row, lambda talk: None):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()

    return in_arrow(_stream(spark, rows, rows, segment), work, schema).withColumnRenamed("conv", "conv_id")
