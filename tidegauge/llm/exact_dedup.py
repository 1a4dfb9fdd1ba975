"""Exact dedup by a content sort.

Sampled splitters range-partition the rows by their text, each partition is sorted externally, so that equal texts
are adjacent, and each text is compared in full with its neighbour. Splitters hold the first characters and a hash
of the whole text, and the id: so the driver's sample stays small for long texts, and a text that a third of all
rows share is dealt over as many partitions as its rows need. Runs of equal texts that cross partitions' borders
are put together from one row for each partition and run.

Null texts count as empty. Null ids sort below all others. Repeated rows (equal id and text) count in group_size;
exactly one row of a group is kept. An empty table gives an empty result. Input columns whose name is one of the
result's own (keep_id, group_size, kept, text_sha256) are replaced in annotate(); keep() returns the input's columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, in_arrow, null_text

#: Characters of a text that a splitter holds beside the hash of the whole text.
HEAD = 24


def _runs(text: str, ident: str, key: str, payload: list[str], only_leads: bool):
    """A sorted partition's rows, each with the number of its run of equal texts; then border rows with the text
    of each run that other partitions may go on with, those of the partition's first and last key."""

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        run, last, sha, first_key, last_key = -1, None, "", None, None
        tail: list[tuple[int, str, int | None]] = []  # runs of the newest key: number, text, largest id
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts, keys, ids = batch.column(text), batch.column(key), batch.column(ident)
            starts = np.ones(n, bool)
            starts[1:] = ~np.asarray(pc.equal(texts[1:], texts[:-1]))
            starts[0] = last is None or texts[0].as_py() != last
            number = run + np.cumsum(starts)
            shas = [sha] if not starts[0] else []
            heads = []
            for i in np.flatnonzero(starts):
                i, k, value = int(i), keys[int(i)].as_py(), texts[int(i)].as_py()
                shas.append(hashlib.sha256(value.encode()).hexdigest())
                first_key = k if first_key is None else first_key
                if k != last_key:
                    tail, last_key = [], k
                run, last = run + 1, value
                (heads if k == first_key else tail).append((run, value, ids[i].as_py()))
            sha = shas[-1]
            which = number - number[0]
            rows = {c: batch.column(c) for c in payload}
            rows |= {ident: ids, "part": pa.repeat(pa.scalar(part, pa.int32()), n), "run": pa.array(number.astype(np.int32)), "lead": pa.array(starts), "sha": pa.array(shas, pa.string()).take(pa.array(which)), "border": pa.nulls(n, pa.string())}
            out = pa.RecordBatch.from_pydict(rows)
            yield out.filter(pa.array(starts)) if only_leads else out
            if heads:
                yield _borders(heads, part, out.schema)
        if tail:
            yield _borders(tail, part, out.schema)

    return work


def _borders(runs, part, schema):
    n = len(runs)
    own_ = {"part": [part] * n, "run": [r[0] for r in runs], "lead": [False] * n, "border": [r[1] for r in runs], schema.names[schema.names.index("part") - 1]: [r[2] for r in runs]}
    return pa.RecordBatch.from_arrays([pa.array(own_[f.name], f.type) if f.name in own_ else pa.nulls(n, f.type) for f in schema], schema=schema)


def _sorted(docs: DataFrame, ident: str, text: str, payload: list[str], only_leads: bool, scratch: Scratch, tag: str) -> DataFrame:
    """Columns: c0.. (the payload's), id, part, run, lead, sha, border."""
    given = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(payload)], F.col(f"`{ident}`").cast("long").alias("id"), null_text(f"`{text}`").alias("body"))
    given = given.withColumn("head", F.substring("body", 1, HEAD)).withColumn("key", F.xxhash64("body"))
    dealt = given.repartitionByRange("head", "key", F.desc_nulls_last("id")).sortWithinPartitions("head", "key", "body", F.desc_nulls_last("id")).drop("head")
    names = [f"c{i}" for i in range(len(payload))]
    fields = [StructField(n, docs.schema[c].dataType) for n, c in zip(names, payload)]
    fields += [StructField("id", LongType()), StructField("part", IntegerType()), StructField("run", IntegerType()), StructField("lead", BooleanType()), StructField("sha", StringType()), StructField("border", StringType())]
    return scratch.save(in_arrow(dealt, _runs("body", "id", "key", names, only_leads), StructType(fields)), tag)


def _whole(borders: DataFrame, sizes: DataFrame | None, scratch: Scratch) -> DataFrame:
    """For each border run the largest id of its text over all partitions, and the size with sizes (part, run, n).

    A few rows for each partition, written first: so Spark knows the size and need not shuffle the documents to join
    them, unless it is too large to broadcast."""
    runs = borders.select("part", "run", "border", F.col("id").alias("most"))
    runs = runs.join(sizes, ["part", "run"]) if sizes is not None else runs.withColumn("n", F.lit(0).cast("long"))
    whole = runs.groupBy("border").agg(F.max("most").alias("whole_most"), F.sum("n").alias("whole_n"), F.collect_list(F.struct("part", "run")).alias("runs"))
    whole = whole.where(F.size("runs") > 1).select(F.explode("runs").alias("r"), "whole_most", "whole_n")
    return scratch.save(whole.select("r.part", "r.run", "whole_most", "whole_n"), "whole")


def annotate(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without its text, with keep_id, group_size, kept and text_sha256 for every row, dropped ones too."""
    scratch = Scratch(spark, "exact")
    payload = [c for c in docs.columns if c not in (ident, text, "keep_id", "group_size", "kept", "text_sha256")]
    rows = _sorted(docs, ident, text, payload, False, scratch, "rows")
    # a run within one partition has at most that partition's rows, however many rows its text has
    run = Window.partitionBy("part", "run")
    seen = rows.where("border is null").withColumn("most", F.max("id").over(run)).withColumn("n", F.count("*").over(run))
    sizes = rows.where("border is null").groupBy("part", "run").agg(F.count("*").alias("n"))
    joined = seen.join(_whole(rows.where("border is not null"), sizes, scratch), ["part", "run"], "left")
    keep = F.when(F.col("whole_n").isNull(), F.col("most")).otherwise(F.col("whole_most"))
    return joined.select(F.col("id").alias(ident), *[F.col(f"c{i}").alias(c) for i, c in enumerate(payload)], keep.alias("keep_id"), F.coalesce("whole_n", "n").alias("group_size"), (F.col("lead") & F.col("id").eqNullSafe(keep)).alias("kept"), F.col("sha").alias("text_sha256"))


def keep(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each text: that with the largest id."""
    scratch = Scratch(spark, "exact")
    rows = _sorted(docs, ident, text, docs.columns, True, scratch, "rows")
    leads = rows.where("border is null").join(_whole(rows.where("border is not null"), None, scratch), ["part", "run"], "left")
    stays = F.col("whole_n").isNull() | F.col("id").eqNullSafe(F.col("whole_most"))
    return leads.where(stays).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
