"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

A document's hash puts it in one of the blocks of its source, so the order of a source's blocks is a random
permutation of its documents. A source's target gives it a number of whole passes over its blocks and, for the
rest, its first blocks, up to the one whose middle the rest reaches: that many blocks are its quota.

The root of the tree has all sources' quotas. A node gives half of its blocks to its left child: how many of each
source is one draw from the multivariate hypergeometric distribution, made source by source from the conditional
distributions, by inversion from a hash of node and source. What is left is the right child's, so quotas are exact at
every node. Leaves are the output shards; a leaf holds the next blocks of each source's permutation, as many as its
quota, so blocks are disjoint. Within a shard a hash of document and pass gives the order.

Shards and blocks grow with the words of the table: see shape(). The leaves are resolved to a table of the shards that
take each block of a source, which documents are joined with by source and block: a document's row carries its own
shards alone, however many there are. The table is broadcast up to BROADCAST_ROWS rows, by a count; beyond, the join is
a merge join by source and block, so a hot source is spread over its blocks. Counts are kept for each source and block
and combined before any shuffle: no task holds a source's documents.

Sizes are numbers of words, [^\\x20\\x09-\\x0D]+; null texts have none. Null sources are one source, last in order.
Null ids count as the empty id. Repeated rows are taken alike. Documents without words belong to no partial pass.
Empty tables give empty results. Input columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, own

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a shard, about; levels of the tree and binary digits of a block's number, at least.
SHARD_WORDS, LEVELS, BITS = 1 << 24, 6, 12
#: Rows of a table that is broadcast, at most: a source, a block's number and up to three shards each, under 40 MB.
BROADCAST_ROWS = 1 << 18
SEED = "mix"


def shape(total: int, shard_words: int = SHARD_WORDS) -> tuple[int, int]:
    """Levels of the tree and binary digits of a block's number, for a table of so many words."""
    levels = max(LEVELS, math.ceil(math.log2(max(total, 1) / shard_words)))
    return levels, max(BITS, levels + 4)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def spot(ident: Column) -> Column:
    """The first eight hexadecimal digits of the id's hash."""
    return F.conv(F.substring(_hash(ident), 1, 8), 16, 10).cast("long")


def block(at: Column, bits: int) -> Column:
    return F.shiftright(at, 32 - bits).cast("int")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target: shares by weight, held at `most` times a
    source's size, where the rest is shared by weight again until no share is above.

    In order of size for weight, the sources held at their limit come first: a share for each unit of weight that
    is left over by the sources before is tried at each place, and the first that fits is everyone's from there on.
    One row for each source goes through one task here.
    """
    order = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order + 1).cast("int"))).withColumn("limit_", F.col("source_size") * most)
    by = Window.orderBy(F.col("limit_") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("limit_").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("unit", (F.sum("source_size").over(Window.partitionBy()) - before) / left)
    fits = F.when(F.col("unit") * F.col("weight") <= F.col("limit_"), F.col("unit"))
    w = w.withColumn("share", F.first(fits, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return w.select("source", "source_size", F.when(F.col("share").isNull(), F.col("limit_").cast("double")).otherwise(F.col("weight") * F.col("share")).alias("target"))


def quotas(sized: DataFrame, bits: int) -> DataFrame:
    """sized: (source, spot, size). A row for each source: source_size, target, and quota, the blocks to take."""
    cells = sized.groupBy("source", block(F.col("spot"), bits).alias("block")).agg(F.sum("size").alias("words"))
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    inner = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = cells.withColumn("before", F.coalesce(F.sum("words").over(inner), F.lit(0))).join(goal.select("source", "rest", "passes").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    taken = (F.col("words") > 0) & (2 * F.col("before") + F.col("words") <= 2 * F.col("rest")) & (F.col("passes") < MOST)
    cut = upto.groupBy("source").agg(F.coalesce(F.max(F.when(taken, F.col("block") + 1)), F.lit(0)).alias("cutoff")).withColumnRenamed("source", "s")
    goal = goal.join(cut, F.col("source").eqNullSafe(F.col("s")))
    return goal.select("source", "source_size", "target", (F.col("passes").cast("long") * (1 << bits) + F.col("cutoff")).alias("quota"))


def _log_factorial(n: str) -> str:
    """Exact up to 19, by Stirling's series above. This and the next ones make SQL, as one text is parsed faster than
    hundreds of columns are built."""
    small, x = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(20)), f"CAST(greatest({n}, 20) AS DOUBLE)"
    series = f"({x} + 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5))"
    return f"CASE WHEN {n} < 20 THEN element_at(array({small}), CAST({n} + 1 AS INT)) ELSE {series} END"


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)}) - ({_log_factorial(k)}) - ({_log_factorial(f'({n} - {k})')})"


def hypergeometric(total: str, good: str, drawn: str, unit: str) -> str:
    """How many of `drawn` things, taken from `total` of which `good` are good, are good: the quantile at `unit`.

    The search starts ten standard deviations and ten below the mean; what lies beyond has a chance under 1e-20. All
    four are SQL, as is the result."""
    given = f"struct({total} AS t, {good} AS g, {drawn} AS d, {unit} AS u)"
    share = "(i.g / greatest(i.t, 1))"
    mean = f"(i.d * {share})"
    far = f"(10 * sqrt({mean} * (1 - {share}) * (i.t - i.d) / greatest(i.t - 1, 1)) + 10)"
    ends = f"struct(greatest(greatest(0, i.d - (i.t - i.g)), floor({mean} - {far})) AS a, least(least(i.d, i.g), ceil({mean} + {far})) AS b)"
    first = f"exp({_log_choose('i.g', 'e.a')} + {_log_choose('(i.t - i.g)', '(i.d - e.a)')} - ({_log_choose('i.t', 'i.d')}))"
    ratio = "CAST(i.g - s.x AS DOUBLE) * (i.d - s.x) / (CAST(s.x + 1 AS DOUBLE) * (i.t - i.g - i.d + s.x + 1))"
    search = f"aggregate(sequence(e.a + 1, e.b), struct(e.a AS x, i.u AS left, {first} AS p), (s, z) -> CASE WHEN s.left >= s.p THEN struct(s.x + 1 AS x, s.left - s.p AS left, s.p * {ratio} AS p) ELSE s END).x"
    return f"transform(array({given}), i -> transform(array({ends}), e -> CASE WHEN e.b > e.a THEN {search} ELSE e.a END)[0])[0]"


def _split(node: str, held: str) -> str:
    """held: (source, quota) of a node; the left child's quotas in the same order, half of all blocks."""
    unit = f"pmod(xxhash64('{SEED}', {node}, q.source, q.source IS NULL), {1 << 52}) / {float(1 << 52)!r}D"
    draw = hypergeometric("r.rest", "q.quota", "r.want", unit)
    start = f"transform(array(aggregate({held}, 0L, (t, q) -> t + q.quota)), t -> struct(t AS rest, t div 2 AS want, CAST(array() AS ARRAY<BIGINT>) AS taken))[0]"
    return f"aggregate({held}, {start}, (r, q) -> transform(array({draw}), x -> struct(r.rest - q.quota AS rest, r.want - x AS want, concat(r.taken, array(x)) AS taken))[0]).taken"


def tree(goal: DataFrame, levels: int) -> DataFrame:
    """(node, held) for all nodes: the root is 1, the children of n are 2 n and 2 n + 1, leaves are 2 ** levels on.

    A node is a row, and splitting it is an expression of that row: no shuffle, but rows are dealt out anew by and by."""
    nodes = goal.agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("held")).select(F.lit(1).cast("long").alias("node"), "held")
    node, held = F.col("node"), F.col("held")
    half = F.expr(_split("node", "held"))
    pick = lambda f: F.zip_with("held", "left", lambda q, x: F.struct(q["source"].alias("source"), f(q["quota"], x).alias("quota")))
    here, left, right = (F.struct(n.alias("node"), h.alias("held")) for n, h in ((node, held), (node * 2, pick(lambda q, x: x)), (node * 2 + 1, pick(lambda q, x: q - x))))
    for level in range(levels):
        nodes = nodes.repartition("node") if level and level % 6 == 0 else nodes
        now = node >= 1 << level  # nodes above this level have been split
        nodes = nodes.withColumn("left", F.when(now, half))
        nodes = nodes.select(F.explode(F.when(now, F.array(here, left, right)).otherwise(F.array(here))).alias("n")).select("n.*")
    return nodes


def dealt(nodes: DataFrame, levels: int, bits: int) -> DataFrame:
    """(source, block, shards): the shards that take a block, one for each pass, in order of the passes. nodes: tree().

    The leaves take a source's blocks, pass after pass, in their own order: what the leaves before take is where a leaf
    begins."""
    leaves = nodes.where(F.col("node") >= 1 << levels).select((F.col("node") - (1 << levels)).alias("shard"), F.explode("held").alias("h")).select("shard", "h.source", "h.quota").where("quota > 0")
    before = F.sum("quota").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    each = leaves.withColumn("first", F.coalesce(before, F.lit(0))).select("source", "shard", F.explode(F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("at"))
    by = each.groupBy("source", F.col("at").bitwiseAND((1 << bits) - 1).cast("int").alias("block"))
    return by.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.shiftright("at", bits).alias("pass"), "shard"))), lambda x: x["shard"]).alias("shards"))


def plan(scratch: Scratch, sized: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """A row for each source (source_size, target); dealt(), to be joined; bits."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    levels, bits = shape(total, shard_words)
    goal = scratch.save(quotas(sized, bits), "quotas")
    table = scratch.save(dealt(tree(goal, levels), levels, bits), "dealt")
    return goal.drop("quota"), table.hint("broadcast" if table.count() <= BROADCAST_ROWS else "merge"), bits


def sizes(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"), spot(F.col(f"`{ident}`")).alias("spot"))


def taken(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs; taken: the words that the tree's leaves take."""
    scratch = Scratch(spark, "mix")
    sized = scratch.save(sizes(docs, ident, source, text), "sized")
    goal, table, bits = plan(scratch, sized, shard_words)
    rows = sized.withColumn("block", block(F.col("spot"), bits)).join(table.toDF("s", "b", "shards"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s")
    rows = rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    copies = F.coalesce(F.size("shards"), F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", shard: str | None = "shard", place: str | None = "place", shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs, each row as often as the mix takes it, with its shard and, to sort the shard by, its place (None: without)."""
    scratch = Scratch(spark, "mix")
    _, table, bits = plan(scratch, scratch.save(sizes(docs, ident, source, text), "sized"), shard_words)
    s, b, at, found, to, n = (own(docs, x) for x in ("source", "of", "block", "shards", "shard", "pass"))
    given = docs.withColumn(at, block(spot(F.col(f"`{ident}`")), bits))
    placed = given.join(table.toDF(s, b, found), F.col(f"`{source}`").eqNullSafe(F.col(s)) & (F.col(at) == F.col(b)))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in (shard, place)]
    new = [c.alias(name) for c, name in ((F.col(to), shard), (_hash(F.col(f"`{ident}`"), F.col(n)), place)) if name]
    return placed.select("*", F.posexplode(found).alias(n, to)).select(*columns, *new)


def shuffled(mixed: DataFrame, shard: str = "shard", place: str = "place") -> DataFrame:
    """A partition has whole shards, each in order of its rows' places. Shards are about SHARD_WORDS words."""
    return mixed.repartition(shard).sortWithinPartitions(shard, place)


def write(mixed: DataFrame, path: str, shard: str = "shard", place: str = "place") -> None:
    """A folder for each shard, shuffled within: rows in order of their place."""
    shuffled(mixed, shard, place).write.partitionBy(shard).parquet(path)


#: The same for DuckDB.
ORACLE = rf"""
WITH sized0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS spot
  FROM documents),
shape AS (SELECT greatest({BITS}, ceil(log2(greatest(sum(size), 1)::DOUBLE / {SHARD_WORDS})) + 4)::INT AS bits FROM sized0),
sized AS (SELECT doc_id, source, size, spot >> (32 - bits) AS block FROM sized0, shape),
cells AS (SELECT source, block, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
goal0 AS (SELECT source, sum(words)::BIGINT AS source_size FROM cells GROUP BY ALL),
goal1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * {MOST} AS limit_ FROM goal0),
goal2 AS (SELECT *, ((sum(source_size) OVER ())::BIGINT
    - coalesce(sum(limit_) OVER (ORDER BY limit_ / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY limit_ / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS unit FROM goal1),
goal3 AS (SELECT *, first_value(CASE WHEN unit * weight <= limit_ THEN unit END IGNORE NULLS)
    OVER (ORDER BY limit_ / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share FROM goal2),
goal4 AS (SELECT source, source_size, CASE WHEN share IS NULL THEN limit_::DOUBLE ELSE weight * share END AS target FROM goal3),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goal4),
upto AS (SELECT c.*, g.passes, g.target - g.passes * g.source_size AS rest,
    coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM cells c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT source, coalesce(max(CASE WHEN words > 0 AND 2 * before + words <= 2 * rest AND passes < {MOST} THEN block + 1 END), 0) AS cutoff FROM upto GROUP BY source)
SELECT s.doc_id, s.size, g.source_size, g.target, (g.passes + (s.block < c.cutoff)::INT) * s.size AS taken
FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""
