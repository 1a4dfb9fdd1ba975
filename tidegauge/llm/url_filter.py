"""URL filters by a character language-model ratio, in DataFrame operations only.

Rules judge the urls they fit (a rule fits its host and all subdomains, if the path starts with the rule's; the
longest wins). Of the urls that a rule judges, one in HELD is held out, by a hash of host and path; all others teach
two variable-order Markov models over the characters of host and path, one for allowed urls and one for blocked ones:
contexts of up to three characters, interpolated with shorter ones by Witten-Bell smoothing, so a context counts for
as much as it was seen. Every other url is judged by the difference of its log-likelihoods divided by its length,
against the threshold that separates the held-out urls best (the mean of the two error rates is least).

The symbols are a-z, 0-9, five marks, the start and one for all else, so there are at most 43**4 sequences of four,
whatever the input: counts are combined before the shuffle, and the table of log ratios is written and joined by
Spark's own choice, a broadcast only if its size allows. Sequences carry no more than the number of their row; their
sums are joined back.

Log ratios are whole millionths, so sums are exact and don't depend on order. Null urls and those without :// have
an empty host and path; these have no rule and no likelihood and are blocked. Repeated rows are judged alike.
Urls of any length are judged whole. Other columns are not passed on. Empty tables give empty results; without judged
urls all ratios are zero and every url with a host or path is allowed; without held-out ones the threshold is zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Host and path of a rule, and what becomes of its urls.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
ORDER = 3
#: One judged url in so many is held out for the threshold.
HELD = 5
MARKS = "./-_~"
SYMBOLS = 26 + 10 + len(MARKS) + 1
START = "^"
#: Width of a bin of the threshold's search, in millionths, and the bins on either side of zero.
BIN, BINS = 10_000, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        top, slash, rest = rule.partition("/")
        fits.append(F.when(((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def judged(pages: DataFrame, rules: dict[str, str], ident: str = "page_id", url: str = "url") -> DataFrame:
    host, path = parsed(F.col(f"`{url}`"))
    out = pages.select(F.col(f"`{ident}`").alias("page_id"), host.alias("host"), path.alias("path"))
    out = out.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    said = reduce(lambda c, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(c), rules, F.lit(None).cast("string"))
    held = F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 4), 16, 10).cast("int") % HELD == 0
    return out.withColumns({"said": said, "held": held})


def grams() -> Column:
    """All sequences of ORDER + 1 symbols of host and path, the first ones with start symbols."""
    line = F.concat(F.lit(START * ORDER), F.regexp_replace(F.translate(F.concat("host", "path"), UPPER, LOWER), r"[^a-z0-9./\-_~]", "?"))
    return F.explode(F.regexp_extract_all(line, F.lit("(?=(.{%d}))" % (ORDER + 1)), F.lit(1)))  # at each place, in one go


def ratios(seen: DataFrame) -> DataFrame:
    """seen: (gram, n_allow, n_block), all sequences that any url has. Returns (gram, ratio): the logarithm, in
    millionths, of how much likelier the last symbol is after the others in allowed urls than in blocked ones."""
    table = seen.withColumns({"p_allow": F.lit(1.0 / SYMBOLS), "p_block": F.lit(1.0 / SYMBOLS)})
    for k in range(ORDER + 1):
        tail = F.substr("gram", F.lit(ORDER + 1 - k), F.lit(k + 1))
        level = seen.groupBy(tail.alias("tail")).agg(F.sum("n_allow").alias("c_allow"), F.sum("n_block").alias("c_block"))
        level = level.withColumn("context", F.substr("tail", F.lit(1), F.lit(k)))
        after = level.groupBy("context").agg(*[F.sum(f"c_{c}").alias(f"t_{c}") for c in ("allow", "block")], *[F.count_if(F.col(f"c_{c}") > 0).alias(f"kinds_{c}") for c in ("allow", "block")])
        level = level.join(after, "context").drop("context")
        table = table.withColumn("tail", tail).join(level, "tail")
        for c in ("allow", "block"):
            new = (F.col(f"c_{c}") + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"t_{c}") + F.col(f"kinds_{c}"))
            table = table.withColumn(f"p_{c}", F.when(F.col(f"t_{c}") > 0, new).otherwise(F.col(f"p_{c}")))
        table = table.select("gram", "p_allow", "p_block")
    return table.select("gram", F.floor(1e6 * (F.ln("p_allow") - F.ln("p_block")) + 0.5).cast("long").alias("ratio"))


def scored(urls: DataFrame, table: DataFrame) -> DataFrame:
    """urls, with their row numbers, and total (of the ratios) and n_grams instead of these."""
    sums = urls.where("host != '' or path != ''").select("row", grams().alias("gram")).join(table, "gram").groupBy("row").agg(F.sum("ratio").alias("total"), F.count("*").alias("n_grams"))
    return urls.join(sums, "row", "left").drop("row").withColumn("n_grams", F.coalesce("n_grams", F.lit(0)))


def threshold(scored: DataFrame) -> int:
    """In millionths a symbol. At most 2 * BINS + 1 counts are summed up in order; one number reaches the driver."""
    at = F.greatest(F.least(F.floor(F.col("total") / F.col("n_grams") / BIN), F.lit(BINS)), F.lit(-BINS))
    bins = scored.where("said is not null and held and n_grams > 0").groupBy(at.alias("bin")).agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("b"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    wrong = F.coalesce(F.sum("a").over(below), F.lit(0)) / F.greatest(F.sum("a").over(total), F.lit(1)) + (F.sum("b").over(total) - F.coalesce(F.sum("b").over(below), F.lit(0))) / F.greatest(F.sum("b").over(total), F.lit(1))
    best = bins.withColumn("wrong", wrong).orderBy("wrong", F.abs("bin"), "bin").first()
    return best.bin * BIN if best and best.wrong < 2 else 0


def verdicts(spark: SparkSession, pages: DataFrame, rules: dict[str, str] = RULES, ident: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio, n_grams) for every row; ratio: the sum, in millionths."""
    scratch = Scratch(spark, "urls")
    urls = scratch.save(judged(pages, rules, ident, url).withColumn("row", F.monotonically_increasing_id()), "urls")
    said = F.when(~F.col("held"), F.col("said"))
    seen = urls.where("host != '' or path != ''").select(said.alias("said"), grams().alias("gram")).groupBy("gram").agg(F.count_if(F.col("said") == "allow").alias("n_allow"), F.count_if(F.col("said") == "block").alias("n_block"))
    table = scratch.save(ratios(scratch.save(seen, "seen")), "ratios")
    found = scratch.save(scored(urls, table), "scored")
    fair = F.when((F.col("n_grams") > 0) & (F.col("total") >= threshold(found) * F.col("n_grams")), "allow").otherwise("block")
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", fair).alias("verdict"), F.coalesce("total", F.lit(0)).alias("ratio"), "n_grams")


def _oracle() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r), r))
    fits = "\n".join(f"    WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in rules)
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    levels = ""
    for k in range(ORDER + 1):
        before = f"p{k - 1}" if k else f"(SELECT gram, 1.0::DOUBLE / {SYMBOLS} AS pa, 1.0::DOUBLE / {SYMBOLS} AS pb FROM seen)"
        new = lambda c: f"CASE WHEN t_{c} > 0 THEN (c_{c} + k_{c} * p{c}) / (t_{c} + k_{c})::DOUBLE ELSE p{c} END AS p{c}"  # noqa: B023, E731
        levels += f"""
l{k} AS (SELECT substr(gram, {ORDER + 1 - k}, {k + 1}) AS tail, sum(na)::DOUBLE AS c_a, sum(nb)::DOUBLE AS c_b FROM seen GROUP BY ALL),
x{k} AS (SELECT substr(tail, 1, {k}) AS context, sum(c_a) AS t_a, sum(c_b) AS t_b, count(*) FILTER (c_a > 0)::DOUBLE AS k_a, count(*) FILTER (c_b > 0)::DOUBLE AS k_b FROM l{k} GROUP BY ALL),
p{k} AS (SELECT gram, {new('a')}, {new('b')} FROM {before} p JOIN l{k} ON substr(gram, {ORDER + 1 - k}, {k + 1}) = tail JOIN x{k} ON substr(tail, 1, {k}) = context),"""
    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parsed AS (SELECT page_id, row_number() OVER () AS row, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
ruled AS (SELECT *, CASE
{fits}
    END AS rule FROM parsed),
urls AS (SELECT *, CASE rule {said} END AS said, ('0x' || substr(md5(host || path), 1, 4))::INT % {HELD} = 0 AS held, '{START * ORDER}' || regexp_replace(translate(host || path, '{UPPER}', '{LOWER}'), '[^a-z0-9./\-_~]', '?', 'g') AS line FROM ruled),
grams AS (SELECT row, CASE WHEN NOT held THEN said END AS said, substr(line, i::INT, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(line) - {ORDER} + 1)) AS i FROM urls)),
seen AS (SELECT gram, count(*) FILTER (said = 'allow') AS na, count(*) FILTER (said = 'block') AS nb FROM grams GROUP BY ALL),{levels}
ratios AS (SELECT gram, floor(1e6::DOUBLE * (ln(pa) - ln(pb)) + 0.5)::BIGINT AS r FROM p{ORDER}),
sums AS (SELECT row, sum(r)::BIGINT AS total, count(*) AS n FROM grams JOIN ratios USING (gram) GROUP BY ALL),
scored AS (SELECT u.page_id, u.host, u.path, u.rule, u.said, u.held, s.total, coalesce(s.n, 0) AS n FROM urls u LEFT JOIN sums s USING (row)),
bins AS (SELECT greatest(least(floor((total::DOUBLE / n) / {BIN}), {BINS}), -{BINS})::BIGINT AS bin, count(*) FILTER (said = 'allow')::DOUBLE AS a, count(*) FILTER (said = 'block')::DOUBLE AS b
  FROM scored WHERE said IS NOT NULL AND held AND n > 0 GROUP BY ALL),
wrong AS (SELECT bin, coalesce(sum(a) OVER w, 0) / greatest(sum(a) OVER (), 1) + (sum(b) OVER () - coalesce(sum(b) OVER w, 0)) / greatest(sum(b) OVER (), 1) AS wrong
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce((SELECT bin * {BIN} FROM wrong WHERE wrong < 2 ORDER BY wrong, abs(bin), bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN n > 0 AND total >= least * n THEN 'allow' ELSE 'block' END) AS verdict, coalesce(total, 0)::BIGINT AS ratio, n::BIGINT AS n_grams FROM scored, best
"""


ORACLE = _oracle()
