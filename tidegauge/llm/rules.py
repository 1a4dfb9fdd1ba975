"""Quality rules by divergence of distributions, in DataFrame operations only.

A document's characters fall into classes, its words into the COMMON words that most documents of its language have,
and the rest. A language's reference is the mean of these two histograms over its documents, each weighing the same. A
document is rejected if one of its histograms is farther from its language's than a limit, by Jensen-Shannon distance
(the root of the divergence, in bits). Short texts are far from any reference by chance, so limits widen with one over
the number of words, the words of texts shorter than WORDS_FROM aren't judged, and neither are languages with fewer
than LEAST_DOCS documents that the base rules pass. The divergence is quadratic in what is mixed into a reference: a
group of copies that makes a third of a language's documents adds about 0.01 to the divergence of the others, well
within the limits.

Documents are measured once, row by row; only words' document counts (combined first) and two rows a language's worth
of sums are shuffled. Null texts have no words. Null languages are one language, and all of lang's values are taken as
they are. Texts of any length are read whole. Repeated rows and null ids are judged like others. Empty tables give
empty results; input columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, null_text

#: Words of a language's histogram, besides the rest.
COMMON = 16
#: Base rules: fewer words, or a greater share of words in repeated windows of three, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Classes of characters; what is left is the last class.
BLANK_CLASS, SYMBOL_CLASS = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", BLANK_CLASS, r"[.,;:!?'\"()-]", SYMBOL_CLASS, r"[^\x00-\x7F]")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Limits of the divergence in bits: a constant, and what is added over the number of words. The expected divergence of n
#: words of the reference itself is COMMON / (8 ln 2 n); twice that is added.
WORD_LIMIT, WORD_NOISE = 0.03, 2 * COMMON / (8 * math.log(2))
CLASS_LIMIT, CLASS_NOISE = 0.04, 4.0
WORDS_FROM, LEAST_DOCS = 80, 20


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated(w: Column) -> Column:
    """Words of array w that are in a window of three which is there twice or more. If no hash of a window is there twice,
    nothing is; else windows are put in order of their hashes, so that equal ones are neighbours, and their words compared."""
    same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda x, y: F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))
        at = _let(placed, lambda s: F.array_compact(F.transform(s, lambda x, j: F.when(near(x, F.get(s, j - 1)) | near(x, F.get(s, j + 1)), x["i"]))))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(at), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > 3, found).otherwise(0)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that an earlier line equals."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def characters(text: Column) -> Column:
    """Numbers of characters by class. The first class, most of a text, is taken out in runs, and the others are counted in
    what is left."""

    def counts(rest: Column) -> Column:
        one = F.array(F.length(text) - F.length(rest), *(F.length(rest) - F.length(F.regexp_replace(rest, f"{c}+", "")) for c in CLASSES[1:]))
        return _let(one, lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))

    return _let(F.regexp_replace(text, f"{CLASSES[0]}+", ""), counts)


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", n: int = COMMON) -> DataFrame:
    """(lang, common): the n words that most documents of a language have, ties in order of the words."""
    each = docs.select(F.col(f"`{lang}`").alias("lang"), F.explode(F.array_distinct(words(F.col(f"`{text}`")))).alias("word"))
    many = each.groupBy("lang", "word").agg(F.count("*").alias("docs"))
    top = many.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("docs"), "word"))).where(F.col("place") <= n)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("common"))


def measure(docs: DataFrame, common: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang) with the base rules' numbers and the two histograms, chars and picks."""
    given = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), null_text(f"`{text}`").alias("body"))
    longest = F.aggregate("common", F.lit(0), lambda a, x: F.greatest(a, F.octet_length(x))).alias("longest")  # longer words needn't be looked for
    given = given.join(common.select(F.col("lang").alias("l"), "common", longest), F.col("lang").eqNullSafe(F.col("l")), "left")
    body, listed = F.col("body"), F.coalesce("common", F.array().cast("array<string>"))

    def counts(w: Column) -> Column:
        places = F.filter(F.transform(F.filter(w, lambda x: F.octet_length(x) <= F.col("longest")), lambda x: F.array_position(listed, x)), lambda p: p > 0)
        picks = _let(places, lambda p: F.concat(F.transform(F.sequence(F.lit(1), F.lit(COMMON)), lambda k: F.size(F.filter(p, lambda x: x == k))), F.array(F.size(w) - F.size(p))))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).cast("long").alias("n_repeat_words"), picks.alias("picks"))

    blank, symbol = (F.get("chars", F.lit(CLASSES.index(c))) for c in (BLANK_CLASS, SYMBOL_CLASS))
    found = given.select("doc_id", "lang", _let(words(body), counts).alias("w"), characters(body).alias("chars"), F.length(body).alias("n"), repeated_lines(body).cast("long").alias("n_dup_lines"))
    return found.select("doc_id", "lang", "w.n_words", (F.col("n") - blank).cast("long").alias("word_chars"), symbol.cast("long").alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", "chars", "w.picks")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _shares(name: str, n: int) -> list[Column]:
    total = F.greatest(F.aggregate(F.col(name), F.lit(0), lambda a, x: a + x), F.lit(1))
    return [F.get(name, F.lit(i)) / total for i in range(n)]


def references(measured: DataFrame) -> DataFrame:
    """(lang, docs, typical_chars, typical_picks): a language's mean shares over its documents that the base rules pass."""
    chars, picks = _shares("chars", len(CLASSES) + 1), _shares("picks", COMMON + 1)
    return measured.where(~base_failed()).groupBy("lang").agg(F.count("*").alias("docs"), F.array(*map(F.avg, chars)).alias("typical_chars"), F.array(*map(F.avg, picks)).alias("typical_picks"))


def divergence(counts: Column, typical: Column) -> Column:
    """Jensen-Shannon, in bits, of counts' shares and typical ones."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    total = F.greatest(F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.lit(1))
    terms = lambda n: F.zip_with(counts, typical, lambda c, q: _let(c / n, lambda p: (part(p, q) + part(q, p)) / 2))
    return F.aggregate(_let(total, terms), F.lit(0.0), lambda a, x: a + x)


def judged(measured: DataFrame, typical: DataFrame) -> DataFrame:
    """measured with base_failed, its two distances, and kept."""
    both = measured.join(typical.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    both = both.withColumns({"base_failed": base_failed(), "class_distance": F.sqrt(F.greatest(divergence(F.col("chars"), F.col("typical_chars")), F.lit(0.0))), "word_distance": F.sqrt(F.greatest(divergence(F.col("picks"), F.col("typical_picks")), F.lit(0.0)))})
    far = F.col("class_distance") > F.sqrt(CLASS_LIMIT + CLASS_NOISE / F.col("n_words"))
    other = (F.col("n_words") >= WORDS_FROM) & (F.col("word_distance") > F.sqrt(WORD_LIMIT + WORD_NOISE / F.col("n_words")))
    wrong = (F.coalesce("docs", F.lit(0)) >= LEAST_DOCS) & F.coalesce(far | other, F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & ~wrong)


def judge(spark: SparkSession, docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """judged() for every row of docs, with references of docs themselves."""
    scratch = Scratch(spark, "rules")
    common = scratch.save(common_words(docs, text, lang), "common")
    measured = scratch.save(measure(docs, common, ident, text, lang), "measured")
    return judged(measured, scratch.save(references(measured), "references"))


def _oracle_classes(text: str) -> str:
    quoted = [c.replace("'", "''") for c in CLASSES]
    return ", ".join(f"len({text}) - len(regexp_replace({text}, '{c}', '', 'g'))" for c in quoted)


def _oracle_divergence(counts: str, typical: str) -> str:
    p = f"({counts}[i] / greatest(list_sum({counts}), 1))"
    q = f"{typical}[i]"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"list_sum([({part(p, q)} + {part(q, p)}) / 2 FOR i IN range(1, len({counts}) + 1)])"


#: The same for DuckDB.
ORACLE = rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
many AS (SELECT lang, word, count(*) AS docs FROM (SELECT lang, unnest(list_distinct(w)) AS word FROM base) GROUP BY ALL),
top AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY docs DESC, word) AS place FROM many QUALIFY place <= {COMMON}),
windows AS (SELECT r, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 3),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
found AS (SELECT r, place, count(*) AS n FROM (SELECT r, lang, unnest(w) AS word FROM base) b JOIN top t ON b.word = t.word AND b.lang IS NOT DISTINCT FROM t.lang GROUP BY ALL),
picked AS (SELECT b.r, [coalesce(list_sum([x.n FOR x IN f IF x.place = k]), 0) FOR k IN range(1, {COMMON} + 1)] AS p, len(w) AS n
  FROM base b LEFT JOIN (SELECT r, list({{'place': place, 'n': n}}) AS f FROM found GROUP BY r) USING (r)),
measured AS (SELECT r, doc_id, lang, len(w) AS n_words, len(translate(body, '{BLANKS}', '')) AS word_chars, len(body) - len(translate(body, '{SYMBOLS}', '')) AS n_symbols,
    len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, [{_oracle_classes('body')}] AS counted, len(body) AS long_, list_append(p, picked.n - coalesce(list_sum(p), 0)) AS picks
  FROM base JOIN picked USING (r) LEFT JOIN covered c USING (r)),
all_ AS (SELECT *, list_append(counted, long_ - list_sum(counted)) AS chars, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM measured),
typical AS (SELECT lang, count(*) AS docs, [{', '.join(f'avg(chars[{i + 1}] / greatest(list_sum(chars), 1))' for i in range(len(CLASSES) + 1))}] AS typical_chars,
    [{', '.join(f'avg(picks[{i + 1}] / greatest(list_sum(picks), 1))' for i in range(COMMON + 1))}] AS typical_picks FROM all_ WHERE NOT base_failed GROUP BY lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(docs, 0) >= {LEAST_DOCS} AND coalesce(
    sqrt(greatest({_oracle_divergence('chars', 'typical_chars')}, 0)) > sqrt({CLASS_LIMIT} + {CLASS_NOISE} / n_words)
    OR (n_words >= {WORDS_FROM} AND sqrt(greatest({_oracle_divergence('picks', 'typical_picks')}, 0)) > sqrt({WORD_LIMIT} + {WORD_NOISE} / n_words)), false)) AS kept
FROM all_ LEFT JOIN typical t ON all_.lang IS NOT DISTINCT FROM t.lang
"""
