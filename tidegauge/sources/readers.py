"""Text and CSV sources. Paths go through Spark's file systems."""

from __future__ import annotations

import csv
import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, LongType, StringType, StructField, StructType

#: Which names belong to a kind of file (fixed values).
KINDS = {"excel": ".xls", "text": ".txt", "csv": ".csv", "zrx": ".zrx"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, path: str, ext: str) -> list[str]:
    """Sorted paths of a folder's files of a kind: excel (.xls and .xlsx), text, csv or zrx."""
    if ext not in KINDS:
        raise ValueError(f"files are one of {sorted(KINDS)}, not {ext!r}")
    fs, p = _fs(spark, path)
    names = [f.getPath().toString() for f in fs.listStatus(p) if f.isFile()]
    hit = (lambda n: ".xls" in n) if ext == "excel" else (lambda n: n.endswith(KINDS[ext]))
    return sorted(n for n in names if hit(n.rpartition("/")[2]))


def _top(spark: SparkSession, path: str, comment: str, encoding: str = "UTF-8", sep: str = ",") -> tuple[list[str], str | None]:
    """A file's leading lines that begin with the comment character, and the record after them; reads no further. Of a
    folder, its first file's."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isDirectory():
        p = sorted((f.getPath() for f in fs.listStatus(p) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda x: x.toString())[0]
    io = spark.sparkContext._jvm.java.io
    stream = io.BufferedReader(io.InputStreamReader(fs.open(p), encoding))
    try:
        lines, line = [], stream.readLine()
        line = line and line.removeprefix("\ufeff")
        while line is not None and (not line or comment and line.startswith(comment)):
            lines += [line] if line else []
            line = stream.readLine()
        while line is not None and ends_inside(line, sep) and (more := stream.readLine()) is not None:
            line += "\n" + more
        return lines, line
    finally:
        stream.close()


def header_length(spark: SparkSession, path: str, comment: str = "#") -> int:
    """Leading lines that begin with the comment character; reads no further."""
    return len(_top(spark, path, comment)[0])


def ends_inside(line: str, sep: str, inside: bool = False) -> bool:
    """Whether a line's end is within a quoted value: one that begins with a quote and goes on to a single one. Quotes
    elsewhere are characters like others."""
    at = 0
    while True:
        if inside:
            if (q := line.find('"', at)) < 0:
                return True
            if line[q + 1 : q + 2] == '"':
                at = q + 2
                continue
            inside, at = False, q + 1
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        if (end := line.find(sep, at)) < 0:
            return False
        at = end + len(sep)


_PLACE = StructType([StructField("file", StringType()), StructField("block", LongType())])


def _states(lines: DataFrame, sep: str, encoding: str) -> DataFrame:
    """(file, block, inside): whether a split of a file begins within a quoted value. Each split is read from both states,
    lines with quotes alone, and has a row with what either leads to; a file's rows are put together in order."""

    def leads(batches):
        now, out = None, {}
        for b in batches:
            for file, block, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, block) != now:
                    now = (file, block)
                    out.setdefault(now, [False, True])
                if value is not None:
                    line = value.decode(encoding, "replace")
                    out[now] = [ends_inside(line, sep, x) for x in out[now]]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()), *(pa.array([v[i] for v in out.values()], pa.bool_()) for i in (0, 1))], names=["file", "block", "outer", "inner"])

    def chained(rows):
        rows, inside, begins = rows.sort_values("block"), False, []
        for outer, inner in zip(rows["outer"], rows["inner"]):
            begins.append(inside)
            inside = inner if inside else outer
        return rows[["file", "block"]].assign(inside=begins)

    quoted = lines.select("file", "block", F.when(F.contains("value", F.lit(b'"')), F.col("value")).alias("value"))
    some = quoted.where("value IS NOT NULL").unionAll(quoted.where("value IS NULL").distinct())
    each = some.mapInArrow(leads, StructType([*_PLACE, StructField("outer", BooleanType()), StructField("inner", BooleanType())]))
    each = each.groupBy("file", "block").agg(F.bool_or("outer").alias("outer"), F.bool_and("inner").alias("inner"))  # with lines without quotes
    return each.groupBy("file").applyInPandas(chained, StructType([*_PLACE, StructField("inside", BooleanType())]))


def records(spark: SparkSession, paths: list[str], sep: str = ",", comment: str = "#", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """(file, record): the records of delimited text files as text, line ends within quoted values included, without
    empty ones, leading comments and headers, which are known by their place in the file.

    Files are read in splits, line by line; a task puts the lines of quoted values together. Where files are large enough
    for several splits and have quotes, a first pass finds in which state each split begins, and what a split has of
    the record before is added to it.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    conf = lambda k: spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(k))
    least = min(conf("spark.sql.files.maxPartitionBytes"), conf("spark.sql.files.openCostInBytes"))
    begins = None
    if any(n > least for p in paths for n in _sizes(spark, p)):
        found = {(r.file, r.block) for r in _states(lines, sep, encoding).where("inside").collect()}  # a row for each record over two splits, at most
        begins = found or None

    def work(batches):
        now, held, inside, top, ours = None, None, False, False, True
        for b in batches:
            files, blocks, values = (b.column(i) for i in range(3))
            out, start = [], 0

            def put(kind, record):
                out.append((*now, kind, record))

            keys = list(zip(files.to_pylist(), blocks.to_pylist()))
            if now == keys[0] == keys[-1] and not inside and not top and not _any_quote(values) and (text := _utf8(values, encoding)) is not None:
                yield pa.RecordBatch.from_arrays([files, blocks, pa.nulls(b.num_rows, pa.int8()).fill_null(0), text], names=["file", "block", "kind", "record"])
                continue
            for key, value in zip(keys, values.to_pylist()):
                line = value.decode(encoding, "replace")
                if key != now:
                    if held is not None:
                        put(1 if ours else 2, held)
                    now, held, top, inside = key, None, key[1] == 0, begins is not None and key in begins
                    ours = not inside
                    line = line.removeprefix("\ufeff") if top else line
                    begun = header
                if top and not inside and held is None and (not line or comment and line.startswith(comment)):
                    continue
                held = line if held is None else f"{held}\n{line}"
                inside = ends_inside(line, sep, inside)
                if inside:
                    continue
                if not ours:
                    put(2, held)
                elif not (top and begun):
                    put(0, held)
                top, begun, held, ours = False, False, None, True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int8(), pa.string()))], names=["file", "block", "kind", "record"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, 1 if ours else 2, held), (pa.string(), pa.int64(), pa.int8(), pa.string()))], names=["file", "block", "kind", "record"])

    # kinds: 0 a record, 1 one that the split's end cuts, 2 what a split has of the one before
    pieces = lines.mapInArrow(work, StructType([*_PLACE, StructField("kind", ByteType()), StructField("record", StringType())]))
    whole = pieces if begins is None else pieces.where("kind = 0")
    whole = whole.select("file", "record")
    if begins is not None:
        w = Window.partitionBy("file").orderBy("block", F.desc("kind"))
        cut = pieces.where("kind > 0").withColumn("of", F.last(F.when(F.col("kind") == 1, F.col("block")), ignorenulls=True).over(w))
        parts = F.sort_array(F.collect_list(F.struct("block", "record")))
        whole = whole.unionAll(cut.groupBy("file", "of").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")).select("file", "record"))
    return whole.where("record != ''")


def _sizes(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    return [f.getLen() for f in fs.listStatus(p) if f.isFile()]


def _any_quote(values: pa.Array) -> bool:
    return bool(pc.any(pc.match_substring(values, '"')).as_py())


def _utf8(values: pa.Array, encoding: str) -> pa.Array | None:
    if encoding.upper().replace("_", "-") not in ("UTF-8", "US-ASCII", "ASCII"):
        return None
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return None


def read_text(spark: SparkSession, paths: str | list[str], ext: str = "text", sep: str = ",", comment: str = "#", encoding: str = "UTF-8", decimal: str = ".", schema: str | None = None, header: bool = True) -> DataFrame:
    """Text files are tab-separated whatever sep says. Short lines are filled up with nulls; lines with more values
    than the header are left out of CSV files, and cut off in text files. Leading lines that begin with the comment
    character and the header of each file are skipped, later ones like them are data. Quoted values may hold separators,
    doubled quotes and line ends, of whatever kind, which become line feeds; a byte-order mark is no part of the first name.
    Without a schema all columns are text: give one, or cast, rather than pay for a second reading. A decimal comma
    becomes a point. All paths have the first one's header. UTF-16 and UTF-32, whose line ends aren't bytes, are read by
    file, not by split, and all lines that begin with a comment character are skipped then, if the first one does."""
    return _typed(_read(spark, paths, ext, sep, comment, encoding, decimal, header), schema)


def _read(spark: SparkSession, paths: str | list[str], ext: str, sep: str, comment: str, encoding: str, decimal: str, header: bool = True, file: str | None = None) -> DataFrame:
    if ext not in ("text", "csv", "zrx"):
        raise ValueError(f"text, csv or zrx, not {ext!r}")
    some = [paths] if isinstance(paths, str) else list(paths)
    sep = "\t" if ext in ("text", "zrx") else sep
    lead, line = _top(spark, some[0], comment[:1], encoding, sep)
    first = next(csv.reader((line or "").splitlines(keepends=True), delimiter=sep), [""])
    names = unlike([n or f"_c{i}" for i, n in enumerate(first)] if header else [f"_c{i}" for i in range(len(first))])
    fields = StructType([StructField(n, StringType()) for n in (*names, "__more")])
    options = {"sep": sep, "mode": "PERMISSIVE", "escape": '"', "maxCharsPerColumn": "-1"}
    if re.match(r"utf[-_]?(16|32)", encoding.lower()):
        df = spark.read.options(**options, encoding=encoding, header=header, multiLine=True, **({"comment": comment[:1]} if lead else {})).schema(fields).csv(some)
        df = df.withColumn(file, F.input_file_name()) if file else df
    else:
        ddl = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in fields.names)
        found = records(spark, some, sep, comment[:1], encoding, header)
        df = found.select(F.from_csv("record", ddl, options).alias("__v"), *([F.col("file").alias(file)] if file else [])).select("__v.*", *([file] if file else []))
    df = (df.where(F.col("__more").isNull()) if ext == "csv" else df).drop("__more")
    if decimal != ".":
        df = df.withColumns({c: F.when(F.col(f"`{c}`").rlike(rf"^\s*[-+]?\d*{re.escape(decimal)}?\d+\s*$"), F.replace(F.col(f"`{c}`"), F.lit(decimal), F.lit("."))).otherwise(F.col(f"`{c}`")) for c in names})
    return df


def _typed(df: DataFrame, schema: str | None) -> DataFrame:
    return df if not schema else df.select(*[F.col(f"`{have}`").try_cast(f.dataType).alias(f.name) for have, f in zip(df.columns, StructType.fromDDL(schema))])


def unlike(names: list[str]) -> list[str]:
    """Names that stand twice get their place after them, as do those that differ in case alone."""
    low = [n.lower() for n in names]
    return [n if low.count(x) == 1 else f"{n}{i}" for i, (n, x) in enumerate(zip(names, low))]


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    raise NotImplementedError("MATLAB files are not supported")


def join_files(spark: SparkSession, paths: list[str], ext: str = "text", sep: str = ",", comment: str = "#", encoding: str = "UTF-8", decimal: str = ".") -> DataFrame:
    """All files under each other in order of their names; columns by name, those a file lacks are null. Files of
    one header are read together, and the driver reads no more than the header of each. source_file and source_line
    keep the order."""
    heads: dict[str | None, list[str]] = {}
    for p in sorted(paths):
        heads.setdefault(_top(spark, p, comment[:1], encoding, "\t" if ext in ("text", "zrx") else sep)[1], []).append(p)
    parts = [_read(spark, some, ext, sep, comment, encoding, decimal, file="source_file") for some in heads.values()]
    parts = [p.withColumns({"source_file": F.url_decode(F.element_at(F.split("source_file", "/"), -1)), "source_line": F.monotonically_increasing_id()}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def remove_empty_lines(source: DataFrame | str, ext: str | None = None, to: str | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Without rows that miss any value: of a table, or of all tab-separated files of a kind in folder `source`, each
    written to a folder of its name below `to`."""
    if isinstance(source, DataFrame):
        return source.na.drop(how="any")
    if not (ext and to and spark):
        raise ValueError("files need a kind, a folder to write to and a session")
    for path in list_files(spark, source, ext):
        whole = read_text(spark, path, "text").na.drop(how="any")
        whole.write.option("sep", "\t").option("header", True).csv(f"{to.rstrip('/')}/{path.rpartition('/')[2]}")
    return None


def find_and_replace(spark: SparkSession, path: str, to: str, replace: tuple[str, str]) -> None:
    """Literal replacement in the lines of text files, written to a new folder."""
    spark.read.text(path).select(F.replace("value", F.lit(replace[0]), F.lit(replace[1])).alias("value")).write.text(to)


def read_model_output(spark: SparkSession, path: str, time: str = "#.t") -> DataFrame:
    """Tab-separated model output: the line of units below the header is dropped and all columns are numbers."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    # units are no numbers; of the time column this holds for the units' line alone
    t = F.col(f"`{time}`").try_cast("double")
    return df.where(t.isNotNull()).select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns])
