"""Writers of series and of simulation input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import ORIGINAL, SeriesFrame, filled, valid


def written(s: SeriesFrame, method: str = "all") -> DataFrame:
    """What write_series() writes: all data, `filtered` data (only original points keep their value) or filled values, with
    the key if there is one."""
    if method not in ("all", "filtered", "filled"):
        raise ValueError(f"method is all, filtered or filled, not {method!r}")
    axis = [s.time] if s.single else [s.key, s.time]
    if method == "filled":
        return s.df.select(*axis, *[F.col(filled(c)).alias(c) for c in s.columns if filled(c) in s.df.columns])
    keep = lambda c: F.when(F.col(valid(c)) == ORIGINAL, F.col(c)).alias(c) if method == "filtered" and valid(c) in s.df.columns else F.col(c)
    return s.df.select(*axis, *map(keep, s.columns))


def write_series(s: SeriesFrame, path: str, method: str = "all", single_file: bool = False) -> None:
    """Tab-separated, by series and in order of time over the part files, or in a single one (small exports only)."""
    order = [s.key, s.time, s.seq]
    df = s.df.coalesce(1).sortWithinPartitions(*order) if single_file else s.df.orderBy(*order)
    df = written(s.with_df(df), method)
    df.write.option("sep", "\t").option("header", True).csv(path)


def to_west(s: SeriesFrame, names: dict[str, tuple[str, str]], time: str | None = None) -> DataFrame:
    """Simulation input as text columns: #t and the renamed ones, a row of units (ord 0) before the data (ord 1).
    names: raw column -> (new name, unit)."""
    data = s.df.select(F.lit(1).alias("ord"), F.col(time or s.time).cast("string").alias("#t"), *[F.col(c).cast("string").alias(n) for c, (n, _) in names.items()])
    units = s.df.sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit("#d").alias("#t"), *[F.lit(u).alias(n) for n, u in names.values()])
    return units.unionByName(data)


def west_lines(s: SeriesFrame, units: list[str], columns: list[str] | None = None, fillna: bool = True) -> DataFrame:
    """(ord, time, seq, value): the lines of a simulation input file. The first is the header with #.t for the time (ord 0),
    the second has the units (1), then the data follow (2)."""
    columns = columns or s.columns
    if len(units) != len(columns):
        raise ValueError("as many units as columns are needed")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)) if fillna else F.col(c)
    body = s.df.select(F.lit(2).alias("ord"), F.col(s.time).alias("time"), F.col(s.seq).alias("seq"), F.concat_ws("\t", F.col(s.time).cast("string"), *[F.coalesce(value(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    lines = ["\t".join(["#.t", *columns]), "\t".join(["#d", *units])]
    top = s.df.sparkSession.createDataFrame(list(enumerate(lines)), "ord int, value string").select("ord", F.lit(None).cast(s.df.schema[s.time].dataType).alias("time"), F.lit(None).cast(s.df.schema[s.seq].dataType).alias("seq"), "value")
    return top.unionByName(body)


def write_west(s: SeriesFrame, path: str, units: list[str], columns: list[str] | None = None, fillna: bool = True, single_file: bool = False) -> None:
    """Text whose first line is the header and whose second line has the units, in order of time over the part files,
    or in a single one (small exports only)."""
    lines = west_lines(s, units, columns, fillna)
    lines = lines.coalesce(1).sortWithinPartitions("ord", "time", "seq") if single_file else lines.orderBy("ord", "time", "seq")
    lines.select("value").write.text(path)


def log_removed(log_file: str, before: int, after: int, what: str) -> None:
    """Appends a line to a log on the driver."""
    from ..operators.report import removed_line

    with open(log_file, "a", encoding="utf-8") as f:
        f.write(removed_line(before, after, what) + "\n")
