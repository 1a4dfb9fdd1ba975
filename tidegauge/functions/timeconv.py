"""Time conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
_SECONDS = {"sec": 1, "s": 1, "min": 60, "hr": 3600, "h": 3600, "d": 86_400, "D": 86_400}


def per_unit(unit: str) -> int:
    """Seconds in a unit."""
    if unit not in _SECONDS:
        raise ValueError(f"unknown time unit {unit!r}; one of {sorted(_SECONDS)}")
    return _SECONDS[unit]


def micros_of_day(t: Column) -> Column:
    return F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(DAY))


def month_days(spark: SparkSession) -> DataFrame:
    """(month, day) of a year without a leap day, in order of n = 0..364."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int"))
    return spark.range(365).select(F.col("id").alias("n"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))


def days_from_windows_serial(serial: Column, exact: bool = False) -> Column:
    """A Windows date serial (days since the end of 1899) as a time stamp of whole seconds.

    exact: by the calendar. Otherwise by years of 365.25 days and the day of a year without a leap day, as old tools
    did; a day number past the year's end is its last day.
    """
    s = serial.cast("double")
    start = lambda text: F.lit(text).cast("timestamp_ntz")
    if exact:
        return F.timestamp_micros(F.unix_micros(start("1899-12-30 00:00:00").cast("timestamp")) + F.floor(s * 86_400) * 1_000_000).cast("timestamp_ntz")
    year = F.floor(s / 365.25)
    number = F.least(F.floor(s - year * 365.25), F.lit(364)).cast("int")
    seconds = F.floor((s - F.floor(s)) * 86_400)
    day = F.date_add(F.lit("2023-01-01").cast("date"), number)
    date = F.make_timestamp_ntz((F.lit(1900) + year).cast("int"), F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + seconds * 1_000_000).cast("timestamp_ntz")


def elapsed(micros: Column, unit: str) -> Column:
    """A difference in microseconds in whole seconds, as a fraction of the unit."""
    return F.floor(micros / 1e6) / per_unit(unit)


def total_seconds(micros: Column) -> Column:
    return micros / 1e6


def parse_short(text: Column) -> Column:
    """dd-mm-yy hh:mm with anything after it ignored; the century is 20xx."""
    return F.try_to_timestamp(F.concat(F.substring(text, 1, 6), F.lit("20"), F.substring(text, 7, 8)), F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz")


# strptime directives and their pattern letters (fixed values).
_PATTERNS = {"%d": "dd", "%m": "MM", "%y": "yy", "%Y": "yyyy", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%p": "a", "%I": "hh"}


def pattern(strptime: str) -> str:
    """A strptime format as a pattern of Spark's."""
    out, i = "", 0
    while i < len(strptime):
        two = strptime[i : i + 2]
        if strptime[i] == "%":
            if two not in _PATTERNS:
                raise ValueError(f"unknown directive {two} in the time format {strptime!r}")
            out, i = out + _PATTERNS[two], i + 2
        else:
            out, i = out + (f"'{strptime[i]}'" if strptime[i].isalpha() else strptime[i]), i + 1
    return out
