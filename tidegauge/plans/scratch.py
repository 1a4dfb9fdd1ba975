"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local session without one (tests) a temporary folder."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidegauge-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_all: list[Scratch] = []


@contextlib.contextmanager
def released():
    """Drops the tables that are made within, at the end: for a result that has been written by then."""
    first = len(_all)
    try:
        yield
    finally:
        while len(_all) > first:
            _all.pop().drop()


class Scratch:
    """Parquet tables in the shared folder.

    drop() deletes a table that no later plan reads, released() all those of a block; what is left goes when the
    driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.top = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)
        _all.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            if self.spark.sparkContext._jsc is not None:
                self.drop()
