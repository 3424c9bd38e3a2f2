"""Tables written once to the folder that all executors share, so that later steps neither recompute them nor lose them with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where the session names none, a new temporary one if it runs on one machine (tests), else an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


class Scratch:
    """Tables written to a new folder of the shared one, and dropped when no longer read."""

    #: Those not yet dropped.
    held: list[Scratch] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.n = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4()}", 0
        Scratch.held.append(self)

    def __call__(self, df: DataFrame) -> DataFrame:
        """df computed once and kept, with its lineage cut."""
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """All tables go; what was made of them must be kept elsewhere by now."""
        remove(self.spark, self.top)
        if self in Scratch.held:
            Scratch.held.remove(self)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropped(*kept: Scratch) -> Iterator[None]:
    """Every table made inside and still held goes at the end: for callers who have written by then what they made of them."""
    before = list(Scratch.held)
    try:
        yield
    finally:
        for one in [x for x in Scratch.held if x not in before and x not in kept]:
            one.drop()
