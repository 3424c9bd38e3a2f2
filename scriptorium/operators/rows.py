"""Row functions in Python, by Arrow batches: columns that pass through keep their type and nulls."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MOST, BYTES = 10_000, 1 << 25  # rows and bytes of a batch that goes back, about
TEXTS = 1_000  # whole texts in a batch that goes to Python


@contextmanager
def small_batches(spark: SparkSession, most: int = TEXTS) -> Iterator[None]:
    """What is computed inside, not just planned, sends rows to Python in batches of `most` at most: a batch stands in the executor's and the worker's memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run; after its last batch the free memory of the process goes back, as a worker that waits for another task else keeps it beside those at work."""

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, TypeError, AttributeError):  # of glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return freeing


def flat_mapped(df: DataFrame, keep: list[str], use: list[str], out: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """For each row the rows (keep.., out..) that make()(use..) yields; make is called once a task.

    The columns of keep are taken by Arrow as they are, so that no whole number beside a null becomes a float.
    """
    added = StructType.fromDDL(out)
    kept = StructType([df.schema[c] for c in keep])
    schema = StructType([*kept.fields, *added.fields])
    types = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            held = [batch.column(batch.schema.get_field_index(c)) for c in use]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            at: list[int] = []
            made: list[tuple] = []
            size = 0

            def batch_of(at: list[int], made: list[tuple], own: list = own) -> pa.RecordBatch:
                cols = list(zip(*made, strict=True)) if made else [[]] * len(types)
                return pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in own], *[pa.array(v, t.type) for v, t in zip(cols, types, strict=True)]], names=schema.names)

            for i in range(batch.num_rows):
                for row in f(*[c[i].as_py() for c in held]):
                    at.append(i)
                    made.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                    if len(made) >= MOST or size >= BYTES:
                        yield batch_of(at, made)
                        at, made, size = [], [], 0
            yield batch_of(at, made)

    return df.select(*dict.fromkeys([*keep, *use])).mapInArrow(freed(run), schema)
