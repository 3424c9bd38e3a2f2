"""What several of these operators share: words, table reads, and cutting of lineage."""

from __future__ import annotations

import string
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.rows import flat_mapped, freed, small_batches
from scriptorium.sources.scratch import Scratch, dropped, remove, shared_folder

__all__ = ["Scratch", "cut", "dropped", "first_by_hash", "flat_mapped", "folded", "freed", "remove", "shared_folder", "small_batches", "table", "word_count", "words"]

#: White space of a word boundary: space, tab, newline, vertical tab, form feed, carriage return.
BREAKS = "\t\n\x0b\x0c\r"
NOT_WORD = r"\x20\x09-\x0D"
_FOLD = (string.ascii_uppercase + BREAKS, string.ascii_lowercase + " " * len(BREAKS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(text: Column) -> Column:
    """A-Z lower-cased, every kind of white space one space, nothing else changed; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), *_FOLD)


def words(text: Column) -> Column:
    """The text's lower-cased words, in order."""
    return F.array_remove(F.split(folded(text), " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{NOT_WORD}]++")), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: later steps neither recompute it nor lose it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def first_by_hash(rows: DataFrame, n: int, *cols: str) -> DataFrame:
    """Of distinct rows the n that come first by a hash of the columns, all if there are fewer: the same however rows are dealt.

    Rows that can't be among them, by their count and six standard deviations, are left out first, so that not every
    task sends n rows to the one that picks.
    """
    count = rows.count()
    u = F.shiftrightunsigned(F.xxhash64(*cols), 32)
    if count > n:
        rows = rows.where(u < int((n + 6 * sqrt(n) + 20) / count * 2**32))
    return rows.orderBy(u, *cols).limit(n)
