"""Sources and sinks: text, inbox listings, run records, batch logs, WAV files and configuration."""

from __future__ import annotations

import tomllib
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import stem
from scriptorium.operators.records import LOG, RUN
from scriptorium.operators.rows import flat_mapped
from scriptorium.sources.scratch import remove


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id: the file's path, text: the whole file)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, kind) of PDF and text files, by path; contents are not read."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    listed = spark.read.format("binaryFile").load(path).select("path").withColumn("kind", kind)
    return listed.where(F.col("kind").isin("pdf", "txt")).select("path", stem(F.col("path")).alias("stem"), "kind").orderBy("path")


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select(F.col("path").alias("id"), "content")


def pdf_words(spark: SparkSession, path: str, load: Callable[[], Callable[[bytes], Iterable[tuple]]]) -> DataFrame:
    """Positioned words of the PDFs under path, by a caller's parser: its callable, made once a task, yields for a file's bytes
    (page_no, page_width, word_idx, text, x0, x1, top, bottom) of each word."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select(F.col("path").alias("doc_id"), "content")
    return flat_mapped(files, ["doc_id"], ["content"], "page_no int, page_width double, word_idx int, text string, x0 double, x1 double, top double, bottom double", load)


def run_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).option("multiLine", True).json(path)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or folder; whatever stood at new goes only once the other is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = f"{new}.old-{uuid.uuid4()}"
    had = fs.exists(path(new)) and fs.rename(path(new), path(aside))
    fs.mkdirs(path(new).getParent())
    if not fs.rename(path(old), path(new)):
        raise OSError(f"can't move {old} to {new}")
    if had:
        fs.delete(path(aside), True)


def write_run_records(runs: DataFrame, path: str) -> None:
    """Replaces the records: the new ones are written beside the old, which go only when those are complete; runs may read path itself."""
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4()}"
    runs.write.option("ignoreNullFields", False).json(beside)
    renamed(runs.sparkSession, beside, path)


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of the log; malformed lines are skipped, a log that isn't there is empty."""
    try:
        return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def clear_log(spark: SparkSession, path: str) -> None:
    remove(spark, path)


def export_files(contents: DataFrame, folder: str) -> int:
    """Writes contents (name, content: binary) as files of those names, one at a time; how many."""
    spark, n = contents.sparkSession, 0
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in contents.select("name", "content").toLocalIterator():
        out = fs.create(path(f"{folder.rstrip('/')}/{row['name']}"), True)
        try:
            out.write(bytearray(row["content"]))
        finally:
            out.close()
        n += 1
    return n


def write_cleaned(texts: DataFrame, folder: str) -> int:
    """Texts (doc_id: a path, text) as <stem>_cleaned.txt in a folder; how many."""
    name = F.concat(stem(F.col("doc_id").cast("string")), F.lit("_cleaned.txt"))
    return export_files(texts.select(name.alias("name"), F.col("text").cast("binary").alias("content")), folder)


def lexicon_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a dictionary file; read whole, so that lines keep their order."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def load_config(*paths: str) -> dict:
    """The first of the files that there is and that parses; else nothing."""
    for p in paths:
        if Path(p).is_file():
            try:
                return tomllib.loads(Path(p).read_text())
            except tomllib.TOMLDecodeError as e:
                print(f"warning: {p}: {e}")
    return {}


def coalesced(*values: object) -> object:
    return next((v for v in values if v is not None), None)
