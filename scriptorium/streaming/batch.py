"""Batches of an inbox: what lies there, file by file, with a strike gate, a log and routing; and a file stream that starts them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import stem
from scriptorium.operators.records import LOG, STRIKES, strikes
from scriptorium.plans.config import Config
from scriptorium.plans.drivers import Steps, default_run, job_outcomes, transcoded
from scriptorium.sources.files import append_log, batch_log, clear_log, export_files, inbox, renamed
from scriptorium.sources.scratch import dropped

#: The folders of a batch, and how the log names outcomes.
IN, DONE, ERRORED, TEXTS, AUDIO, LOGGED = "in", "pdf_completed", "pdf_errored", "text_completed", "audio", "batch.log"
OUTCOMES = {"Clean": "ok", "Part": "part", "Picturebook": "picturebook"}


def _escaped(name: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def _docs(spark: SparkSession, folder: str, names: list[str], rip: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(doc_id: the file's name, text) of the files of the inbox; rip turns files (doc_id, content) of PDFs into texts."""
    files = spark.read.format("binaryFile").load([f"{folder}/{_escaped(n)}" for n in names]).select(F.regexp_extract("path", "([^/]*)$", 1).alias("doc_id"), "content")
    pdf = F.lower("doc_id").endswith(".pdf")
    texts = files.where(~pdf).select("doc_id", F.col("content").cast("string").alias("text"))
    if all(not n.lower().endswith(".pdf") for n in names):
        return texts
    if rip is None:
        raise ValueError("no parser for PDFs is given")
    return texts.unionByName(rip(files.where(pdf)).select("doc_id", "text"))


def run_batch(spark: SparkSession, root: str, steps: Steps, cfg: Config, rip: Callable[[DataFrame], DataFrame] | None = None, group: int = 1, names: list[str] | None = None) -> None:
    """All files now in root/in, by name, `group` of them a job; names: only these.

    A file with two dangling starts is logged as failed and moved away unread. A job's files are logged as started when
    the job begins and as ended after it, and then moved, so that a crash leaves strikes against that job's files only; with
    a group of one, against the file that crashed. An error of a job is a failure of its files. When all is done, the
    log goes. The log holds files by their names, artifacts are named by stems.
    """
    log, folder = f"{root}/{LOGGED}", f"{root}/{IN}"
    against = {r["pdf"]: r["strikes"] for r in strikes(batch_log(spark, log)).collect()}
    # a listing of names, as routing moves files one by one
    found = [r["path"].rsplit("/", 1)[-1] for r in inbox(spark, folder).collect()]
    jobs = [n for n in found if names is None or n in names]

    def note(rows: list[tuple]) -> None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        append_log(spark.createDataFrame([(None, *r) for r in rows], LOG).withColumn("ts", now), log)

    struck = [n for n in jobs if against.get(n, 0) >= STRIKES]
    for n in struck:
        renamed(spark, f"{folder}/{n}", f"{root}/{ERRORED}/{n}")
        note([(n, "fail", None, None, f"{against[n]} interrupted attempts")])
    left = [n for n in jobs if n not in struck]
    for some in (left[k : k + group] for k in range(0, len(left), group)):
        note([(n, "start", None, None, None) for n in some])
        with dropped():
            try:
                run = default_run(_docs(spark, folder, some, rip), steps, cfg)
                named = stem(F.col("doc_id"))
                export_files(run.texts.select(F.concat(named, F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), f"{root}/{TEXTS}")
                ends = job_outcomes(run, named).select("doc_id", "outcome", "artifact", "marker")
                sound = transcoded(run.merged, steps, cfg).withColumn("content", F.coalesce("mp3", "content")).select("doc_id", "content").join(ends, "doc_id").where("content IS NOT NULL")
                export_files(sound.select(F.col("artifact").alias("name"), "content"), f"{root}/{AUDIO}")
                export_files(ends.where("marker IS NOT NULL").select(F.col("artifact").alias("name"), F.col("marker").cast("binary").alias("content")), f"{root}/{AUDIO}")
                rows = [(r["doc_id"], "complete", OUTCOMES[r["outcome"]], r["artifact"], None) for r in ends.collect()]
            except Exception as e:  # the job's failure, not the batch's
                rows = [(n, "fail", None, None, f"{type(e).__name__}: {e}"[:500]) for n in some]
        for n, event, *_ in rows:
            renamed(spark, f"{folder}/{n}", f"{root}/{DONE if event == 'complete' else ERRORED}/{n}")
        note(rows)
    clear_log(spark, log)


def watch(spark: SparkSession, root: str, checkpoint: str, steps: Steps, cfg: Config, rip: Callable[[DataFrame], DataFrame] | None = None, group: int = 1):
    """A stream over the inbox that runs a batch for the files of each arrival; a name that comes again is not run again."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{txt,pdf,TXT,PDF}").load(f"{root}/{IN}")

    def one(batch: DataFrame, _: int) -> None:
        names = [r["n"] for r in batch.select(F.regexp_extract("path", "([^/]*)$", 1).alias("n")).distinct().collect()]
        if names:
            run_batch(spark, root, steps, cfg, rip, group, names)

    return arrived.select("path").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
