"""Run and batch records: selection, repair, strikes and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = """timestamp string, input_file string, pdf_ripped string, llm_clean struct<model:string,words_before:bigint,words_after:bigint,changed:boolean>,
chunks array<struct<ordinal:bigint,wav:string,trailing_boundary:string,status:struct<status:string,original_text:string,reason:string>>>"""
LOG = "ts string, pdf string, event string, outcome string, mp3 string, reason string"
STRIKES = 2


def chunk_records(runs: DataFrame) -> DataFrame:
    """A row for each chunk of each run."""
    return runs.select("input_file", F.explode("chunks").alias("c")).select("input_file", "c.*")


def mergeable(chunks: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(Ok chunks whose file exists, those whose file is missing); files: (wav) of one run, or (input_file, wav)."""
    ok = chunks.where("status.status = 'Ok'")
    if files is None:
        return ok, None
    on = [c for c in ("input_file", "wav") if c in files.columns]
    return ok.join(files, on, "left_semi"), ok.join(files, on, "left_anti")


def to_retry(chunks: DataFrame) -> DataFrame:
    """Quarantined chunks and their text; failed ones are not retried."""
    return chunks.where("status.status = 'Quarantined'").withColumn("text", F.col("status.original_text"))


def repaired(chunks: DataFrame, fixed: DataFrame) -> DataFrame:
    """chunks with those of fixed (input_file, ordinal) that were quarantined made Ok."""
    ok = F.struct(F.lit("Ok").alias("status"), F.lit(None).cast("string").alias("original_text"), F.lit(None).cast("string").alias("reason"))
    hit = chunks.join(fixed.select("input_file", "ordinal", F.lit(True).alias("fixed")), ["input_file", "ordinal"], "left")
    return hit.withColumn("status", F.when(F.col("fixed") & (F.col("status.status") == "Quarantined"), ok).otherwise(F.col("status"))).drop("fixed")


def status_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("status.status").alias("status")).agg(F.count("*").alias("n"))


def strikes(log: DataFrame) -> DataFrame:
    """(pdf, strikes): starts without an end, for files with a start."""
    started, ended = F.count_if(F.col("event") == "start"), F.count_if(F.col("event").isin("complete", "fail"))
    return log.groupBy("pdf").agg(started.alias("s"), ended.alias("e")).where("s > 0").select("pdf", F.greatest(F.col("s") - F.col("e"), F.lit(0)).alias("strikes"))


def gated(jobs: DataFrame, log: DataFrame, most: int = STRIKES) -> DataFrame:
    """jobs (pdf) with poisoned: whether `most` strikes or more stand against the file."""
    return jobs.join(strikes(log), "pdf", "left").withColumn("poisoned", F.coalesce("strikes", F.lit(0)) >= most).drop("strikes")


def run_of(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Run records of docs (input_file, pdf_ripped, llm_clean) and their chunk records, in order."""
    each = F.struct(F.col("ordinal").cast("long").alias("ordinal"), "wav", "trailing_boundary", "status")
    own = chunks.groupBy("input_file").agg(F.array_sort(F.collect_list(each), lambda a, b: (a["ordinal"] - b["ordinal"]).cast("int")).alias("chunks"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return docs.join(own, "input_file", "left").select(now.alias("timestamp"), F.col("input_file").cast("string").alias("input_file"), "pdf_ripped", "llm_clean", "chunks")


def outcome(good: Column, bad: Column) -> Column:
    return F.when(good == 0, "Picturebook").when(bad == 0, "Clean").otherwise("Part")


def artifact_of(result: Column, stem: Column) -> Column:
    suffix = F.when(result == "Clean", ".mp3").when(result == "Part", "_part.mp3").when(result == "Picturebook", "_picturebook.txt")
    return F.concat(stem, suffix)


def event_of(result: Column) -> Column:
    """A picture book completes too; only a hard failure fails."""
    return F.when(result == "HardFail", "fail").otherwise("complete")


def outcomes(chunks: DataFrame, key: str = "input_file") -> DataFrame:
    """(key, good, bad, outcome, event, artifact) from chunk records."""
    good, bad = F.count_if(F.col("status.status") == "Ok"), F.count_if(F.col("status.status") != "Ok")
    counted = chunks.groupBy(key).agg(good.alias("good"), bad.alias("bad")).withColumn("outcome", outcome(F.col("good"), F.col("bad")))
    return counted.withColumn("event", event_of(F.col("outcome"))).withColumn("artifact", artifact_of(F.col("outcome"), F.col(key).cast("string")))
