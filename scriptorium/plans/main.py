"""The program: settings choose a mode, and a mode reads and writes the files that it is known by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import artifact
from scriptorium.operators import records, scoring
from scriptorium.plans import drivers
from scriptorium.plans.config import Config
from scriptorium.sources import files
from scriptorium.sources.scratch import dropped
from scriptorium.streaming.batch import run_batch

RECORDS, COMBINED = "run.json", "combined"


def _combined(spark: SparkSession, done: DataFrame, steps: drivers.Steps, cfg: Config) -> None:
    """Writes combined.wav, and combined.mp3 where it is asked for; what can't be merged or transcoded is said."""
    out = drivers.transcoded(done, steps, cfg)
    for what in ("error", "mp3_error"):
        for r in out.where(F.col(what).isNotNull()).select("doc_id", what).collect():
            print(f"warning: {r['doc_id']}: {r[what]}")
    for column, suffix in (("content", "wav"), ("mp3", "mp3")):
        files.export_files(out.where(F.col(column).isNotNull()).select(F.lit(f"{COMBINED}.{suffix}").alias("name"), F.col(column).alias("content")), cfg.out_dir)


def _numbered(ordinal, suffix: str):
    return F.regexp_replace(artifact(ordinal), "wav$", suffix)


def run_default(spark: SparkSession, cfg: Config, steps: drivers.Steps, rip: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """One text, or PDF, from input to combined audio; 1 if a chunk couldn't be spoken, as no quarantined one does."""
    if cfg.rip_pdf:
        if rip is None:
            raise ValueError("no parser for PDFs is given")
        pages = spark.read.format("binaryFile").load(cfg.rip_pdf).select(F.col("path").alias("doc_id"), "content")
        folder, _, name = cfg.input.rpartition("/")
        if not files.export_files(rip(pages).select(F.lit(name).alias("name"), F.col("text").cast("binary").alias("content")), folder or "."):
            raise ValueError(f"nothing is left of {cfg.rip_pdf}")
        if cfg.rip_pdf_only:
            return 0
    run = drivers.default_run(files.text_files(spark, cfg.input), steps, cfg)
    if run.chunks.isEmpty():
        raise ValueError(f"no usable chunks in {cfg.input} (min_chars={cfg.min_chars})")
    if cfg.llm_clean:
        files.write_cleaned(run.texts, cfg.input.rpartition("/")[0] or ".")
    docs = run.texts.select(F.col("doc_id").alias("input_file"), F.lit(cfg.rip_pdf).cast("string").alias("pdf_ripped"), "llm_clean")
    files.export_files(run.chunks.where("audio IS NOT NULL").select(F.col("wav").alias("name"), F.col("audio").alias("content")), cfg.out_dir)
    files.write_run_records(records.run_of(run.chunks, docs), f"{cfg.out_dir}/{RECORDS}")
    if run.attempts is not None:
        notes = scoring.sidecars(run.attempts)
        for column, suffix in (("transcription", "transcription.txt"), ("report", "bad.txt")):
            files.export_files(notes.where(F.col(column).isNotNull()).select(_numbered(F.col("id.ordinal"), suffix).alias("name"), F.col(column).cast("binary").alias("content")), cfg.out_dir)
    if cfg.merge:
        _combined(spark, run.merged, steps, cfg)
    return int(drivers.failed(run))


def _audio(spark: SparkSession, cfg: Config, chunks: DataFrame) -> DataFrame:
    """(input_file, wav, content) of the audio files of a run."""
    there = files.wav_files(spark, cfg.out_dir).select(F.regexp_extract("id", "([^/]*)$", 1).alias("wav"), "content")
    return chunks.select("input_file", "wav").join(there, "wav").select("input_file", "wav", "content")


def run_merge_only(spark: SparkSession, cfg: Config, steps: drivers.Steps) -> int:
    chunks = records.chunk_records(files.run_records(spark, f"{cfg.out_dir}/{RECORDS}"))
    done, missing = drivers.merge_only(chunks, _audio(spark, cfg, chunks), cfg)
    for r in missing.select("wav").collect():
        print(f"warning: {r['wav']} is missing")
    if done.isEmpty():
        raise ValueError("no audio to merge in the run's records")
    _combined(spark, done, steps, cfg)
    return 0


def run_fix_quarantine(spark: SparkSession, cfg: Config, steps: drivers.Steps) -> int:
    """Audio of what is recovered, and the records brought up to date; a report on it goes."""
    path = f"{cfg.out_dir}/{RECORDS}"
    runs = files.run_records(spark, path)
    fixed, sound = drivers.fix_quarantine(records.chunk_records(runs), steps, cfg)
    files.export_files(sound.select(F.col("wav").alias("name"), F.col("audio").alias("content")), cfg.out_dir)
    files.write_run_records(records.run_of(fixed, runs.select("input_file", "pdf_ripped", "llm_clean")), path)
    for r in sound.select(_numbered(F.col("ordinal"), "bad.txt").alias("name")).collect():
        files.remove(spark, f"{cfg.out_dir}/{r['name']}")
    return 0


def main(spark: SparkSession, cfg: Config, steps: drivers.Steps, rip: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Runs the mode of the settings: a batch before merging anew before repair before a default run. The exit code.

    rip: (doc_id, content) of PDFs -> (doc_id, text), by a caller's parser.
    """
    with dropped():
        if cfg.mode == "batch":
            run_batch(spark, cfg.batch_pdf, steps, cfg, rip)
            return 0
        if cfg.mode == "merge-only":
            return run_merge_only(spark, cfg, steps)
        if cfg.mode == "fix-quarantine":
            return run_fix_quarantine(spark, cfg, steps)
        return run_default(spark, cfg, steps, rip)
