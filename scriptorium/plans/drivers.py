"""The program's modes, composed of the operators: a default run, merging anew, repairing what was quarantined, and the job of a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import artifact, sanitize_changed, sanitized, terminated
from scriptorium.operators import audio, chunking, layout, models, records, scoring
from scriptorium.plans.config import Config
from scriptorium.sources.scratch import Scratch

CLEANED = "struct<model:string,words_before:bigint,words_after:bigint,changed:boolean>"


@dataclass(frozen=True)
class Steps:
    """What the program's servers do, as callables that are made once a task: rewriting, speech, hearing, transcoding."""

    speak: Callable[[], Callable[[str], bytes]]
    rewrite: Callable[[], Callable[[str], str]] | None = None
    transcribe: Callable[[], Callable[[bytes], str]] | None = None
    transcode: Callable[[], Callable[[bytes], bytes]] | None = None
    lexicon: DataFrame | None = None
    model: str = "rewriter"


@dataclass(frozen=True)
class Run:
    """texts (doc_id, text, llm_clean); chunks: chunk records of (input_file, ordinal), with text and audio; merged (doc_id, content, error);
    attempts: of validated runs, with id (doc_id, ordinal)."""

    texts: DataFrame
    chunks: DataFrame
    merged: DataFrame
    attempts: DataFrame | None = None


def _status(name: str, text: object = None, reason: object = None):
    null = F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("status"), (null if text is None else text).alias("original_text"), (null if reason is None else reason).alias("reason"))


def ripped(words: DataFrame, cfg: Config) -> DataFrame:
    """(doc_id, text) of positioned words of pages."""
    return layout.paragraph_text(layout.rip(words, cfg.skip_refs, cfg.skip_captions, cfg.span_mode))


def prepared(docs: DataFrame, steps: Steps, cfg: Config) -> DataFrame:
    """(doc_id, text, llm_clean): the texts as they are to be spoken. A document of which nothing is left has an empty text."""
    if not cfg.llm_clean:
        return docs.select("doc_id", "text", F.lit(None).cast(CLEANED).alias("llm_clean"))
    done = models.clean_text(docs, steps.rewrite, cfg.min_chars)
    record = F.struct(F.lit(steps.model).alias("model"), F.coalesce("words_before", F.lit(0)).alias("words_before"), F.coalesce("words_after", F.lit(0)).alias("words_after"), F.coalesce("changed", F.lit(False)).alias("changed"))
    return docs.select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), record.cast(CLEANED).alias("llm_clean"))


def spoken(chunks: DataFrame, steps: Steps, cfg: Config) -> tuple[DataFrame, DataFrame | None]:
    """(id, audio, status) of chunks (id, text), validated where the settings ask for it; and then the attempts."""
    if cfg.validate:
        tries = scoring.attempted(chunks, lambda d: models.speak(d, steps.speak), lambda d: models.transcribe(d, steps.transcribe), steps.lexicon, cfg.validate_threshold)
        out = scoring.verdicts(tries)
        status = F.when(F.col("status") == "Ok", _status("Ok")).when(F.col("status") == "Failed", _status("Failed", reason=F.col("error"))).otherwise(_status("Quarantined", F.col("original")))
        return out.select("id", F.when(F.col("status") == "Ok", F.col("wav")).alias("audio"), status.alias("status")), tries
    said = models.speak(chunks.select("id", terminated(F.col("text")).alias("text")), steps.speak)
    return said.select("id", F.col("wav").alias("audio"), F.when(F.col("wav").isNotNull(), _status("Ok")).otherwise(_status("Failed", reason=F.col("error"))).alias("status")), None


def merged(chunks: DataFrame, cfg: Config) -> DataFrame:
    """(doc_id, content, error) of the Ok chunks (input_file, ordinal, trailing_boundary, status, audio)."""
    ok, _ = records.mergeable(chunks)
    return audio.merge(ok.select(F.col("input_file").alias("doc_id"), "ordinal", "trailing_boundary", F.col("audio").alias("content")), cfg.paragraph_gap_ms, cfg.sentence_gap_ms)


def transcoded(done: DataFrame, steps: Steps, cfg: Config) -> DataFrame:
    """merged files (doc_id, content, error) with mp3 and mp3_error, where the settings and a caller's command give one."""
    if not (cfg.to_mp3 and steps.transcode):
        return done.withColumns({"mp3": F.lit(None).cast("binary"), "mp3_error": F.lit(None).cast("string")})
    made = models.mapped(done.where("content IS NOT NULL").select("doc_id", "content"), steps.transcode, "content", "mp3", "binary").select("doc_id", "mp3", F.col("error").alias("mp3_error"))
    return done.join(made, "doc_id", "left")


def default_run(docs: DataFrame, steps: Steps, cfg: Config) -> Run:
    """A run over texts (doc_id, text): cleaned, chunked, spoken, validated, merged. Speech is written once to the shared folder."""
    keep = Scratch(docs.sparkSession)
    texts = keep(prepared(docs, steps, cfg))
    made = chunking.chunks(texts, cfg.min_chars, cfg.max_words)
    if cfg.validate:
        made = keep(made)
        out, tries = spoken(made.select(F.struct("doc_id", "ordinal").alias("id"), "text"), steps, cfg)
        each = made.join(keep(out.select("id.*", "audio", "status")), ["doc_id", "ordinal"])
    else:  # a chunk is spoken where it is cut, and its other columns pass through
        out, tries = spoken(made.select(F.struct(*made.columns).alias("id"), "text"), steps, cfg)
        each = keep(out.select("id.*", "audio", "status"))
    wav = artifact(F.col("ordinal"))
    chunks = each.select(F.col("doc_id").alias("input_file"), "ordinal", wav.alias("wav"), "trailing_boundary", "status", "text", "audio")
    nothing = chunks.limit(0).select(F.col("input_file").alias("doc_id"), F.col("audio").alias("content"), F.lit(None).cast("string").alias("error"))
    return Run(texts, chunks, merged(chunks, cfg) if cfg.merge else nothing, tries)


def failed(run: Run) -> bool:
    """Whether the program would end in an error: a chunk that couldn't be spoken, not one that is quarantined."""
    return not run.chunks.where("status.status = 'Failed'").isEmpty()


def merge_only(chunks: DataFrame, files: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(merged (doc_id, content, error), chunk records whose file is missing) from chunk records and files (input_file, wav, content)."""
    _, missing = records.mergeable(chunks, files.select("input_file", "wav"))
    there, _ = records.mergeable(chunks)  # whether the file is there, the join with it tells
    parts = there.select("input_file", "ordinal", "wav", "trailing_boundary").join(files.select("input_file", "wav", "content"), ["input_file", "wav"])
    return audio.merge(parts.withColumnRenamed("input_file", "doc_id"), cfg.paragraph_gap_ms, cfg.sentence_gap_ms), missing


def fix_quarantine(chunks: DataFrame, steps: Steps, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(chunk records with those recovered made Ok, the recovered audio (input_file, ordinal, wav, audio)).

    What was quarantined is spoken anew from its sanitised text where that differs, and held against that text. What
    failed otherwise is left alone. Other columns of chunks stay.
    """
    keep = Scratch(chunks.sparkSession)
    again = records.to_retry(chunks).where("text IS NOT NULL")
    text = F.when(sanitize_changed(F.col("text")), sanitized(F.col("text"))).otherwise(F.col("text"))
    out, _ = spoken(again.select(F.struct("input_file", "ordinal").alias("id"), text.alias("text")), steps, cfg)
    said = keep(out.where("status.status = 'Ok'").select("id.*", "audio"))
    return records.repaired(chunks, said), said.withColumn("wav", artifact(F.col("ordinal")))


def job_outcomes(run: Run, stem: Column | None = None) -> DataFrame:
    """(doc_id, good, failed, quarantined, outcome, artifact, marker) of every document of a run, also those without chunks.

    marker: the text that stands for the audio of a picture book that had chunks. stem: of a document's artifacts, else its id.
    """
    count = lambda s: F.count_if(F.col("status.status") == s)
    counted = run.chunks.groupBy(F.col("input_file").alias("doc_id")).agg(count("Ok").alias("good"), count("Failed").alias("failed"), count("Quarantined").alias("quarantined"))
    every = run.texts.select("doc_id").join(counted, "doc_id", "left").fillna(0, ["good", "failed", "quarantined"])
    found = every.withColumn("outcome", records.outcome(F.col("good"), F.col("failed") + F.col("quarantined")))
    stem = F.col("doc_id").cast("string") if stem is None else stem
    total = F.col("good") + F.col("failed") + F.col("quarantined")
    marker = F.format_string("no audio produced for %s\nchunks=%d, failed=%d, quarantined=%d\n", stem, total, "failed", "quarantined")
    return found.withColumn("artifact", records.artifact_of(F.col("outcome"), stem)).withColumn("marker", F.when((F.col("outcome") == "Picturebook") & (total > 0), marker))
