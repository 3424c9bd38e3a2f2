"""Steps that call a caller's model: rewriting, speech and transcription. Any callable of the given shape will do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import is_drop, think_stripped, trimmed, word_count
from scriptorium.operators.audio import write_header
from scriptorium.operators.chunking import paragraphs
from scriptorium.operators.rows import flat_mapped


def mapped(df: DataFrame, load: Callable[[], Callable], col: str, out: str, kind: str) -> DataFrame:
    """df with column out: load's callable, made once a task, over col; and error: what a failed call raised, whose out is null."""

    def make() -> Callable:
        model = load()

        def one(x: object) -> list[tuple]:
            try:
                return [(model(x), None)]
            except Exception as e:  # a model's failure is the row's, never the task's
                return [(None, f"{type(e).__name__}: {e}")]

        return one

    return flat_mapped(df.drop(out, "error"), [c for c in df.columns if c not in (out, "error")], [col], f"{out} {kind}, error string", make)


def rewrite(paras: DataFrame, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """paras (.., text) with reply, error and cleaned: the trimmed reply after its thinking; a failed or empty reply leaves the text, DROP gives null."""
    out = mapped(paras, load, "text", "reply", "string").withColumn("reply", think_stripped(trimmed(F.col("reply"))))
    kept = F.when(F.coalesce("reply", F.lit("")) == "", F.col("text")).otherwise(F.col("reply"))
    return out.withColumn("cleaned", F.when(~is_drop(kept), kept))


def clean_text(docs: DataFrame, load: Callable[[], Callable[[str], str]], min_chars: int = 10) -> DataFrame:
    """(doc_id, text, words_before, words_after, rewritten, dropped, changed) over the paragraphs of each document."""
    done = rewrite(paragraphs(docs, min_chars), load)
    kept = F.col("cleaned").isNotNull()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "cleaned")))), lambda x: x["cleaned"]), "\n\n")
    out = done.groupBy("doc_id").agg(
        joined.alias("text"), F.sum(word_count(F.col("text"))).alias("words_before"), F.sum(F.coalesce(word_count(F.col("cleaned")), F.lit(0))).alias("words_after"),
        F.count_if(kept & (F.col("cleaned") != F.col("text"))).alias("rewritten"), F.count_if(~kept).alias("dropped"),
    )
    return out.withColumn("changed", F.col("rewritten") > 0)


def speak(texts: DataFrame, load: Callable[[], Callable[[str], bytes]]) -> DataFrame:
    """(.., wav, error) of texts (.., text); error: why there is no audio."""
    return mapped(texts, load, "text", "wav", "binary").drop("text")


def transcribe(wavs: DataFrame, load: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(.., wav, transcription) of wavs (.., wav); a failure is heard as null."""
    return mapped(wavs, load, "wav", "transcription", "string").drop("error")


def tone_speaker() -> Callable[[str], bytes]:
    """A stand-in for speech: the text's own bytes as samples."""

    def say(text: str) -> bytes:
        body = text.encode("utf-16-le")
        return write_header(1, 1, 24000, 16, len(body)) + body

    return say


def tone_reader() -> Callable[[bytes], str]:
    return lambda wav: bytes(wav)[44:].decode("utf-16-le")


def command(argv: list[str]) -> Callable[[], Callable[[bytes], bytes]]:
    """A transcoder that runs a command: bytes to its input, bytes from its output; a failure is an error with what it says."""

    def make() -> Callable[[bytes], bytes]:
        import subprocess

        def run(data: bytes) -> bytes:
            done = subprocess.run(argv, input=data, capture_output=True, check=False)
            if done.returncode:
                raise OSError(f"{argv[0]}: {done.stderr[-500:].decode('utf-8', 'replace')}")
            return done.stdout

        return run

    return make


def mp3_command(binary: str = "ffmpeg") -> list[str]:
    """MP3 at variable rate, quality 2."""
    return [binary, "-hide_banner", "-loglevel", "error", "-i", "pipe:0", "-codec:a", "libmp3lame", "-q:a", "2", "-f", "mp3", "pipe:1"]
