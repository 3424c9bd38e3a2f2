"""Phoneme error rates of transcriptions against their source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import normalized, sanitize_changed, sanitized, terminated
from scriptorium.sources.scratch import Scratch

#: The two-letter phones of the dictionary's alphabet; one-letter phones stand for themselves.
PHONES = ["AA", "AE", "AH", "AO", "AW", "AY", "CH", "DH", "EH", "ER", "EY", "HH", "IH", "IY", "JH", "NG", "OW", "OY", "SH", "TH", "UH", "UW", "ZH"]
THRESHOLD = 0.15
#: A few common words in the dictionary's format, for use without the dictionary itself.
SAMPLE = """;;; sample
THE  DH AH0
THE(1)  DH IY0
AND  AH0 N D
OF  AH1 V
TO  T UW1
IN  IH0 N
IS  IH1 Z
IT  IH1 T
ON  AA1 N
WITH  W IH1 DH
BY  B AY1
AS  AE1 Z
AT  AE1 T
FOR  F AO1 R
THAT  DH AE1 T
THIS  DH IH1 S
WAS  W AA1 Z
BE  B IY1
ARE  AA1 R
OR  AO1 R
"""


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """(word, phones) from (line_no, value): comments and blanks skipped, one split at two spaces, variants and stress dropped, the first of a word kept."""
    parts = F.split("value", "  ", 2)
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit(";;;")) & (F.size(parts) == 2))
    word = F.lower(F.split(parts[0], r"\(")[0])
    phones = F.transform(F.split(F.trim(parts[1]), r"\s+"), lambda p: F.regexp_replace(p, "[0-9]+$", ""))
    return rows.select(word.alias("word"), F.struct("line_no", phones.alias("phones")).alias("x")).groupBy("word").agg(F.min_by("x", "x.line_no").alias("x")).select("word", "x.phones")


def sample_lexicon(spark) -> DataFrame:
    return parse_lexicon(spark.createDataFrame(list(enumerate(SAMPLE.splitlines())), "line_no long, value string"))


def phonemes(texts: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, tokens): the phones of each word and a bar after it; words the lexicon lacks by their letters in upper case.

    The lexicon is a dictionary of a language, of bounded size; Spark broadcasts it below its own threshold and shuffles beyond.
    """
    each = texts.select("id", F.posexplode(F.split(normalized(F.col(text_col)), " ")).alias("at", "word")).where("word <> ''")
    letters = F.transform(F.array_remove(F.split("word", ""), ""), lambda c: F.upper(c))
    known = each.join(lexicon, "word", "left").select("id", "at", F.array_append(F.coalesce("phones", letters), F.lit("|")).alias("t"))
    joined = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("w")).select("id", F.flatten("w.t").alias("tokens"))
    return texts.select("id").join(joined, "id", "left").select("id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def _codes() -> dict[str, str]:
    """A character for each token of several: phones by their place, and the upper cases of single letters by that letter, which no token is."""
    wide = {chr(c).upper(): chr(c) for c in range(0xFFFF, 0, -1) if len(chr(c).upper()) > 1}
    return wide | {p: chr(97 + k) for k, p in enumerate(PHONES)}


def encoded(tokens: Column) -> Column:
    """One character a token, so that the built-in distance counts tokens."""
    codes = F.create_map(*[F.lit(x) for pair in _codes().items() for x in pair])
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(codes, t), F.left(t, F.lit(1)))), "")


def error_rate(a: Column, b: Column) -> Column:
    """Token edits over the longer length as a float; both empty 0, one empty 1."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(encoded(a), encoded(b)) / longest).cast("float")


def scored(pairs: DataFrame, lexicon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, per, passed) of pairs (id, original, transcription)."""
    a = phonemes(pairs.select("id", F.col("original").alias("text")), lexicon).withColumnRenamed("tokens", "a")
    b = phonemes(pairs.select("id", F.coalesce("transcription", F.lit("")).alias("text")), lexicon).withColumnRenamed("tokens", "b")
    per = error_rate(F.col("a"), F.col("b"))
    return a.join(b, "id").select("id", per.alias("per"), (per <= F.lit(threshold).cast("float")).alias("passed"))


def attempted(chunks: DataFrame, speak: Callable[[DataFrame], DataFrame], transcribe: Callable[[DataFrame], DataFrame], lexicon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, original, attempt, wav, error, transcription, per, passed): the attempts at chunks (id, text), one or two of each.

    speak: (id, text) -> (id, wav, error), a null wav for a failure; transcribe: (id, wav) -> (id, wav, transcription), null
    for a failure, which is heard as nothing. A chunk that can't be spoken at first has no second attempt. What is spoken
    but fails the threshold is spoken again, from its sanitised text where that differs; both attempts are scored against
    the original. Each attempt is written once to the shared folder, so that a model is asked once and its answers agree.
    """
    keep = Scratch(chunks.sparkSession)

    def attempt(texts: DataFrame, number: int) -> DataFrame:
        """texts: id, text as spoken, original."""
        said = keep(speak(texts.select("id", "text")).select("id", "wav", "error"))
        heard = keep(transcribe(said.where("wav IS NOT NULL").select("id", "wav")).select("id", "transcription"))
        pairs = texts.select("id", "original").join(said, "id").join(heard, "id", "left")
        rated = scored(pairs.where("wav IS NOT NULL").select("id", "original", "transcription"), lexicon, threshold)
        return keep(pairs.join(rated, "id", "left").select("id", "original", F.lit(number).alias("attempt"), "wav", "error", "transcription", "per", F.coalesce("passed", F.lit(False)).alias("passed")))

    first = attempt(chunks.select("id", terminated(F.col("text")).alias("text"), F.col("text").alias("original")), 1)
    failed = first.where("wav IS NOT NULL AND NOT passed").select("id", F.col("original").alias("text"))
    again = F.when(sanitize_changed(F.col("text")), sanitized(F.col("text"))).otherwise(F.col("text"))
    return first.unionByName(attempt(failed.select("id", again.alias("text"), F.col("text").alias("original")), 2))


def verdicts(attempts: DataFrame) -> DataFrame:
    """(id, original, attempts, wav, error, per, transcription, status) from attempts: what the last one of each left.

    Ok: it passed. Failed: it was never spoken. Quarantined: neither attempt passed.
    """
    last = attempts.groupBy("id").agg(F.max("attempt").alias("attempt"))
    status = F.when(F.col("passed"), "Ok").when(F.col("wav").isNull() & (F.col("attempt") == 1), "Failed").otherwise("Quarantined")
    return attempts.join(last, ["id", "attempt"]).select("id", "original", F.col("attempt").alias("attempts"), "wav", "error", "per", "transcription", status.alias("status"))


def validate_and_retry(chunks: DataFrame, speak: Callable[[DataFrame], DataFrame], transcribe: Callable[[DataFrame], DataFrame], lexicon: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The verdicts on all attempts at chunks (id, text)."""
    return verdicts(attempted(chunks, speak, transcribe, lexicon, threshold))


def sidecars(attempts: DataFrame) -> DataFrame:
    """(id, transcription, report): the last transcription of each chunk, and for quarantined ones the report on them."""
    out = verdicts(attempts)
    heard = F.coalesce("transcription", F.lit(""))
    report = F.format_string("ORIGINAL:\n%s\n\nTRANSCRIPTION:\n%s\n\nPHONEME_ERROR: %.4f\nATTEMPTS: %d\n", "original", heard, F.coalesce(F.col("per").cast("double"), F.lit(1.0)), "attempts")
    return out.where("status <> 'Failed'").select("id", heard.alias("transcription"), F.when(F.col("status") == "Quarantined", report).alias("report"))
