"""WAV headers, silence, merging, decoding and resampling."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import trimmed
from scriptorium.operators.rows import flat_mapped

#: Silence after a paragraph and after a sentence, in milliseconds.
PARAGRAPH_MS, SENTENCE_MS = 360, 180
HEADER = "fmt_tag int, channels int, sample_rate long, bits_per_sample int, data_offset long, data_len long, error string"
MOST = 4294967295


def parse_header(data: bytes) -> tuple:
    """The header fields, or an error: RIFF chunks, word-aligned, up to the data; PCM or float only."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return (None,) * 6 + ("not a WAV file",)
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if tag not in (1, 3):
                return (None,) * 6 + (f"unsupported format {tag}",)
            fmt = (tag, channels, rate, bits)
        elif name == b"data":
            return (*fmt, at + 8, size, None) if fmt else (None,) * 6 + ("data before fmt",)
        at += 8 + size + size % 2
    return (None,) * 6 + ("no data chunk",)


def write_header(tag: int, channels: int, rate: int, bits: int, size: int) -> bytes:
    frame = channels * bits // 8
    return b"RIFF" + struct.pack("<I", min(MOST, 36 + size)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, channels, rate, rate * frame, frame, bits) + b"data" + struct.pack("<I", min(MOST, size))


def headers(wavs: DataFrame) -> DataFrame:
    """(.., header fields, error) of wavs (.., content); the other columns pass through."""
    keep = [c for c in wavs.columns if c != "content"]
    return flat_mapped(wavs, keep, ["content"], HEADER, lambda: lambda content: [parse_header(content or b"")])


def _little(n: Column, width: int) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)]))


def header_bytes(tag: Column, channels: Column, rate: Column, bits: Column, size: Column) -> Column:
    """The 44 bytes before the data; lengths saturate where the format's fields do."""
    text = lambda x: F.lit(x.encode())
    frame = channels * F.floor(bits / 8)
    riff = F.least(F.lit(MOST), size + 36)
    return F.concat(text("RIFF"), _little(riff, 4), text("WAVEfmt "), _little(F.lit(16), 4), _little(tag, 2), _little(channels, 2), _little(rate, 4), _little(rate * frame, 4), _little(frame, 2), _little(bits, 2), text("data"), _little(F.least(F.lit(MOST), size), 4))


def silence_length(rate: Column, channels: Column, bits: Column, ms: Column) -> Column:
    """Bytes of silence: whole frames."""
    return F.floor(rate.cast("long") * ms / 1000) * channels * F.floor(bits / 8)


def gap_ms(boundary: Column, paragraph: int, sentence: int) -> Column:
    return F.when(boundary == "Paragraph", paragraph).when(boundary == "Sentence", sentence).otherwise(0)


def merge_plan(parts: DataFrame, paragraph_ms: int = PARAGRAPH_MS, sentence_ms: int = SENTENCE_MS) -> DataFrame:
    """parts (doc_id, ordinal, data_len, trailing_boundary, sample_rate, channels, bits_per_sample) with gap_len and start: its first byte in the merged data."""
    gap = silence_length(F.col("sample_rate"), F.col("channels"), F.col("bits_per_sample"), gap_ms(F.col("trailing_boundary"), paragraph_ms, sentence_ms))
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("gap_len", gap.cast("long")).withColumn("start", F.coalesce(F.sum(F.col("data_len") + F.col("gap_len")).over(before), F.lit(0)))


def merged_length(plan: DataFrame) -> DataFrame:
    """(doc_id, data_len, seconds), saturated where the format's field is."""
    total = F.least(F.sum(F.col("data_len") + F.col("gap_len")), F.lit(MOST))
    rate = F.first("sample_rate") * F.first("channels") * F.floor(F.first("bits_per_sample") / 8)
    return plan.groupBy("doc_id").agg(total.alias("data_len"), (total / rate).alias("seconds"))


def merge(wavs: DataFrame, paragraph_ms: int = PARAGRAPH_MS, sentence_ms: int = SENTENCE_MS) -> DataFrame:
    """(doc_id, content, error): the WAVs of each document (doc_id, ordinal, content, trailing_boundary) with their gaps, as one file.

    The first header that can't be read is the document's error, as are formats that differ; the format's tag isn't
    compared, the first one stands. The bytes stay in the JVM but for the headers' reading; a document's audio must fit one value.
    """
    known = flat_mapped(wavs, ["doc_id", "ordinal", "trailing_boundary", "content"], ["content"], HEADER, lambda: lambda content: [parse_header(content or b"")])
    form = F.concat_ws("/", "channels", "sample_rate", "bits_per_sample")
    gap = silence_length(F.col("sample_rate"), F.col("channels"), F.col("bits_per_sample"), gap_ms(F.col("trailing_boundary"), paragraph_ms, sentence_ms)).cast("int")
    own = F.substr("content", F.col("data_offset") + 1, F.least("data_len", F.octet_length("content") - F.col("data_offset")))
    good = F.col("error").isNull()
    # silence is a number until the document is together: it may be many times the speech
    part = F.struct("ordinal", F.when(good, gap).alias("gap"), F.when(good, own).alias("own"))
    at_first = [F.min_by(c, "ordinal").alias(c) for c in ("fmt_tag", "channels", "sample_rate", "bits_per_sample")]
    error = F.coalesce(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ordinal"))), F.when(F.min("form") != F.max("form"), F.lit("formats differ")))
    joined = known.withColumn("form", form).groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), error.alias("error"), *at_first)
    # as strings, which are any bytes here: those an array joins in one go
    pieces = F.transform("parts", lambda p: F.concat(p["own"].cast("string"), F.repeat(F.lit("\0"), p["gap"])))
    data = F.array_join(pieces, "").cast("binary")
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["own"]) + p["gap"])
    head = header_bytes(F.col("fmt_tag"), F.col("channels"), F.col("sample_rate"), F.col("bits_per_sample"), size)
    return joined.select("doc_id", F.when(F.col("error").isNull(), F.concat(head, data)).alias("content"), "error")


def decoded(wavs: DataFrame) -> DataFrame:
    """(.., samples) of wavs (.., content); a file that can't be read has none."""
    return flat_mapped(wavs, [c for c in wavs.columns if c != "content"], ["content"], "samples array<float>", lambda: lambda content: [(decode(content or b""),)])


def decode(content: bytes) -> np.ndarray:
    """Samples as float32, in the file's order, whatever the number of channels."""
    tag, _, _, _, at, size, error = parse_header(content)
    if error:
        return np.empty(0, np.float32)
    data = content[at : at + size]
    return np.frombuffer(data[: len(data) // 4 * 4], "<f4") if tag == 3 else (np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768)


def resampled(samples: Column, rate: int, to: int = 16000) -> Column:
    """Linear interpolation between neighbours, in single precision."""
    ratio = rate / to
    n = F.floor(F.size(samples) / F.lit(ratio)).cast("int")

    def at(i: Column) -> Column:
        pos = i * F.lit(ratio)
        k = F.floor(pos).cast("int")
        part = (pos - k).cast("float")
        a = F.get(samples, k)
        b = F.get(samples, F.least(k + 1, F.size(samples) - 1))
        return (a + ((b - a).cast("float") * part).cast("float")).cast("float")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<float>"))


def segments_joined(segments: Column) -> Column:
    """A transcription's segments, trimmed of any white space, without empty ones, joined by a space."""
    return F.array_join(F.filter(F.transform(segments, trimmed), lambda s: s != ""), " ")
