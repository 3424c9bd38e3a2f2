"""Paragraphs and word-bounded chunks, tagged with the pause that follows them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import trimmed
from scriptorium.operators.rows import flat_mapped

WINDOW = 150  # bytes after the budget in which a sentence may still end


def _paragraphs(text: Column, min_chars: int) -> Column:
    """(pos, text) of each paragraph, in order."""
    raw = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n")
    each = F.transform(raw, lambda x, i: F.struct(i.alias("pos"), trimmed(x).alias("text")))
    return F.filter(each, lambda x: F.length(F.regexp_replace(x["text"], r"(?U)\s", "")) >= min_chars)


def paragraphs(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, pos, text): the pieces between blank lines, trimmed, of at least min_chars other than white space."""
    # explode_outer, and the test after it: else the optimizer infers a filter on the array and evaluates it twice
    each = docs.select("doc_id", F.explode_outer(_paragraphs(F.col("text"), min_chars)).alias("p"))
    return each.where("p.pos IS NOT NULL").select("doc_id", "p.pos", "p.text")


def split_words(text: str, most: int) -> list[str]:
    """Greedy pieces of about `most` words: to the first sentence end past the budget and less than WINDOW bytes on, else one word short of it."""
    tokens = re.findall(r"\S+\s*", text.strip())
    bare = [t.rstrip() for t in tokens]
    at, ends = 0, []
    for t, w in zip(tokens, bare, strict=True):
        ends.append(at + len(w.encode()))
        at += len(t.encode())
    out, s, n = [], 0, len(tokens)
    while n - s > most:
        limit = ends[s + most - 1] + WINDOW
        k, stop = s + most, s + max(most - 2, 0)
        while k < n and ends[k] < limit:
            if bare[k][-1] in ".!?":
                stop = k
                break
            k += 1
        out.append("".join(tokens[s : stop + 1]).strip())
        s = stop + 1
    if s < n:
        out.append("".join(tokens[s:]).strip())
    return out


def chunks(docs: DataFrame, min_chars: int = 10, max_words: int = 200) -> DataFrame:
    """(doc_id, ordinal, text, trailing_boundary): Paragraph after a paragraph, Sentence inside one, null after the last; max_words 0: whole paragraphs.

    A document is a row and is numbered where it lies, without an exchange; null and repeated ids are rows like others.
    """
    paras = docs.select("doc_id", F.transform(_paragraphs(F.col("text"), min_chars), lambda x: x["text"]).alias("paras"))
    if max_words <= 0:
        each = paras.select("doc_id", F.size("paras").alias("n"), F.posexplode_outer("paras").alias("at", "text")).where("at IS NOT NULL")
        return each.select("doc_id", (F.col("at") + 1).alias("ordinal"), "text", F.when(F.col("at") + 1 < F.col("n"), "Paragraph").alias("trailing_boundary"))

    def split(paras: list[str] | None) -> Iterator[tuple]:
        parts = [split_words(p, max_words) for p in paras or ()]
        flat = [(t, "Sentence" if k + 1 < len(own) else "Paragraph") for own in parts for k, t in enumerate(own)]
        for k, (text, tag) in enumerate(flat):
            yield k + 1, text, tag if k + 1 < len(flat) else None

    return flat_mapped(paras, ["doc_id"], ["paras"], "ordinal int, text string, trailing_boundary string", lambda: split)
