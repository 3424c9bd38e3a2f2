"""Count-only Viterbi over a unigram vocabulary.

A text is normalised as SentencePiece does for the model's own pieces: white space becomes the mark U+2581, one
stands before the text, runs are one. No piece goes on past the start of a mark, so each marked word is
segmented by itself, once for each distinct word of a batch. Aho-Corasick enumerates the pieces that end at
each place; the program carries the best score and the number of pieces of the best path only. Ties: of paths
of equal score to a place the one whose last piece starts first stays, as in the tokenizer's forward pass,
which replaces a path by a strictly better one only. A character that no piece of one character covers costs
the lowest score less ten and counts one a UTF-8 byte where the vocabulary has byte pieces, else one a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PENALTY = 10.0
CACHE = 200_000  # distinct words remembered by a Python worker


class Counter:
    """Counts pieces for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.found = ahocorasick.Automaton()
        for p, s in pieces:
            self.found.add_word(p, (len(p), s))
        if pieces:
            self.found.make_automaton()
        self.cache: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Counter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usual = [k for k in range(n) if not (sp.is_unknown(k) or sp.is_control(k) or sp.is_byte(k) or sp.is_unused(k))]
        return cls([(sp.id_to_piece(k), sp.get_score(k)) for k in usual], any(sp.is_byte(k) for k in range(n)))

    def word(self, w: str) -> int:
        n = len(w)
        best = [0.0] + [None] * n
        count = [0] * (n + 1)
        run = [False] * (n + 1)  # whether the best path to here ends in unknown characters
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.found):
            for end, hit in self.found.iter(w):
                ends[end].append(hit)
        for e in range(n):
            options = [(e + 1 - size, s, False) for size, s in ends[e]]
            if w[e] not in self.single:
                options.append((e, self.unknown, True))
            options.sort(key=lambda o: o[0])
            b, c, u = None, 0, False
            for start, s, odd in options:
                if best[start] is not None and (b is None or best[start] + s > b):
                    b, u = best[start] + s, odd
                    more = (len(w[e].encode("utf-8", "surrogatepass")) if self.byte_fallback else 0 if run[start] else 1) if odd else 1
                    c = count[start] + more
            best[e + 1], count[e + 1], run[e + 1] = b, c, u
        return count[n]

    def words(self, distinct: list[str]) -> list[int]:
        out = []
        for w in distinct:
            c = self.cache.get(w)
            if c is None:
                c = self.word(MARK + w)
                if len(self.cache) < CACHE:
                    self.cache[w] = c
            out.append(c)
        return out


def texts_counted(counter: Counter, texts: pa.Array) -> pa.Array:
    """Tokens of each text, by the distinct words of them all."""
    clean = pc.utf8_trim_whitespace(pc.fill_null(pc.cast(texts, pa.large_string()), ""))
    split = pc.utf8_split_whitespace(clean)
    lists = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    counts = pa.array([c if w else 0 for w, c in zip(distinct, counter.words(distinct), strict=True)], pa.int64())
    each = counts.take(coded.indices) if len(flat) else pa.array([], pa.int64())
    total = pc.cumulative_sum(each).to_numpy() if len(each) else []
    sums = np.r_[0, total].astype("int64")
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    return pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; vocabulary: path of a SentencePiece model on every executor.

    Null, empty and white texts: 0. Null and repeated ids: each row has its count. Other columns are not read,
    whatever their names. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.from_file(vocabulary)
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), texts_counted(counter, part.column(1))], ["id", "n_tokens"])

    return rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long")
