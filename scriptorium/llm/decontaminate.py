"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case with runs of white space as one space, character by character. An item is cut into
pieces of `piece` characters or so, one from each word on, so that any run of its whole words a word longer than that
holds a piece; a document leaks an item where one piece occurs within `budget` of its length in edits. A piece of n
characters within k edits of a region shares at least n - q + 1 - k*q of its q-grams with it, on diagonals no more
than k apart. For counting a character is folded into one byte, so that a q-gram is a whole number: characters that
fold alike can only add to a count, and alignment compares the characters themselves. So the q-grams that a text shares with an item are
sorted in overlapping bands of diagonals 2k wide, one every k, and counted for each piece; those that reach the bound are verified by
alignment inside the band. A band's count needs no more than the text's own matching positions.

The index of the q-grams of all pieces is built once on the driver in blocks of `block` items and broadcast;
its size is bounded by block and piece lengths, and more items only make more blocks, each a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, flat_mapped, small_batches

Q, PIECE, BUDGET, BLOCK = 8, 96, 0.1, 5_000
BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def characters(text: str) -> np.ndarray:
    """A number for each character."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def bytes_of(text: str) -> np.ndarray:
    """A byte for each character."""
    c = characters(text)
    return c if c.dtype == np.uint8 else (c ^ (c >> 8) ^ (c >> 16)).astype(np.uint8)


def pieces_of(item: str, piece: int = PIECE) -> list[str]:
    """The item in pieces of words of at least `piece` characters; a short rest joins the last, a short item is one piece."""
    out, now = [], ""
    for w in item.split(" "):
        now = now + " " + w if now else w
        if len(now) >= piece:
            out.append(now)
            now = ""
    if now and (not out or len(now) >= piece // 2):
        out.append(now)
    elif now:
        out[-1] += " " + now
    return out


def overlapping(item: str, piece: int = PIECE) -> list[tuple[int, str]]:
    """(start, piece): the item's pieces end to end, and then those from every other word on, at least `piece` characters each."""
    out, at = [], 0
    for p in pieces_of(item, piece):
        out.append((at, p))
        at += len(p) + 1
    known, ends = set(out), [k for k, c in enumerate(item) if c == " "] + [len(item)]
    e = 0
    for start in [0, *[k + 1 for k in ends[:-1]]]:
        while e < len(ends) and ends[e] - start < piece:
            e += 1
        if e == len(ends):
            break
        if (new := (start, item[start : ends[e]])) not in known:
            out.append(new)
    return out


def _codes(data: np.ndarray) -> np.ndarray:
    """Each run of Q bytes as one integer."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(data, Q).copy().view("<u8").ravel()


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Index:
    """The q-grams of the pieces of a block of items: sorted codes with piece and offset, and a bitmap of hashes to test first."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE, budget: float = BUDGET):
        whole = [(i, n) for i, t in items if (n := normal(t))]
        cuts = [overlapping(n, piece) for _, n in whole]
        self.items = [i for (i, _), own in zip(whole, cuts, strict=True) for _ in own]
        self.pieces = [p for own in cuts for _, p in own]
        self.start = np.array([a for own in cuts for a, _ in own], int)
        self.head = np.cumsum([0, *map(len, cuts)])  # the first piece of each item
        self.edits = [int(budget * len(p)) for p in self.pieces]
        self.short = [k for k, p in enumerate(self.pieces) if 0 < len(p) < Q]  # too short for a q-gram
        parts = [(_codes(bytes_of(n)), k) for k, (_, n) in enumerate(whole)]
        codes = np.concatenate([c for c, _ in parts]) if parts else np.empty(0, np.uint64)
        owner = np.concatenate([np.full(len(c), k) for c, k in parts]) if parts else np.empty(0, int)
        offset = np.concatenate([np.arange(len(c)) for c, _ in parts]) if parts else np.empty(0, int)
        order = np.argsort(codes, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.codes, self.first, self.many = np.unique(codes[order], return_index=True, return_counts=True)
        # what the lemma asks for; a piece so short that it asks for nothing must occur as it is
        lemma = np.array([len(p) - Q + 1 - e * Q for p, e in zip(self.pieces, self.edits, strict=True)], int)
        self.edits = [e if n >= 1 else 0 for e, n in zip(self.edits, lemma, strict=True)]
        self.need = np.where(lemma >= 1, lemma, np.maximum(1, np.array([len(p) for p in self.pieces], int) - Q + 1))
        self.last = self.start + np.array([len(p) for p in self.pieces], int) - Q  # the offset of a piece's last q-gram
        # of an item: what any of its pieces asks for, and bands wide enough for all
        self.least = np.minimum.reduceat(self.need, self.head[:-1]) if whole else self.need
        self.step = np.maximum(1, np.maximum.reduceat(np.array(self.edits, int), self.head[:-1])) if whole else self.need
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[_slot(codes)] = True

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(piece, start, end, edits) of the best region for each piece that the text holds."""
        codes = _codes(bytes_of(text))
        at = np.flatnonzero(self.bitmap[_slot(codes)])
        found = []
        if len(at):
            place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
            true = self.codes[place] == codes[at]
            at, place = at[true], place[true]
            many = self.many[place]
            entry = np.repeat(self.first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            own, offset = self.owner[entry], self.offset[entry]
            some = np.bincount(own, minlength=len(self.least))[own] >= self.least[own]  # items whose q-grams suffice anywhere
            own, offset = own[some], offset[some]
            # bands [s*step, (s+2)*step): overlapping, so that diagonals no more than step apart share one
            band = (np.repeat(at, many)[some] - offset) // self.step[own] + (1 << 30)
            names, rank = np.unique(own, return_inverse=True)
            key = (rank << 32) + band
            # each q-gram of an item counts once in a band
            order = np.lexsort((np.tile(offset, 2), key := np.concatenate([key, key - 1])))
            key, offset = key[order], np.tile(offset, 2)[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])] if len(key) else np.empty(0, bool)
            key, offset = key[once], offset[once]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
            ends = np.r_[heads[1:], len(key)] if len(heads) else heads
            owners = names[key[heads] >> 32] if len(heads) else heads
            enough = ends - heads >= self.least[owners] if len(heads) else np.empty(0, bool)
            best: dict[int, tuple[int, int, int]] = {}
            for a, b, own_k in zip(heads[enough].tolist(), ends[enough].tolist(), owners[enough].tolist(), strict=True):
                first, past, step = int(self.head[own_k]), int(self.head[own_k + 1]), int(self.step[own_k])
                low = (int(key[a] & 0xFFFFFFFF) - (1 << 30)) * step
                counts = np.searchsorted(offset[a:b], self.last[first:past], "right") - np.searchsorted(offset[a:b], self.start[first:past])
                for k in (first + np.flatnonzero(counts >= self.need[first:past])).tolist():
                    if k in best and best[k][2] == 0:
                        continue
                    start = int(self.start[k])
                    hit = align(self.pieces[k], text, low + start, low + start + 2 * step, self.edits[k])
                    if hit is not None and (k not in best or hit[2] < best[k][2]):
                        best[k] = hit
            found = [(k, *hit) for k, hit in best.items()]
        for k in self.short:
            if (i := (" " + text + " ").find(" " + self.pieces[k] + " ")) >= 0:
                found.append((k, i, i + len(self.pieces[k]), 0))
        return found


def align(piece: str, text: str, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the region of the text nearest to the piece whose diagonals lie within edits of [low, high), if within edits."""
    at = text.find(piece, max(0, low - edits), max(0, high + edits + len(piece)))
    if at >= 0 or edits == 0:
        return (at, at + len(piece), 0) if at >= 0 else None
    low, high = low - edits, high + edits
    width = high - low + 1
    far = len(piece) + 1
    cells = np.arange(width)
    start = low + cells
    cost = np.where((start >= 0) & (start <= len(text)), 0, far)
    # cell j of row i stands for text position i + low + j; places outside the text equal nothing
    data = np.full(len(piece) + width, -1)
    a, b = max(0, low), min(len(text), low + len(data))
    if b > a:
        data[a - low : b - low] = characters(text[a:b])
    up, up_start = np.full(width, far), np.zeros(width, start.dtype)
    for i, c in enumerate(characters(piece).tolist()):
        diag = cost + (data[i : i + width] != c)
        up[:-1], up_start[:-1] = cost[1:] + 1, start[1:]  # the character is left out of the text
        new_start = np.where(diag <= up, start, up_start)
        new = np.minimum(diag, up) - cells
        # characters put into the text: from the left, a running minimum of cost - place
        run = np.minimum.accumulate(new)
        cost, start = np.minimum(run + cells, far), new_start[np.maximum.accumulate((new == run) * cells)]
    end = len(piece) + low + cells
    cost = np.where((end >= 0) & (end <= len(text)), cost, far)
    j = int(cost.argmin())
    return (int(start[j]), int(end[j]), int(cost[j])) if cost[j] <= edits else None


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", piece: int = PIECE, budget: float = BUDGET, block: int = BLOCK) -> DataFrame:
    """(id, item_id, pieces, matched, edits): each item of which a document holds pieces, of how many, and the edits in all of those.

    Null or empty texts and items match nothing. Null ids: kept as null. Repeated ids: each row has its results.
    Repeated items: by item_id, of whatever type, each with its own pieces; null item ids are left out. Other columns
    are not read, whatever their names. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    kind = items.schema["i"].dataType.simpleString()
    parts: list[DataFrame] = []
    held: list[tuple[int, str]] = []

    def add(held: list[tuple[int, str]]) -> None:
        index = spark.sparkContext.broadcast(Index(held, piece, budget))
        total: dict[int, int] = {}
        for i in index.value.items:
            total[i] = total.get(i, 0) + 1

        def leaks(text: str | None) -> Iterator[tuple]:
            by: dict[int, list[int]] = {}
            for k, _, _, e in index.value.search(normal(text)):
                by.setdefault(index.value.items[k], []).append(e)
            for i, e in by.items():
                yield i, total[i], len(e), sum(e)

        parts.append(flat_mapped(rows, ["id"], ["text"], f"item_id {kind}, pieces int, matched int, edits int", lambda: leaks))

    for r in items.orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) == block:
            add(held)
            held = []
    if held or not parts:
        add(held)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    with small_batches(spark):  # written once, as the size of a batch holds for what is computed here
        return Scratch(spark)(out)
