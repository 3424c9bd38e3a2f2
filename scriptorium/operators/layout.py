"""Reading order and prose paragraphs from positioned words of pages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.functions import text as T
from scriptorium.operators.rows import freed

GAP = 3.0  # between the middles of two words of a line, at most
WORDS = 100_000  # ordered at a time, about


def _keys(a: pa.Array) -> list[np.ndarray]:
    """Sort keys of the values, the last one foremost, as Spark orders them: nulls first, NaN last."""
    if pa.types.is_integer(a.type) or pa.types.is_floating(a.type):
        own = a.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        own = np.asarray(pc.rank(a, tiebreaker="dense", null_placement="at_start"))
    return [own, np.asarray(a.is_valid())] if a.null_count else [own]


def _begins(keys: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it in a key; NaNs are equal."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([(k[1:] != k[:-1]) & ((k[1:] == k[1:]) | (k[:-1] == k[:-1])) for k in keys])
    return out


def _joined(text: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    """The texts from each start to the next, joined; nulls are left out."""
    counts = np.add.reduceat(np.asarray(text.is_valid()).astype(np.int64), starts)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), text.drop_null()), by)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[pa.Array]]]:
    """(documents, the number of each word's document, fields of the words) of batches of documents (doc_id, w), about WORDS words at a time."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column(1)))
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + WORDS, "right")))
            part = batch.slice(at, to - at)
            yield part.column(0), np.repeat(np.arange(to - at), sizes[at:to]), part.column(1).flatten().flatten()
            at = to


def _lines(batches: Iterable[pa.RecordBatch], geometric: bool) -> Iterator[pa.RecordBatch]:
    """Batches of lines (doc_id, page_no, line_no, text), whole documents in each, of documents (doc_id, w) with their words in no order."""
    for docs, doc, (page, col, top, x0, word, y, text) in _parts(batches):
        col, pages = np.asarray(col), [*_keys(page), doc]
        if geometric:  # a page's column shows once all of it is there
            order = np.lexsort(pages)
            nth = np.empty(len(order), np.int64)
            nth[order] = np.cumsum(_begins([k[order] for k in pages])) - 1
            single = np.bincount(nth, np.where(col == 0, 1, -1)) > 0
            col = np.where(single[nth], 0, col)
        order = np.lexsort([*_keys(word), *_keys(x0), *_keys(top), col, *pages])
        doc, col, y = doc[order], col[order], y.to_numpy(zero_copy_only=False)[order]  # y: null as NaN, which breaks a line as well
        new_page = _begins([k[order] for k in pages])
        new = new_page.copy()
        with np.errstate(invalid="ignore"):
            new[1:] |= (col[1:] != col[:-1]) | ~(np.abs(np.diff(y)) <= GAP)
        starts = np.flatnonzero(new)
        texts = _joined(text.take(pa.array(order)), starts, " ")
        ends = np.append(new_page[starts][1:], True)
        size = 1 + ends.astype(np.int64)  # with the blank line after a page
        place = np.cumsum(size) - size
        first = np.maximum.accumulate(np.where(_begins([doc])[starts], place, 0))  # where the line's document begins
        at, no, pick = (np.repeat(v, size) for v in (starts, place - first + 1, np.arange(len(starts))))
        blank = (place + 1)[ends]
        no[blank] += 1
        pick[blank] = len(starts)
        own = pa.concat_arrays([texts, pa.array([""], texts.type)])
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(doc[at])), page.take(pa.array(order[at])), pa.array(no, pa.int32()), own.take(pa.array(pick))], names=["doc_id", "page_no", "line_no", "text"])


def _documents(lines: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text): the lines of each document, joined by newlines."""
    for batch in lines:
        starts = np.flatnonzero(np.asarray(batch.column(2)) == 1)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), _joined(batch.column(3), starts, "\n")], names=["doc_id", "text"])


def _laid_out(words: DataFrame, span_mode: str, whole: bool) -> DataFrame:
    """Lines of positioned words, or the documents that they make up. Words are gathered to their document, one row each, before the only
    exchange, and ordered there: no word is a row in an exchange, in a sort or on its way to Python. A document is held whole."""
    mid = F.col("page_width") / 2
    side = F.when((F.col("x0") + F.col("x1")) / 2 < mid, 1).otherwise(2)
    geometric = span_mode == "geometric"
    if geometric:
        width = F.greatest(F.col("x1") - F.col("x0"), 0.01 * F.col("page_width"))
        spans = (F.col("x0") < mid) & (F.col("x1") > mid) & (F.least(mid - F.col("x0"), F.col("x1") - mid) / width > 0.1)
        side = F.when(spans, 0).otherwise(side)
    mid_y = ((F.col("top") + F.col("bottom")) / 2).cast("double")
    word = F.struct("page_no", side.alias("col"), "top", "x0", "word_idx", mid_y.alias("y"), "text")
    rows = words.groupBy("doc_id").agg(F.collect_list(word).alias("w"))
    added = StructType.fromDDL("line_no int, text string")
    schema = StructType([rows.schema["doc_id"], added["text"]] if whole else [rows.schema["doc_id"], words.schema["page_no"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _lines(batches, geometric)
        return _documents(lines) if whole else lines

    return rows.mapInArrow(freed(run), schema)


def words_to_lines(words: DataFrame, span_mode: str = "reference") -> DataFrame:
    """(doc_id, page_no, line_no, text) from words (doc_id, page_no, page_width, word_idx, text, x0, x1, top, bottom).

    Every page ends with a blank line. span_mode "reference": a word is left or right of the page's middle by its
    own middle, as the reference behaves. "geometric": a word that crosses the middle by over a tenth of its width
    spans; where more words span than not, the page is one column.
    """
    return _laid_out(words, span_mode, False)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines with hyphenation rejoined across them and glyph names scrubbed; a rejoined line takes the first one's place."""
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l")).select("doc_id", T.hyphens_rejoined(F.array_join("l.text", "\n")).alias("text"))
    each = whole.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return each.select("doc_id", (F.col("line_no") + 1).alias("line_no"), T.glyphs_scrubbed(F.col("text")).alias("text"))


def latched(lines: DataFrame) -> DataFrame:
    """lines with in_refs: whether a reference heading stands at or above the line."""
    down = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("in_refs", F.max(T.is_reference_heading(F.col("text"))).over(down))


def _dropped(x: Column, skip_captions: bool) -> Column:
    drop = T.is_page_number(x) | T.is_noise(x)
    return drop | T.is_caption(x) if skip_captions else drop


def filter_lines(lines: DataFrame, skip_refs: bool = True, skip_captions: bool = True) -> DataFrame:
    """Lines without references, page numbers, captions and noise; blank lines stay."""
    x = F.col("text")
    drop = _dropped(x, skip_captions)
    if skip_refs:
        lines, drop = latched(lines), drop | F.col("in_refs")
    return lines.where((T.trimmed(x) == "") | ~drop).drop("in_refs")


def lines_to_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, para, text): runs of lines that aren't blank, trimmed and joined by a space; para counts from 1."""
    bare = lines.withColumn("text", T.trimmed(F.col("text")))
    down = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = bare.withColumn("g", F.sum((F.col("text") == "").cast("int")).over(down)).where("text <> ''")
    joined = grouped.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    order = Window.partitionBy("doc_id").orderBy("g")
    return joined.select("doc_id", F.row_number().over(order).alias("para"), F.array_join("l.text", " ").alias("text"))


def rip(words: DataFrame, skip_refs: bool = True, skip_captions: bool = True, span_mode: str = "reference") -> DataFrame:
    """Paragraphs of positioned words: all of the above in order, but from the layout on a document stays one row, so that nothing is exchanged or sorted again."""
    docs = _laid_out(words, span_mode, True)
    lines = docs.select("doc_id", F.transform(F.split(T.hyphens_rejoined(F.col("text")), "\n"), T.glyphs_scrubbed).alias("l"))
    kept = F.col("l")
    if skip_refs:
        lines = lines.select("doc_id", "l", F.array_position(F.transform("l", T.is_reference_heading), True).cast("int").alias("refs"))
        kept = F.when(F.col("refs") > 0, F.slice("l", F.lit(1), F.col("refs") - 1)).otherwise(kept)
    kept = F.filter(kept, lambda x: (x == "") | ~_dropped(x, skip_captions))
    runs = F.transform(F.split(F.array_join(kept, "\n"), "\n\n+"), lambda x: F.replace(F.btrim(x, F.lit("\n")), F.lit("\n"), F.lit(" ")))
    each = lines.select("doc_id", F.posexplode_outer(F.filter(runs, lambda x: x != "")).alias("para", "text")).where("para IS NOT NULL")
    return each.select("doc_id", (F.col("para") + 1).alias("para"), "text")


def without_paragraphs(words: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, error) of documents of which nothing is left."""
    return words.select("doc_id").distinct().join(paras.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error", F.lit("no paragraphs left"))


def paragraph_text(paras: DataFrame, key: str = "para") -> DataFrame:
    """(doc_id, text): paragraphs joined by a blank line, with a final newline."""
    joined = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(key, "text"))).alias("p"))
    return joined.select("doc_id", F.concat(F.array_join("p.text", "\n\n"), F.lit("\n")).alias("text"))
