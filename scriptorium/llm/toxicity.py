"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a general lexicon of insults and of one mined from the training texts
(words, and beginnings of words for languages that inflect or compound), how near lexicon words stand to a second person, capitals, punctuation and obfuscation (digits or symbols
inside words, letters held, letters spaced out). The model is fitted on the driver on a sample of `sample`
labelled training rows at most, the first by hash; its features are small rows of numbers. Scores of all
documents are computed on the executors. A margin is calibrated on cross-fitted margins of the sample.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.boosting import Isotonic, Trees
from scriptorium.llm.common import Scratch, cut, first_by_hash, freed, small_batches

SAMPLE = 20_000  # labelled rows fitted on, at most
FOLDS = 3
TERMS = 100_000  # terms that a task counts before it hands the counts on
STEMS = (4, 5, 6, 7)  # letters of the word beginnings that are mined beside whole words

#: General words of abuse in English, German, French and Spanish.
LEXICON = frozenset(
    """arse arsehole ass asshole bastard bitch bloody bollocks bullshit clown coward creep crap cretin cunt damn dick dickhead dimwit dipshit disgusting
    douchebag dumb dumbass dunce filth filthy fool freak fuck fucked fucker fucking garbage goddamn halfwit hate hateful hideous hypocrite idiot idiotic
    idiots ignorant imbecile inferior jackass jerk kill lazy liar loser losers lowlife lunatic maggot moron moronic motherfucker numbskull nutjob pathetic
    parasite pig piss prick psycho rat repulsive retard rotten savage scum scumbag shit shithead shitty sick sissy slob slut snake stupid sucks thug toxic
    traitor trash troll twat ugly useless vermin vile wanker weirdo whore worthless wretch
    abschaum arsch arschloch blöd blödmann depp drecksack dumm dummkopf fotze hure hurensohn idioten mistkerl missgeburt scheiße schlampe schwein
    trottel verdammt versager wertlos widerlich wichser
    abruti batard bâtard con connard connasse crétin débile dégage dégoûtant enculé idiote imbécile merde minable ordure pathétique pourri pute salaud
    salope stupide
    asco asqueroso basura bastardo cabrón cerdo cobarde estúpida estúpido gilipollas idiotas imbécil inútil maldito mierda miserable pendejo perra puta
    puto repugnante tonto zorra""".split()
)
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos usted ustedes tus ti vosotros".split())
NAMES = ["lexicon", "lexicon_log", "mined", "mined_log", "mined_weight", "stems", "stems_log", "stem_weight", "near_second", "second", "capitals", "shouted", "exclaim", "punct", "digits_inside", "symbols_inside", "held", "spaced", "words_log", "word_length", "symbols"]

_TOKEN = re.compile(r"[^\W_]+(?:[*@$!1034]+[^\W_]+)*")
_INSIDE_DIGIT = re.compile(r"[^\W\d_][0134]+[^\W\d_]")
_INSIDE_SYMBOL = re.compile(r"[^\W\d_][*@$!#]+[^\W\d_]")
_HELD = re.compile(r"([^\W\d_])\1{2}")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-]){3}")
_LEET = str.maketrans("013457@$!", "oieastasi")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def terms(text: str) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    own = {t for t in tokens(text) if t.isalpha() and len(t) > 2}
    return own | {t[:k] + "*" for t in own for k in STEMS if len(t) > k}


class Mined:
    """A mined lexicon, laid out for lookups: words, beginnings, and what all beginnings begin with."""

    def __init__(self, weights: dict[str, float]):
        self.words = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.heads = {t[: STEMS[0]] for t in self.stems}

    def word(self, t: str) -> tuple[float | None, bool]:
        """Of a word, as written or with its digits and symbols read as letters: its weight, if it is mined, and whether the general lexicon holds it."""
        if t not in self.words and t not in LEXICON and not t.isalpha():
            t = t.translate(_LEET)
        return self.words.get(t), t in LEXICON

    def beginning(self, t: str) -> float:
        """The greatest weight of a beginning of the word."""
        return max((self.stems.get(t[:k], 0.0) for k in STEMS if len(t) > k), default=0.0) if t[: STEMS[0]] in self.heads else 0.0


def features(text: str | None, mined: Mined) -> list[float]:
    """The numbers of NAMES."""
    text = text or ""
    found = tokens(text)
    n = max(1, len(found))
    distinct = set(found)
    known = {}
    second = distinct & SECOND
    lexicon = hits = near = stems = 0
    weight = stem_weight = 0.0
    for t in distinct:
        own = mined.word(t)
        if own[0] is not None or own[1]:
            known[t] = own
        if w := mined.beginning(t):
            stems += (c := found.count(t))
            stem_weight += w * c
    seconds = sum(map(found.count, second))
    if known:  # most texts hold none
        hit_at = []
        for i, t in enumerate(found):
            if t in known:
                w, own = known[t]
                lexicon += own
                hits += w is not None
                weight += w or 0.0
                hit_at.append(i)
        if second:
            at = np.flatnonzero(np.fromiter((t in second for t in found), bool, len(found)))
            h = np.array(hit_at)
            near = int((np.searchsorted(at, h + 5, "right") - np.searchsorted(at, h - 5, "left")).sum())
    size = max(1, len(text))
    letters = max(1, sum(map(len, found)))
    upper = sum(map(text.count, string.ascii_uppercase))
    return [lexicon / n, np.log1p(lexicon), hits / n, np.log1p(hits), weight, stems / n, np.log1p(stems), stem_weight / n, near / n, seconds / n, upper / letters, sum(1 for x in text.split() if len(x) > 2 and x.isupper()) / n, text.count("!") / n, sum(map(text.count, ".,;:?")) / n, len(_INSIDE_DIGIT.findall(text)) / n, len(_INSIDE_SYMBOL.findall(text)) / n, len(_HELD.findall(text)) / n, len(_SPACED.findall(text)) / n, np.log1p(len(found)), letters / n, sum(map(text.count, "#$%&*|")) / size]


def mine(words: DataFrame, toxic: int, clean: int, least: int = 5, z: float = 4.0) -> dict[str, float]:
    """Every word whose log odds of standing in a toxic text exceed z standard errors; words: word, t, c (texts of each kind that hold it)."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))
    error = F.sqrt(1 / (t + 0.5) + 1 / (toxic - t + 0.5) + 1 / (c + 0.5) + 1 / (clean - c + 0.5))
    strong = words.where(t >= least).select("word", odds.alias("odds"), error.alias("error")).where(F.col("odds") >= z * F.col("error"))
    return {r["word"]: round(r["odds"], 6) for r in strong.orderBy("word").collect()}


def term_counts(batches: Iterator[pa.RecordBatch], most: int = TERMS) -> Iterator[pa.RecordBatch]:
    """(word, t, c) of batches (text, y): in how many toxic and other texts a term stands, to be summed by term, as counts go out whenever `most` are held."""
    t, c = Counter(), Counter()

    def out() -> Iterator[pa.RecordBatch]:
        every = list(t.keys() | c.keys())
        for i in range(0, len(every), 50_000):
            some = every[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([t[w] for w in some], pa.int64()), pa.array([c[w] for w in some], pa.int64())], names=["word", "t", "c"])
        t.clear()
        c.clear()

    for part in batches:
        for text, y in zip(part.column(0), part.column(1), strict=True):
            (t if y.as_py() else c).update(terms(text.as_py()))
            if len(t) + len(c) >= most:
                yield from out()
    yield from out()


def fit(training: DataFrame, text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], Trees, Isotonic]:
    """(mined lexicon, trees, calibration) from labelled rows, of which the caller bounds the number; null labels are left out. No rows: a constant score."""
    labelled = training.where(F.col(label_col).isNotNull()).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.col(label_col) > 0).cast("int").alias("y"))
    rows = labelled.withColumn("o", F.xxhash64("text", "y"))

    rows = cut(rows)
    by_class = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = by_class.get(1, 0), by_class.get(0, 0)
    counted = rows.select("text", "y").mapInArrow(freed(term_counts), "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    mined = mine(counted, toxic, clean)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Mined(mined)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([features(t.as_py(), words) for t in part.column(2)], pa.list_(pa.float64()))], names=["o", "y", "f"])

    got = rows.select("o", "y", "text").mapInArrow(freed(dense), "o long, y int, f array<double>").toPandas().sort_values(["o", "y"])
    x = np.array(got.f.tolist(), dtype=float).reshape(len(got), len(NAMES))
    y = got.y.to_numpy(float)
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            margins[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return mined, Trees().fit(x, y), Isotonic().fit(margins, y)


def score(docs: DataFrame, model: tuple[dict[str, float], Trees, Isotonic], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null text: as an empty one."""

    mined, trees, calibration = model

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Mined(mined)
        for part in batches:  # by Arrow: ids keep their type beside nulls
            x = np.array([features(t.as_py(), words) for t in part.column(1)], dtype=float).reshape(part.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(calibration.predict(trees.margin(x)), 0, 1), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(freed(scored), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs; labels (id, toxic) teach, but for those held out.

    Null or empty text: scored as one of no words. Null ids: scored, never taught from. Repeated ids: each row has
    its score; the least text is taught from. Several labels of an id: each a row, repeated ones once. Other columns of docs are not read, whatever their names.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & ~held_out("id"))
    # chosen among the narrow labels, the first by hash: the same however rows are dealt, and no text is shuffled for it;
    # the chosen are `sample` rows at most, which is the proven bound of what is broadcast
    chosen = cut(first_by_hash(known.distinct(), sample, "id", "y"))
    # a repeated id is taught from once
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    training = texts.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(chosen), "id")
    with small_batches(docs.sparkSession):
        model = fit(training, "text", "y")
        # written once, as the size of a batch holds for what is computed here
        scores = Scratch(docs.sparkSession)(score(docs, model, id_col, text_col))
    return scores.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
