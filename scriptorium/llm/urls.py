"""URL filters: rules first, then naive Bayes over words that a Viterbi search finds in hosts and paths.

Concatenated names are split into words by the best sum of unigram log probabilities. The unigram counts are of
all words of all pages' texts and URLs; of these the ones that stand somewhere in a name are joined to it in Spark,
so that neither vocabulary nor tokens pass through the driver or have a bound. Words of over LONGEST letters are no
part of the unigram model: a name is split into words of at most so many. The naive Bayes classifier learns from
the verdicts of the rules over all URLs that they decide: its counts are sums over all of those, smoothed by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, flat_mapped

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
LONGEST = 24  # letters of a word of the unigram model, at most


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*+://([^/?#]*+)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)(?:(?!://).)*+://[^/?#]*+([^?#]*+)", 1)


def ruled(h: Column, p: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or above it and whose path begins the URL's; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(w, n): the words of letters of all texts and URLs, lower-cased, with their counts."""
    text = F.lower(F.concat_ws(" ", F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "<[^>]*+>", " "), F.coalesce(F.col(url_col).cast("string"), F.lit(""))))
    each = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<!\p{L})\p{L}++"), F.lit(0))).alias("w"))
    return each.where(F.length("w") <= LONGEST).groupBy("w").agg(F.count("*").alias("n"))


def split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The best split of a name by unigram log probability; letters that no word covers stand together at a price by length."""
    unseen = log(1 / total)
    score = {w: log(n / total) for w, n in counts.items()}
    best, back = [0.0], [0]
    for e in range(1, len(name) + 1):
        # of equal scores the longest last word
        found = max((best[s] + score.get(name[s:e], unseen - 2 * (e - s)), -s) for s in range(max(0, e - LONGEST), e))
        best.append(found[0])
        back.append(-found[1])
    out, e = [], len(name)
    while e:
        out.append(name[back[e] : e])
        e = back[e]
    return out[::-1]


def pieces(name: str) -> set[str]:
    """What of a name may be a word."""
    return {name[s:e] for s in range(len(name)) for e in range(s + 1, min(len(name), s + LONGEST) + 1)}


def runs(host: str, path: str) -> Iterator[tuple[int, str, str, bool]]:
    """(place, mark, run, whether of letters): the runs of letters and of digits of a host, marked h:, and a path, marked p:; numbers by their number of digits."""
    at = 0
    for mark, text in (("h:", host), ("p:", path.lower())):
        start = 0
        for k in range(len(text) + 1):
            ends = k == len(text) or not text[k].isalnum() or (k > start and text[k].isdigit() != text[k - 1].isdigit())
            if ends and k > start:
                number = text[start].isdigit()
                yield at, mark, "9" * min(k - start, 8) if number else text[start:k], not number
                at += 1
            if ends:
                start = k if k < len(text) and text[k].isalnum() else k + 1


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct names (run), split by the counts (w, n)."""
    total = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    may = flat_mapped(names, ["run"], ["run"], "w string", lambda: lambda run: ((x,) for x in pieces(run)))
    known = may.join(counts, "w").groupBy("run").agg(F.collect_list("w").alias("ws"), F.collect_list("n").alias("ns"))

    def best() -> Callable:
        return lambda run, ws, ns: [(split(run, dict(zip(ws or (), ns or (), strict=True)), total),)]

    return flat_mapped(names.join(known, "run", "left"), ["run"], ["run", "ws", "ns"], "words array<string>", best)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, words, margin); margin: the classifier's log odds of block, above 0 a block where no rule decides.

    Null URLs and those without ://: empty host and path, judged by the prior. Null and repeated ids: each row has
    its verdict. Where no rule decides any URL, every other is allowed. Other columns are not read. No rows: no rows.
    Host and path decide a verdict, so each pair of them is judged once; margins are summed in the order of words.
    """
    cut, keep = Scratch(pages.sparkSession), Scratch(pages.sparkSession)
    h, p = host(F.col(url_col).cast("string")), path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), h.alias("host"), p.alias("path"))
    urls = cut(rows.groupBy("host", "path").agg(F.count("*").alias("urls")))
    rule, ruled_as = ruled(F.col("host"), F.col("path"), rules)
    parts = cut(flat_mapped(urls.withColumn("ruled", ruled_as), ["host", "path", "urls", "ruled"], ["host", "path"], "at int, mark string, run string, letters boolean", lambda: runs))
    names = cut(parts.where("letters").select("run").distinct())
    split_as = cut(segmented(names, cut(word_counts(pages, url_col, html_col))))
    words = F.when(F.col("letters"), F.col("words")).otherwise(F.array("run"))
    tokens = cut(parts.join(split_as, "run", "left").select("host", "path", "urls", "ruled", "at", F.posexplode(F.transform(words, lambda w: F.concat("mark", w))).alias("k", "token")))

    # the classifier: how many URLs of each verdict hold each token, repeats counted
    by = {v: F.coalesce(F.sum(F.when(F.col("ruled") == v, F.col("urls"))), F.lit(0)) for v in ("block", "allow")}
    prior = urls.withColumn("ruled", ruled_as).agg(by["block"].alias("b"), by["allow"].alias("a")).first()
    counted = cut(tokens.where("ruled IS NOT NULL").groupBy("token").agg(by["block"].alias("b"), by["allow"].alias("a")))
    sums = counted.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    tb, ta = sums["b"] + sums["n"] + 1, sums["a"] + sums["n"] + 1
    weight = counted.select("token", (F.log((F.col("b") + 1) / tb) - F.log((F.col("a") + 1) / ta)).alias("weight"))
    weighed = tokens.join(weight, "token", "left").groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("at", "k", "token", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("t"))
    margins = keep(weighed.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.array_join("t.token", " ").alias("words"), F.aggregate("t.weight", F.lit(0.0), lambda x, w: x + w).alias("margin")))
    cut.drop()
    start = log((prior["b"] + 1) / (prior["a"] + 1))
    out = rows.join(margins, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").withColumn("margin", F.lit(start) + F.coalesce("margin", F.lit(0.0)))
    verdict = F.coalesce(ruled_as, F.when((F.col("margin") > 0) & F.lit(prior["b"] + prior["a"] > 0), "block").otherwise("allow"))
    return out.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.coalesce("words", F.lit("")).alias("words"), "margin")
