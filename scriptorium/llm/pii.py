"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They seed the bootstrap: every
token that holds a digit or an at sign is an instance, the lower-cased word before it and the word after it
are its lexical patterns. Over all documents the graph of patterns and instances is scored in rounds: a
pattern's confidence is the mean confidence of its distinct instances, shrunk by `doubt` imaginary ones of
none; an instance's confidence is the noisy-or of its patterns', and stays one for seeds. Tokens of a
confident pattern that no base span touches are identifiers found by context (kind "context").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import spans
from scriptorium.llm.common import NOT_WORD, cut

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"

#: The base kinds in order. A possessive quantifier stands where what follows can't match what it
#: holds, so that the matches are the same and no text, however long, needs a stack or quadratic time; a
#: match that fails at the start of a run of characters fails at its later ones too, and \G is where the last ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: from the start of a word, holding a digit or an at sign.
TOKEN = rf"(?<![^{NOT_WORD}])[^{NOT_WORD}0-9@]*+[0-9@][^{NOT_WORD}]*+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base (a struct of, for each kind, its spans) and tokens (spans s, e, m with before, after: the neighbouring words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__text", text)
    may = {"email": F.contains("__text", F.lit("@")), "phone": F.contains("__text", F.lit("+"))} | dict.fromkeys(("ip", "card"), F.col("__text").rlike("[0-9]"))
    out = out.withColumn("__may", F.struct(*[(c & F.col("__text").rlike(BASE[k])).alias(k) for k, c in may.items()], F.col("__text").rlike("[0-9@]").alias("token")))
    steps = {}
    for k, regex in [*BASE.items(), ("token", TOKEN)]:
        steps[f"__p_{k}"] = F.when(F.col(f"__may.{k}"), spans.pieces(F.col("__text"), regex))
        steps[f"__m_{k}"] = F.when(F.col(f"__may.{k}"), spans.matches(F.col("__text"), regex))
    out = out.withColumns(steps)

    def kept(kind: str) -> Column:
        found = F.filter(spans.located(F.col(f"__p_{kind}"), F.col(f"__m_{kind}")), lambda x: _passes(kind, x["m"]))
        return F.when(F.col(f"__may.{kind}"), found).otherwise(spans.none()).alias(kind)

    blank = lambda p: F.translate(p, "\t\n\x0b\x0c\r", "     ")
    words_before = lambda p: F.substring_index(F.rtrim(blank(p)), " ", -1)
    words_after = lambda p: F.substring_index(F.ltrim(blank(p)), " ", 1)

    def with_words(piece: Column) -> Column:
        return F.transform(spans.located(piece, F.col("__m_token")), lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lower(words_before(F.get(piece, i))).alias("before"), F.lower(words_after(F.get(piece, i + 1))).alias("after")))

    tokens = spans.let(F.col("__p_token"), with_words)
    nothing = F.array().cast("array<struct<s:int,e:int,m:string,before:string,after:string>>")
    out = out.withColumn("base", F.struct(*[kept(k) for k in BASE])).withColumn("tokens", F.when(F.col("__may.token"), tokens).otherwise(nothing))
    return out.drop("__text", "__may", *steps)


def confident_patterns(graph: DataFrame, rounds: int = 3, least: float = 0.8, doubt: float = 1.0, support: int = 3) -> DataFrame:
    """pattern, p: the patterns whose confidence reaches least, with at least `support` distinct seeds among their instances.

    graph: distinct (pattern, instance, seed). A seed counts as certain in every round.
    """
    nodes = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("c"))
    edges = cut(graph.select("pattern", "instance", "seed").join(cut(nodes.withColumn("fixed", F.col("c") == 1.0)), "instance"))
    strong = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), (F.sum("c") / (F.count("*") + doubt)).alias("p"))
    for _ in range(rounds - 1):
        scored = cut(strong.where(F.col("seeds") >= support).select("pattern", F.least("p", F.lit(0.999)).alias("p")))
        spread = cut(edges.where("NOT fixed").select("pattern", "instance").join(scored, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("p"))))).alias("new")))
        now = edges.select("pattern", "instance", "seed", "c", "fixed").join(spread, "instance", "left").select("pattern", "seed", F.when(F.col("fixed"), F.col("c")).otherwise(F.coalesce("new", F.lit(0.0))).alias("c"))
        strong = now.groupBy("pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), (F.sum("c") / (F.count("*") + doubt)).alias("p"))
    return strong.where((F.col("seeds") >= support) & (F.col("p") >= least)).select("pattern", "p")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least: float = 0.8, support: int = 3) -> DataFrame:
    """(id, base, context): base is a struct of, for each base kind, its spans (s, e: code points, end exclusive;
    m: the text); context are the spans that confident patterns add.

    Null text: as an empty one. Null and repeated ids: each row has its own result. Other columns of docs are
    not read, whatever their names. No rows: no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # what the contexts add follows from the text alone, so its digest names it
    found = cut(base_spans(rows.withColumn("row", F.unhex(F.md5(F.col("text").cast("binary")))), "text").select("id", "row", "base", "tokens"))
    covered = F.concat(*[F.transform(F.col(f"base.{k}"), lambda x: F.struct("id", x["s"].alias("s"), x["e"].alias("e"))) for k in BASE])
    seen = found.where(F.size("tokens") > 0).select("row", covered.alias("covered"), F.explode("tokens").alias("t"))
    token = cut(
        seen.select("row", "t.*", F.exists("covered", lambda x: (x["s"] < F.col("t.e")) & (x["e"] > F.col("t.s"))).alias("seed"))
        .select("row", "s", "e", F.lower("m").alias("instance"), "m", "seed", F.explode(F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit(">"), "after"))).alias("pattern"))
        .where("length(pattern) > 1")
    )
    graph = token.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    strong = cut(confident_patterns(graph, rounds, least, support=support))
    new = token.where("NOT seed").select("row", "s", "e", "m", "pattern").join(strong, "pattern").select("row", "s", "e", "m").distinct()
    gained = cut(new.groupBy("row").agg(F.collect_list(F.struct("s", "e", "m")).alias("context")))
    return found.select("id", "row", "base").join(gained, "row", "left").select("id", "base", F.coalesce("context", spans.none()).alias("context"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_<kind>.., base_sha256, spans, n_context) from what find_pii returns."""
    base = [(k, F.col(f"base.{k}")) for k in BASE]
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spans.listing(base), 256).alias("base_sha256"), spans.listing([*base, ("context", F.col("context"))]).alias("spans"), F.size("context").cast("long").alias("n_context"))
