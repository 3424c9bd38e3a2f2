"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: a match must contain them. The index
holds postings (trigram, key) for the trigrams that some query names; key is a hash of the text, so that equal
texts share their postings and no numbering of documents is needed. It is written once, a segment for each task in
order of trigrams. A query is a union of conjunctions; a conjunction's posting lists are intersected by gathering
them by key, where a key stays if it has met every list, so that a trigram that most texts hold is spread over all
tasks. Candidates are verified with the expression itself on the texts of their keys, so that keys that collide
only add candidates; a rule whose query is empty (no mandatory trigram) scans every text.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import spans
from scriptorium.llm.common import Scratch

MANY = 24  # exact strings kept before they turn into trigrams
MOST = 62  # lists of a conjunction that are intersected: as many as a long has bits to spare; what more a query asks for, verification tests


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group: whose length must reach least, else the match is dropped. base: counted by kind."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    base: bool = False


#: A private key in PEM: to its END line; where that is missing, over its header fields and lines of base64.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nrt])*+(?:(?:Proc-Type|DEK-Info):[^\n]*+|[A-Za-z0-9+/]{16,}+={0,2}+))*+(?:[\r\n]++[A-Za-z0-9+/]{1,15}+={0,2}+(?![^\r\n]))?+)"
)

#: The base kinds in order, then formats of credentials as their issuers publish them.
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("basic_url", r"://[A-Za-z0-9._~-]{1,64}:[A-Za-z0-9._~!$-]{3,64}@"),
]

# A Boolean query: None (anything), ("tri", t), ("and", [...]) or ("or", [...])


def _all(parts: list) -> tuple | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list) -> tuple | None:
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> tuple | None:
    return _any([_all([("tri", t) for t in sorted({x[i : i + 3] for i in range(len(x) - 2)})]) for x in sorted(strings)])


def _walk(items: list) -> tuple[set[str] | None, tuple | None]:
    """(all strings that the items match, if few; what each match must contain)."""
    exact, need = {""}, []

    def flush() -> None:
        nonlocal exact
        need.append(_of_strings(exact))
        exact = {""}

    for op, arg in items:
        own, also = None, None
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            own = {chr(v).lower() for _, v in arg}
        elif op is C.SUBPATTERN:
            own, also = _walk(list(arg[-1]))
        elif op is C.BRANCH:
            found = [_walk(list(x)) for x in arg[1]]
            if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MANY:
                own = set().union(*[e for e, _ in found])
            also = _any([q if q is not None else _of_strings(e) if e else None for e, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            e, q = _walk(list(inner))
            if low == 0 and high == 1 and e is not None:
                own = e | {""}
            elif low == high == 1:
                own, also = e, q
            elif low > 0:
                also = q if q is not None else _of_strings(e) if e else None
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if own is not None and len(exact) * len(own) <= MANY:
            exact = {a + b for a, b in product(exact, own)}
        else:
            flush()
            if own is not None:
                exact = set(own)
            else:
                need.append(also)
    if not need:
        return exact, _of_strings(exact)
    flush()
    return None, _all(need)


def trigram_query(regex: str) -> tuple | None:
    """What lower-cased trigrams every match of the expression contains; None if none is mandatory."""
    return _walk(list(parser.parse(regex)))[1]


def _leaves(q: tuple | None) -> set[str]:
    return set() if q is None else {q[1]} if q[0] == "tri" else set().union(*[_leaves(x) for x in q[1]])


def trigrams(rules: list[Rule]) -> list[str]:
    return sorted(set().union(*[_leaves(trigram_query(r.regex)) for r in rules]))


def conjunctions(q: tuple | None) -> list[frozenset[str]]:
    """The query as a union of conjunctions of trigrams, without those that another one implies."""
    if q is None:
        return []
    if q[0] == "tri":
        return [frozenset([q[1]])]
    parts = [conjunctions(x) for x in q[1]]
    found = {c for p in parts for c in p} if q[0] == "or" else {frozenset().union(*some) for some in product(*parts)}
    return sorted((c for c in found if not any(d < c for d in found)), key=sorted)


def terms(rules: list[Rule]) -> list[tuple[str, int, int, int, int]]:
    """(trigram, rule, conjunction, the list's bit, the bits of all lists of the conjunction) of the rules' queries."""
    out, n = [], 0
    for k, r in enumerate(rules):
        for c in conjunctions(trigram_query(r.regex)):
            lists = sorted(c)[:MOST]
            out += [(t, k, n, 1 << i, (1 << len(lists)) - 1) for i, t in enumerate(lists)]
            n += 1
    return out


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def postings(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(trigram, key): the inverted index, for trigrams that some rule's query names; texts are compared in lower case."""
    low = docs.select(F.xxhash64(_text(text_col)).alias("key"), F.lower(_text(text_col)).alias("low"))
    held = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams(rules)]
    return low.select(F.explode(F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")).alias("trigram"), "key")


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(key, rules): of each key that satisfies a rule's query the rules, a bit for each."""
    asked = index.sparkSession.createDataFrame(terms(rules), "trigram string, rule int, conjunction int, bit long, every long")
    # a few rows for each rule: its size is that of the rules
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "conjunction", "rule", "every").agg(F.bit_or("bit").alias("bits"))
    bit = F.expr("shiftleft(1L, rule)")
    return met.where("bits = every").groupBy("key").agg(F.bit_or(bit).alias("rules"))


def find_secrets(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """docs with secrets: a struct of, for each kind, its spans (s, e, m: start and end in code points, the text matched).

    Null text: as an empty one, no spans. Every row is judged alone, so null or repeated ids and other columns
    are passed through; a column of docs named secrets is replaced. No rows: no rows.
    """
    cut, keep = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    index = cut(postings(docs, text_col, rules).sortWithinPartitions("trigram"))
    found = keep(candidates(index, rules).select(F.col("key").alias("__key"), F.col("rules").alias("__rules")))
    cut.drop()
    out = docs.withColumn("__text", _text(text_col)).withColumn("__key", F.xxhash64("__text")).join(found, "__key", "left")

    def may(k: int, r: Rule) -> Column:
        asked = F.lit(True) if trigram_query(r.regex) is None else F.coalesce("__rules", F.lit(0)).bitwiseAND(F.lit(1 << k).cast("long")) != 0
        return asked & F.col("__text").rlike(r.regex)

    out = out.withColumn("__may", F.struct(*[may(k, r).alias(r.kind) for k, r in enumerate(rules)]))
    steps = {}
    for r in rules:
        held = F.col(f"__may.{r.kind}")
        steps[f"__p_{r.kind}"] = F.when(held, spans.pieces(F.col("__text"), r.regex))
        steps[f"__m_{r.kind}"] = F.when(held, spans.matches(F.col("__text"), r.regex))
        if r.group:
            steps[f"__g_{r.kind}"] = F.when(held, spans.matches(F.col("__text"), r.regex, r.group))
    out = out.withColumns(steps)
    kept = []
    for r in rules:
        p, m = F.col(f"__p_{r.kind}"), F.col(f"__m_{r.kind}")
        found = spans.located(p, m)
        size = F.col(f"__g_{r.kind}") if r.group else m
        if r.least:
            found = spans.long_enough(found, size, r.least)
        kept.append(F.when(F.col(f"__may.{r.kind}"), found).otherwise(spans.none()).alias(r.kind))
    return out.withColumn("secrets", F.struct(*kept)).drop("__text", "__key", "__rules", "__may", *steps)


def digest(found: DataFrame, id_col: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_<kind>.. of base kinds, base_sha256, spans) from what find_secrets returns."""
    base = [(r.kind, F.col(f"secrets.{r.kind}")) for r in rules if r.base]
    every = base + [(r.kind, F.col(f"secrets.{r.kind}")) for r in rules if not r.base]
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in base]
    return found.select(F.col(id_col).alias("doc_id"), *counts, F.sha2(spans.listing(base), 256).alias("base_sha256"), spans.listing(every).alias("spans"))
