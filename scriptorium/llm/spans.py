"""Spans of regular-expression matches, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<s:int,e:int,m:string>>"


def pieces(text: Column, regex: str) -> Column:
    """What lies before, between and after the leftmost non-overlapping matches."""
    return F.split(text, regex, -1)


def matches(text: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once: what a lambda only captures is else evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(a, start, n), F.lit(0), lambda x, y: x + y)


def located(piece: Column, match: Column) -> Column:
    """The matches with start and end in code points; end exclusive. Lengths are summed by blocks: n matches take n * BLOCK steps."""

    def found(z: Column, lengths: Column, before: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            s = F.get(before, block) + _sum(lengths, block * BLOCK + 1, i % BLOCK) + F.length(F.get(z["p"], i))
            return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"))

        return F.transform(z["m"], one)

    def blocks(z: Column, lengths: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: _sum(lengths, b * BLOCK + 1, F.lit(BLOCK)))
        return let(sums, lambda t: let(F.transform(t, lambda _, b: _sum(t, F.lit(1), b)), lambda before: found(z, lengths, before)))

    def both(z: Column) -> Column:
        return let(F.zip_with(z["p"], z["m"], lambda x, y: F.length(x) + F.coalesce(F.length(y), F.lit(0))), lambda lengths: blocks(z, lengths))

    return let(F.struct(piece.alias("p"), match.alias("m")), both)


def none() -> Column:
    return F.array().cast(SPAN)


def long_enough(found: Column, size_of: Column, least: int) -> Column:
    """The spans whose entry of size_of has at least so many characters."""
    return let(size_of, lambda sizes: F.filter(found, lambda x, i: F.length(F.get(sizes, i)) >= least))


def listing(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans by start, then by the order of kinds, comma-joined."""

    def ranked(k: int, kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    each = F.array_sort(F.concat(*[ranked(k, kind, found) for k, (kind, found) in enumerate(kinds)]))
    return F.array_join(F.transform(each, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
