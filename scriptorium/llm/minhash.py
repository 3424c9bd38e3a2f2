"""MinHash near-dedup with b-bit signatures, in DataFrame functions only.

A document is the set of its distinct five-word shingles. The minima of the set under bands * rows hash functions
give `bands` bucket keys of `rows` minima each; the low two bits of every minimum, packed in longs, are the b-bit
signature. Two sets that share a bucket are a candidate pair when their sizes allow the similarity and the
estimate from the bit counts of the two signatures, corrected for chance collisions, lies within six standard
deviations of it. Candidates are confirmed on the full sets.

No bucket is expanded into all its pairs. Sets that are equal become one class. In each round one member of each
bucket is paired with those of other components in it: first the member that meets the most sets in all its
buckets, then the one of those outside the bucket's largest component; rounds go on while they find links. Pairs
inside a component need no test. At last the members still outside the largest component of a bucket are paired
with those of other components with which they share a bucket and one of their rarest shingles, as every linked
pair does, at such places in the order of rarity that what follows can still reach the similarity. So the many
texts of a common passage, which share buckets but no more, make no pairs. There an exact bound comes before
the full sets: a set's parity bits tell for each of 64 * PARITY bins whether it holds an odd number of shingles,
so the bits in which two sets differ are at most the shingles that only one of them holds.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, cut, words
from scriptorium.llm.components import components

#: With 28 * 3 minima the aggregate that makes a signature has under 100 columns, beyond which Spark compiles no code for it.
BANDS, ROWS, BITS = 28, 3, 2
PARITY = 8  # longs of a set's parity bits
LANES = 30  # minima in a long of the signature


def shingle_set(w: Column, size: int = 5) -> Column:
    """Distinct hashes of the runs of `size` words of the array w; shorter arrays give one, empty ones none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    short = F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")))
    return F.when(F.size(w) >= size, F.array_distinct(runs)).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))


def estimate(matches: Column, perms: int, bits: int = BITS) -> Column:
    """Similarity from the count of equal b-bit minima, corrected for chance collisions."""
    chance = 1 / 2**bits
    return (matches / perms - chance) / (1 - chance)


def least_estimate(similarity: float, perms: int, bits: int = BITS, sigmas: float = 6) -> float:
    """The least estimate that a pair of the similarity gives, but for one beyond so many standard deviations."""
    chance = 1 / 2**bits
    p = similarity + (1 - similarity) * chance
    return similarity - sigmas * sqrt(p * (1 - p) / perms) / (1 - chance)


def _matches(a: str, b: str, longs: int, perms: int) -> Column:
    lanes = F.lit(int("01" * LANES, 2)).cast("long")
    differ = [F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(lanes)) for k in range(longs) for x in [F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))]]
    return F.lit(perms) - reduce(lambda x, y: x + y, differ)


def _salt(k: int) -> Column:
    """The long that sets the k-th hash function apart: shingles are hashes, so a mix of their bits with it gives another order."""
    return F.lit(int.from_bytes(sha256(str(k).encode()).digest()[:8], "big", signed=True))


def _minimum(k: int) -> Column:
    """The k-th minimum of the shingles x of a group; one mix serves two, which order by its upper and by its lower half."""
    mix = F.xxhash64(F.col("x").bitwiseXOR(_salt(k // 2)))
    return F.min(mix) if k % 2 else F.shiftright(F.min(F.shiftleft(mix, 32)), 32)


def _parity(k: int) -> Column:
    """The k-th long of the parity bits of the shingles x of a group."""
    return F.expr(f"bit_xor(if((shiftright(x, 6) & {PARITY - 1}) = {k}, shiftleft(1L, cast(x & 63 AS int)), 0L))").alias(f"p{k}")


def _near_enough(a: str, b: str, percent: int) -> Column:
    """Whether sets of sizes {a}n, {b}n whose parity bits differ as they do may reach the similarity; never false where they reach it."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(PARITY)])
    # of a union u at most (100 - percent) * u / 100 lie apart, and u is half of both sizes and what lies apart
    return apart * (100 + percent) <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per id and set of at least one word: id, n (size of the set), fx, fm (two longs that name the set), bands, s0.. (packed low bits), p0.. (parity bits)."""
    perms = bands * rows
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    # a set that stands twice would put each shingle in twice, and bit_xor would take it out again: the rows of
    # repeated ids are made distinct first, and the sets of an id are told apart by a hash of the whole set
    twice = cut(narrow.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))

    def sets(some: DataFrame) -> DataFrame:
        return some.select("id", words(F.col("text")).alias("w")).select("id", shingle_set(F.col("w")).alias("h"))

    # explode_outer, and the test on an aggregate: else the optimizer infers filters on h and evaluates it again inside them
    if twice.isEmpty():
        each = sets(narrow).select("id", F.size("h").alias("n"), F.lit(0).cast("long").alias("own"), F.explode_outer("h").alias("x"))
    else:
        again = sets(narrow.join(twice, "id", "left_semi")).select("id", F.array_sort("h").alias("h")).distinct()
        each = sets(narrow.join(twice, "id", "left_anti")).select("id", F.size("h").alias("n"), F.lit(0).cast("long").alias("own"), F.explode_outer("h").alias("x"))
        each = each.unionAll(again.select("id", F.size("h").alias("n"), F.xxhash64("h").alias("own"), F.explode_outer("h").alias("x")))
    mins = each.groupBy("id", "n", "own").agg(F.bit_xor("x").alias("fx"), *[_parity(k) for k in range(PARITY)], *[_minimum(k).alias(f"m{k}") for k in range(perms)]).where("fx IS NOT NULL")
    packed = [reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{k * LANES + j}").bitwiseAND(3), 2 * j) for j in range(LANES) if k * LANES + j < perms]).alias(f"s{k}") for k in range(ceil(perms / LANES))]
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)])
    return mins.select("id", "n", "fx", F.xxhash64("n", *[f"m{k}" for k in range(perms)]).alias("fm"), keys.alias("bands"), *packed, *[f"p{k}" for k in range(PARITY)])


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h): the shingle sets of the ids."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    return texts.select("id", words(F.col("text")).alias("w")).select("id", shingle_set(F.col("w")).alias("h"))


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, cut: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = cut(_sets(wanted, docs, id_col, text_col))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    met = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("both"))
    return cut(met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct())


def rare_shingles(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, cut: Scratch) -> DataFrame:
    """(id, n, g, at) of ids (id, outer): the shingles g, with their places, by which a set meets all outer ones that reach the similarity to it.

    With the shingles of every set ordered alike, here by how many of the sets hold them, two sets of that
    similarity share one of the first n - ceil(percent * n / 100) + 1 of each. Shingles of one set only, and those
    of no outer set, come first and meet nothing. So passages that very many texts share, which come last, make
    no pairs. What stands from place `at` on, counted from 0, is all that two sets that first meet there share.
    """
    each = cut(_sets(ids, docs, id_col, text_col).join(ids, "id").select("id", "outer", F.size("h").alias("n"), F.explode_outer("h").alias("g")))
    often = cut(each.groupBy("g").agg(F.count("*").alias("c"), F.max("outer").alias("outer")).where("c > 1 AND outer").select("g", "c"))
    ranked = each.join(often, "g").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("s"))
    before = F.col("n") - F.size("s")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - before
    placed = ranked.select("id", "n", before.alias("before"), F.posexplode(F.slice("s", F.lit(1), F.greatest(F.lit(0), first).cast("int"))).alias("k", "x"))
    return placed.select("id", "n", F.col("x.g").alias("g"), (F.col("before") + F.col("k")).alias("at"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS, rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each id of docs.

    Links join documents with 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest id reachable. At the similarity itself a pair shares no bucket with probability
    (1 - s^rows)^bands, 2e-7 by default.

    Null or empty texts, and texts of white space: no shingles, linked with nothing, kept. Null ids: no row.
    Rows that share an id: one row, linked as all its texts are, n_shingles of the largest. Other columns of
    docs are not read, whatever their names. No rows: no rows.
    """
    perms, longs = bands * rows, ceil(bands * rows / LANES)
    packed, parity = [f"s{k}" for k in range(longs)], [f"p{k}" for k in range(PARITY)]
    # kept for the result; for all rounds; for one round (at first: to make the buckets)
    keep, base, cut = (Scratch(docs.sparkSession) for _ in range(3))
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    every = keep(signatures(docs, id_col, text_col, bands, rows))
    classes = keep(every.groupBy("n", "fx", "fm").agg(F.min("id").alias("rep")))
    reps = every.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")

    # of each id the keys of its buckets that hold others, and how many it meets there in all: the id that meets the
    # most stands nearest to the middle of a group of copies, and is the best one to pair with all
    member = reps.select("id", F.explode("bands").alias("key"))
    crowded = cut(member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    member = base(member.join(crowded, "key").groupBy("id").agg(F.collect_list("key").alias("keys"), F.sum("c").alias("w")))
    signed = base(reps.join(member.select("id"), "id", "left_semi").select("id", "n", "bands", *packed, *parity))
    cut.drop()

    least = least_estimate(percent / 100, perms)
    plausible = (100 * F.least("ln", "rn") >= percent * F.greatest("ln", "rn")) & (estimate(_matches("ls", "rs", longs, perms), perms) >= least)

    def linked(pairs: DataFrame, exact: bool = False) -> DataFrame:
        """Those of the pairs (a, b) that are links; exact: pairs that share a bucket only, and tested by parity bits too."""
        facts = ("n", *packed, *((*parity, "bands") if exact else ()))
        both = pairs
        for end, mark in (("a", "l"), ("b", "r")):
            both = both.join(signed.select(F.col("id").alias(end), *[F.col(c).alias(mark + c) for c in facts]), end)
        likely = plausible & _near_enough("l", "r", percent) & F.arrays_overlap("lbands", "rbands") if exact else plausible
        found = cut(both.where(likely).select("a", "b"))
        return found if found.isEmpty() else _confirmed(found, docs, id_col, text_col, percent, cut)

    def ordered(met: DataFrame) -> DataFrame:
        return met.select(F.least("lid", "rid").alias("a"), F.greatest("lid", "rid").alias("b")).distinct()

    def sided(rows: DataFrame, on: str, mark: str) -> DataFrame:
        return rows.select(on, *[F.col(c).alias(mark + c) for c in rows.columns if c != on])

    twice = every.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    links = keep(every.join(twice, "id", "left_semi").join(classes, ["n", "fx", "fm"]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    labels = keep(components(links, cut=cut))
    cut.drop()
    last = rounds == 0
    for turn in range(rounds + 1):
        cut = Scratch(docs.sparkSession)
        named = cut(member.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), "w", F.explode("keys").alias("key")))
        counts = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
        mixed = cut(counts.groupBy("key").agg(F.max_by("comp", "c").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main"))
        # outside a bucket's largest component: at first all, as every member is its own
        apart = named if turn == 0 else cut(named.join(mixed, "key").where("comp != main").drop("main"))
        if turn and apart.isEmpty():
            cut.drop()
            break
        if not last:  # one member of each bucket with all others
            rank = F.shiftleft("w", 16) + F.pmod(F.hash("id"), F.lit(65536))
            hub = apart.groupBy("key").agg(F.max_by("id", rank).alias("lid"), F.max_by("comp", rank).alias("lcomp"))
            met = cut(hub).join(sided(named.select("key", "id", "comp"), "key", "r"), "key")
            more = linked(cut(ordered(met.where("lcomp != rcomp"))))
        else:  # what is still apart with all others: every pair of different components
            outer = cut(apart.select("id").distinct())
            pool = cut(named.join(mixed, "key", "left_semi").select("id", "comp").distinct().join(outer.withColumn("outer", F.lit(True)), "id", "left").fillna(False, "outer"))
            rare = cut(rare_shingles(pool.select("id", "outer"), docs, id_col, text_col, percent, cut).join(pool, "id"))
            met = sided(rare.where("outer"), "g", "l").join(sided(rare, "g", "r"), "g")
            # all that a pair shares stands from its first common shingle on
            reaches = (100 + percent) * F.least(F.col("ln") - F.col("lat"), F.col("rn") - F.col("rat")) >= percent * (F.col("ln") + F.col("rn"))
            more = linked(cut(ordered(met.where((F.col("lcomp") != F.col("rcomp")) & reaches))), exact=True)
        if more.isEmpty():
            done, last = last, True
        else:
            links = keep(links.union(more))
            labels = keep(components(links, labels, cut))
            done, last = last, turn + 1 == rounds
        cut.drop()
        if done:
            break

    placed = keep(classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("n", "fx", "fm", F.coalesce("comp", "rep").alias("comp")))
    base.drop()
    found = every.select("id", "n", "fx", "fm").join(placed, ["n", "fx", "fm"]).select("id", F.col("n").cast("long").alias("n"), "comp")
    bare = ids.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("comp"))
    whole = found.union(bare).groupBy("id").agg(F.max("n").alias("n_shingles"), F.min("comp").alias("component_id"))
    return whole.select("id", "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
