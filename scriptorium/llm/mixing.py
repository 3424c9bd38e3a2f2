"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Each source's documents are dealt by hash into at most `blocks` blocks, permuted by hash. A source's target
asks for whole passes over its blocks and a part of one more, which ends with part of a block, taken document
by document; that gives the source's exact quota of block draws. A binary tree splits the quotas among output
shards: at a node the left half's quota of each source is drawn from the hypergeometric distribution given
what the earlier sources left, so that the counts of a shard are distributed as if all draws were shuffled.
A shard draws the next blocks of each source's permutation, so draws are disjoint, and shuffles locally.
The tree sees numbers of blocks only; its size depends on sources and shards, not on documents. Sources are split
in groups first, so that very many of them make no long array.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, word_count
from scriptorium.llm.spans import let

#: Weights of the sources in order of name, repeating.
WEIGHTS = (5, 2, 1)
BLOCKS, SHARDS, LIMIT = 4096, 16, 3
WIDTH = 1024  # sources of a group
SIGMAS = 9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT, share: float = 1.0) -> DataFrame:
    """(source, source_size, docs (rows), target) from (source, size): share of all sizes by weight, no source above limit times its own.

    Sources by code point, null last. What a target exceeds its limit by is shared by weight among the rest
    until none is above: with caps c and weights w in order of c / w, the first k sources are capped where
    the level (total - sum of their caps) / (sum of the other weights) reaches the next c / w.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = one.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(limit))
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    levelled = (
        weighed.withColumn("total", total)
        .withColumn("done", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("done")) / F.col("left"))
        .withColumn("free", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")))
        .withColumn("water", F.first("free", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return levelled.select("source", "source_size", "docs", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series shifted by 8 so that it is exact to 1e-10 for all n >= 0."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - F.log(reduce(lambda a, b: a * b, [n.cast("double") + k for k in range(1, 9)]))


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """The u-quantile of how many of `drawn` items out of `total` are among its `good` ones, by inversion."""
    mean = drawn.cast("double") * good / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (1 - good / F.greatest(total, F.lit(1))), F.lit(0.0))) * SIGMAS + 2
    low = F.greatest(F.lit(0), drawn + good - total, F.floor(mean - spread)).cast("long")
    high = F.least(good, drawn, F.ceil(mean + spread)).cast("long")

    def choose(n: Column, k: Column) -> Column:
        return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    def chance(x: Column) -> Column:
        return F.exp(choose(good, x) + choose(total - good, drawn - x) - choose(total, drawn))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + chance(x)).alias("sum"), F.when((acc["x"] < 0) & (acc["sum"] + chance(x) >= u), x).otherwise(acc["x"]).alias("x"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("x"))
    return F.aggregate(F.sequence(low, F.greatest(low, high)), start, step, lambda acc: F.when(acc["x"] < 0, high).otherwise(acc["x"]))


def _uniform(*cols: Column) -> Column:
    return (F.xxhash64(*cols).bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / float(1 << 52)


def _split(node: DataFrame, shards: int, seed: int) -> DataFrame:
    """(g, shard, k, n), with zeros: of each row (g, q, sizes) the counts n of its elements q (k, n) split among shards of the given sizes.

    At a node of m shards the first m // 2 take as many draws as they have room for, and from each element in turn what
    the hypergeometric distribution gives it, given what the elements before left.
    """
    node = node.select("g", F.lit(0).alias("first"), F.lit(shards).alias("m"), "q", "sizes")
    long = F.lit(0).cast("long")
    half = F.floor(F.col("m") / 2).cast("int")

    def halve(x: Column, acc: Column) -> Column:
        drawn = hypergeometric(x["n"], acc["total"], acc["room"], _uniform(F.lit(seed), F.col("g"), F.col("first"), F.col("m"), x["k"]))
        return let(drawn, lambda d: F.struct((acc["total"] - x["n"]).alias("total"), (acc["room"] - d).alias("room"), F.concat(acc["q"], F.array(F.struct(x["k"].alias("k"), d.alias("n")))).alias("q")))

    for _ in range(max(0, ceil(log2(shards)))):
        start = F.struct(F.aggregate("q", long, lambda a, x: a + x["n"]).alias("total"), F.aggregate(F.slice("sizes", F.lit(1), half), long, lambda a, x: a + x).alias("room"), F.slice("q", 1, 0).alias("q"))
        left = F.when(F.col("m") > 1, F.aggregate("q", start, lambda acc, x: halve(x, acc), lambda acc: acc["q"])).otherwise(F.col("q"))
        split = cut(node.withColumn("left", left))
        right = F.zip_with("q", "left", lambda a, b: F.struct(a["k"].alias("k"), (a["n"] - b["n"]).alias("n")))
        low = F.struct(F.col("first").alias("first"), half.alias("m"), F.col("left").alias("q"), F.slice("sizes", F.lit(1), half).alias("sizes"))
        high = F.struct((F.col("first") + half).alias("first"), (F.col("m") - half).alias("m"), right.alias("q"), F.slice("sizes", half + 1, F.col("m") - half).alias("sizes"))
        kids = F.when(F.col("m") > 1, F.array(low, high)).otherwise(F.array(F.struct("first", "m", "q", "sizes")))
        node = split.select("g", F.explode(kids).alias("z")).select("g", "z.*")
    return node.select("g", F.col("first").alias("shard"), F.explode("q").alias("x")).select("g", "shard", "x.k", "x.n")


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = 0, width: int = WIDTH) -> DataFrame:
    """(shard, k, n) from (k, quota): how many of each source's draws go to each shard; zero counts are left out.

    Shards differ by one draw at most. The sources are split in two steps, groups of `width` of them first and then each
    group by itself, so that no array holds more than `width` sources or one entry for each group.
    """
    grouped = cut(quotas.select((F.col("k") / width).cast("long").alias("g"), F.col("k").cast("long").alias("k"), F.col("quota").cast("long").alias("n")))
    pairs = lambda k: F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), "n")))
    sums = grouped.groupBy("g").agg(F.sum("n").alias("n"))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("t") / shards) + F.when(s < F.col("t") % shards, 1).otherwise(0))
    top = sums.agg(F.sum("n").alias("t"), pairs("g").alias("q")).where("t IS NOT NULL").select(F.lit(-1).cast("long").alias("g"), "q", even.alias("sizes"))
    rooms = _split(top, shards, seed).groupBy(F.col("k").alias("g")).agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("s")).select("g", F.col("s.n").alias("sizes"))
    own = grouped.groupBy("g").agg(pairs("k").alias("q")).join(cut(rooms), "g")
    return _split(own, shards, seed).select("shard", "k", "n").where("n > 0")


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0, share: float = 1.0) -> DataFrame:
    """docs with size, source_size, target and draws: an array of (shard, place), one entry for each time that the mix takes the document.

    place orders a shard's rows (its local shuffle); reruns agree. At most `limit` draws a document.
    Null source: a source of its own, last. Null or empty text: size 0, drawn with its block. Null or repeated
    ids: rows are drawn one by one, rows that agree in all of id, source and size together. Columns of docs named
    size, source_size, target or draws are replaced. Sources of size 0: target 0. No rows: no rows.
    """
    named = docs.drop("size", "source_size", "target", "draws").withColumn("size", word_count(F.col(text_col)))
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), F.col("size"))
    # a document's block is numbered by hash: the order of the numbers is the blocks' permutation
    narrow = cut(named.select(F.col(source_col).alias("source"), "size", key.alias("u"), F.pmod(key, F.lit(blocks)).cast("int").alias("block")))
    held = cut(narrow.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    targets = cut(source_targets(held.select("source", F.col("words").alias("size")), weights, limit, share).withColumnRenamed("docs", "b"))
    order = Window.partitionBy("source").orderBy("block")
    t = targets.select(F.col("source").alias("ts"), "source_size", "target", "b")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    asked = held.join(t, F.col("source").eqNullSafe(F.col("ts"))).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    after = F.sum("words").over(order)
    placed = cut(asked.withColumn("rank", F.row_number().over(order) - 1).withColumn("after", after).withColumn("room", F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), F.col("rest") - (F.col("after") - F.col("words"))))))
    placed = placed.withColumn("part", F.col("rest") > F.col("after") - F.col("words"))
    # the block that the part of a pass ends in is taken by documents: those whose running size lies nearest to the room
    edge = placed.where("room > 0 AND room < words").select(F.col("source").alias("es"), F.col("block").alias("eb"), "room")
    inside = Window.partitionBy("source").orderBy("u")
    within = narrow.groupBy("source", "block", "u").agg(F.sum("size").alias("size")).join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")))
    cutoff = within.withColumn("sum", F.sum("size").over(inside)).where((F.col("sum") - F.col("room")) <= (F.col("room") - (F.col("sum") - F.col("size")))).groupBy("source").agg(F.max("u").alias("last"))
    ends = cut(cutoff.select(F.col("source").alias("cs"), "last"))

    quota = F.col("full") + F.col("part").cast("int")
    k = targets.select(F.col("source").alias("ks"), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("k"))
    drawn = cut(placed.join(k, F.col("source").eqNullSafe(F.col("ks"))).select("k", "source", "block", "rank", "full", "room", "words", "part", "source_size", "target", "b", quota.alias("quota")))
    counts = split_quotas(drawn.groupBy("k").agg(F.sum("quota").cast("long").alias("quota")), shards, seed)
    ranges = cut(counts.withColumn("end", F.sum("n").over(Window.partitionBy("k").orderBy("shard"))).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")))
    # a source's draws in order: pass after pass over its blocks; the d-th goes to the first shard whose range ends beyond it
    pass_at = F.transform(F.sequence(F.lit(0), F.col("quota") - 1), lambda p: p.cast("long") * F.col("b") + F.col("rank"))

    def shard_of(d: Column) -> Column:
        return F.coalesce(F.get(F.filter("ends", lambda e: e["end"] > d), F.lit(0))["shard"], F.element_at("ends", -1)["shard"])

    to = drawn.where("quota > 0").join(ranges, "k").select("k", "block", F.transform(pass_at, shard_of).alias("shards"))
    plan = cut(
        drawn.join(to, ["k", "block"], "left")
        .join(ends, F.col("source").eqNullSafe(F.col("cs")), "left")
        .select(F.col("source").alias("ps"), F.col("block").alias("pb"), "full", (F.col("room") >= F.col("words")).alias("whole"), "part", "last", "source_size", "target", "shards")
    )
    with_block = named.withColumn("__u", key).withColumn("__block", F.pmod("__u", F.lit(blocks)).cast("int"))
    joined = with_block.join(plan, F.col(source_col).eqNullSafe(F.col("ps")) & (F.col("__block") == F.col("pb")))
    times = F.col("full") + F.when(F.col("whole") & F.col("part"), 1).when(F.col("part") & (F.col("__u") <= F.col("last")), 1).otherwise(0)
    draws = F.transform(F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), times), lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed), F.col("__u"), i).alias("place")))
    return joined.withColumn("draws", draws).drop("__u", "__block", "ps", "pb", "full", "whole", "part", "last", "shards")


def written_mix(mixed: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The mix itself: a row for each draw, dealt to its shard and shuffled there; a shard lies in parts of about `rows` draws."""
    each = mixed.withColumn("draw", F.explode("draws")).select("*", "draw.shard", "draw.place").drop("draws", "draw")
    count = mixed.agg(F.sum(F.size("draws")).alias("n"), F.max(F.array_max("draws.shard")).alias("s")).first()
    parts = max(1, ceil((count["n"] or 0) / rows / ((count["s"] or 0) + 1)))
    part = F.pmod("place", F.lit(parts))
    return each.repartition(parts * ((count["s"] or 0) + 1), "shard", part).sortWithinPartitions("shard", part, "place")


def digest(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken, draws, shards: the shard of each draw) from what mix returns."""
    shards = F.array_join(F.transform("draws.shard", lambda s: s.cast("string")), ",").alias("shards")
    return mixed.select(F.col(id_col).alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.size("draws").cast("long").alias("draws"), shards)
