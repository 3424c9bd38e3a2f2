"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds.

Unit-free largest inner products are turned into least distances: with M the largest norm of all vectors, x gets
the further component sqrt(M^2 - |x|^2) and a query 0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x. Gaussian projections
to `dims` numbers are 2-stable: the squared projected distance over the squared distance is chi-square with
`dims` degrees. With d the distance of a query's k-th best so far and r the projected distance of the nearest
point not yet verified, the query stops when chi-square's distribution at r^2 / d^2 reaches `confidence`: a
nearer point not yet seen would be that unlikely. A point beyond that bound is never verified.

The tree has two levels. The upper one, built on the driver from a sample of `sample` projected rows at most, cuts
the space into cells of about `cell` rows; every row lies in one cell, and cells that hold more are split by hash.
Queries are routed to cells: in each round a query visits those of its next nearest cells that pass the test with
the bound that the rounds before have left it, and the lower tree of a cell gives its points by rising bound. Of a
cell that nobody visits no row travels, and of others one copy for each `visits` queries that come to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, gamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, first_by_hash

DIMS, LEAF, CONFIDENCE, CELL, SAMPLE, VISITS, SEED = 12, 128, 0.9, 8_192, 65_536, 16_384, 7
WAVES = (1, 4, 16)  # ranks at which the waves of leaves end
ROUNDS = (1, 4)  # how many of its nearest cells a query visits in the first rounds; all others in the last


def chi_square(x: float, dims: int) -> float:
    """Distribution function of chi-square."""
    if x <= 0:
        return 0.0
    total = erf(sqrt(x / 2)) if dims % 2 else 1 - exp(-x / 2)
    for j in range(dims % 2 or 2, dims, 2):
        total -= (x / 2) ** (j / 2) * exp(-x / 2) / gamma(j / 2 + 1)
    return total


def quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def projection(d: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    """The Gaussian matrix for vectors of d numbers and the one that makes their norms equal."""
    return np.random.default_rng((seed, d)).standard_normal((d + 1, dims))


def projected(x: np.ndarray, largest: float | None, turn: np.ndarray) -> np.ndarray:
    """Rows of x projected; largest: the norm up to which the further component fills, None for queries."""
    rest = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    return np.c_[x, rest] @ turn


def boxed(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared projected distance of each query to each box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - q[:, None, j], q[:, None, j] - high[None, :, j]), 0)
        out += gap * gap
    return out


class Tree:
    """Leaves of a balanced kd-tree over the projected points: their boxes and members; and the cuts that lead to them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.members: list[np.ndarray] = []
        self.axis: list[int] = []  # of a node, or -1 - the number of its leaf
        self.at: list[float] = []
        self.kids: list[tuple[int, int]] = []

        def node(p: np.ndarray) -> int:
            k = len(self.axis)
            self.axis.append(-1 - len(self.members))
            self.at.append(0.0)
            self.kids.append((0, 0))
            axis = int(np.ptp(points[p], axis=0).argmax()) if len(p) else 0
            if len(p) <= leaf or np.ptp(points[p, axis]) == 0:
                self.members.append(p)
                return k
            half = len(p) // 2
            p = p[np.argpartition(points[p, axis], half)]
            self.axis[k], self.at[k] = axis, float(points[p[half], axis])
            below = points[p, axis] < self.at[k]
            if not below.any():  # the middle is the least: cut above it
                self.at[k] = float(points[p, axis][points[p, axis] > self.at[k]].min())
                below = points[p, axis] < self.at[k]
            self.kids[k] = (node(p[below]), node(p[~below]))
            return k

        node(np.arange(len(points)))
        self.low = np.array([points[p].min(axis=0) for p in self.members if len(p)])
        self.high = np.array([points[p].max(axis=0) for p in self.members if len(p)])

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf in whose part of the space each point lies."""
        at = np.zeros(len(points), int)
        axis, cut, kids = np.array(self.axis), np.array(self.at), np.array(self.kids)
        while (inner := axis[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            at[rows] = kids[n, (points[rows, axis[n]] >= cut[n]).astype(int)]
        return -1 - axis[at]


def search(x: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int, largest: float, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the rows of x found among its k best that reach its bar, and their scores; and how many pairs were verified.

    bar: the score of the k-th best that a query has already; -inf for none. Leaves are opened in waves by rank of
    their bounds, each by all queries at once that the test hasn't stopped. Of a leaf the points within a query's bound
    are verified; where most are, its scores are one matrix product, and those of points beyond the bound are not used.
    """
    turn, limit = projection(x.shape[1], dims, seed), quantile(confidence, dims)
    points, asked = projected(x, largest, turn), projected(q, None, turn)
    tree, verified = Tree(points), 0
    members = [m for m in tree.members if len(m)]
    slack = k + 8  # sums differ in their last bits by how they are made: the best are added up anew at the end
    rows_out, scores_out = [], []
    for a in range(0, len(q), 512):
        part, place = q[a : a + 512], asked[a : a + 512]
        bound = boxed(tree.low, tree.high, place)
        rank = np.argsort(np.argsort(bound, axis=1, kind="stable"), axis=1, kind="stable")
        floor, size = (part**2).sum(axis=1) + largest**2, (place**2).sum(axis=1)
        best = np.full((len(part), slack), -np.inf)
        which = np.full((len(part), slack), -1)
        kth = bar[a : a + 512] - 1e-9
        reach = limit * np.maximum(floor - 2 * kth, 0) + 1e-9
        for first, past in zip((0, *WAVES), (*WAVES, len(members)), strict=True):
            for one, own in enumerate(members):
                rows = np.flatnonzero((rank[:, one] >= first) & (rank[:, one] < past) & (bound[:, one] <= reach))
                if not len(rows):
                    continue
                far = size[rows][:, None] - 2 * place[rows] @ points[own].T + (points[own] ** 2).sum(axis=1)[None, :]
                live = far <= reach[rows][:, None]
                count = int(np.count_nonzero(live))
                verified += count
                if 8 * count < live.size:
                    r, c = np.nonzero(live)
                    score = np.full(live.shape, -np.inf)
                    score[r, c] = np.einsum("ij,ij->i", part[rows[r]], x[own[c]])
                else:
                    score = np.where(live, part[rows] @ x[own].T, -np.inf)
                some = np.flatnonzero((score >= kth[rows][:, None]).any(axis=1))
                if not len(some):
                    continue
                rows = rows[some]
                both = np.concatenate([best[rows], score[some]], axis=1)
                name = np.concatenate([which[rows], np.broadcast_to(own, (len(some), len(own)))], axis=1)
                top = np.argpartition(-both, slack - 1, axis=1)[:, :slack]
                both, name = np.take_along_axis(both, top, axis=1), np.take_along_axis(name, top, axis=1)
                best[rows], which[rows] = both, name
                kth[rows] = np.maximum(kth[rows], np.partition(both, slack - k, axis=1)[:, slack - k] - 1e-9)
                reach[rows] = limit * np.maximum(floor[rows] - 2 * kth[rows], 0) + 1e-9
        for i in range(len(part)):
            found = which[i][np.isfinite(best[i])]
            score = (x[found] * part[i]).sum(axis=1)  # the same sum wherever a vector stands
            top = np.argsort(-score, kind="stable")
            top = top[: max(k, int((score >= score[top[min(k, len(top)) - 1]]).sum()))] if len(top) else top  # ties too
            rows_out.append(found[top])
            scores_out.append(score[top])
    return rows_out, scores_out, verified


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list())


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, cell: int = CELL, visits: int = VISITS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score): for each row that satisfies `queries` the k rows of largest inner product found.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows of null id. Only
    vectors of a query's own length are compared with it. Rows of a query's own id are not its neighbours;
    a query id that repeats asks once, with the least of its vectors. Ties: smaller ids first; repeated ids count
    once, by their best vector. Other columns are not read, whatever their names. No rows: no rows.
    """
    spark, keep, cut = vectors.sparkSession, Scratch(vectors.sparkSession), Scratch(vectors.sparkSession)
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), wide.alias("v"), F.coalesce(queries, F.lit(False)).alias("ask")).where(F.col("id").isNotNull() & usable(F.col("v")))
    largest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first()["m"] or 1.0
    # equal vectors are one point: of any number of ids that share it, k + 1 can be of use; these are picked before the shuffle too
    twin = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    points = cut(rows.select("id", "v").withColumn("r", twin).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    some = first_by_hash(points.select("v"), sample, "v").toPandas().v  # of rows, all of which are indexed
    count = points.count()

    by_length: dict[int, list[np.ndarray]] = {}
    for v in some:
        by_length.setdefault(len(v), []).append(v)
    seen = [projected(np.stack(vs), largest, projection(d)) for d, vs in by_length.items()]
    # at least 32 sampled rows to a cell; what cells hold more is split by hash
    upper = Tree(np.concatenate(seen), max(32, ceil(len(some) * cell / max(1, count)))) if seen else Tree(np.zeros((0, DIMS)))
    cells = len(upper.members)

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            d = part.v.map(len).to_numpy()
            home, at = np.zeros(len(part), int), np.zeros((len(part), DIMS))
            for n in np.unique(d):
                at[d == n] = projected(_stacked(part.v[d == n]), largest, projection(n))
                home[d == n] = upper.leaves(at[d == n])
            yield part.assign(cell=d * cells + home, p=list(at))

    # a cell's number holds the length of its vectors too, so that only equal lengths meet
    homed = cut(points.mapInPandas(placed, "v array<double>, ids array<long>, cell long, p array<double>"))
    corner = [f(F.get("p", F.lit(j))).alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(DIMS)]
    boxes = homed.groupBy("cell").agg(F.count("*").alias("n"), *corner).orderBy("cell").toPandas()  # a row for each cell of the upper tree
    names, held = boxes["cell"].to_numpy(), np.ceil(boxes["n"].to_numpy() / (2 * cell)).astype(int)
    low, high = (boxes[[f"{n}{j}" for j in range(DIMS)]].to_numpy() for n in ("low", "high"))
    limit = quantile(confidence, DIMS)

    def visited(first: int, past: int | None):
        """Of each query the cells with the nearest boxes, from the first-th on, that its bar doesn't rule out."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in parts:
                for a in range(0, len(whole), 256):
                    part = whole.iloc[a : a + 256]
                    d = part.v.map(len).to_numpy()
                    pairs = []
                    for n in np.unique(d):
                        own, mine = np.flatnonzero(d == n), np.flatnonzero(names // cells == n)
                        q = _stacked(part.v.iloc[own])
                        bound = boxed(low[mine], high[mine], projected(q, None, projection(n)))
                        turns = np.argsort(bound, axis=1, kind="stable")[:, first:past]
                        bound = np.take_along_axis(bound, turns, axis=1)
                        reach = limit * np.maximum((q**2).sum(axis=1) + largest**2 - 2 * part.bar.to_numpy()[own], 0)
                        r, c = np.nonzero((bound < reach[:, None]) | (bound == 0))
                        pairs += [(i, names[b], p) for i, b in zip(own[r], mine[turns[r, c]], strict=True) for p in range(held[b])]
                    if pairs:
                        i, b, p = zip(*pairs, strict=True)
                        yield part.iloc[list(i)].assign(cell=b, part=p)

        return run

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        found, scores, _ = search(_stacked(left.v), _stacked(right.v), right.bar.to_numpy(), k + 1, largest, confidence=confidence)
        ids = left.ids.to_list()
        out = [(q, i, s) for q, rows, at in zip(right.query_id, found, scores, strict=True) for r, s in zip(rows, at, strict=True) for i in ids[r] if i != q]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    asked = cut(rows.where("ask").groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("query_id"), "v"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    best = spark.createDataFrame([], "query_id long, id long, score double")
    first = 0
    for turn in (*ROUNDS, None):
        # the k-th best so far; k + 1 are asked for, so that a query's own vector takes no place
        bar = best.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("bar"))
        barred = asked.join(bar, "query_id", "left").select("query_id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
        past = None if turn is None else first + turn
        going = cut(barred.mapInPandas(visited(first, past), "query_id long, v array<double>, bar double, cell long, part int"))
        chunks = going.groupBy("cell", "part").agg(F.ceil(F.count("*") / visits).cast("int").alias("chunks"))
        deal = F.pmod(F.xxhash64("query_id"), F.col("chunks").cast("long")).cast("int")
        coming = going.join(chunks, ["cell", "part"]).withColumn("chunk", deal)
        split = homed.join(boxes_of(spark, names, held), "cell").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts").cast("long")).cast("int"))
        there = split.join(chunks, ["cell", "part"]).select("v", "ids", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        more = there.groupBy("cell", "part", "chunk").cogroup(coming.groupBy("cell", "part", "chunk")).applyInPandas(met, "query_id long, id long, score double")
        single = best.unionAll(more).groupBy("query_id", "id").agg(F.max("score").alias("score"))
        best = keep(single.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"))
        first = past
        if first is not None and first >= len(names):
            break
    cut.drop()
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "id", "score")


def boxes_of(spark, names: np.ndarray, held: np.ndarray) -> DataFrame:
    """(cell, parts): in how many parts each cell lies."""
    return spark.createDataFrame([(int(c), int(p)) for c, p in zip(names, held, strict=True)], "cell long, parts int")
