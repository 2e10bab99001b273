"""Nearest neighbours by inner product: stable projections in a kd-tree, with a chi-square stopping test.

Vectors get one more coordinate so that the largest inner product is the smallest distance, and are
projected to a few Gaussian directions.  The squared projected distance over the squared true one
follows a chi-square law, so a search that goes through neighbours by projected distance and verifies them
may stop when the next one, were it nearer than the k-th found, would project that far away too seldom.

The upper levels of the tree are cells that Spark groups by; each cell holds a tree of its own.  A
query searches its own cell first and then only the cells that the stopping test can't rule out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Projected dimensions; the probability with which a true neighbour is not missed at a stop.
PROJECTED, SURE = 10, 0.97
#: Points in a cell or in a part of a large one, in a leaf, and leaves verified at a time.
CELL, LEAF, STEP = 8192, 32, 8
#: Cells at most, and points that place the cuts between them.
MOST_CELLS, SAMPLE = 4096, 20_000
SEED = 17


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(chi-square of k degrees <= x) = p, by halving on the series of the gamma function."""

    def below(x: float) -> float:
        a, x = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 500):
            term *= x / (a + n)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * k + 50
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def usable(vectors: DataFrame) -> DataFrame:
    """id, v of vectors that are not null, not zero and hold finite numbers only."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


class Projection:
    def __init__(self, size: int, longest: float):
        self.longest = longest
        self.directions = np.random.default_rng(SEED).normal(size=(size + 1, PROJECTED))

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return np.c_[x, rest] @ self.directions

    def queries(self, q: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(q, axis=1, keepdims=True)
        return (q / length * self.longest) @ self.directions[:-1]


class Cells:
    """Cuts of the projected space, halved along its widest direction until there are enough cells."""

    def __init__(self, points: np.ndarray, count: int):
        self.cuts: list[tuple[int, float]] = []
        self.depth = max(0, math.ceil(math.log2(max(1, count))))
        level = [points]
        for _ in range(self.depth):
            after = []
            for p in level:
                way = int(np.argmax(p.var(axis=0))) if len(p) else 0
                cut = float(np.median(p[:, way])) if len(p) else 0.0
                self.cuts.append((way, cut))
                after += [p[p[:, way] <= cut], p[p[:, way] > cut]]
            level = after

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        if self.cuts:
            way, cut = np.array([c[0] for c in self.cuts]), np.array([c[1] for c in self.cuts])
            for _ in range(self.depth):
                right = points[np.arange(len(points)), way[node]] > cut[node]
                node = 2 * node + 1 + right
        return node - len(self.cuts)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = [np.full(PROJECTED, -np.inf)], [np.full(PROJECTED, np.inf)]
        for node in range(len(self.cuts)):
            way, cut = self.cuts[node]
            for right in (False, True):
                a, b = low[node].copy(), high[node].copy()
                (a if right else b)[way] = cut
                low.append(a)
                high.append(b)
        return np.array(low[len(self.cuts) :]), np.array(high[len(self.cuts) :])


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from every query to every box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(low[None, :, d] - q[:, None, d], q[:, None, d] - high[None, :, d])
        out += np.square(np.maximum(gap, 0))
    return out


class Tree:
    """The leaves of a kd-tree over projected points."""

    def __init__(self, points: np.ndarray):
        leaves, rest = [], [np.arange(len(points))]
        while rest:
            at = rest.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            way = int(np.argmax(points[at].var(axis=0)))
            order = at[np.argsort(points[at, way], kind="stable")]
            rest += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.leaves = leaves
        self.low = np.array([points[at].min(axis=0) for at in leaves])
        self.high = np.array([points[at].max(axis=0) for at in leaves])


def search(x: np.ndarray, tree: Tree, q: np.ndarray, projected: np.ndarray, longest: float, k: int, known: np.ndarray):
    """Per query the places and inner products of its best k; known: squared distance to the k-th so far."""
    stop = chi_square_quantile(SURE, PROJECTED)
    near = box_distance(projected, tree.low, tree.high)
    order = np.argsort(near, axis=1, kind="stable")
    out = []
    for i in range(len(q)):
        length = np.linalg.norm(q[i])
        limit, at, got = known[i], np.zeros(0, np.int64), np.zeros(0)
        for s in range(0, order.shape[1], STEP):
            leaves = order[i, s : s + STEP]
            if near[i, leaves[0]] > stop * limit:
                break
            new = np.concatenate([tree.leaves[n] for n in leaves])
            at, got = np.concatenate((at, new)), np.concatenate((got, x[new] @ q[i]))
            if len(at) > k:
                best = np.argpartition(-got, k - 1)[: k + 4]
                at, got = at[best], got[best]
            if len(at) >= k:
                # |x'|^2 + |q'|^2 - 2 x'q', with both as long as the longest vector.
                kth = np.partition(got, len(got) - k)[len(got) - k]
                limit = min(limit, max(0.0, 2 * longest**2 - 2 * longest * kth / length))
        # Summed row by row, so that equal vectors have equal scores.
        exact = (x[at] * q[i]).sum(axis=1)
        best = np.lexsort((at, -exact))[:k]
        out.append((at[best], exact[best]))
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors by inner product of each vec_id divisible by `every`.

    Vectors that are null, zero or hold null or non-finite numbers take no part, nor do those of
    another length than the most common one (the larger of several).  Ties go to the smaller vec_id.  A vec_id that is given twice
    counts with its smallest vector.  Equal vectors are one point with its k + 1 smallest ids, which is all that can
    be among the best k, so a vector that a third of the rows share is no larger than another.
    Every row is indexed; the cuts between cells come from SAMPLE points.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    size = sizes[0]["n"]
    rows = stored(rows.where(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    least = Window.partitionBy("v").orderBy("id")
    points = (
        rows.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("point"), "v", "ids")
    )
    points = stored(points, "points")
    asked = rows.where(F.col("id") % every == 0).join(points.select("point", "v"), "v").select("id", "point")
    asked = stored(asked, "queries")
    queries = points.join(asked.select("point").distinct(), "point", "left_semi").select(F.col("point").alias("query"), F.col("v").alias("q"))

    norms = points.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    longest = math.sqrt(norms["most"])
    projection = Projection(size, longest)
    some = points.orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").collect()
    cells = Cells(projection.points(np.array([r["v"] for r in some])), min(MOST_CELLS, -(-norms["n"] // CELL)))
    shared = spark.sparkContext.broadcast((projection, cells))

    def matrix(column) -> np.ndarray:
        return np.array(column.tolist(), float).reshape(len(column), size)

    def with_cell(frames):
        projection, cells = shared.value
        for f in frames:
            f["cell"] = cells.of(projection.points(matrix(f["v"])))
            yield f[["point", "v", "cell"]]

    def home_cell(frames):
        projection, cells = shared.value
        for f in frames:
            f["cell"] = cells.of(projection.queries(matrix(f["q"])))
            f["known"] = np.inf
            yield f[["query", "q", "known", "cell"]]

    placed = stored(points.select("point", "v").mapInPandas(with_cell, "point long, v array<double>, cell long"), "cells")
    # A cell that came out large, as its cuts are from a sample, is searched in parts.
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    split = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int")).drop("parts")

    def in_cell(points_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        projection, _ = shared.value
        columns = ["query", "point", "score"]
        if not len(points_) or not len(asked_):
            return pd.DataFrame({"query": [], "point": [], "score": []}).astype({"query": "int64", "point": "int64", "score": float})
        points_ = points_.sort_values("point", ignore_index=True)
        x, q = matrix(points_["v"]), matrix(asked_["q"])
        tree, ids = Tree(projection.points(x)), points_["point"].to_numpy()
        found = search(x, tree, q, projection.queries(q), longest, k + 1, asked_["known"].to_numpy(float))
        return pd.concat(
            [pd.DataFrame({"query": query, "point": ids[at], "score": score})[columns] for query, (at, score) in zip(asked_["query"], found)],
            ignore_index=True,
        )

    def look(asked_: DataFrame) -> DataFrame:
        to_parts = asked_.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return split.groupBy("cell", "part").cogroup(to_parts.groupBy("cell", "part")).applyInPandas(
            in_cell, "query long, point long, score double"
        )

    home = stored(queries.mapInPandas(home_cell, "query long, q array<double>, known double, cell long"), "home-cells")
    first = stored(look(home), "home-neighbours")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    kth = first.withColumn("place", F.row_number().over(best)).where(F.col("place") == k + 1).select("query", F.col("score").alias("kth"))

    def other_cells(frames):
        projection, cells = shared.value
        low, high = cells.boxes()
        stop = chi_square_quantile(SURE, PROJECTED)
        for f in frames:
            q = matrix(f["q"])
            length = np.linalg.norm(q, axis=1)
            known = np.maximum(0, 2 * longest**2 - 2 * longest * f["kth"].to_numpy(float) / length)
            known = np.where(np.isnan(known), np.inf, known)
            gap = box_distance(projection.queries(q), low, high)
            i, cell = np.nonzero((gap <= stop * known[:, None]) & (np.arange(len(low))[None, :] != f["cell"].to_numpy()[:, None]))
            yield pd.DataFrame({"query": f["query"].to_numpy()[i], "q": f["q"].to_numpy()[i], "known": known[i], "cell": cell})

    others = home.join(kth, "query", "left").select("query", "q", "kth", "cell").mapInPandas(
        other_cells, "query long, q array<double>, known double, cell long"
    )
    found = first.unionByName(look(others))
    # k + 1 points are enough, and of them k + 1 ids, as a query leaves out one: itself.
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    ids = top.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    )
    return (
        asked.join(lists, F.col("point") == F.col("query"))
        .select(
            F.col("id").alias("query_id"),
            F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)).alias("pos", "hit"),
        )
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
