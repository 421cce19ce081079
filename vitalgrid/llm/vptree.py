"""Approximate nearest neighbours by inner product with vantage-point trees.

Inner products become distances by one more component: with M the largest norm, |(q, 0) - (x, sqrt(M^2 - |x|^2))|^2 =
|q|^2 + M^2 - 2 q.x, so the nearest point has the largest product.  A tree over a bounded sample deals the space into
cells, more of them the more vectors there are; a shard is a cell (or a part of a large one) with a tree of its own.  Each
query first searches its home cell, and then, knowing its k-th distance, the cells that the triangle inequality cannot rule
out.  Everywhere a branch is left out when factor * lower bound > k-th distance: factor 1 is exact, larger factors prune more.

In each of the two rounds every point goes to its shard once, where the tree is built, and the queries of the shard
stream past it; neither is copied for the other.

Edge cases: vectors that are null, zero, of another than the most common length, or hold null or non-finite components
take no part; equal vectors are searched once and listed by id; repeated rows (one id twice) count once; with fewer
candidates than k all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frees, materialize

#: Vectors meant for a cell, vectors of the sample for each cell and in all, and numbers that the sample may hold (64 MB): the bound of what comes to the driver.
CELL_ROWS, SAMPLED, SAMPLE, SAMPLE_NUMBERS = 4_000, 16, 8_192, 8_000_000
#: Most vectors of a shard, queries that are searched at once, and queries that are held against all cells at once.
SHARD_ROWS, QUERY_ROWS, REACHED_ROWS = 40_000, 4_000, 500
#: Vectors of a leaf: fewer make more steps, each of which costs more than the distances that it saves.
LEAF = 256


class Tree:
    """A vantage-point tree over the rows of ``x``; ``depth`` bounds it, else leaves hold ``leaf`` rows at most."""

    def __init__(self, x: np.ndarray, depth: int | None = None, seed: int = 7, leaf: int = LEAF):
        self.x, self.random, self.leaf = x, np.random.RandomState(seed), leaf
        self.n_leaves = 0
        self.root = self._grow(np.arange(len(x)), depth)

    def _grow(self, rows: np.ndarray, depth: int | None):
        if depth == 0 or (depth is None and len(rows) <= self.leaf) or len(rows) < 2:
            self.n_leaves += 1
            return ("leaf", self.n_leaves - 1, rows)
        some = rows[self.random.randint(0, len(rows), min(8, len(rows)))]
        probe = rows[self.random.randint(0, len(rows), min(64, len(rows)))]
        spread = [np.linalg.norm(self.x[probe] - self.x[s], axis=1).std() for s in some]
        point = self.x[some[int(np.argmax(spread))]]
        d = np.linalg.norm(self.x[rows] - point, axis=1)
        mid = float(np.median(d))
        inside = d < mid
        if not inside.any() or inside.all():  # many equal distances
            if depth is None and len(rows) > self.leaf:
                half = len(rows) // 2
                by = np.argsort(d, kind="stable")
                near, far = rows[by[:half]], rows[by[half:]]
                return ("node", point, float(d.max()) if inside.all() else mid, self._grow(near, depth), self._grow(far, depth), True)
            self.n_leaves += 1
            return ("leaf", self.n_leaves - 1, rows)
        less = None if depth is None else depth - 1
        return ("node", point, mid, self._grow(rows[inside], less), self._grow(rows[~inside], less), False)

    def search(self, q: np.ndarray, k: int, factor: float, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and rows of the k nearest of each query that are found within ``limit``; inf and -1 where there are fewer."""
        best = np.full((len(q), k), np.inf)
        rows = np.full((len(q), k), -1, np.int64)
        norm, q_norm = (self.x**2).sum(1), (q**2).sum(1)
        slack = 1e-7 * float(np.sqrt(norm.max(initial=0.0)))  # distances come from sums of squares that cancel

        def radius(i: np.ndarray) -> np.ndarray:
            return np.minimum(best[i].max(axis=1), limit[i]) + slack

        def visit(node, i: np.ndarray) -> None:
            if not len(i):
                return
            if node[0] == "leaf":
                own = node[2]
                d = np.sqrt(np.maximum(norm[own] + q_norm[i, None] - 2 * (q[i] @ self.x[own].T), 0))
                all_d, all_r = np.hstack([best[i], d]), np.hstack([rows[i], np.broadcast_to(own, d.shape)])
                at = np.argpartition(all_d, k - 1, axis=1)[:, :k] if all_d.shape[1] > k else np.broadcast_to(np.arange(all_d.shape[1]), all_d.shape)
                best[i], rows[i] = np.take_along_axis(all_d, at, 1), np.take_along_axis(all_r, at, 1)
                return
            _, point, mid, near, far, loose = node
            d = np.sqrt(np.maximum(((q[i] - point) ** 2).sum(1), 0))
            inner = d < mid
            visit(near, i[inner]), visit(far, i[~inner])
            if loose:
                visit(far, i[inner]), visit(near, i[~inner])
                return
            visit(far, i[inner & (factor * (mid - d) <= radius(i))])
            visit(near, i[~inner & (factor * (d - mid) <= radius(i))])

        visit(self.root, np.arange(len(q)))
        return best, rows

    def leaf_of(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q), np.int64)

        def visit(node, i: np.ndarray) -> None:
            if node[0] == "leaf":
                out[i] = node[1]
                return
            inner = np.sqrt(((q[i] - node[1]) ** 2).sum(1)) < node[2]
            visit(node[3], i[inner]), visit(node[4], i[~inner])

        visit(self.root, np.arange(len(q)))
        return out

    def leaf_bounds(self, q: np.ndarray) -> np.ndarray:
        """A lower bound of the distance from each query to each leaf's points."""
        out = np.zeros((len(q), self.n_leaves))

        def visit(node, low: np.ndarray) -> None:
            if node[0] == "leaf":
                out[:, node[1]] = low
                return
            d = np.sqrt(((q - node[1]) ** 2).sum(1))
            visit(node[3], np.maximum(low, d - node[2])), visit(node[4], np.maximum(low, node[2] - d))

        visit(self.root, np.zeros(len(q)))
        return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.empty((0, 0))


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most**2 - (x**2).sum(1), 0))[:, None]])


def _ground(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searched(k: int, factor: float, most: float, leaf: int, at_once: int):
    """(query, limit, point, score) of the k nearest points of a shard, for rows sorted by shard, points (kind 0) before queries.

    limit is the distance within which the k nearest lie: infinite where the shard has fewer.
    """

    def found(tree: Tree, points: np.ndarray, raw: np.ndarray, ids: np.ndarray, limit: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        d, r = tree.search(_ground(q), k, factor, limit)
        i, j = np.nonzero(r >= 0)
        rows = r[i, j]
        columns = [ids[i], d.max(axis=1)[i], points[rows], (q[i] * raw[rows]).sum(1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "limit", "point", "score"])

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, vectors, tree = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, kind, own, limit = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "part", "kind", "id", "limit"))
            x = _vectors(batch["vector"])
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(own)]):
                if last != (cell[a], part[a]):
                    last, ids, vectors, tree = (cell[a], part[a]), [], [], None
                if not kind[a]:
                    ids.append(own[a:b]), vectors.append(x[a:b])
                elif ids:
                    if tree is None:
                        points, raw = np.concatenate(ids), np.concatenate(vectors)
                        by = np.argsort(points)
                        points, raw = points[by], raw[by]
                        tree = Tree(_lift(raw, most), leaf=leaf)
                    for c in range(a, b, at_once):
                        e = min(b, c + at_once)
                        yield found(tree, points, raw, own[c:e], limit[c:e], x[c:e])

    return run


def _cells(tree: Tree, most: float):
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf_of(_lift(_stack(column), most)) if len(column) else np.empty(0, np.int64))

    return run


def _reached(tree: Tree, factor: float):
    """Cells, other than the home cell, that a query must look into; ``REACHED_ROWS`` queries are held against all cells at once."""

    def run(vector: pd.Series, limit: pd.Series, home: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(vector), REACHED_ROWS):
            some = slice(lo, lo + REACHED_ROWS)
            low = tree.leaf_bounds(_ground(_stack(vector.iloc[some])))
            wanted = factor * low <= limit.iloc[some].to_numpy()[:, None]
            wanted[np.arange(len(low)), home.iloc[some].to_numpy()] = False
            out += [np.flatnonzero(w).tolist() for w in wanted]
        return pd.Series(out, dtype=object)

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score of the k rows of largest inner product found for each query row, its own left out."""
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & fine)
    rows = rows.withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0)))  # -0 equals 0
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = usual["n"] if usual else 0
    rows = rows.where(F.size("vector") == dimension).withColumn("c0", F.xxhash64("vector")).withColumn("c1", F.xxhash64(F.lit(1), "vector"))

    # equal vectors: the least id stands for all; of the others only as many ids as an answer can hold are looked at
    order = Window.partitionBy("c0", "c1").orderBy("id")
    kept = rows.groupBy("c0", "c1", "id").agg(F.first("vector").alias("vector")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = materialize(kept.groupBy("c0", "c1").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")), "points")
    asked = rows.where("asks").groupBy("id", "c0", "c1").agg(F.lit(1))
    asked = materialize(asked.join(points.select("c0", "c1", "point"), ["c0", "c1"]).select(F.col("id").alias("query_id"), F.col("point").alias("query")), "queries")
    queries = points.join(asked.select(F.col("query").alias("point")).distinct(), "point").select(F.col("point").alias("query"), "vector")

    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    total = points.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    most = float(np.sqrt(total["square"] or 0.0)) * (1 + 1e-12)
    n_sample = min(max(SAMPLE, SAMPLED * (total["n"] // CELL_ROWS)), max(1, SAMPLE_NUMBERS // max(1, dimension)))
    # a part of the rows by hash, so that not much more than the wanted number is sorted
    share = min(1.0, 2 * n_sample / max(1, total["n"]) + 1e-6)
    some = points.where(F.pmod(F.xxhash64("point"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = some.orderBy(F.xxhash64("point"), "point").limit(n_sample).select("vector").toPandas()
    n_cells = max(1, min(total["n"] // CELL_ROWS, len(sample) // SAMPLED))
    lifted = _lift(_stack(sample["vector"]), most) if len(sample) else np.zeros((0, dimension + 1))
    tree = Tree(lifted, depth=int(np.log2(n_cells)))
    tree.x = None  # only the vantage points and bounds travel

    cell = F.pandas_udf(_cells(tree, most), "long")
    shards = materialize(points.select("point", "vector", cell("vector").alias("cell")), "shards")
    parts = shards.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(SHARD_ROWS)).cast("int").alias("parts"))
    parts = F.broadcast(materialize(parts, "parts"))  # one row a cell, whose number is bounded by the sample
    home = queries.withColumn("home", F.pandas_udf(lambda c: pd.Series(tree.leaf_of(_ground(_stack(c))) if len(c) else np.empty(0, np.int64)), "long")("vector"))
    home = materialize(home, "homes")
    spread = shards.join(parts, "cell").select("cell", F.pmod(F.xxhash64("point"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), F.col("point").alias("id"), F.lit(0.0).alias("limit"), "vector")

    def search(asking: DataFrame) -> DataFrame:
        asking = asking.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = spread.unionByName(asking.select("cell", "part", F.lit(1).alias("kind"), F.col("query").alias("id"), "limit", "vector"))
        rows = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return rows.mapInArrow(_searched(k + 1, factor, most, LEAF, QUERY_ROWS), "query long, limit double, point long, score double")

    first = materialize(search(home.select("query", "vector", F.col("home").alias("cell"), F.lit(float("inf")).alias("limit"))), "near")
    reach = first.groupBy("query").agg(F.min("limit").alias("limit"))
    further = home.join(reach, "query", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    further = further.withColumn("cell", F.explode(F.pandas_udf(_reached(tree, factor), "array<long>")("vector", "limit", "home")))
    second = search(further.select("query", "vector", "cell", "limit"))
    found = first.unionByName(second).join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("all"))
    own = asked.join(lists, "query")
    hits = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(hits).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))
