"""Exact top-k search by inner product of whole numbers, with MaxScore over sharded postings.

A component of a vector is a term; a shard holds the postings of each term, the rows in which its weight is not zero, in
order of id.  A term can add no more to the score of a query than its own weight in the query times the largest (or, for a
weight below zero, the least) weight of its list.  The terms of a query are sorted by that bound.

While a shard is searched, the k-th best score so far divides them: the last ones, whose bounds together do not exceed it (by
choice, ``SPARE`` of it), are non-essential, as no row that occurs in them alone can get in.  Only the essential postings are
traversed, a window of ids at a time; the rows found there are looked up in the others, largest bound first, and are dropped
as soon as what they have and what is left to add do not exceed the k-th best score.  Postings that hold an eighth of all
rows or more are kept as columns, so that those of a block of queries are traversed by one product of matrices.

Rows are dealt to shards by a hash of their id, each once; the queries of a shard stream past its index.  Each shard gives
its k best rows of a query, and the best of all shards are the answer.

Edge cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; zero and empty
vectors do, with a score of zero; a component that a vector lacks counts as zero; rows of one id count once, with the
vector that is largest in order of arrays; components and scores beyond 64 bits count as the nearest long; with fewer
candidates than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, frees, materialize

#: Weights that a shard holds, rows of a window, queries of a block, and the share of the k-th best score that non-essential bounds may reach.
SHARD_WEIGHTS, WINDOW, QUERY_ROWS, SPARE = 2_000_000, 8_192, 128, 0.5


class Postings:
    """Postings of some rows by term, with the largest and least weight of each list."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, values: np.ndarray, window: int = WINDOW):
        self.ids, self.window = ids, window
        size = np.diff(offsets)
        row = np.repeat(np.arange(len(ids)), size)
        term = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)
        some = np.flatnonzero(values)
        some = some[np.argsort(term[some], kind="stable")]  # within a term by row
        term, row, values = term[some], row[some], values[some]
        self.terms, start = np.unique(term, return_index=True)
        ends = np.append(start, len(term))
        if len(term):
            self.high, self.low = np.maximum.reduceat(values, start), np.minimum.reduceat(values, start)
        else:
            self.high = self.low = np.empty(0, np.int64)
        self.most = int(max(self.high.max(initial=0), -int(self.low.min(initial=0))))
        dense = np.diff(ends) * 8 >= len(ids)
        self.column = np.where(dense, np.cumsum(dense) - 1, -1)
        self.columns = np.zeros((int(dense.sum()), len(ids)), np.float64 if self.most < 2**53 else object)
        edges = np.arange(0, len(ids) + window, window)
        self.lists: list[tuple] = []
        for t in range(len(self.terms)):
            r, w = row[ends[t] : ends[t + 1]], values[ends[t] : ends[t + 1]]
            if dense[t]:
                self.columns[self.column[t], r] = w
            self.lists.append(() if dense[t] else (r, w, np.searchsorted(r, edges)))

    def search(self, query_ids: np.ndarray, queries: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k best rows of each query."""
        largest = max((int(np.abs(q.astype(object)).max(initial=0)) for q in queries), default=0)
        kind = np.float64 if self.most * largest * max(1, len(self.terms)) < 2**53 else object  # exact either way
        columns = self.columns.astype(kind)
        plans = [self._plan(q, kind) for q in queries]
        own = [int(np.searchsorted(self.ids, i)) for i in query_ids]
        own = [at if at < len(self.ids) and self.ids[at] == i else -1 for at, i in zip(own, query_ids)]
        best = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in queries]
        for n, lo in enumerate(range(0, len(self.ids), self.window)):
            rows = slice(lo, min(lo + self.window, len(self.ids)))
            limits = [b[1][-1] if len(b[1]) == k else None for b in best]
            essential = [self._essential(plan[2], limit) for plan, limit in zip(plans, limits)]
            weight = np.zeros((len(queries), len(columns)), kind)
            for i, (at, x, _) in enumerate(plans):
                c = self.column[at[: essential[i]]]
                weight[i, c[c >= 0]] = x[: essential[i]][c >= 0]
            scores = weight.dot(columns[:, rows])
            for i in range(len(queries)):
                best[i] = self._window(n, lo, scores[i], plans[i], essential[i], limits[i], own[i], best[i], k, columns, kind)
        whole = lambda b: np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in b], np.int64)
        return [(self.ids[r], whole(b)) for r, b in best]

    def _plan(self, q: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray, list]:
        """Terms of a query by falling bound, its weights, and what the terms from each one on can add."""
        at = np.flatnonzero(self.terms < len(q))
        x = q[self.terms[at]].astype(object)
        at, x = at[x != 0], x[x != 0]
        bound = np.array([max(0, int(w * (self.high[t] if w > 0 else self.low[t]))) for t, w in zip(at.tolist(), x)], object)
        order = np.array(sorted(range(len(at)), key=lambda i: -bound[i]), np.int64)
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0) if len(at) else np.array([0], object)
        return at[order], x[order].astype(kind), left.tolist()

    @staticmethod
    def _essential(left: list, limit) -> int:
        """How many terms are essential: all while a row without any could still get in."""
        n = len(left) - 1
        if limit is not None and limit >= 0:
            while n and left[n - 1] <= limit * SPARE:
                n -= 1
        return n

    def _window(self, n: int, lo: int, score: np.ndarray, plan: tuple, essential: int, limit, own: int, best: tuple, k: int, columns: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        at, x, left = plan
        for t, w in zip(at[:essential].tolist(), x[:essential]):
            if self.column[t] < 0:
                row, weight, edge = self.lists[t]
                score[row[edge[n] : edge[n + 1]] - lo] += w * weight[edge[n] : edge[n + 1]].astype(kind)
        if limit is None:
            alive = np.arange(len(score))
        else:  # a row that occurs in no essential list has a score of zero here, and left does not exceed the limit
            alive = np.flatnonzero(score + left[essential] > limit)
        if 0 <= own - lo < len(score):
            alive = alive[alive != own - lo]
        value = score[alive]
        for j in range(essential, len(at)):
            if not len(alive):
                break
            t, w = int(at[j]), x[j]
            if self.column[t] >= 0:
                value += w * columns[self.column[t], alive + lo]
            else:
                row, weight, edge = self.lists[t]
                row, weight = row[edge[n] : edge[n + 1]], weight[edge[n] : edge[n + 1]]
                if len(row):
                    spot = np.minimum(np.searchsorted(row, alive + lo), len(row) - 1)
                    there = row[spot] == alive + lo
                    value[there] += w * weight[spot[there]].astype(kind)
            if limit is not None:
                fine = np.asarray(value + left[j + 1] > limit, bool)
                alive, value = alive[fine], value[fine]
        if not len(alive):
            return best
        if kind is np.float64 and len(alive) > 4 * k:  # the k best, with all that tie with the last of them
            fine = value >= np.partition(value, len(value) - k)[len(value) - k]
            alive, value = alive[fine], value[fine]
        rows, values = np.concatenate([best[0], alive + lo]), np.concatenate([best[1], value])
        order = sorted(range(len(rows)), key=lambda i: (-values[i], rows[i]))[:k]
        return rows[order], values[order]


def _flat(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)


def _searched(k: int):
    """Over rows in order of shard, kind (0 for points, 1 for queries) and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, index = None, [], None
        last_id = None

        def built() -> Postings:
            ids = np.concatenate([p[0] for p in points]) if points else np.empty(0, np.int64)
            sizes = np.concatenate([p[1] for p in points]) if points else np.empty(0, np.int64)
            values = np.concatenate([p[2] for p in points]) if points else np.empty(0, np.int64)
            return Postings(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), values)

        for batch in batches:
            group = batch["shard"].to_numpy().astype(np.int64) * 2 + batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if group[a] // 2 != shard:
                    shard, points, index, last_id = group[a] // 2, [], None, None
                ids = part["id"].to_numpy()
                offsets, values = _flat(part["vector"])
                if group[a] % 2 == 0:
                    first = np.concatenate([[ids[0] != last_id], ids[1:] != ids[:-1]])  # of one id the largest comes first
                    last_id = ids[-1]
                    size = np.diff(offsets)
                    inner = values[offsets[0] : offsets[-1]]
                    points.append((ids[first], size[first], inner[np.repeat(first, size)]))
                    continue
                if index is None:
                    index, points = built(), []
                for lo in range(0, len(ids), QUERY_ROWS):
                    some = range(lo, min(lo + QUERY_ROWS, len(ids)))
                    found = index.search(ids[some.start : some.stop], [values[offsets[i] : offsets[i + 1]] for i in some], k)
                    query = np.repeat(ids[some.start : some.stop], [len(f[0]) for f in found])
                    columns = [query, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    return run


def scaled(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_weights: int = SHARD_WEIGHTS) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score of the k rows with the largest inner product of scaled vectors for each query row, its own left out; ties go to the smaller id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = materialize(rows.where(F.col("id").isNotNull() & F.col("raw").isNotNull() & fine).select("id", "asks", scaled(F.col("raw"), scale).alias("vector")), "vectors")
    weights = rows.agg(F.sum(F.size("vector") + 1)).first()[0] or 0
    shards = max(1, -(-weights // shard_weights))
    points = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vector")
    asked = rows.where("asks").groupBy("id").agg(F.max("vector").alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vector")
    dealt = points.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "id", F.desc("vector"))
    found = dealt.mapInArrow(frees(_searched(k)), "query_id long, id long, score long")
    found = materialize(found, "found")
    discard(rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
