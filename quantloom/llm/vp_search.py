"""Approximate nearest neighbours with a vantage-point tree per shard.

The largest inner product becomes the smallest distance when every vector of a shard gets one
more component that brings all of them to the same length, and the query a zero there; the
triangle inequality then holds. A tree splits its points at the median distance from a vantage
point and keeps the range of distances of either side. A side is left out when ``factor`` times
the smallest distance it can have exceeds the k-th found: a factor of one is exact search, more
is faster and may miss some.

All queries of a block walk the tree together. Hits are scored anew on the original vectors in
double precision.

How much a factor may miss hangs on the vectors: on clusters little, where all distances are about
the same much. So the factor is chosen for each table, by the recall that some factors reach
against exact search on a few of its shards and queries; the trees hold every row.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part,
neither does a null id; a shorter vector counts as padded with zeros; rows that share the query's
id are its own; fewer candidates than k give all of them; of equal vectors in a shard those with
the smallest ids are found; rows repeated under a query's id are queries each, their hits ranked
together under that id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import durable
from quantloom.llm.vector_blocks import BLOCK_ROWS, best_first, blocks, read_block, same_width, search, usable, written

LEAF = 64
FACTORS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 13.0)
TRIAL_SHARDS, TRIAL_QUERIES = 8, 128
_SLACK = 1e-9
TREE = "n long, ids binary, vectors binary, vantage binary, ranges binary"


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, the vantage point of each inner node (heap order), and the distance
    ranges (near low, near high, far low, far high) of its sides. All leaves lie equally deep."""
    n = len(points)
    depth = 0
    while n >> depth > leaf:
        depth += 1
    order, vantage, ranges = np.arange(n), [], []
    for level in range(depth):
        for node in range(1 << level):
            a, b = n * node >> level, n * (node + 1) >> level
            own = order[a:b]
            spread = np.linalg.norm(points[own] - points[own[0]], axis=1)
            pivot = own[np.argmax(spread)]  # a far point separates better than a middle one
            distance = np.linalg.norm(points[own] - points[pivot], axis=1)
            by = np.argsort(distance, kind="stable")
            order[a:b], distance = own[by], distance[by]
            cut = (n * (2 * node + 1) >> level + 1) - a
            vantage.append(pivot)
            ranges.append((distance[0], distance[cut - 1], distance[cut], distance[-1]))
    return order, np.array(vantage, np.int64), np.array(ranges).reshape(-1, 4)


def _lengthened(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors with one more component, all of one length; its square."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    top = squares.max(initial=0.0)
    return np.c_[vectors, np.sqrt(np.maximum(0.0, top - squares))], top


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "vectors"))):
            ids, vectors = read_block(*row)
            by_id = np.argsort(ids, kind="stable")
            ids, vectors = ids[by_id], vectors[by_id]
            points, _ = _lengthened(vectors)
            order, vantage, ranges = build(points)
            out.append((row[0], ids[order].tobytes(), vectors[order].tobytes(), points[vantage].tobytes(), ranges.tobytes()))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))]
        if out:
            yield pa.RecordBatch.from_arrays(columns, ["n", "ids", "vectors", "vantage", "ranges"])


class _Walk:
    """The state of a block of queries in one tree."""

    def __init__(self, row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, vectors = read_block(row["n"], row["ids"], row["vectors"])
        width = vectors.shape[1]
        self.ranges = np.frombuffer(row["ranges"], "<f8").reshape(-1, 4)
        self.vantage = np.frombuffer(row["vantage"], "<f8").reshape(len(self.ranges), width + 1)[:, :width]
        self.vectors, self.queries, self.vantage = same_width(vectors, queries, self.vantage)
        self.query_ids, self.k = query_ids, k
        self.squares = np.einsum("ij,ij->i", self.queries, self.queries) + np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)
        self.best = np.full((len(query_ids), k), -np.inf)
        self.depth = len(self.ranges).bit_length()
        self.hits: list[tuple[np.ndarray, np.ndarray]] = []

    def distance(self, which: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.squares[which] - 2 * products))

    def reach(self, which: np.ndarray) -> np.ndarray:
        """Distance of the k-th hit so far."""
        return self.distance(which, self.best[which, 0])

    def leaf(self, number: int, which: np.ndarray) -> None:
        n = len(self.ids)
        a, b = n * number >> self.depth, n * (number + 1) >> self.depth
        products = self.queries[which] @ self.vectors[a:b].T
        products[self.ids[a:b] == self.query_ids[which, None]] = -np.inf
        i, j = np.nonzero(products >= np.maximum(self.best[which, :1] - _SLACK, np.finfo(float).min))
        self.hits.append((which[i], a + j))
        both = np.concatenate([self.best[which], products], axis=1)
        self.best[which] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self.best[which] = np.sort(self.best[which], axis=1)

    def run(self, factor: float) -> tuple[np.ndarray, np.ndarray]:
        everyone = np.arange(len(self.query_ids))
        to_vantage = self.distance(everyone[:, None], self.queries @ self.vantage.T) if len(self.ranges) else np.zeros((len(everyone), 0))
        node = np.zeros(len(everyone), np.int64)  # each query's nearest leaf first
        for level in range(self.depth):
            heap = node + (1 << level) - 1
            d, r = to_vantage[everyone, heap], self.ranges[heap]
            node = 2 * node + (np.maximum(0, np.maximum(r[:, 2] - d, d - r[:, 3])) < np.maximum(0, np.maximum(r[:, 0] - d, d - r[:, 1])))
        for number in np.unique(node):
            self.leaf(int(number), everyone[node == number])
        stack = [(0, 0, everyone, np.zeros(len(everyone)))]
        while stack:
            level, number, which, low = stack.pop()
            own = factor * low <= self.reach(which) + _SLACK
            which, low = which[own], low[own]
            if level == self.depth:
                if len(which := which[node[which] != number]):
                    self.leaf(number, which)
                continue
            heap = number + (1 << level) - 1
            d = to_vantage[which, heap]
            near = np.maximum(low, np.maximum(self.ranges[heap, 0] - d, d - self.ranges[heap, 1]))
            far = np.maximum(low, np.maximum(self.ranges[heap, 2] - d, d - self.ranges[heap, 3]))
            sides = [(level + 1, 2 * number, which, near), (level + 1, 2 * number + 1, which, far)]
            stack += sides if (far < near).sum() > len(which) / 2 else sides[::-1]
        which, rows = (np.concatenate(x) for x in zip(*self.hits)) if self.hits else (np.zeros(0, np.int64),) * 2
        return which, rows


def _one_pair(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple:
    walk = _Walk(row, query_ids, queries, k)
    which, rows = walk.run(factor)
    products = np.einsum("ij,ij->i", walk.queries[which], walk.vectors[rows])
    own = products >= walk.best[which, 0] - _SLACK
    return best_first(query_ids[which[own]], walk.ids[rows[own]], products[own], k)


def recalls(numbered: DataFrame, queries: DataFrame, k: int) -> dict[float, float]:
    """Recall of some factors, measured against exact search on a bounded sample.

    The sample is ``TRIAL_SHARDS`` shards and ``TRIAL_QUERIES`` queries, those with the smallest hashes of their
    numbers; its exact answer is that of factor one. With no more shards and queries than that, it is all there is.
    """
    some = [r["_at"] for r in numbered.select("_at").orderBy(F.xxhash64("_at"), "_at").limit(TRIAL_SHARDS).collect()]
    asked = blocks(queries.orderBy(F.xxhash64("id"), "id").limit(TRIAL_QUERIES), TRIAL_QUERIES).collect()
    asked = [read_block(*row) for row in asked]
    shards = numbered.where(F.col("_at").isin(some)).repartition(max(1, len(some)), "_at").drop("_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                for factor in FACTORS:
                    for ids, vectors in asked:
                        found = _one_pair(row, ids, vectors, k, factor)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), factor)), *(pa.array(x) for x in found)], ["factor", "query_id", "vec_id", "score"])

    hits = durable(shards.mapInArrow(run, "factor double, query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    exact = hits.where("factor = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "vec_id").distinct()
    met = hits.select("factor", "query_id", "vec_id").distinct().join(exact, ["query_id", "vec_id"]).groupBy("factor").count()
    found = {r["factor"]: r["count"] for r in met.collect()}
    return {f: found.get(f, 0) / max(1, found.get(1.0, 0)) for f in FACTORS}


def choose(measured: dict[float, float], recall: float) -> float:
    """The largest factor up to which all reach the recall."""
    chosen = 1.0
    for factor in sorted(measured):
        if measured[factor] < recall:
            break
        chosen = factor
    return chosen


def nearest(table: DataFrame, is_query, k: int = 20, factor: float | None = None, recall: float = 0.95, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, factor: the k largest inner products found for each query.

    ``is_query``: a condition on the column ``id``. ``factor``: 1 is exact, more prunes more; None chooses
    the largest that reaches ``recall`` on a sample of this table.
    """
    rows = usable(table, id_, vector).where(F.exists("vector", lambda x: x != 0))
    shards = written(blocks(rows, BLOCK_ROWS).mapInArrow(_index, TREE))
    queries = rows.where(is_query)
    used = choose(recalls(shards, queries, k), recall) if factor is None else factor
    return search(shards, queries, lambda row, ids, vectors: _one_pair(row, ids, vectors, k, used), k, "double").withColumn("factor", F.lit(float(used)))
