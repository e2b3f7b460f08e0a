"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are scaled to integers, so scores and ties are exact. Each shard keeps one list per
dimension, sorted by value. A query reads its lists from the end that its own component favours,
all to the same depth, scores every vector met, and stops as soon as the sum of what the lists
still offer is below its k-th score: no unseen vector can then enter, not even by a tie.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither
does a null id; a shorter vector counts as padded with zeros; rows that share the query's id are
its own; rows repeated under a query's id are queries each, their hits ranked together under that
id; fewer candidates than k give all of them; an empty table gives no rows; other columns are ignored. Scores beyond 64 bits are cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.vector_blocks import BLOCK_ROWS, best_first, blocks, read_block, same_width, search, usable, written


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each shard's lists: the rows by rising value, dimension after dimension."""
    for batch in batches:
        lists = [np.argsort(read_block(*row)[1], axis=0, kind="stable").T.astype("<i4").tobytes() for row in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "vectors")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "ids", "vectors")), pa.array(lists, pa.binary())], ["n", "ids", "vectors", "lists"])


def threshold_topk(values: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores that hold the k best of one query among the allowed rows, ties included."""
    n = len(values)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)  # lists read from their end, and from their beginning
    seen, scores, depth = np.zeros(n, bool), np.zeros(n, values.dtype), 0
    while depth < n:
        upto = min(n, max(k, 2 * depth)) if len(up) + len(down) else n
        met = np.full(n, not len(up) + len(down))
        met[lists[up, n - upto : n - depth]] = True
        met[lists[down, depth:upto]] = True
        new = np.flatnonzero(met & ~seen)
        scores[new] = values[new] @ query
        seen[new] = True
        depth = upto
        own = np.flatnonzero(seen & allowed)
        if len(own) >= k:
            kth = np.partition(scores[own], len(own) - k)[len(own) - k]
            if depth < n and (query[up] * values[lists[up, n - depth], up]).sum() + (query[down] * values[lists[down, depth - 1], down]).sum() < kth:
                break
    own = np.flatnonzero(seen & allowed)
    if len(own) > k:
        own = own[scores[own] >= np.partition(scores[own], len(own) - k)[len(own) - k]]
    return own, scores[own]


def _one_pair(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple:
    ids, values = read_block(row["n"], row["ids"], row["vectors"])
    lists = np.frombuffer(row["lists"], "<i4").reshape(values.shape[1], -1)
    values, queries = same_width(values, queries)
    lists = np.concatenate([lists, np.tile(np.arange(len(ids), dtype="<i4"), (values.shape[1] - len(lists), 1))])
    if values.shape[1] * np.abs(values).max(initial=0) * np.abs(queries).max(initial=0) >= 2.0**53:  # beyond exact doubles
        values, queries = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (values, queries))
    query, vec, score = [], [], []
    for q, vector in zip(query_ids, queries):
        own, found = threshold_topk(values, lists, vector, k, ids != q)
        query.append(np.full(len(own), q))
        vec.append(ids[own])
        score.append(np.clip(found, -(2**63), 2**63 - 1).astype(np.int64))
    return best_first(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (query, vec, score)), k)


def exact_topk(table: DataFrame, is_query, k: int = 10, scale: int = 1024, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each query.

    ``is_query``: a condition on the column ``id``. Components become floor(scale * component).
    """
    rows = usable(table, id_, vector).withColumn("vector", F.transform("vector", lambda x: _floor(x * F.lit(float(scale)))))
    shards = blocks(rows, BLOCK_ROWS).mapInArrow(_index, "n long, ids binary, vectors binary, lists binary")
    return search(written(shards), rows.where(is_query), lambda row, ids, vectors: _one_pair(row, ids, vectors, k), k, "long")


def _floor(x):
    """Floor that stays a double; doubles of 2^52 and more are whole already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
