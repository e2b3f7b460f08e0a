"""Vectors as blocks: rows of a table packed, without a shuffle, into pieces of bounded size.

A search pairs every block of queries with every block of vectors, in rows that each hold one of
either, so a task needs the memory of one pair at a time; hits are cut to the best k per pair
before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import durable

BLOCKS = "n long, ids binary, vectors binary"
BLOCK_ROWS, QUERY_ROWS = 8192, 512


def usable(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and vector (array of doubles) of the rows that have both, the vector with finite components only."""
    v = F.col(vector).cast("array<double>")
    whole = table.select(F.col(id_).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    return whole.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of doubles; a shorter vector counts as padded with zeros."""
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    width = int(offsets.max(initial=0))
    out = np.zeros((len(offsets), width))
    out[np.arange(width) < offsets[:, None]] = flat
    return out


def same_width(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, vector) of each input partition, packed as they come."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0

        def one() -> pa.RecordBatch:
            whole = np.concatenate(same_width(*parts))
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([whole.astype("<f8").tobytes()], pa.binary())], ["n", "ids", "vectors"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, size - n)
                ids.append(some.column("id").to_numpy(zero_copy_only=False))
                parts.append(matrix(some.column("vector")))
                n, at = n + some.num_rows, at + some.num_rows
                if n == size:
                    yield one()
                    ids, parts, n = [], [], 0
        if n:
            yield one()

    return rows.mapInArrow(packed, BLOCKS)


def read_block(n: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, -1)


def written(shards: DataFrame) -> DataFrame:
    """The shards, written once, with a number ``_at`` each."""
    return durable(shards.withColumn("_at", F.monotonically_increasing_id()))


def search(numbered: DataFrame, queries: DataFrame, one_pair: Callable, k: int, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards for each query.

    ``numbered``: shards as ``written`` gives them. ``one_pair(shard row, query ids, query
    vectors)`` gives arrays query id, vector id, score. Both sides are written once. Shards are dealt into as many groups as there are shards, and
    every query block goes to each group once, by an equi-join on the group's number; hits grow
    with queries times shards, at most k each.
    """
    n = max(1, numbered.count())
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(n)))
    asked = durable(blocks(queries, QUERY_ROWS)).select(*(F.col(c).alias(f"q_{c}") for c in ("n", "ids", "vectors")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_group"))
    pairs = dealt.join(asked, "_group").drop("_at", "_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = one_pair(row, *read_block(row["q_n"], row["q_ids"], row["q_vectors"]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_first(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query, ties to the smaller id."""
    order = np.lexsort((vec_id, -score, query))
    query, vec_id, score = query[order], vec_id[order], score[order]
    first = np.searchsorted(query, query, side="left")
    own = np.arange(len(query)) - first < k
    return query[own], vec_id[own], score[own]
