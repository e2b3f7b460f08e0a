"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Method: pieces above one third of the capacity can share a sequence with one more such piece at
most, so they are matched greedily, the longest with the longest partner that still fits; all
smaller pieces then go, longest first, into the tightest gap that holds them, and open a new
sequence only where no gap does.

The decisions depend on nothing but how many pieces there are of each length, and there are at
most ``capacity`` lengths. So Spark counts lengths over all pieces, ``plan`` decides on those
counts (its work and its size are bounded by the capacity, whatever the input), and every piece
finds its slot from its rank among the pieces of its length. Ranks come from counts per task and
a running sum, so a length that a third of all pieces share is ranked task by task.

Defined cases: null and empty texts are one piece that holds only the end id; repeated rows are
packed each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import durable, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Slots:
    """Where the pieces of each length go: by length, arrays of first rank, sequence, offset."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def plan(counts: dict[int, int], capacity: int) -> Slots:
    """Decide on sequences for so many pieces of each length."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left = Counter(counts)
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by gap: copies, lengths inside

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    for longest in large:
        while left[longest]:
            partner = next((n for n in large if n <= capacity - longest and left[n] >= 1 + (n == longest)), None)
            if partner is None:
                copies, inside = left[longest], [longest]
            elif partner == longest:
                copies, inside = left[longest] // 2, [longest, longest]
            else:
                copies, inside = min(left[longest], left[partner]), [longest, partner]
            left.subtract({n: copies * inside.count(n) for n in set(inside)})
            open_[capacity - sum(inside)].append((copies, inside))

    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while n := left[length]:
            gap = next((g for g in range(length, capacity) if open_.get(g)), None)
            copies, inside = open_[gap].pop() if gap is not None else (n, [])
            times = min(n, (gap or capacity) // length)  # a gap that still holds another one is the tightest
            filled = min(copies, n // times)
            if gap is not None and copies > filled:
                open_[gap].append((copies - filled, inside))
            open_[(gap or capacity) - times * length].append((filled, inside + [length] * times))
            left[length] -= filled * times

    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: Counter = Counter()
    sequence = 0
    for groups in open_.values():
        for copies, inside in groups:
            offset = 0
            for length in inside:
                found[length].append((ranks[length], sequence, offset))
                ranks[length] += copies
                offset += length
            sequence += copies
    return Slots({n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in found.items()}, sequence)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset, in place of columns so named; ``length`` (1 to capacity) is all that counts.

    The pieces are cut off from their lineage first, so ranks stay the same whenever a task is
    run again.
    """
    pieces = pieces.drop("sequence_id", "offset", "_task", "_seq", "_rank", "_base")
    schema, names = pieces.schema, pieces.columns
    numbered = durable(pieces.withColumns({"_task": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    by_task = numbered.groupBy("_task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity).by_length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                firsts, sequences, offsets = slots.value[int(n)]
                at = np.searchsorted(firsts, ranks[own], side="right") - 1
                sequence[own], offset[own] = sequences[at] + ranks[own] - firsts[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_task.select("_task", "length", before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("_task", "length").orderBy("_seq")) - 1
    ranked = numbered.withColumn("_rank", within).join(bases, ["_task", "length"])
    whole = ranked.select(*names, (F.col("_rank") + F.col("_base")).alias("_rank"))
    placed_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long"
    return whole.mapInArrow(place, placed_schema)


class Tokenizer:
    """Byte-level BPE of a tokenizers file, with that library's ids.

    The vocabulary runs in tiktoken, whose ids are the same as long as merges are listed in id
    order, which is checked. Added tokens in a text become their ids, as the library does.
    """

    def __init__(self, content: str):
        import re

        import public_tokenizers
        import tiktoken

        spec = json.loads(content)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("merges aren't in the order of their ids")
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in self.added}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def ids(self, text: str, end_id: int) -> np.ndarray:
        parts = self.split(text) if self.split and any(a in text for a in self.added) else [text]
        found = [[self.added[p]] if p in self.added else self.encoding.encode_ordinary(p) for p in parts]
        return np.array([i for part in found for i in part] + [end_id] if len(found) > 1 else found[0] + [end_id], "<u4")


_tokenizers: dict[int, Tokenizer] = {}


def _tokenizer(content: str) -> Tokenizer:
    if (key := hash(content)) not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(content)
    return _tokenizers[key]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids array<int>``) of every document.

    Only documents longer than the capacity are cut, into pieces of the whole capacity with the
    remainder first.
    """
    small_batches(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the input
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            rows, kept = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = tokenizer.ids(text.as_py() or "", end_id)
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    own = ids[start:stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(own.tobytes())))
                    if with_ids:
                        kept.append(own.astype(np.int32))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: the pieces with sequence_id and offset."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), capacity)
