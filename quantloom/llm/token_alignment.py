"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Method: the byte ranges of a text's B tokens are a static interval index (starts and ends, both
sorted, as tokens don't overlap each other). Each A token is a stabbing query: two bisections give
the stretch of B tokens it overlaps. A gap between A tokens that no B token spans closes a group.

A text is aligned part by part, cut at single spaces, where both tokenizers begin a new token; a
part met before is not aligned again. Should a token cross a cut, which is checked, parts are
aligned one by one.

Counts of linked pairs are taken over the whole corpus without moving links: documents are handled
in blocks of about ``block_bytes`` of text, a block keeps every different part once, a dictionary
of the pairs it met, and its links as numbers into that dictionary, and only dictionaries are
shuffled. However frequent a pair, it stands once in each block's dictionary. Each block then meets
its dictionary again, with the corpus' counts, by a cogroup that holds one block at a time. Blocks
lie in row groups of a few each, so memory doesn't hang on how many a task has.

Defined cases: texts that are null, empty or whose tokens don't give back a space and the text, byte by
byte, have no tokens: zeros and an empty string. Special tokens' strings inside texts are plain text. Rows with
a null doc_id and repeated rows are kept each and counted each; a text longer than a block is a
block by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.best_fit_packing import _tokenizer
from quantloom.llm.common import shared_folder, small_batches

BLOCK_BYTES = 4 << 20
GROUP_BYTES = 16 << 20  # of a row group of the blocks' file; a task writes and reads one at a time
PARTS_KEPT, LONG_PART, TOGETHER = 200_000, 200, 1000  # of a worker's table: parts, characters of one, parts encoded together
MARK = "▁"
SINGLE_SPACES, OTHER_SPACES = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s|^\s|\s\Z")
_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_HELD = ("stops", "parts", "part_links", "links")
_OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BLOCK = (
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "stops binary, parts binary, part_links binary, links binary, pair array<long>, n array<long>"
)
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Side:
    """One tokenizer: ids of a text, and of every id its bytes, their number, and its decimal form followed by either separator."""

    def __init__(self, encode, pieces: list[bytes], end: str):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.followed = np.array([[f"{i},", f"{i}{end}"] for i in range(len(pieces))], object)


def byte_level_side(content: str) -> Side:
    """A byte-level BPE from the text of a tokenizers file; encodes a space and the text, added tokens as plain text."""
    tokenizer = _tokenizer(content)
    encoding = tokenizer.encoding
    added = {i: s.encode() for s, i in tokenizer.added.items()}
    pieces = [added[i] if i in added else encoding.decode_single_token_bytes(i) for i in range(max(encoding.n_vocab, *(i + 1 for i in added), 0))]
    return Side(lambda text: encoding.encode_ordinary(f" {text}"), pieces, "|")


def piece_side(model: bytes) -> Side:
    """A sentencepiece model; it adds the space itself."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    return Side(lambda text: library.encode(text, num_threads=1), pieces, ";")


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every A token the first B token it overlaps and the one after the last.

    Lengths are positive and add up to the same on both sides.
    """
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    return np.searchsorted(b_ends, a_ends - a_lengths, side="right"), np.searchsorted(b_ends - b_lengths, a_ends, side="left")


def group_ends(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The A tokens after which no B token spans the gap."""
    return np.flatnonzero(np.append(last[:-1] == first[1:], True)) if len(first) else np.zeros(0, np.int64)


def stretches(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) that overlap, as two arrays."""
    n = last - first
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


def groups_text(left: Side, right: Side, a: np.ndarray, b: np.ndarray, ends: np.ndarray, last: np.ndarray) -> list[str]:
    """``a1,``, ``a2|``, ``b1;``, ``a3|``, ``b2,``, ``b3;``: the ids of each group, A's and B's."""
    a_group, b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_group[ends[:-1] + 1] = 1
    b_group[last[ends[:-1]]] = 1
    a_closes, b_closes = np.append(a_group[1:], 1), np.append(b_group[1:], 1)
    a_group, b_group = np.cumsum(a_group), np.cumsum(b_group)
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + np.r_[0, last[ends]][a_group]] = left.followed[a, a_closes]
    out[np.arange(len(b)) + ends[b_group] + 1] = right.followed[b, b_closes]
    return out.tolist()


class Part(NamedTuple):
    """What a stretch of text adds to its document: tokens of either side, groups, their text, and its linked pairs."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes  # int64, A id times the size of B's vocabulary plus B id


def parts_of(text: str) -> list[str]:
    """The text cut at single spaces between other characters, where neither tokenizer has a token across."""
    return SINGLE_SPACES.split(text) if OTHER_SPACES.search(text) else text.split(" ")


def align(left: Side, right: Side, parts: list[str]) -> list[Part | None]:
    """Align parts, each after a space; None for one whose tokens don't give its bytes back.

    Parts are encoded as one text; should a token cross from part to part, one by one.
    """
    text = " ".join(parts)
    a, b, whole = left.encode(text), right.encode(text), f" {text}".encode("utf-8", "surrogatepass")
    same = b"".join(map(left.pieces.__getitem__, a)) == whole == b"".join(map(right.pieces.__getitem__, b))
    if same:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_lengths, b_lengths = left.lengths[a], right.lengths[b]
        stops = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in parts])
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        a_stops, b_stops = np.searchsorted(a_ends, stops) + 1, np.searchsorted(b_ends, stops) + 1
        same = bool((a_ends[a_stops - 1] == stops).all() and (b_ends[b_stops - 1] == stops).all())
    if not same:
        return [None] if len(parts) == 1 else [one for p in parts for one in align(left, right, [p])]
    first, last = overlaps(a_lengths, b_lengths)
    ends, (i, j) = group_ends(first, last), stretches(first, last)
    pairs, link_stops = a[i] * len(right.pieces) + b[j], np.cumsum(last - first)[a_stops - 1]
    tokens, group_stops = groups_text(left, right, a, b, ends, last), np.searchsorted(ends, a_stops - 1) + 1
    out, begun = [], (0, 0, 0, 0)
    for stop in zip(a_stops.tolist(), b_stops.tolist(), group_stops.tolist(), link_stops.tolist()):
        own = "".join(tokens[begun[0] + begun[1] : stop[0] + stop[1]])[:-1]
        out.append(Part(stop[0] - begun[0], stop[1] - begun[1], stop[2] - begun[2], own, pairs[begun[3] : stop[3]].tobytes()))
        begun = stop
    return out


class Aligner:
    """Aligns texts part by part, in a worker; parts met lately are kept, within a bound."""

    def __init__(self, content: str, model: bytes):
        self.left, self.right = byte_level_side(content), piece_side(model)
        self.kept: dict[str, Part | None] = {}

    def parts(self, wanted: list[str]) -> list[Part | None]:
        """One result for each of some different parts."""
        if len(self.kept) > PARTS_KEPT:
            self.kept.clear()
        kept = self.kept
        fresh = [p for p in wanted if p not in kept]
        plain = [p for p in fresh if p and not p[0].isspace() and not p[-1].isspace()]
        for some in [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)] + [[p] for p in set(fresh) - set(plain)]:
            kept.update(zip(some, align(self.left, self.right, some)))
        found = [kept[p] for p in wanted]
        for p in fresh:
            if len(p) > LONG_PART:
                del kept[p]
        return found


class Block:
    """Documents taken up together: their parts as numbers, and every different part once."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.size = aligner, 0
        self.numbers: dict[str, int] = {}
        self.found: list[Part | None] = []
        self.groups: list[str] = []
        self.lost: set[int] = set()  # parts without tokens
        self.rows: list[tuple] = []  # doc_id, digest
        self.parts: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.size += len(text or "") + 64
        numbers, groups, parts, digest = self.numbers, self.groups, parts_of(text) if text else [], ""
        own = list(map(numbers.get, parts))
        if None in own:
            fresh = list(dict.fromkeys([p for p, i in zip(parts, own) if i is None]))
            at = range(len(numbers), len(numbers) + len(fresh))
            numbers.update(zip(fresh, at))
            met = self.aligner.parts(fresh)
            self.found += met
            self.lost.update(i for i, p in zip(at, met) if p is None)
            groups += [p.groups if p else "" for p in met]
            own = list(map(numbers.__getitem__, parts))
        if self.lost and not self.lost.isdisjoint(own):
            own = []
        if own:
            digest = hashlib.sha256(";".join(map(groups.__getitem__, own)).encode()).hexdigest()
        self.rows.append((doc_id, digest))
        self.parts.append(np.array(own, np.int64))

    def packed(self) -> pa.RecordBatch:
        """A list for each column of the documents, parts and links as numbers, and the pairs that links point to with their count."""
        nothing = Part(0, 0, 0, "", b"")
        found = [p or nothing for p in self.found]
        numbers = np.concatenate(self.parts)
        stops = np.cumsum([len(p) for p in self.parts])
        n_links = np.array([len(p.pairs) // 8 for p in found], np.int64)
        of_part = np.array([p[:3] for p in found], np.int64).reshape(-1, 3).T
        sums = [_sums(x, numbers, stops) for x in (*of_part, n_links)]
        met, links = np.unique(np.frombuffer(b"".join(p.pairs for p in found), np.int64), return_inverse=True)
        times = np.repeat(np.bincount(numbers, minlength=len(found)), n_links)
        n = np.bincount(links, times, len(met)).astype(np.int64)
        doc_ids, digests = zip(*self.rows)
        lists = [pa.array([list(doc_ids)], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.int64())) for x in sums), pa.array([list(digests)], pa.list_(pa.string()))]
        held = [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (stops, numbers, n_links, links)]
        return pa.RecordBatch.from_arrays([*lists, *held, pa.array([met], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], [*_DOC, *_HELD, "pair", "n"])


def _sums(values: np.ndarray, numbers: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of the values that the numbers name, over stretches of numbers."""
    return np.diff(np.r_[0, np.r_[0, np.cumsum(values[numbers])][stops]]).astype(np.int64)


def _resolved(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one block, given its dictionary's place, count and best."""
    own = {c: blocks.column(c)[0] for c in (*_DOC, *_HELD)}
    order = np.argsort(counts.column("place").to_numpy())
    stops, numbers, n_links, links = (np.frombuffer(own[c].as_py(), "<u4").astype(np.int64) for c in _HELD)
    columns = {c: own[c].values for c in _DOC}
    for column, name in (("best", "n_best"), ("count", "count_sum")):
        by_part = _sums(counts.column(column).to_numpy()[order], links, np.cumsum(n_links))
        columns[name] = pa.array(_sums(by_part, numbers, stops))
    return pa.table([columns[c] for c in _OUT], list(_OUT))


_aligners: dict[int, Aligner] = {}


def _aligner(files: tuple[str, bytes]) -> Aligner:
    """A worker's aligner for the two files, from task to task."""
    if (key := hash(files)) not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*files)
    return _aligners[key]


def alignments(docs: DataFrame, byte_level_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    small_batches(docs)
    spark = docs.sparkSession
    with open(byte_level_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))  # two vocabulary files, whatever the input
        right_size = len(piece_side(shared.value[1]).pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        block = Block(aligner)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                block.add(doc_id, text.as_py())
                if block.size >= block_bytes:
                    yield block.packed()
                    block = Block(aligner)
        if block.rows:
            yield block.packed()

    path = shared_folder(spark)
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK)
    # a block is one row of megabytes: without a look at the size after each row, all blocks of a task would be held as one row group
    few = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1}
    blocks.withColumn("block", F.monotonically_increasing_id()).write.options(**few).parquet(path)
    blocks, again = spark.read.parquet(path), spark.read.parquet(path)

    met = again.select("block", F.posexplode(F.arrays_zip("pair", "n")).alias("place", "own")).select("block", "place", "own.pair", "own.n")
    counts = met.groupBy("pair").agg(F.sum("n").alias("count"))
    same_b = Window.partitionBy(F.col("pair") % right_size)  # at most as many rows as A has ids
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(same_b)).cast("long"))
    found = met.drop("n").join(counts, "pair").select("block", "place", "count", "best")
    return blocks.select("block", *_DOC, *_HELD).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_resolved, OUT)
