"""Removal of long repeats over the whole corpus, by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. Finding such strings takes no list of all suffixes:

1. Documents are dealt into blocks. Every string of LENGTH bytes chooses its smallest-hashed
   q-gram, so equal strings choose the same one at the same place; chosen q-grams are anchors,
   about one in 14 bytes. Per block the distinct anchors are sent, six bytes each, to where they
   are counted, and a mask comes back that says which ones the block shares with other documents.
2. Only around shared anchors a block sends contexts: all strings of LENGTH bytes that hold the
   anchor lie inside one. Equal contexts of a block are one, with the smallest doc_id; the other
   documents that have it are decided on the spot.
3. Contexts meet in the q-gram bucket of their anchor and are refined there. All offsets of a
   bucket's contexts get the identifiers of their 8-gram buckets; those are refined by sorting on
   the pair of a bucket and the bucket at a later offset, first 8 on, then 9, then 25, each time
   with the identifiers that the refinement before gave, until buckets hold equal strings of
   LENGTH bytes. The smallest doc_id in a bucket decides.
4. Blocks take the verdicts back and cut their documents.

Nothing gathers for a frequent passage: it is one context per block. An anchor that stands in
very many different contexts is dealt out string by string instead, each to a bucket of its own
(``HOT``). Blocks and buckets have a fixed share of the bytes, so their number grows instead.

Defined cases: null text counts as empty; rows without doc_id are kept whole and remove nothing;
rows that share a doc_id don't remove from each other; an empty table gives no rows; very long
texts are worked off in slices; other columns are ignored by ``cut_repeats`` and kept by ``dedup``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import fresh, shuffle_width

LENGTH, GRAM = 50, 24
LEFT, RIGHT = LENGTH - GRAM, LENGTH  # bytes of a context before and from its anchor
HOT = 50_000
BLOCK_BYTES = 6 << 20
_SLICE = 1 << 19
FIRST, SHIFTS = 8, (8, 9, 25)  # buckets of 8-grams become those of strings of 16, 25 and 50 bytes
_HOT_ROWS, _REFINED = 10_000, 8_192
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
CUT = "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>"
_PARCELS = "dest long, kind int, block long, body binary"


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = op(x[:-size], x[size:]), 2 * size
    return op(x[: size - width], x[width - size :]) if size < width else x


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the q-gram at each place."""
    words = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        own = words[k::8]
        own[:] = np.frombuffer(data, "<u8", len(own), k)
    n = len(data) - GRAM + 1
    h = words[:n] * np.uint64(_MIX[0])
    for i in range(1, GRAM // 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[3]) + words[8 * i : 8 * i + n] * np.uint64(_MIX[i])
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX[3])
    return h ^ (h >> np.uint64(31))


class Block:
    """The documents of a block in one buffer, ordered by doc_id and bytes."""

    def __init__(self, doc_ids: list[int], texts: list[bytes]):
        self.order = sorted(range(len(texts)), key=lambda i: (doc_ids[i], texts[i]))
        self.doc_ids = np.array([doc_ids[i] for i in self.order], np.int64)
        sizes = np.array([len(texts[i]) for i in self.order], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(texts[i] for i in self.order), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the q-grams that strings of LENGTH bytes choose; no string spans two documents."""
        places, hashes, wide = [], [], LENGTH - GRAM + 1
        for a in range(0, max(0, len(self.data) - LENGTH + 1), _SLICE):
            data = np.ascontiguousarray(self.data[a : a + _SLICE + LENGTH - 1])
            h = _gram_hashes(data)
            least = _sliding(np.minimum, h, wide)
            for end in self.ends[np.searchsorted(self.ends, a) :]:
                if end - LENGTH >= a + len(least):
                    break
                least[max(0, end - LENGTH + 1 - a) : max(0, end - a)] = 0
            padded = np.zeros(len(h) + wide - 1, np.uint64)
            padded[wide - 1 : wide - 1 + len(least)] = least
            own = np.flatnonzero(_sliding(np.maximum, padded, wide) == h)
            places.append(own + a)
            hashes.append(h[own])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place, first = np.unique(np.concatenate(places), return_index=True)  # slices overlap
        return place, np.concatenate(hashes)[first]

    def documents_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")


def _distinct(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places and hashes, the sorted distinct hashes, and a count for each (top bit: in several documents)."""
    place, h = block.anchors()
    ids = block.doc_ids[block.documents_of(place)]
    order = np.argsort(h, kind="stable")
    values, first, n = np.unique(h[order], return_index=True, return_counts=True)
    ranked = ids[order]
    several = np.minimum.reduceat(ranked, first) != np.maximum.reduceat(ranked, first) if len(first) else np.zeros(0, bool)
    return place, h, values, np.minimum(n, 0x7FFF).astype("<u2") | (several.astype("<u2") << np.uint16(15))


def _dealt(dest: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each destination, in order, by one sort."""
    order = np.argsort(dest, kind="stable")
    edges = np.flatnonzero(np.diff(dest[order], prepend=-1))
    return {int(dest[own[0]]): own for own in np.split(order, edges[1:])} if len(dest) else {}


def _parcel(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    dest, kind, block, body = zip(*rows) if rows else ([],) * 4
    return pa.table({"dest": pa.array(dest, pa.int64()), "kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64()), "body": pa.array(body, pa.binary())})


def _packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays)] + [a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpacked(body: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 * (n + 1)
    for size, kind in zip(np.frombuffer(raw, "<i8", n, 8), types):
        out.append(np.frombuffer(raw, np.uint8, size, at).view(kind))
        at += size
    return out


def _send_anchors(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = defaultdict(lambda: [[], []])
    for batch in batches:
        for block, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "data"))):
            held[block][0].append(doc_id)
            held[block][1].append(data)
    while held:
        number, (doc_ids, texts) = held.popitem()
        block = Block(doc_ids, texts)
        del doc_ids, texts
        _, _, values, counts = _distinct(block)
        dest = (values % np.uint64(parts)).astype(np.int64)
        rows = []
        for part, own in _dealt(dest).items():
            keys = (values[own] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((part, 0, number, keys.tobytes() + counts[own].tobytes()))
        yield from _parcel(rows).to_batches()


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks over the distinct anchors each block sent: 0 its own, 1 shared, 2 shared and hot."""
    held: dict[int, list] = defaultdict(list)
    for batch in batches:
        for dest, block, body in zip(*(batch.column(c).to_pylist() for c in ("dest", "block", "body"))):
            held[dest].append((block, body))
    while held:
        dest, sent = held.popitem()
        sizes = [len(body) // 8 for _, body in sent]
        keys, counts = np.zeros((sum(sizes), 8), np.uint8), []
        at = 0
        for (_, body), n in zip(sent, sizes):
            keys[at : at + n, :6] = np.frombuffer(body, np.uint8, 6 * n).reshape(-1, 6)
            counts.append(np.frombuffer(body, "<u2", n, 6 * n))
            at += n
        count = np.concatenate(counts)
        _, inverse, n = np.unique(keys.view("<u8")[:, 0], return_inverse=True, return_counts=True)
        total = np.bincount(inverse, count & 0x7FFF)
        several = np.bincount(inverse, count >> 15) > 0
        mark = (((n > 1) | several).astype(np.uint8) + ((total > HOT) & ((n > 1) | several)))[inverse].astype(np.uint8)
        rows, at = [], 0
        for (block, _), size in zip(sent, sizes):
            if mark[at : at + size].any():
                rows.append((dest, 1, block, _packed(mark[at : at + size])))
            at += size
        yield from _parcel(rows).to_batches()


def _contexts(block: Block, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places have a string of LENGTH bytes around them, and rows of 80 bytes for those.

    A row has 76 bytes of context, zero outside the document, how many there are left and right
    of the place, and two bytes without use.
    """
    doc = block.documents_of(place)
    left = np.minimum(LEFT, place - block.starts[doc])
    right = np.minimum(RIGHT, block.ends[doc] - place)
    ok = np.flatnonzero(left + right >= LENGTH)
    place, left, right = place[ok], left[ok], right[ok]
    padded = np.concatenate([np.zeros(LEFT, np.uint8), block.data, np.zeros(RIGHT, np.uint8)])
    rows = np.zeros((len(place), 80), np.uint8)
    for k in range(LEFT + RIGHT):
        rows[:, k] = np.where((k >= LEFT - left) & (k < LEFT + right), padded[place + k], 0)
    rows[:, 76], rows[:, 77] = left, right
    return ok, rows


def _classes(rows: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by row and doc_id, where a new row begins in it, and the number of each one's distinct row."""
    words = rows.view("<u8")
    order = np.lexsort((doc_id, *words.T))
    new = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(1)]
    return order, new, np.cumsum(new) - 1


def _strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows dealt out into one for each string of LENGTH bytes: row, its origin, its start."""
    out, origin, start = [], [], []
    for s in range(LEFT + 1):
        own = np.flatnonzero((rows[:, 76] >= LEFT - s) & (rows[:, 77] >= LENGTH - LEFT + s))
        one = np.zeros((len(own), 80), np.uint8)
        one[:, s : s + LENGTH] = rows[own, s : s + LENGTH]
        one[:, 76], one[:, 77] = LEFT - s, LENGTH - LEFT + s
        out.append(one)
        origin.append(own)
        start.append(np.full(len(own), s, np.int64))
    return np.concatenate(out), np.concatenate(origin), np.concatenate(start)


def _destination(rows: np.ndarray, parts: int, dealt_out: bool) -> np.ndarray:
    """By the anchor; the dealt-out strings of hot anchors go by the string."""
    words = rows.view("<u8")
    anchor = rows[:, LEFT : LEFT + GRAM].copy().view("<u8")
    key = anchor[:, 0] * np.uint64(_MIX[0]) ^ (anchor[:, 1] * np.uint64(_MIX[1]) + anchor[:, 2] * np.uint64(_MIX[2]))
    for i in range(10 if dealt_out else 0):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(_MIX[3]) + words[:, i] * np.uint64(_MIX[i % 3])
    return ((key ^ (key >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _send_contexts(number: int, docs: pa.Table, masks: pa.Table, parts: int) -> pa.Table:
    if not masks.num_rows:
        return _parcel([])
    block = Block(docs.column("doc_id").to_pylist(), docs.column("data").to_pylist())
    place, h, values, _ = _distinct(block)
    dest = (values % np.uint64(parts)).astype(np.int64)
    mark, dealt = np.zeros(len(values), np.uint8), _dealt(dest)
    for part, body in zip(masks.column("dest").to_pylist(), masks.column("body").to_pylist()):
        mark[dealt[part]] = _unpacked(body, np.uint8)[0]
    marked = mark[np.searchsorted(values, h)]
    place, marked = place[marked > 0], marked[marked > 0]
    ok, rows = _contexts(block, place)
    if not len(ok):
        return _parcel([])
    place, hot = place[ok], marked[ok] == 2
    doc_id = block.doc_ids[block.documents_of(place)]
    order, new, row_of = _classes(rows, doc_id)
    rows_sent, first, hot = rows[order[new]], doc_id[order[new]], hot[order[new]]
    theirs = doc_id[order] == first[row_of]
    # strings of documents whose context also stands in a document with a smaller doc_id here
    gone, left, right = order[~theirs], rows[:, 76].astype(np.int64), rows[:, 77].astype(np.int64)
    local = _merged(place[gone] - left[gone], place[gone] + right[gone] - LENGTH + 1)
    out: list[tuple[int, int, int, bytes]] = []

    def send(sent: np.ndarray, ids: np.ndarray, numbers: np.ndarray, dealt_out: bool) -> None:
        for part, own in _dealt(_destination(sent, parts, dealt_out)).items():
            out.append((part, 0, number, _packed(sent[own], ids[own].astype("<i8"), numbers[own].astype("<i8"))))

    calm = np.flatnonzero(~hot)
    send(rows_sent[calm], first[calm], calm, False)
    at, decided, asked = len(rows_sent), [], []  # (row, start) known to go; (row, start, number asked under)
    for some in np.split(h := np.flatnonzero(hot), range(_HOT_ROWS, len(h), _HOT_ROWS)):
        strings, origin, start = _strings(rows_sent[some])
        if not len(strings):
            continue
        order_s, new_s, string_of = _classes(strings, first[some][origin])
        ids = first[some][origin][order_s]
        least = ids[new_s]
        mine = ids == least[string_of]
        decided.append(np.stack([some[origin[order_s[~mine]]], start[order_s[~mine]]]))
        asked.append(np.stack([some[origin[order_s[mine]]], start[order_s[mine]], at + string_of[mine]]))
        send(strings[order_s[new_s]], least, at + np.arange(len(least)), True)
        at += len(least)
    known = [np.concatenate(x, axis=1).ravel() if x else np.zeros(0) for x in (decided, asked)]
    out.append((number, 1, number, _packed(local, place[order[theirs]].astype("<i8"), row_of[theirs].astype("<i8"), np.array([at], "<i8"), *(x.astype("<i8") for x in known))))
    return _parcel(out)


def _merged(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted disjoint intervals, as begin, end, begin, end ..."""
    if not len(begins):
        return np.zeros(0, "<i8")
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, begins[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(begins) - 1]
    return np.stack([begins[new], reach[last]], axis=1).ravel().astype("<i8")


def _numbered(x: np.ndarray) -> np.ndarray:
    """Bucket identifiers: equal values get equal numbers, in sorted order."""
    order = np.argsort(x)
    ranked = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
    return out


def refine(bucket: np.ndarray, shift: int) -> np.ndarray:
    """Buckets of strings at every offset (columns) of some contexts (rows), refined by sorting on the
    identifiers of the buckets at the offset ``shift`` later; those are the buckets themselves, so what
    one refinement finds out the next one uses."""
    now, later = bucket[:, :-shift], bucket[:, shift:]
    return _numbered((now * (int(bucket.max(initial=0)) + 1) + later).ravel()).reshape(now.shape)


def string_buckets(rows: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the strings of LENGTH bytes at their starts (columns) in contexts (rows)."""
    text = np.ascontiguousarray(rows[:, : LEFT + RIGHT])
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, FIRST, axis=1)).view("<u8")[:, :, 0]
    bucket = _numbered(grams.ravel()).reshape(grams.shape)
    for shift in SHIFTS:
        bucket = refine(bucket, shift)
    return bucket


def covered_strings(rows: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """For each context a bit mask of its strings, by start, that a smaller doc_id also has.

    Equal contexts are one. They are dealt into the q-gram buckets of their anchors; one that is
    alone in its bucket has no other equal string, the rest is refined, some thousand at a time.
    """
    if not len(rows):
        return np.zeros(0, np.uint32)
    order, new, row_of = _classes(rows, doc_id)
    one, first = rows[order[new]], doc_id[order[new]]
    starts = np.uint32(1) << np.arange(LEFT + 1, dtype=np.uint32)
    whole = (_there(one) * starts).sum(axis=1, dtype=np.uint32)
    anchor = np.zeros(len(one), np.int64)
    for word in one[:, LEFT : LEFT + GRAM].copy().view("<u8").T:
        anchor = _numbered(anchor * (len(one) + 1) + _numbered(word))
    by = np.argsort(anchor, kind="stable")
    size = np.bincount(anchor)[anchor[by]]
    by, mask = by[size > 1], np.zeros(len(one), np.uint32)
    edges = np.flatnonzero(np.diff(anchor[by], prepend=-1))
    at = np.unique(np.searchsorted(edges, np.arange(0, len(by), _REFINED)))  # the first bucket that begins there or later, if any does
    for a, b in zip(cuts := edges[at[at < len(edges)]], [*cuts[1:], len(by)]):
        own = by[a:b]
        bucket, there = string_buckets(one[own]), _there(one[own])
        ids = np.broadcast_to(first[own, None], there.shape)
        least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, bucket[there], ids[there])
        mask[own] = ((there & (least[bucket] < ids)) * starts).sum(axis=1, dtype=np.uint32)
    out = np.empty(len(rows), np.uint32)
    out[order] = np.where(doc_id[order] > first[row_of], whole[row_of], mask[row_of])
    return out


def _there(rows: np.ndarray) -> np.ndarray:
    """Which starts (columns) have a string of LENGTH bytes in a context (rows)."""
    left, right, start = rows[:, LEFT + RIGHT].astype(np.int64), rows[:, LEFT + RIGHT + 1].astype(np.int64), np.arange(LEFT + 1)
    return (left[:, None] >= LEFT - start) & (right[:, None] >= LENGTH - LEFT + start)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on contexts, to the blocks that sent them; what a block sent to itself passes."""
    held: dict[int, list] = defaultdict(list)
    for batch in batches:
        own = []
        for dest, kind, block, body in zip(*(batch.column(c).to_pylist() for c in ("dest", "kind", "block", "body"))):
            if kind:
                own.append((dest, kind, block, body))
            else:
                held[dest].append((block, body))
        yield from _parcel(own).to_batches()
    while held:
        dest, sent = held.popitem()
        parts = [_unpacked(body, np.uint8, "<i8", "<i8") for _, body in sent]
        rows = np.concatenate([p[0].reshape(-1, 80) for p in parts])
        mask = covered_strings(rows, np.concatenate([p[1] for p in parts]))
        out, at = [], 0
        for (block, _), (_, _, number) in zip(sent, parts):
            own = mask[at : at + len(number)]
            at += len(number)
            if own.any():
                out.append((block, 2, block, _packed(number[own > 0], own[own > 0])))
        yield from _parcel(out).to_batches()


def _cut(docs: pa.Table, verdicts: pa.Table) -> pa.Table:
    block = Block(docs.column("doc_id").to_pylist(), docs.column("data").to_pylist())
    begins = np.zeros(len(block.data) + LENGTH + 1, np.int32)
    own = None
    masks: list[tuple[np.ndarray, np.ndarray]] = []
    for kind, body in zip(verdicts.column("kind").to_pylist(), verdicts.column("body").to_pylist()):
        if kind == 1:
            local, place, row, (count,), decided, asked = _unpacked(body, *["<i8"] * 6)
            own = (place, row, int(count), decided.reshape(2, -1), asked.reshape(3, -1))
            begins[local[::2]] += 1
            begins[local[1::2]] -= 1
        else:
            masks.append(tuple(_unpacked(body, "<i8", "<u4")))
    starts_here = np.cumsum(begins) > 0  # a string that goes starts here
    if own is not None:
        place, row, count, decided, asked = own
        mask_of = np.zeros(count, np.uint32)
        for numbers, mask in masks:
            mask_of[numbers] = mask
        yes = mask_of[asked[2]] > 0
        for rows, starts in (decided, asked[:2, yes]):
            np.bitwise_or.at(mask_of, rows, np.uint32(1) << starts.astype(np.uint32))
        mine = mask_of[row]
        for s in range(LEFT + 1):
            starts_here[place[(mine >> np.uint32(s) & np.uint32(1)) > 0] - LEFT + s] = True
    ids, sizes, kept, removed = [], [], [], []
    for doc_id, a, b in zip(block.doc_ids.tolist(), block.starts.tolist(), block.ends.tolist()):
        data, spans = block.data[a:b], []
        begin = np.flatnonzero(starts_here[a:b])
        if len(begin):
            cut = _merged(begin, begin + LENGTH).reshape(-1, 2)
            keep = np.ones(b - a, bool)
            for start, end in cut.tolist():
                keep[start:end] = False
                spans.append({"start": start, "end": end})
            data = data[keep]
        ids.append(doc_id)
        sizes.append(b - a)
        kept.append(data.tobytes())
        removed.append(spans)
    rest = docs.drop_columns(["block", "doc_id", "data"]).take(block.order)
    runs = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "removed": runs} | {c: rest.column(c) for c in rest.column_names})


def _rows(docs: DataFrame, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    rest = [F.col(c).alias(f"_{i}") for i, c in enumerate(carry)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"), *rest)


def _verdicts(docs: DataFrame, text: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents dealt into blocks, and what has been found out about each block."""
    rows = _rows(docs, text, carry)
    size = rows.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), -(-size // BLOCK_BYTES))
    blocks = rows.where("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartition(parts, "block")
    anchors = blocks.mapInArrow(lambda batches: _send_anchors(batches, parts), _PARCELS)
    masks = anchors.repartition(parts, "dest").mapInArrow(_count_anchors, _PARCELS)

    def contexts(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _send_contexts(key[0].as_py(), left, right, parts)

    sent = blocks.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(contexts, _PARCELS)
    return blocks, sent.repartition(parts, "dest").mapInArrow(_decide, _PARCELS)


def _by_block(blocks: DataFrame, verdicts: DataFrame, f, schema: T.StructType) -> DataFrame:
    return blocks.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(lambda left, right: f(left, right), schema)


def cut_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, the bytes kept, and the removed runs."""
    blocks, verdicts = _verdicts(docs, text)
    cut = _by_block(blocks, verdicts, _cut, T.StructType.fromDDL(CUT))
    unknown = _rows(docs, text).where("doc_id IS NULL")
    whole = {"n_bytes": F.length("data").cast("long"), "kept": F.col("data"), "removed": F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>")}
    return cut.unionByName(unknown.withColumns(whole).drop("data"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with repeats cut out of the text, and n_chars, where there is one, as the new length.

    A character that loses some of its bytes goes whole; a null text stays null.
    """
    names = docs.columns
    missing_text = fresh(names, "_text_missing")
    flagged = docs.withColumn(missing_text, F.col("text").isNull())
    carried = [*(c for c in names if c != "text"), missing_text]

    def decoded(cut: pa.Table) -> pa.Table:
        texts = [None if missing else kept.decode("utf-8", "ignore") for kept, missing in zip(cut.column("kept").to_pylist(), cut.column(f"_{len(names) - 1}").to_pylist())]
        columns = {c: pa.array(texts, pa.string()) if c == "text" else cut.column(f"_{carried.index(c)}") for c in names}
        if "n_chars" in names:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.table(columns)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else T.LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema])
    blocks, verdicts = _verdicts(flagged, "text", tuple(carried))
    cut = _by_block(blocks, verdicts, lambda left, right: decoded(_cut(left, right)), schema)
    unknown = docs.where("doc_id IS NULL")
    return cut.unionByName(unknown.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else unknown)


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
