"""Near-duplicates by SimHash, compared bit-sliced.

A fingerprint's bit is set where over half of the hashes of a text's word shingles set it. Equal
fingerprints are one item. Items within the radius agree on some choice of ``blocks - radius``
of the blocks that 64 bits are cut into, so every item goes once into a bucket for each choice,
and only items of one bucket are compared. A bucket holds distinct fingerprints that differ in
the bits of ``radius`` blocks alone, which bounds it whatever the input: copies never gather.

Inside a task the sorted bucket rows stand as 64 vertical bit planes. Rows are compared with the
row 1, 2, 3 ... places on, 64 distances to a machine word: each plane's difference is added into
carry-save counters, and words whose lanes all exceed the radius (or leave their bucket) are
abandoned. A bucket gives a spanning forest of its links, not all its pairs.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are
linked like any other; repeated rows (also of one doc_id) share a fingerprint; an empty table
gives no rows; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import durable, shuffle_width, small_batches
from quantloom.llm.components import components, forest

SEED = 42
_ROWS = 1 << 16
_SET_ROWS = 1 << 10
_SMALL = 8
_FEW, _HASH_BYTES = 200_000, 5
_CANDIDATE = ["a", "b", "bucket", "print"]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits of a text: ASCII letters lower-cased, words between ASCII white space."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = [words[i:] for i in range(min(shingle, len(words)))]
    hashes = list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*whole)), [SEED] * len(words)))
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        some = np.array(hashes[at : at + _ROWS], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long with the same bits) of every row."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each choice of ``radius`` blocks that may differ, the bits that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [((1 << 64) - 1) ^ sum(parts[i] for i in free) for free in combinations(range(blocks), radius)]


def _planes(items: np.ndarray) -> np.ndarray:
    """64 rows of bits, each as words of 64 lanes, with a word of room at the end."""
    bits = np.unpackbits(items.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    room = -len(items) % 64 + 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, room))), axis=1, bitorder="little")).view("<u8")


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    return np.packbits(np.pad(flags, (0, words * 64 - len(flags))), bitorder="little").view("<u8")


def close_pairs(buckets: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one bucket (rows sorted by bucket) within the radius, bit-sliced."""
    n, shift = len(items), 0
    planes = _planes(np.ascontiguousarray(items, "<u8"))
    words, depth = planes.shape[1] - 1, int(radius + 1).bit_length()
    rows = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        shift += 1
        rows = rows[rows + shift < n]
        rows = rows[buckets[rows] == buckets[rows + shift]]
        if not len(rows):
            break
        flags = np.zeros(n, bool)
        flags[rows] = True
        lanes = _lanes(flags, words)
        at = np.flatnonzero(lanes)
        alive = lanes[at]
        whole, part = divmod(shift, 64)
        counters = np.zeros((depth, len(at)), np.uint64)
        over = np.zeros(len(at), np.uint64)
        for bit in range(64):
            plane = planes[bit]
            other = plane[at + whole] >> np.uint64(part)
            if part:
                other |= plane[np.minimum(at + whole + 1, words)] << np.uint64(64 - part)
            carry = plane[at] ^ other
            for level in counters:
                carry, level[:] = level & carry, level ^ carry
            over |= carry
            if bit % 8 == 7:
                keep = (alive & ~(over | _above(counters, radius))) != 0
                if not keep.all():
                    at, alive, over, counters = at[keep], alive[keep], over[keep], counters[:, keep]
                    if not len(at):
                        break
        if len(at):
            near = alive & ~(over | _above(counters, radius))
            lane = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            word, place = np.nonzero(lane)
            left = at[word] * 64 + place
            out.append((left, left + shift))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius: compare the counter's bits from the top."""
    above, equal = np.zeros(counters.shape[1], np.uint64), np.full(counters.shape[1], ~np.uint64(0))
    for level in range(len(counters) - 1, -1, -1):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            above |= equal & counters[level]
            equal &= ~counters[level]
    return above


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by choice and bucket; whole buckets are compared as they are complete."""
    held = [np.zeros(0, np.int64)] * 3

    def compare(choice, bucket, item) -> pa.RecordBatch:
        starts = np.r_[True, (choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1])]
        a, b = close_pairs(np.cumsum(starts), item.view(np.uint64), radius)
        root = forest(len(item), a, b)
        own = np.flatnonzero(root != np.arange(len(item)))
        return pa.RecordBatch.from_arrays([pa.array(item[own]), pa.array(item[root[own]])], ["a", "b"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "bucket", "item")]
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) >= _ROWS:
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield compare(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
    if len(held[0]):
        yield compare(*held)


def links(items: DataFrame, radius: int = 2, blocks: int = 6) -> DataFrame:
    """Spanning links a, b between the distinct longs of ``items.item`` at most ``radius`` bits apart."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, blocks)]
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("item").bitwiseAND(F.lit(m).cast("long")).alias("bucket")) for i, m in enumerate(signed)))
    rows = items.select("item", F.explode(choices).alias("c")).select("c.choice", "c.bucket", "item")
    dealt = rows.repartition(shuffle_width(items.sparkSession), "choice", "bucket").sortWithinPartitions("choice", "bucket", "item")
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row."""
    printed = durable(fingerprints(docs, shingle))
    items = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    linked = components(links(items.select(F.col("fingerprint").alias("item")), radius))
    groups = items.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = groups.select("fingerprint", "component").join(least, "component").select("fingerprint", "component_id")
    return printed.join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_similarity(a: str, b: str, shingle: int) -> float:
    """Jaccard similarity of the sets of word shingles; a text of fewer words is one shingle, none at all."""
    sets = []
    for text in (a, b):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        sets.append({*zip(*(words[i:] for i in range(min(shingle, len(words)))))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


def _near_one(planes: np.ndarray, item: int, radius: int) -> np.ndarray:
    """Rows of the bit planes within the radius of one item, bit-sliced."""
    at = np.arange(planes.shape[1])
    counters, over = np.zeros((int(radius + 1).bit_length(), len(at)), np.uint64), np.zeros(len(at), np.uint64)
    for bit in range(64):
        carry = ~planes[bit, at] if item >> bit & 1 else planes[bit, at].copy()
        for level in counters:
            carry, level[:] = level & carry, level ^ carry
        over |= carry
        if bit % 8 == 7:
            keep = ~(over | _above(counters, radius)) != 0
            if not keep.all():
                at, over, counters = at[keep], over[keep], counters[:, keep]
                if not len(at):
                    break
    near = np.zeros(planes.shape[1], np.uint64)
    near[at] = ~(over | _above(counters, radius))
    return np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))


def _leaders(items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, leader) for a large bucket: again and again the row nearest to the majority of those
    left takes all within the radius, so a group meets its most central member, not all pairs."""
    left, a, b = np.arange(len(items)), [], []
    while len(left) > 1:
        bits = np.unpackbits(items[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = bits.sum(0, dtype=np.int64) * 2 > len(left)
        leader = int(np.argmin((bits != middle).sum(1)))
        near = _near_one(_planes(items[left]), int(items[left[leader]]), radius)
        near = near[near < len(left)]
        a.append(left[near[near != leader]])
        b.append(np.full(len(a[-1]), left[leader]))
        gone = np.zeros(len(left), bool)
        gone[near] = gone[leader] = True
        left = left[~gone]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles that ``shingle_similarity`` compares."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = {*map(b" ".join, zip(*(words[i:] for i in range(min(shingle, len(words))))))}
    return np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, len(joined))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signature(hashes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, int]:
    """Of a set of hashes: a number for each band, equal where the band's smallest rehashes are, and the SimHash of the set."""
    if not len(hashes):
        return np.zeros(bands, np.uint64), 0
    n = bands * rows
    factors = _mixed(_STEP * np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    least, ones = np.full(n, ~np.uint64(0)), np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SET_ROWS):
        h = hashes[at : at + _SET_ROWS]
        np.minimum(least, np.minimum.reduce(h[:, None] * factors, axis=0), out=least)
        ones += np.unpackbits(_mixed(h).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        keys = _mixed(keys * _STEP ^ row)
    return keys, int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows sorted by the first column, in stretches of whole buckets, and which rows are of a bucket that
    comes in several stretches: one of more than ``4 * rows`` rows does."""
    held, waiting, count, parted = [np.zeros(0, np.int64)] * len(names), [], 0, None
    for batch in batches:
        waiting.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        count += batch.num_rows
        if count >= rows:
            held, waiting = [np.concatenate(x) for x in zip(held, *waiting)], []
            last = np.flatnonzero(held[0] != held[0][-1])
            cut = last[-1] + 1 if len(last) else len(held[0]) if len(held[0]) >= 4 * rows else 0
            if cut:
                if not len(last):
                    parted = held[0][0]
                yield [h[:cut] for h in held], held[0][:cut] == parted
                held = [h[cut:] for h in held]
            count = len(held[0])
    held = [np.concatenate(x) for x in zip(held, *waiting)]
    if len(held[0]):
        yield held, held[0] == parted


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, rows: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. Small buckets give all pairs within the radius; larger ones connect
    members with the most central texts, and name their members for a second look (b is null). A
    bucket that comes in several stretches is a large one in all of them, however few rows the last has."""
    for (bucket, item, printed), parted in _buckets(batches, ["bucket", "item", "print"], rows):
        printed = printed.view(np.uint64)
        number = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1
        size = np.where(parted, _SMALL + 1, np.bincount(number)[number])
        small, a, b = np.flatnonzero((size > 1) & (size <= _SMALL)), [], []
        i, j = close_pairs(number[small], printed[small], radius)
        a.append(small[i])
        b.append(small[j])
        large = np.flatnonzero(size > _SMALL)
        for own in np.split(large, np.flatnonzero(np.diff(number[large])) + 1) if len(large) else []:
            i, j = _leaders(printed[own], radius)
            a.append(own[i])
            b.append(own[j])
        a, b = item[np.concatenate(a)], item[np.concatenate(b)]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], _CANDIDATE)
        yield pa.RecordBatch.from_arrays([pa.array(item[large]), pa.nulls(len(large), pa.int64()), pa.array(bucket[large]), pa.array(printed[large].view(np.int64))], _CANDIDATE)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by block, block by block."""
    held: list[pa.RecordBatch] = []
    for batch in filter(lambda b: b.num_rows, batches):
        block = batch.column("block").to_numpy()
        if held and held[-1].column("block")[-1].as_py() != block[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _left_apart(batches: Iterator[pa.RecordBatch], similarity: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. Links that connect what isn't connected yet in a block.

    A block holds two chunks of a bucket, or one; of two chunks only pairs across them count.
    Texts outside the block's largest component meet all others, bit-sliced; pairs within the
    radius are compared by their sets, until the two are connected.
    """
    for table in _whole_blocks(batches):
        component, chunk, item, printed = (table.column(c).to_numpy() for c in ("component", "chunk", "item", "print"))
        values, at = np.unique(component, return_inverse=True)
        if len(values) < 2:
            continue
        across, root, items = bool(table.column("two")[0].as_py()), np.arange(len(values)), printed.view(np.uint64)
        main = at == np.argmax(np.bincount(at))
        size = table.column("size").to_numpy().astype(np.int64)
        raw = np.zeros((int(size.sum()), 8), np.uint8)
        raw[:, :_HASH_BYTES] = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, _HASH_BYTES)
        words, planes = np.unique(raw.view("<u8")[:, 0], return_inverse=True)[1], _planes(items)
        del raw
        ends = np.cumsum(size)
        marked, a, b = np.zeros(int(words.max(initial=0)) + 1, np.int64), [], []
        for x in np.flatnonzero(~main):
            near = _near_one(planes, int(items[x]), radius)
            near = near[near < len(item)]
            near = near[(root[at[near]] != root[at[x]]) & (main[near] | (near > x)) & (not across or chunk[near] != chunk[x])]
            near = near[np.minimum(size[near], size[x]) >= similarity * np.maximum(size[near], size[x]) - 1e-9]
            if not len(near):
                continue
            own = words[ends[x] - size[x] : ends[x]]
            marked[own] = 1
            n = size[near]
            places = np.arange(int(n.sum())) + np.repeat(ends[near] - n - (np.cumsum(n) - n), n)
            both = np.bincount(np.repeat(np.arange(len(near)), n), marked[words[places]], len(near))
            marked[own] = 0
            whole = n + size[x] - both
            for y in near[(both >= similarity * whole) | (whole == 0)]:
                if (one := root[at[x]]) != (two := root[at[y]]):
                    root[root == two] = one
                    a.append(item[x])
                    b.append(item[y])
        if a:
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 30, band_rows: int = 5, radius: int = 24, block_rows: int = 20_000, block_shingles: int = 4_000_000, stretch_rows: int = _ROWS) -> DataFrame:
    """doc_id, component_id of all rows with a doc_id; texts whose shingle sets reach the similarity are linked.

    Such texts differ in so few bits of a SimHash of their shingles that no block of useful size
    need agree, so buckets come from elsewhere: texts meet where the smallest rehashes of their
    shingle sets are equal in all ``band_rows`` of one of ``bands`` bands. At similarity s that fails
    with probability (1 - s ** band_rows) ** bands, under 7 in a million at 0.8. Within buckets
    texts are compared bit-sliced, and every pair within the radius (5 standard deviations at
    0.8) is verified on its whole shingle sets. Equal texts are one item all the way.

    Members of a large bucket are paired with its most central texts first, a bucket of more than
    four times ``stretch_rows`` texts stretch by stretch. Where that leaves a
    bucket in several components, texts of different ones are compared inside tasks, in blocks of
    at most two chunks of about ``block_rows`` texts or ``block_shingles`` shingles (by hashes of
    ``_HASH_BYTES`` bytes); so every pair of a bucket within the radius is compared or already
    connected, however large the bucket, and only links leave the tasks.
    """
    small_batches(docs)
    spark = docs.sparkSession
    width = shuffle_width(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(shingle_hashes(t.as_py(), shingle), bands, band_rows) for t in batch.column("text")]
            prints = np.array([p for _, p in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array(prints)], ["doc_id", "key", "bands", "print"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            item, printed = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), bands) for c in ("item", "print"))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(item), pa.array(printed)], ["bucket", "item", "print"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [shingle_similarity(a, b, shingle) >= similarity for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), shingle) & np.uint64((1 << 8 * _HASH_BYTES) - 1)) for t in batch.column("text")]
            cut = [h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES].tobytes() for h in found]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([len(h) for h in found], pa.int32()), pa.array(cut, pa.binary())], ["item", "size", "hashes"])

    def texts_of(wanted: DataFrame) -> DataFrame:
        """item and text of the wanted items; where they are few, only their texts are moved."""
        named = durable(items.select("key", "item").join(wanted, "item"))
        named = F.broadcast(named) if named.count() <= _FEW else named
        return rows.join(named, (rows["doc_id"] == named["item"]) & (rows["key"] == named["key"])).select("item", "text").dropDuplicates(["item"])

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs that are."""
        texts = texts_of(pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct())
        both = pairs.join(texts.select(F.col("item").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("item").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(verified, "a long, b long")

    printed = rows.mapInArrow(run, "doc_id long, key binary, bands binary, print long")
    items = durable(printed.groupBy("key").agg(F.min("doc_id").alias("item"), F.first("bands").alias("bands"), F.first("print").alias("print")))
    dealt = items.select("item", "bands", "print").mapInArrow(banded, "bucket long, item long, print long").repartition(width, "bucket").sortWithinPartitions("bucket", "item")
    met = durable(dealt.mapInArrow(lambda batches: _candidates(batches, radius, stretch_rows), "a long, b long, bucket long, print long"))
    pairs = durable(met.where("a <> b").select("a", "b").distinct())
    linked = components(similar(pairs))

    members = met.where("b IS NULL").select("bucket", F.col("a").alias("item"), "print").join(linked.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    several = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("who")).where("low < high")
    members = durable(members.join(several.groupBy("low", "high", "n", "who").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket"))  # once each, where bands give the same bucket
    sets = texts_of(members.select("item").distinct()).mapInArrow(hashed, "item long, size int, hashes binary")
    held = members.join(sets, "item")
    sizes = held.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("size") / block_shingles)).alias("chunks"))
    chunked = held.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("item"), "chunks"))
    placed = chunked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    one, two = F.least("chunk", "other"), F.greatest("chunk", "other")
    blocks = placed.select(F.xxhash64("bucket", one, two).alias("block"), (one < two).cast("long").alias("two"), "chunk", "component", "item", "print", "size", "hashes")
    apart = blocks.repartition(width, "block").sortWithinPartitions("block", "item").mapInArrow(lambda batches: _left_apart(batches, similarity, radius), "a long, b long")
    found = durable(similar(durable(apart.distinct())))
    if not found.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    classes = items.select("key", "item").join(linked.withColumnRenamed("node", "item"), "item", "left").select("key", F.coalesce("component", "item").alias("component_id"))
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows that stand for their group of similar texts: that of the smallest doc_id, and all with a null doc_id.

    Rows that share a doc_id with different texts go only if all of them have a smaller similar one.
    """
    classes = similar_documents(docs, similarity, shingle)
    least = classes.groupBy("doc_id").agg(F.max("component_id").alias("component_id"))
    gone = least.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
