"""Corpus operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from quantloom.llm import best_fit_packing, chat_format, language_id, license_scan, queries, secret_scan, sentencepiece_codec, simhash_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(where="true"):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE {where}").fetchall()


def odd_docs(spark, schema="doc_id long, text string, block string, data int, kept int, _blob int, _spans int, score int, item int, _text_missing int"):
    """Nulls, empties, repeats, one long text, and columns with names that operators use inside."""
    rng = random.Random(4)
    words = "the and lorem ipsum dolor amet password=hunter22 é日本 x".split()
    rows = [(None, None), (1, None), (2, ""), (3, "  \n\t"), (4, "a b c"), (4, "a b c"), (5, "a b c"), (None, "a b c"), (6, "zz " * 40_000), (7, "zz " * 40_000)]
    rows += [(10 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(20)]
    return spark.createDataFrame([(*r, "b", 1, 2, 3, 4, 5, 6, 7) for r in rows], schema), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 packing


def test_packing_places_every_token_once(spark):
    found = queries.op1_best_fit_packing(spark, SF).collect()
    library = tokenizers.Tokenizer.from_file(BPE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in found:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    total = 0
    for doc_id, text in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for n, p in enumerate(sorted(pieces[doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (n, at, zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length])))
            assert n == 0 or p.length == 1024
            at += p.length
        assert at == len(ids)
        total += at
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.03 * total / 1024 + 1


@pytest.mark.parametrize("counts, sequences", [({}, 0), ({1: 5}, 1), ({341: 7}, 3), ({342: 5}, 3), ({1024: 3, 1: 1}, 4), ({512: 3, 300: 1}, 2), ({600: 2, 424: 2}, 2), ({1: 1024, 1023: 1}, 2)])
def test_packing_plans(counts, sequences):
    slots = best_fit_packing.plan(counts, 1024)
    assert slots.sequences == sequences
    with pytest.raises(ValueError):
        best_fit_packing.plan({1025: 1}, 1024)


def test_packing_defined_cases(spark):
    docs, rows = odd_docs(spark)
    found = best_fit_packing.pack_documents(docs, BPE, capacity=64, with_ids=True).collect()
    assert sum(p.length == 1 and p.ids == [2] for p in found) >= 3  # nulls and the empty text
    assert all(len(p.ids) == p.length <= 64 for p in found)
    assert best_fit_packing.pack_documents(empty(spark), BPE).count() == 0
    clash = spark.createDataFrame([(3, "x", 9, 9)], "length long, _rank string, sequence_id int, offset int")
    assert best_fit_packing.pack(clash, 8).collect() == [(3, 0, 0)]


def test_packing_tokens_are_the_librarys():
    own, library = best_fit_packing.Tokenizer(open(BPE, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(BPE)
    rng = random.Random(2)
    alphabet = [*"ab e \n\té😀日<|endoftext|>'s1,", "<|endoftext|>", "'ll", "\x85"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert own.ids(text, 2).tolist() == library.encode(text, add_special_tokens=False).ids + [2]


# -- 2 secrets

BASE = [
    ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(BASE) for m in pattern.finditer(text or "") if ok(m))
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in found)


def test_secrets_match_the_patterns(spark):
    texts = ["é PassWord = 'hunter22'", "toKen:abcdef", "token:abcde secret=\"x1y2z3\"", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "ſecret=abcdefgh", "api_Key=abcdefgh", "f" * 24 + "g" + "0" * 23, "password=" + "a1" * 20, "apikey  :  'q.w-e/r=' passwd=longer7"]
    for text in texts:
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.secrets(text)) == brute_spans(text), text
    got = {r.doc_id: r for r in queries.op2_secret_scan(spark, SF).collect()}
    for doc_id, text in documents():
        want = brute_spans(text)
        assert got[doc_id].spans == want and got[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[doc_id].n_hex == want.count("hex:") and got[doc_id].n_assign == want.count("assign:")


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "password=hunter22"), (2, "password=hunter22"), (3, "clean")], "doc_id long, text string")
    more = first.union(spark.createDataFrame([(4, "token=abcdefg"), (5, None)], "doc_id long, text string"))
    assert secret_scan.update_ledger(first, path).count() == 2
    ledger = secret_scan.update_ledger(more, path)
    assert ledger.count() == 4
    assert secret_scan.blob_findings(more, ledger).count() == 0
    want = {1: "assign:0:17", 2: "assign:0:17", 3: "", 4: "assign:0:13", 5: ""}
    assert {r.doc_id: r.spans for r in secret_scan.scan(more, path).collect()} == want and secret_scan.update_ledger(more, path).count() == 4
    late = more.union(spark.createDataFrame([(6, "passwd: abcdef7")], "doc_id long, text string"))  # a blob the ledger lacks
    assert {r.doc_id: r.spans for r in secret_scan.scan(late, path).collect()} == want | {6: "assign:0:15"}


def test_changed_patterns_are_another_rule_version(spark, tmp_path, monkeypatch):
    path, docs = f"file://{tmp_path}/ledger", spark.createDataFrame([(1, "password=hunter22"), (2, "clean")], "doc_id long, text string")
    secret_scan.update_ledger(docs, path)
    assert secret_scan.rule_version((re.compile("a"),)) != secret_scan.rule_version((re.compile("b"),)) != secret_scan.RULES
    before, now = secret_scan.RULES, "other"
    monkeypatch.setattr(secret_scan, "RULES", now)
    assert secret_scan.blob_findings(docs, spark.read.parquet(path)).count() == 2
    assert {(r.rules, r.n) for r in secret_scan.update_ledger(docs, path).groupBy("rules").agg(F.count("*").alias("n")).collect()} == {(before, 2), (now, 2)}


def test_secret_defined_cases(spark):
    docs, rows = odd_docs(spark)
    assert secret_scan.scan(docs).count() == len(rows)
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns and masked.where("text LIKE '%hunter22%'").count() == 0
    assert masked.where("text IS NULL").count() == 2 and masked.where("_blob = 3 AND _spans = 4").count() == len(rows)
    assert secret_scan.scan(empty(spark)).count() == 0 and secret_scan.redact(empty(spark)).count() == 0


# -- 3 repeats


def brute_repeats(rows):
    first, out = {}, defaultdict(list)
    for doc_id, text in sorted((d, (t or "").encode()) for d, t in rows):
        gone, new = bytearray(len(text)), []
        for s in range(len(text) - 49):
            f = first.get(text[s : s + 50])
            if f is None:
                new.append(text[s : s + 50])
            elif f < doc_id:
                gone[s : s + 50] = b"\1" * 50
        for x in new:
            first.setdefault(x, doc_id)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id].append((len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def found_repeats(docs):
    out = defaultdict(list)
    for r in suffix_dedup.digests(suffix_dedup.cut_repeats(docs)).collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def patchwork(n):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(5)] + ["x" * 300, "é日" * 60, " " * 200]

    def piece():
        b = rng.choice(base)
        a = rng.randint(0, len(b))
        return b[a : a + rng.randint(0, 90)] + "".join(rng.choice("qwertz") for _ in range(rng.randint(0, 12)))

    return [(rng.randint(0, n) - 50, "".join(piece() for _ in range(rng.randint(0, 8)))) for _ in range(n)] + [(7, None), (-99, "x" * 20_000), (900, "x" * 700_000)]


def test_repeats_at_the_edges_of_documents(spark):
    """Texts of one string, and passages that begin or end one document and stand inside another."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for _ in range(40):
        own, passage = noise(50), noise(90)
        pair = [own, noise(30) + own + noise(30)]
        rows += [*(pair if rng.random() < 0.5 else pair[::-1]), passage + noise(40), noise(40) + passage + noise(40), noise(40) + passage]
    rows = list(enumerate(rows))
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == brute_repeats(rows)


def test_repeats_match_brute_force(spark):
    rows = patchwork(150)
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_refined_buckets_are_equal_strings():
    """Contexts of a few anchors, cut off at documents' edges, against a table of all strings."""
    import numpy as np

    rng = np.random.default_rng(17)
    rows = np.zeros((900, 80), np.uint8)
    rows[:, :76] = rng.integers(97, 99, (12, 76))[rng.integers(0, 12, 900)]
    rows[:, 26:50] = rng.integers(97, 100, (4, 24))[rng.integers(0, 4, 900)]
    for i in range(900):
        rows[i, rng.integers(0, 26)] ^= rng.integers(0, 2)
        left, right = (26, 50) if i % 3 else (rng.integers(0, 27), rng.integers(24, 51))
        rows[i, : 26 - left], rows[i, 26 + right : 76], rows[i, 76:78] = 0, 0, (left, right)
    ids = rng.integers(0, 300, 900)
    least = {}
    there = lambda i, s: rows[i, 76] >= 26 - s and rows[i, 77] >= 24 + s
    for i, s in itertools.product(range(900), range(27)):
        if there(i, s):
            key = rows[i, s : s + 50].tobytes()
            least[s, key] = min(least.get((s, key), 999), int(ids[i]))
    want = [sum(1 << s for s in range(27) if there(i, s) and least[s, rows[i, s : s + 50].tobytes()] < ids[i]) for i in range(900)]
    assert suffix_dedup.covered_strings(rows, ids).tolist() == want and sum(map(bool, want)) > 500
    assert len(suffix_dedup.covered_strings(rows[:0], ids[:0])) == 0
    buckets = suffix_dedup.string_buckets(rows[:200])
    strings = [[rows[i, s : s + 50].tobytes() for s in range(27)] for i in range(200)]
    assert len(np.unique(buckets)) == len({x for r in strings for x in r}) == len({(b, x) for r, q in zip(strings, buckets.tolist()) for x, b in zip(r, q)})


def test_refinement_ends_in_a_bucket_wherever_it_is_cut(monkeypatch):
    """The last bucket of a task may hold the last place at which contexts are taken together."""
    import numpy as np

    rng = np.random.default_rng(23)
    rows = np.zeros((240, 80), np.uint8)
    rows[:, :76] = rng.integers(97, 99, (9, 76))[rng.integers(0, 9, 240)]
    rows[:, 26:50] = rng.integers(97, 100, (30, 24))[rng.integers(0, 30, 240)]
    rows[:, 76], rows[:, 77] = 26, 50
    ids, held = rng.permutation(240), defaultdict(list)
    for i, s in itertools.product(range(240), range(27)):
        held[s, rows[i, s : s + 50].tobytes()].append(int(ids[i]))
    want = [sum(1 << s for s in range(27) if min(held[s, rows[i, s : s + 50].tobytes()]) < ids[i]) for i in range(240)]
    for together in range(1, 241):
        monkeypatch.setattr(suffix_dedup, "_REFINED", together)
        assert suffix_dedup.covered_strings(rows, ids).tolist() == want


def test_frequent_anchors_are_decided_string_by_string():
    """The path for anchors in very many contexts, in one block after the other without Spark."""
    import numpy as np
    import pyarrow as pa

    rows = [(d, t or "") for d, t in patchwork(60) if len(t or "") < 10_000]
    blocks = [rows[i::3] for i in range(3)]
    parts, hot = 4, suffix_dedup.HOT
    tables = [pa.table({"block": pa.array([i] * len(b), pa.int64()), "doc_id": pa.array([d for d, _ in b], pa.int64()), "data": pa.array([t.encode() for _, t in b], pa.binary())}) for i, b in enumerate(blocks)]
    try:
        suffix_dedup.HOT = 10
        sent = [x for t in tables for x in suffix_dedup._send_anchors(iter(t.to_batches()), parts)]
        masks = pa.Table.from_batches(list(suffix_dedup._count_anchors(iter(sent))))
        assert any((suffix_dedup._unpacked(b, np.uint8)[0] == 2).any() for b in masks.column("body").to_pylist())
        own = lambda table, i: table.filter(pa.compute.equal(table.column("block"), i))
        contexts = pa.concat_tables([suffix_dedup._send_contexts(i, t, own(masks, i), parts) for i, t in enumerate(tables)])
        verdicts = pa.Table.from_batches(list(suffix_dedup._decide(iter(contexts.to_batches()))))
        out = defaultdict(list)
        for i, t in enumerate(tables):
            for r in suffix_dedup._cut(t, own(verdicts, i)).to_pylist():
                out[r["doc_id"]].append((r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()))
    finally:
        suffix_dedup.HOT = hot
    assert {k: sorted(v) for k, v in out.items()} == brute_repeats(rows)


def test_repeats_on_documents(spark):
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in queries.op3_suffix_dedup(spark, SF).collect()}
    assert got == brute_repeats(documents())


def test_repeats_defined_cases(spark):
    docs, rows = odd_docs(spark)
    cut = suffix_dedup.dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert cut.where("doc_id IS NULL AND text = 'a b c'").count() == 1 and cut.where("text IS NULL").count() == 2
    assert [len(r.text) for r in cut.where("doc_id IN (6, 7)").orderBy("doc_id").collect()] == [120_000, 0]
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    split = suffix_dedup.dedup(spark.createDataFrame([(1, "é" + "a" * 49), (2, "è" + "a" * 49 + "b"), (3, "xé" + "a" * 49)], "doc_id long, text string"))
    assert all("�" not in r.text for r in split.collect())


# -- 4 SentencePiece


def test_sentencepiece_matches_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.read(PIECES))
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "▁x ▁▁ y", "\n\t a", "日本語😀 a😀b", "\x00\x01", "ﬁ Ａ", "a" * 300, " " * 50 + "x", "<s></s>", "<0x41>", "ᄀ각"]
    texts += ["".join(rng.choice("ab e  ▁\n\té😀日<>/s0x41") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
    got = {r.doc_id: r for r in queries.op4_sentencepiece_codec(spark, SF).collect()}
    for doc_id, text in documents():
        ids = library.encode(text or "", add_eos=True)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want


def test_sentencepiece_words_are_kept_within_bounds():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.read(PIECES))
    codec.words.most = 5_000
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(16)
    for n in range(60):
        text = " ".join("".join(rng.choice("abcdeé日") for _ in range(rng.choice((3, 8, 200)))) for _ in range(30))
        assert codec.encode(text) == library.encode(text) + [library.eos_id()]
        assert codec.words.used < 6_000 and all(len(w) <= 64 for w in codec.words)


def test_sentencepiece_defined_cases(spark):
    docs, rows = odd_docs(spark)
    assert sentencepiece_codec.sentencepiece_encode(docs, PIECES).where("text IS NULL AND ids = array(2)").count() == 2
    assert sentencepiece_codec.sentencepiece_digests(docs, PIECES).count() == len(rows)
    assert sentencepiece_codec.sentencepiece_digests(empty(spark), PIECES).count() == 0


# -- 5 SimHash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark):
    rows = documents()
    prints = {d: brute_fingerprint(t or "") for d, t in rows}
    ids = sorted(prints)
    want = groups(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    for r in queries.op5_simhash_dedup(spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    import numpy as np

    rng = np.random.default_rng(radius)
    items = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(15)]).astype(np.uint64)
    buckets = np.sort(rng.integers(0, 12, len(items)))
    a, b = simhash_dedup.close_pairs(buckets, items, radius)
    want = {(i, j) for i in range(len(items)) for j in range(i + 1, len(items)) if buckets[i] == buckets[j] and (int(items[i]) ^ int(items[j])).bit_count() <= radius}
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want


def test_links_cross_all_blocks_and_chains(spark):
    """Every way to differ in two bits is found, and a chain is one component."""
    rng = random.Random(9)
    base = rng.getrandbits(63)
    items = [base] + [base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(200)]
    chain = [rng.getrandbits(62)]
    for i in range(40):
        chain.append(chain[-1] ^ (3 << (i % 60)))
    frame = spark.createDataFrame([(x,) for x in sorted({*items, *chain})], "item long")
    from quantloom.llm.components import components

    root = {r.node: r.component for r in components(simhash_dedup.links(frame)).collect()}
    assert len({root[x] for x in items}) == 1 and len({root[x] for x in chain}) == 1


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    rows = []
    for group in range(30):
        base = [rng.choice(words) for _ in range(rng.choice((30, 120, 600)))]
        for copy in range(rng.choice((1, 2, 5, 30))):
            text = list(base)
            for _ in range(int(len(text) * rng.choice((0, 0.004, 0.02, 0.05)))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    linked = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if simhash_dedup.shingle_similarity(s, t, 5) >= 0.8]
    want = groups([d for d, _ in rows], linked)
    kept = {r.doc_id for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d in want if want[d] == d}


def brute_kept(rows):
    linked = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if simhash_dedup.shingle_similarity(s, t, 5) >= 0.8]
    want = groups([d for d, _ in rows], linked)
    return {d for d in want if want[d] == d}


def test_near_copies_with_one_block_of_new_words(spark):
    rng, rows = random.Random(6), []
    words = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    for n in (60, 150, 300, 600) * 25:
        base = words(n)
        cut = n // rng.choice((9, 10))
        other = base[:-cut] + words(cut) if rng.random() < 0.5 else base + words(n // 4 - 1)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    want = brute_kept(rows)
    assert 100 <= len(want) < 150
    assert {r.doc_id for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_among_texts_of_one_template(spark):
    """Separate pairs in buckets of very many texts that are alike, but not enough."""
    rng, rows = random.Random(7), []
    word = lambda: f"{rng.getrandbits(40):x}"
    template = [word() for _ in range(150)]
    for _ in range(1000):
        base = [word() if i % 15 == 0 else w for i, w in enumerate(template)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-8] + [word() for _ in range(8)]))]
    assert all(simhash_dedup.shingle_similarity(a[1], b[1], 5) >= 0.8 for a, b in zip(rows[::2], rows[1::2]))
    assert all(simhash_dedup.shingle_similarity(a[1], b[1], 5) < 0.8 for a, b in zip(rows[1::2], rows[2::2]))
    kept = {r.doc_id for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {d for d, _ in rows[::2]}


def test_near_copies_with_equal_words_in_other_orders(spark):
    """Ten families of 80 texts: 20 orders of the same 300 words, four near copies of each."""
    rng, rows = random.Random(12), []
    for _ in range(10):
        words = [f"{rng.getrandbits(40):x}" for _ in range(300)]
        for _ in range(20):
            order = rng.sample(words, 300)
            for copy in range(4):
                text = list(order)
                if copy:
                    i = rng.randrange(299)
                    text[i], text[i + 1] = text[i + 1], text[i]
                rows.append((len(rows), " ".join(text)))
    kept = {r.doc_id for r in simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 800, 4))


def test_large_buckets_are_decided_in_blocks(spark):
    """Separate pairs, and a chain in which only neighbours are alike, in buckets of many chunks."""
    rng, rows = random.Random(13), []
    word = lambda: f"{rng.getrandbits(40):x}"
    template = [word() for _ in range(150)]
    for _ in range(60):
        base = [word() if i % 15 == 0 else w for i, w in enumerate(template)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-8] + [word() for _ in range(8)]))]
    chain = list(template)
    for i in range(60):
        chain[2 * i] = word()
        rows.append((len(rows), " ".join(chain)))
    want = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows in (7, 20_000):
        found = simhash_dedup.similar_documents(docs, block_rows=block_rows).collect()
        assert {r.doc_id for r in found if r.doc_id == r.component_id} == want
    linked = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if simhash_dedup.shingle_similarity(s, t, 5) >= 0.8]
    assert {r.doc_id: r.component_id for r in found} == groups([d for d, _ in rows], linked)


def stretched(n, sizes, rows):
    """Candidates of one bucket of n items that arrive in batches of such sizes, between two small buckets."""
    bucket, item = [1, 1] + [2] * n + [3, 3], list(range(n + 4))
    prints = [5, 5] + [(0x9E3779B97F4A7C15 * (i + 1)) % 2**63 for i in range(n)] + [9, 9]
    batches, at = [], 0
    for size in itertools.cycle(sizes):
        if at >= n + 4:
            break
        columns = (pa.array(x[at : at + size], pa.int64()) for x in (bucket, item, prints))
        batches.append(pa.RecordBatch.from_arrays(list(columns), ["bucket", "item", "print"]))
        at += size
    found = [r for b in simhash_dedup._candidates(iter(batches), 2, rows) for r in b.to_pylist()]
    return {r["a"] for r in found if r["b"] is None and r["bucket"] == 2}, {(r["a"], r["b"]) for r in found if r["b"] is not None}


@pytest.mark.parametrize("n", range(60, 131))
def test_buckets_in_stretches_name_all_their_members(n):
    for sizes in ((16,), (1,), (7, 3), (64,), (500,)):
        named, pairs = stretched(n, sizes, 16)
        assert named == set(range(2, n + 2)) and {(1, 0), (n + 3, n + 2)} <= pairs


@pytest.mark.parametrize("n", [65, 66, 73, 129])
def test_copies_in_the_first_and_last_row_of_a_bucket_in_stretches(spark, n):
    """Texts of one template share bands; near copies stand at both ends of the item order."""
    rng = random.Random(n)
    word = lambda: f"{rng.getrandbits(40):x}"
    template = [word() for _ in range(150)]
    rows = [(i, " ".join(word() if k % 15 == 0 else w for k, w in enumerate(template))) for i in range(n - 1)]
    rows.append((n - 1, rows[0][1] + " one more"))
    found = simhash_dedup.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), stretch_rows=4).collect()
    linked = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if simhash_dedup.shingle_similarity(s, t, 5) >= 0.8]
    assert (0, n - 1) in linked
    assert {r.doc_id: r.component_id for r in found} == groups([d for d, _ in rows], linked)


def test_signatures_meet_as_often_as_they_should():
    """Bands agree with probability s ** 5, so 30 of them find nearly every pair of similarity 0.8."""
    rng, met, n = random.Random(14), 0, 200
    import numpy as np

    for _ in range(n):
        every = np.array([rng.getrandbits(64) for _ in range(250)], np.uint64)
        (a, x), (b, y) = (simhash_dedup.signature(h, 30, 5) for h in (every[:225], every[25:]))
        same = int((a == b).sum())
        assert same and bin(x ^ y).count("1") <= 24
        met += same
    assert abs(met / n / 30 - 0.8**5) < 0.03


def test_simhash_defined_cases(spark):
    docs, rows = odd_docs(spark)
    found = simhash_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1} and all(r.fingerprint == "0" * 16 for r in found if r.doc_id in (1, 2, 3))
    assert {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns and set(kept.columns) == set(docs.columns) and kept.where("doc_id IS NULL").count() == 2
    assert kept.where("doc_id = 4").count() == 2 and kept.where("doc_id IN (5, 7)").count() == 0
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0 and simhash_dedup.keep_one(empty(spark)).count() == 0


# -- 6 languages


def test_language_accuracy_on_held_out_rows(spark):
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    found = queries.op6_language_id(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_model_by_hand(spark):
    """Counts, tables and decoding against plain loops."""
    import numpy as np

    rng = random.Random(15)
    rows = [(i, " ".join(rng.choice(("ab", "ba", "Éa", "cc")[k : k + 2]) for _ in range(20)), f"l{k}") for i in range(40) for k in (i % 3,)]
    docs = spark.createDataFrame([*rows, (99, None, "l0"), (100, "zz", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, "doc_id >= 0")

    def grams(text):
        data = f" {text.lower()} ".encode()
        return [((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761 % 2**32) >> 16 for i in range(len(data) - 2)]

    counts = {lang: Counter(g for _, t, own in rows if own == lang for g in grams(t)) for lang in ("l0", "l1", "l2")}
    assert model.languages == ("l0", "l1", "l2") and model.code.tolist() == [[1, 1, 1], [1, -1, -1], [-1, 1, -1]]
    share = lambda lang, g: (counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * 65536)
    for g in {*counts["l0"], *counts["l2"], 7}:
        for bit, side in enumerate(model.code.T):
            plus, minus = ([share(x, g) for x, s in zip(model.languages, side) if s == sign] for sign in (1, -1))
            assert abs(model.weights[g, bit] - (math.log(sum(plus) / len(plus)) - math.log(sum(minus) / len(minus)))) < 1e-4
    for text in ("ab ba", "cc Éa cc", "ÉA"):
        own = grams(text)
        evidence = [sum(float(model.weights[g, b]) for g in own) / len(own) * min(len(own), 100) * 0.2 for b in range(3)]
        loss = [sum(math.log1p(math.exp(-c * e)) for c, e in zip(code, evidence)) for code in model.code.tolist()]
        lang, score, gap = language_id.predict(model, text)
        assert lang == model.languages[min(range(3), key=lambda i: loss[i])]
        assert abs(score - math.exp(-min(loss)) / sum(math.exp(-x) for x in loss)) < 1e-6 and abs(gap - (sorted(loss)[1] - min(loss))) < 1e-5
    few = language_id.fit(docs, "doc_id >= 0", languages=2)
    assert few.languages == ("l0", "l1")  # most labelled rows, ties by name
    for text in ("² ½ ① Ⅷ 12", "", None, "_-"):
        assert language_id.predict(model, text) == ("und", 0.0, 0.0)
    assert language_id.predict(model, "ab ba " * 300_000)[0] == language_id.predict(model, "ab ba")[0]
    even = language_id.Model(("a", "b"), model.code[:2], np.zeros((65536, 3), np.float32))
    assert language_id.predict(even, "text")[0] == "a"


def test_codewords_stand_apart():
    for n in (1, 2, 3, 4, 7, 20, 100):
        code = language_id.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n
    assert min((a != b).sum() for i, a in enumerate(language_id.codewords(20)) for b in language_id.codewords(20)[:i]) >= 10


def test_language_defined_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the cat and the dog", "en"), (5, "the house", None), (None, "the mouse", "fr"), (6, "le chat et le chien", "fr"), (6, "le chat et le chien", "fr")] + [(100 + i, "the cat and the dog sat" if i % 2 else "le chat et le chien sont", "en" if i % 2 else "fr") for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, lang_pred int")
    found = {r.doc_id: r for r in language_id.predictions(docs).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[1].score == 0
    assert found[4].lang_pred == "en" and found[6].lang_pred == "fr" and not found[None].held_out
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id <= 3").count() == 0 and kept.where("doc_id = 6 AND score = 1 AND lang_pred = 2").count() == 2
    assert language_id.predictions(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.predictions(unlabelled).collect()] == ["und"]


# -- 9 licences


def test_license_findings(spark):
    templates = [license_scan.Template.of(*x) for x in license_scan.NOTICES.items()]
    long = license_scan.NOTICES["MIT-text"]
    text = ("/* " + long.replace(" a ", " some ") + " */ ") * 3 + "x " * 50 + license_scan.NOTICES["Apache-2.0-header"]
    assert [f[0] for f in license_scan.scan_text(text, templates)] == ["MIT-text"] * 3 + ["Apache-2.0-header"]
    assert license_scan.scan_text(" ".join(long.split()[:40]), templates) == []
    assert len(license_scan.scan_text("Released under the MIT License. " * 4, templates)) == 4
    every = [license_scan.Template.of(*x) for x in license_scan.known_texts().items()]
    for name, notice in license_scan.known_texts().items():
        found = license_scan.scan_text(f"Intro words. {notice}. Outro words.", every)
        assert max(found, key=lambda f: f[4])[1:3] == (1.0, len("Intro words. ") + re.search(r"\w", notice).start()), name
        if name not in ("BSD-2-Clause",):  # the beginning of another
            assert max(found, key=lambda f: f[4])[0] == name
    assert license_scan.scan_text("Licensed under the Apache License, Version 2.0.", every)[0][0] == "Apache-2.0"
    assert [f[0] for f in license_scan.scan_text("// SPDX-License-Identifier: BSD-3-Clause\nint x;", every)] == ["BSD-3-Clause-tag"]
    assert license_scan.scan_text("SPDX-License-Identifier: BSD-4-Clause", every) == []


LINES = {
    "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
    "This work is licensed under the GNU General Public License, version 2.1": [],
    "This work is licensed under the GNU General Public License, version 3": ["GPL-3.0"],
    "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
    "This work is licensed under the GNU Affero General Public License, version 2": [],
    "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
    "This work is licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1"],
    "This work is licensed under the GNU Other General Public License, version 3": [],
    "Licensed under the Apache License, Version 2.0": ["Apache-2.0"],
    "Licensed under the Apache License, Version 1.1": [],
    "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
    "Licensed under CC BY-ND 4.0": [],
    "Licensed under CC BY 4.0": ["CC-BY-4.0"],
    "SPDX-License-Identifier: Apache-2.0 OR MIT": ["Apache-2.0-tag", "MIT-tag"],
    "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-only WITH Classpath-exception-2.0\nMIT": ["MIT-tag", "BSD-3-Clause-tag", "GPL-2.0-only-tag"],
    "SPDX-License-Identifier: GPL-2.0+ or later": ["GPL-2.0-or-later-tag"],
    "SPDX-License-Identifier: BSD-4-Clause AND mit, XSPDX-License-Identifier: ISC, SPDX-License-Identifier: MIT_x": ["MIT-tag"],
}


@pytest.mark.parametrize("line", LINES)
def test_license_lines_name_the_right_license(line):
    every = [license_scan.Template.of(*x) for x in license_scan.known_texts().items()]
    found = license_scan.scan_text(f"Some words. {line}. More words.", every)
    assert [f[0] for f in found] == LINES[line]
    assert all(f[1] == 1.0 for f in found)


def test_license_headers_with_one_word_changed_name_the_right_license():
    """Neighbours: any word of one may be another; where that word is one of its name, no other license is named."""
    known = license_scan.known_texts()
    every = [license_scan.Template.of(*x) for x in known.items()]
    near = ["GPL-2.0-header", "GPL-3.0-header", "AGPL-3.0-header", "LGPL-3.0-header", "LGPL-2.1-header", "BSD-2-Clause", "BSD-3-Clause", "MIT-text", "Apache-2.0-header", "MPL-2.0"]
    for name in near:
        assert [f[0] for f in license_scan.scan_text(known[name], every)] == [name]
        words = known[name].split()
        for i in range(len(words)):
            found = license_scan.scan_text(" ".join(words[:i] + ["changed"] + words[i + 1 :]), every)
            assert {f[0] for f in found} <= {name}, (name, words[i])
            naming = " ".join(license_scan.NAMING.get(name, ()))
            assert found or words[i].strip(",;.()").lower() in naming or "." in words[i], (name, words[i])
    header = known["GPL-3.0-header"]
    for text, want in ((header.replace("GNU", "GNU Affero"), {"AGPL-3.0-header"}), (header.replace("GNU", "GNU Other"), set()), (header.replace("version 3", "version 4"), set()), (header.replace("version 3", "version 2"), {"GPL-2.0-header"})):
        assert {f[0] for f in license_scan.scan_text(text, every)} == want
    lesser = known["GPL-3.0-header"].replace("GNU", "GNU Lesser").replace("program", "library")
    assert {f[0] for f in license_scan.scan_text(lesser, every)} == {"LGPL-3.0-header"}


def test_naming_phrases_stand_in_their_texts():
    for name, text in license_scan.known_texts().items():
        assert all(len(places) > 1 for places in license_scan.Template.of(name, text).naming), name
    assert set(license_scan.NAMING) <= set(license_scan.known_texts())


def test_full_licenses_are_told_apart():
    every = [license_scan.Template.of(*x) for x in license_scan.known_texts().items()]
    full = license_scan.known_texts()["GPL-3.0-full"]
    assert max(license_scan.scan_text(full, every), key=lambda f: f[4])[0] == "GPL-3.0-full"
    other = full.replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")
    assert "GPL-3.0-full" not in {f[0] for f in license_scan.scan_text(other, every)}


def test_license_with_other_words_in_the_middle(spark):
    """Any number of them, also where the license stands twice."""
    rng = random.Random(9)
    templates = [license_scan.Template.of("MIT-text", license_scan.NOTICES["MIT-text"])]
    words = license_scan.NOTICES["MIT-text"].split()
    for n in (20, 60, 120, 1000, 20_000):
        noise = [f"w{rng.randrange(300)}" for _ in range(n)]
        text = " ".join(words[:50] + noise + words[50:])
        (found,) = license_scan.scan_text(text, templates)
        assert found[:2] == ("MIT-text", 1.0) and (found[2], found[3]) == (0, len(text) - 1)
    twice = " ".join((words[:50] + noise + words[50:]) * 2 + words)
    assert [f[:2] for f in license_scan.scan_text(twice, templates)] == [("MIT-text", 1.0)] * 3
    spread = [x for w in words for x in (w, f"x{rng.randrange(50)}", f"y{rng.randrange(50)}")]
    assert license_scan.scan_text(" ".join(spread), templates) == []  # no run of three words


def patience_by_hand(a, b):
    """Pairs of a patience alignment, with the longest rising run found by trying all."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in patience_by_hand(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return patience_by_hand(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    best = [[]]
    for n in range(len(anchors), 0, -1):
        best = [c for c in itertools.combinations(anchors, n) if all(p[1] < q[1] for p, q in zip(c, c[1:]))]
        if best:
            break
    if len(best) > 1:
        raise ArithmeticError("not the only one")
    edges, out = [(-1, -1), *best[0], (len(a), len(b))] if best[0] else [], list(best[0])
    for (i, j), (k, m) in zip(edges, edges[1:]):
        out += [(i + 1 + x, j + 1 + y) for x, y in patience_by_hand(a[i + 1 : k], b[j + 1 : m])]
    return sorted(out)


def test_license_alignment_equals_one_by_hand():
    rng, compared = random.Random(10), 0
    for _ in range(600):
        a, b = ([rng.choice("abcdefghijklmn") for _ in range(rng.randint(0, 10))] for _ in range(2))
        try:
            want = patience_by_hand(a, b)
        except ArithmeticError:  # several rising runs are equally long
            continue
        compared += 1
        assert license_scan.align(a, b) == want
    assert compared > 200


def test_license_alignment_is_a_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    distinct = [str(i) for i in range(30)]
    moved = distinct[10:] + distinct[:10]
    assert len(license_scan.align(distinct, moved)) == 20  # equal to the longest common subsequence where all words are unique


def test_license_scan_of_documents(spark):
    lines = ("Licensed under CC BY-NC 4.0", "licensed under the GNU General Public License, version 3", "Licensed under the Apache License, Version 2.0", "Released under the MIT License")
    got = {r.doc_id for r in queries.op9_license_scan(spark, SF).collect() if r.license}
    assert got == {d for d, t in documents() if any(x in t for x in lines)}
    docs, rows = odd_docs(spark)
    assert license_scan.license_findings(docs).where("license IS NULL AND coverage = 0").count() == len(rows)
    assert license_scan.license_findings(empty(spark)).count() == 0


# -- 10 chats


def test_chat_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(queries.OP10_SQL)
    names = [d[0] for d in cursor.description]
    want = {r[0]: dict(zip(names, r)) for r in cursor.fetchall()}
    got = {r.conv_id: r.asDict() for r in queries.op10_chat_format(spark, SF).collect()}
    assert got == want


def test_chat_round_trip_and_defined_cases(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|x", "<|", "", "a\nb", "\\n", "<" * 5 + "|"]
    turns = [(c, t, r, x, 1, 2) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", None, "as\n\\sistant"] * 2, nasty))] + [(2, None, "assistant", None, 1, 2), (2, 1, "assistant", "dup", 1, 2), (2, 1, "assistant", "dup", 1, 2), (3, 1, "user", "only", 1, 2)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example int, loss_start int")
    examples = chat_format.prefix_target_examples(rows).collect()
    by = defaultdict(list)
    for e in sorted(examples, key=lambda e: e.example):
        by[e.conv_id].append(e)
    for conv in (1, None):
        whole = list(chat_format.read_turns(by[conv][-1].text))
        assert whole == [(r or "", x or "") for c, _, r, x, _, _ in turns if c == conv]
        trained = [chat_format.unescape(e.text[e.loss_start : e.loss_end]) for e in by[conv] if e.loss_end > e.loss_start or e is not by[conv][-1]]
        assert trained == [x for c, _, r, x, _, _ in turns if c == conv and r == "assistant"]
        assert all(b.text.startswith(a.text) for a, b in zip(by[conv], by[conv][1:]))
    assert len(by[2]) == 3 and len(by[3]) == 1 and by[3][0].loss_start == by[3][0].loss_end
    assert chat_format.digests(chat_format.prefix_target_examples(rows.limit(0))).count() == 0
