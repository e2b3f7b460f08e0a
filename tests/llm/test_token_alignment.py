"""Cross-tokenizer alignment against brute force over the libraries' tokens, and its defined cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from quantloom.llm import queries, token_alignment

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def a_tokens(text):
        return [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]

    def b_tokens(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text, num_threads=1)]

    return a_tokens, b_tokens


def brute(libraries, rows):
    """The contract, byte by byte."""
    a_tokens, b_tokens = libraries
    kept, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (a_tokens(text), b_tokens(text)) if text else ([], [])
        whole = f" {text}".encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            a, b = [], []
        owner_a, owner_b = ([n for n, (_, t) in enumerate(side) for _ in t] for side in (a, b))
        links = sorted(set(zip(owner_a, owner_b)))
        ends = [{at + 1 for at in range(len(o)) if at + 1 == len(o) or o[at] != o[at + 1]} for o in (owner_a, owner_b)]
        cuts, groups, start = sorted(ends[0] & ends[1]), [], 0
        for stop in cuts:
            groups.append("|".join(",".join(str(side[n][0]) for n in sorted(set(o[start:stop]))) for side, o in ((a, owner_a), (b, owner_b))))
            start = stop
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(pairs)
        kept.append((doc_id, len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (_, b_id), n in counts.items():
        highest[b_id] = max(highest[b_id], n)
    return sorted((i, n_a, n_b, g, len(p), sum(counts[x] == highest[x[1]] for x in p), sum(counts[x] for x in p), d) for i, n_a, n_b, g, p, d in kept)


def found(frame):
    assert frame.columns == NAMES
    return sorted(map(tuple, frame.collect()), key=lambda r: (r[0] is None, r))


def odd_texts():
    rng = random.Random(5)
    units = ["the", "tion", " ", "  ", "\n", "\t", "é", "日本", "🙂", "<|endoftext|>", "</s>", "<0x41>", "'s", "don't", "12345", "!!", " ", " ", "é", "\x00", "\x1c", "ﬁ", "a", "B", "...", "\r\n", " "]
    texts = [None, "", " ", "\n", "a", " a", "a ", "  a  b  ", "x▁y", "▁", "▁ ▁ a", "a ▁", "zz " * 3000, "a" * 5000, " " * 300, "the the the", "the the the", "\x1ca \x1c b"]
    return texts + ["".join(rng.choice(units) + rng.choice(["", " "]) for _ in range(rng.randint(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 23])
def test_alignment_equals_brute_force_on_odd_texts(spark, libraries, block_bytes):
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, block int, links string, n int").repartition(3)
    assert found(token_alignment.alignments(docs, BPE, PIECES, block_bytes)) == brute(libraries, rows)


def test_alignment_of_documents(spark, libraries):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert found(queries.op11_token_alignment(spark, SF)) == brute(libraries, rows)


def test_alignment_of_parts_when_the_table_is_full(spark, libraries, monkeypatch):
    monkeypatch.setattr(token_alignment, "PARTS_KEPT", 5)
    monkeypatch.setattr(token_alignment, "LONG_PART", 3)
    monkeypatch.setattr(token_alignment, "TOGETHER", 2)
    aligner = token_alignment.Aligner(open(BPE, encoding="utf-8").read(), open(PIECES, "rb").read())
    a_tokens, b_tokens = libraries
    for text in filter(None, odd_texts()):
        block = token_alignment.Block(aligner)
        block.add(1, text)
        row = block.packed().to_pylist()[0]
        if row["n_a"] != [0]:
            assert (row["n_a"], row["n_b"]) == ([len(a_tokens(text))], [len(b_tokens(text))])


def test_tokens_across_a_cut_are_aligned_one_by_one():
    pieces = [bytes([i]) for i in range(256)] + [b"b c"]

    def encode(text):
        text = f" {text}".encode()
        out, at = [], 0
        while at < len(text):
            long = text[at : at + 3] == b"b c"
            out.append(256 if long else text[at])
            at += 3 if long else 1
        return out

    side = token_alignment.Side(encode, pieces, "|")
    assert [p.n_a for p in token_alignment.align(side, side, ["ab", "cd"])] == [3, 3]


def test_alignment_of_an_empty_table_and_null_ids(spark, libraries):
    schema = "doc_id long, text string"
    assert token_alignment.alignments(spark.createDataFrame([], schema), BPE, PIECES).count() == 0
    rows = [(None, "same text"), (None, "same text"), (1, "same text"), (1, None)]
    out = found(token_alignment.alignments(spark.createDataFrame(rows, schema), BPE, PIECES))
    assert [r[0] for r in out] == [1, 1, None, None] and len({r[1:] for r in out if r[1]}) == 1
    assert out[-1][6] == 3 * out[-1][4] and out[0] == (1, 0, 0, 0, 0, 0, 0, "")


def test_a_task_holds_few_blocks_at_a_time(spark, monkeypatch, tmp_path):
    """One task's blocks lie in many row groups, so neither their writer nor their reader holds them all."""
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(60)]
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 1 << 17)
    monkeypatch.setattr(token_alignment, "shared_folder", lambda _: str(tmp_path / "blocks"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in token_alignment.alignments(docs, BPE, PIECES, 4000).collect()}
    (file,) = glob.glob(f"{tmp_path}/blocks/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows >= 20 and meta.num_row_groups >= 4 and max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= meta.num_rows // 3
    monkeypatch.undo()
    assert len(found) == 60 and found == {r.doc_id: r for r in token_alignment.alignments(docs, BPE, PIECES).collect()}
