"""The pipeline's stages, each on its own input, against brute force."""

import duckdb
import pytest

import corpus_pipeline
from quantloom.llm import secret_scan, simhash_dedup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{i}")
        docs = spark.read.parquet(f"file://{folder}/{i}")
        out.append(({r.doc_id: r.text for r in before.collect()}, docs))
    return out


def test_stages_give_documents_on(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "suffix-array dedup", "secret scans", "best-fit packing"]
    assert all(docs.columns == COLUMNS for _, docs in stages[:-1])


def test_language_stage_keeps_clean_documents(stages):
    before, after = stages[0]
    assert {r.doc_id for r in after.collect()} == set(before)


def test_near_dedup_stage(stages):
    before, after = stages[1]
    ids = sorted(before)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if simhash_dedup.shingle_similarity(before[a], before[b], 5) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = {r.doc_id: r.text for r in after.collect()}
    assert kept == {i: before[i] for i in ids if find(i) == i}


def test_repeat_stage(stages):
    before, after = stages[2]
    first = {}
    for doc_id in sorted(before):
        data = before[doc_id].encode()
        for s in range(len(data) - 49):
            first.setdefault(data[s : s + 50], doc_id)
    for r in after.collect():
        data = before[r.doc_id].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 49):
            if first[data[s : s + 50]] < r.doc_id:
                gone[s : s + 50] = b"\1" * 50
        assert r.text == bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore") and r.n_chars == len(r.text)


def test_secret_stage(stages):
    before, after = stages[3]
    for r in after.collect():
        found = secret_scan.secrets(before[r.doc_id])
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id]) == (not found)
        assert all(before[r.doc_id][a:b] not in r.text for _, a, b in found)


def test_run_gives_the_last_stage(spark, stages):
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    row = lambda r: tuple(r[c] for c in pieces)
    assert sorted(map(row, corpus_pipeline.run(spark, SF).collect())) == sorted(map(row, stages[-1][1].collect()))
    assert {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()} >= {r.doc_id for r in stages[-1][1].select("doc_id").distinct().collect()}


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty, repeated and long texts, rows that share a doc_id, further columns with names used inside; and an empty table."""
    names = "doc_id long, text string, lang string, source string, n_chars long, block int, item int, component_id string"
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(8).collect()]
    rows = [(i, t, None, None, None) for i, t in enumerate(prose[:6])] + [(10, prose[0], "en", "s", 3), (10, prose[0], "en", "s", 3), (11, prose[1] + " " + prose[1], None, "s", 1), (12, prose[2] * 40, "en", None, 2)]
    rows += [(None, prose[3], "en", "s", 5), (13, None, "en", "s", 0), (14, "", "en", "s", 0), (15, "12 34", "en", "s", 0), (16, prose[6] + " password=hunter22", "en", "s", 0), (16, prose[7] + " other", "en", "s", 0)]
    for name, some in (("odd", rows), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(*r, 1, 2, "c") for r in some], names).write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/stage-{i}")
            docs = spark.read.parquet(f"{folder}/stage-{i}")
        found = corpus_pipeline.run(spark, folder)
        assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs.collect()}
        if some:
            kept = {r.doc_id for r in docs.collect()}
            assert None in kept and 0 in kept and not kept & {10, 13, 14, 15} and docs.where("text LIKE '%hunter22%'").count() == 0
            assert docs.where("doc_id = 16").count() == 2
