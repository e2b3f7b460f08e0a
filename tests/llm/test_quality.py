"""Quality classifier: its parts against plain versions, held-out accuracy, and its defined cases."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from quantloom.llm import quality_classifier as qc
from quantloom.llm import queries

SF = "/root/testdata/sf0.01"


def plain_ngrams(text):
    """The n-grams as tuples, by the definition."""
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in text).split(" ") if w]

    def shape(word):
        out = []
        for c in word:
            kind = "a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c
            out += [kind] * (not out or out[-1] != kind)
        return "".join(out)

    shapes = ["=" if i and words[i - 1] == w else shape(w) for i, w in enumerate(words)]
    return {("w", *words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)} | {("s", *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


@pytest.mark.parametrize("slice_bytes", [1 << 20, 16])
def test_ngrams_tell_texts_apart_as_tuples_do(monkeypatch, slice_bytes):
    monkeypatch.setattr(qc, "BITS", 62)  # no two by chance
    monkeypatch.setattr(qc, "SLICE", slice_bytes)
    monkeypatch.setattr(np, "int32", np.int64)
    rng = random.Random(1)
    units = ["the", "The", "THE", "a1", "12", "é", "x-y", "##", "and", "and", "aB"]
    texts = ["", " ", "a", "a a", "a  a\na"] + [rng.choice(["", " "]) + rng.choice([" ", "\n", "  "]).join(rng.choice(units) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    found, plain = [set(qc.ngrams(t).tolist()) for t in texts], [plain_ngrams(t) for t in texts]
    assert [len(f) for f in found] == [len(p) for p in plain]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(found[i] & found[j]) == len(plain[i] & plain[j])


def test_long_words_and_texts_are_taken_whole(monkeypatch):
    assert len(qc.ngrams("x" * 200_000 + "1")) == len(qc.ngrams("x1"))
    assert len(set(qc.ngrams("x" * 200_000)) & set(qc.ngrams("x" * 200_001))) == 1  # the shape
    text = "one two " * 300_000  # several slices
    assert (qc.ngrams(text + "end!") == qc.ngrams("one two one two one two end!")).all()


def test_ratios_by_hand():
    ratios = qc.log_count_ratios([np.array([1, 2]), np.array([2, 3]), np.array([3])], np.array([True, True, False]))
    a, b = 4 + qc.BUCKETS, 1 + qc.BUCKETS
    assert ratios[[0, 1, 2, 3]] == pytest.approx(np.log([b / a, 2 * b / a, 3 * b / a, b / a]))


def test_descent_reaches_the_optimum():
    """Primal and dual objective meet."""
    rng = np.random.default_rng(0)
    good = rng.random(120) < 0.3
    rows = [np.unique(rng.integers(0, 30, 8) + 10 * g) for g in good]
    values = [rng.random(len(r)) for r in rows]
    cost = 0.7
    weights, bias = qc.dual_coordinate_descent(rows, values, good, cost, 3000, 1e-7)
    sign = np.where(good, 1, -1)
    costs = cost * len(good) / (2 * np.where(good, good.sum(), (~good).sum()))
    margins = np.array([weights[r] @ v + bias for r, v in zip(rows, values)])
    primal = (weights @ weights + bias**2) / 2 + (costs * np.maximum(0, 1 - sign * margins)).sum()
    x = np.zeros((len(rows), qc.BUCKETS // 1024))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r] = v
    # the subgradient at the optimum holds zero: weights are a sum of rows at or inside the margin
    inside = np.abs(1 - sign * margins) < 1e-5
    outside = sign * margins < 1 - 1e-5
    rest = weights[: x.shape[1]] - ((sign * costs)[outside, None] * x[outside]).sum(0)
    part, left, *_ = np.linalg.lstsq((sign[:, None] * np.c_[x, np.ones(len(x))])[inside].T, np.r_[rest, bias - (sign * costs)[outside].sum()], rcond=None)
    assert np.allclose((sign[:, None] * np.c_[x, np.ones(len(x))])[inside].T @ part, np.r_[rest, bias - (sign * costs)[outside].sum()], atol=1e-4)
    assert primal < (costs.sum())  # better than zero weights


def test_held_out_accuracy(spark):
    found = {r.doc_id: r for r in queries.op13_quality_classifier(spark, SF).collect()}
    ids = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SF}/documents.parquet'").fetchall()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert set(found) == ids
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [i for i in labels if found[i].held_out]
    assert len(held) > 50 and sum(found[i].predicted == labels[i] for i in held) >= 0.97 * len(held)
    assert sum(found[i].score for i in held if labels[i]) / sum(labels[i] for i in held) > 0.8


def test_labels_of_held_out_rows_play_no_part(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(qc.quality_scores(docs, turned).collect()) == sorted(qc.quality_scores(docs.repartition(7), labels).collect())


def test_sample_is_bounded_and_even(spark):
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 10 > 0 AS int) AS quality")
    found = qc.learned_from(labels, "quality", "true", 150).collect()
    assert sum(r.good for r in found) == 150 and len(found) == 300
    assert sorted(found) == sorted(qc.learned_from(labels.repartition(9), "quality", "true", 150).collect())


def test_defined_cases(spark):
    schema = "doc_id long, text string, good int, quality string, grams int, score int"
    texts = [(i, f"fine words number {i} here" if i % 2 else f"BAD!! WORDS!! {i}!!") for i in range(60)]
    texts += [(None, "fine words"), (None, None), (61, None), (62, ""), (63, " \n"), (64, "BAD!! " * 50_000), (1, "another text"), (1, "fine words number 1 here"), (1, "fine words number 1 here")]
    docs = spark.createDataFrame([(*t, 5, "x", 6, 7) for t in texts], schema)
    marks = [(i, i % 2, 1) for i in range(60)] + [(None, 1, 1), (7, None, 1), (8, 3, 1), (9, 0, 1), (61, 1, 1), (62, 0, 0), (99, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text int")
    rows = qc.quality_scores(docs, labels).collect()
    assert len(rows) == len(texts) and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert all(0 <= r.score <= 1 for r in rows)
    first = {}
    for r in rows:
        first.setdefault(r.doc_id, r)
    assert first[64].predicted == 0 and first[61].score == first[62].score == first[63].score
    assert sum(first[i].predicted == i % 2 for i in range(60)) >= 58
    empty_docs, no_labels = docs.limit(0), labels.where("quality = 1")
    assert qc.quality_scores(empty_docs, labels).count() == 0
    assert {r.score for r in qc.quality_scores(docs, no_labels).collect()} == {r.score for r in qc.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
