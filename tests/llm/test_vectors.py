"""Vector search against brute force."""

import duckdb
import numpy as np
import pytest

from quantloom.llm import exact_topk, queries, vector_blocks, vp_search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, equal vectors, nulls, non-finite, zero and short vectors, and columns with names used inside."""
    rng = np.random.default_rng(0)
    x = rng.integers(-8, 9, (500, 8)) / 8
    x[200:350] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, []), (2400, [0.0] * 8), (2500, [1.5, -2.0]), (None, [1.0] * 8), (2600, [float("inf")] * 8)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, id int, n int, vector int")
    usable = [(i, np.pad(np.array(v, float), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    return frame, usable


def brute(usable, score, k, every):
    out = []
    for q, a in usable:
        if q % every == 0:
            best = sorted((-score(a, b), i) for i, b in usable if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    for module in (vector_blocks, exact_topk, vp_search):
        monkeypatch.setattr(module, "BLOCK_ROWS", 90, raising=False)
    monkeypatch.setattr(vector_blocks, "QUERY_ROWS", 3)


def test_exact_topk(odd, small_blocks):
    frame, usable = odd
    want = brute(usable, lambda a, b: int(np.floor(1024 * a) @ np.floor(1024 * b)), 10, 100)
    assert sorted(map(tuple, exact_topk.exact_topk(frame, "id % 100 = 0").collect())) == want


def test_exact_topk_beyond_exact_doubles(spark):
    rows = [(0, [2.0**18, 1 / 1024]), (1, [2.0**19, 3 / 1024]), (2, [2.0**19, 4 / 1024]), (3, [2.0**18, 0.0]), (4, [1e300, 0.0])]
    found = exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(4, 2**63 - 1), (2, 2**57 + 4), (1, 2**57 + 3), (3, 2**56)]


def test_threshold_stops_early():
    """On lists that agree, the bound ends the search long before the lists do."""
    n = 4096
    values = np.tile(np.arange(n, dtype=float)[:, None], (1, 4))
    lists = np.argsort(values, axis=0, kind="stable").T
    met = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, np.ndarray) and key.ndim == 1:
                met.append(len(key))
            return out

    rows, scores = exact_topk.threshold_topk(values.view(Counted), lists, np.array([1.0, 2.0, 0.0, 1.0]), 10, np.ones(n, bool))
    assert sorted(rows) == list(range(n - 10, n)) and sum(met) < 100


def test_vp_tree_with_factor_one_is_exact(odd, small_blocks):
    frame, usable = odd
    usable = [(i, v) for i, v in usable if v.any()]
    want = brute(usable, lambda a, b: float(a @ b), 20, 20)  # eighths, so sums are exact
    assert sorted(tuple(r)[:4] for r in vp_search.nearest(frame, "id % 20 = 0", factor=1.0).collect()) == want


def test_vp_recall(spark):
    found = queries.op8_vp_search(spark, "/root/testdata/sf0.1").collect()
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    ids, x = np.array(rows["vec_id"]), np.stack([np.array(v, float) for v in rows["embedding"]])
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = set(ids[np.argsort(-scores)[:20]].tolist())
        hits, total = hits + len(best & by[int(ids[q])]), total + 20
    assert hits / total >= 0.93


KINDS = {
    "clusters": lambda rng, n: rng.normal(size=(30, 32))[rng.integers(0, 30, n)] + 0.2 * rng.normal(size=(n, 32)),
    "isotropic": lambda rng, n: rng.normal(size=(n, 64)),
    "unit": lambda rng, n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16))),
    "norms": lambda rng, n: rng.normal(size=(n, 24)) * rng.lognormal(0, 1, (n, 1)),
    "flat": lambda rng, n: rng.normal(size=(n, 2)),
    "copies": lambda rng, n: rng.normal(size=(n // 10, 8))[rng.integers(0, n // 10, n)],
}


def measured_recall(frame, x, k=20):
    found = vp_search.nearest(frame, "id % 20 = 0").collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        kth = np.sort(scores)[-k]
        assert [r for r, _, _ in sorted(by[q])] == list(range(1, k + 1))
        assert all(abs(s - scores[i]) < 1e-9 for _, i, s in by[q])
        hits, total = hits + sum(s >= kth - 1e-9 for _, _, s in by[q]), total + k
    return hits / total, found[0].factor


@pytest.mark.parametrize("kind", KINDS)
def test_vp_recall_on_any_table(spark, kind):
    x = KINDS[kind](np.random.default_rng(8), 3000)
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(2)
    recall, factor = measured_recall(frame, x)
    print(kind, recall, factor)
    assert recall >= 0.9 and factor >= 1


def test_vp_recall_where_shards_differ(spark, small_blocks):
    """Sorted clusters, so that each of some 50 shards holds its own kind; the factor comes from 8 of them."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=8) * 3 + (0.1 + i % 5) * rng.normal(size=(225, 8)) for i in range(20)])
    recall, factor = measured_recall(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), x)
    assert recall >= 0.9, factor


def test_vp_factor_is_the_largest_that_reaches_the_recall():
    assert vp_search.choose({1.0: 1.0, 2.0: 0.99, 3.0: 0.94, 4.0: 0.96}, 0.95) == 2.0
    assert vp_search.choose({1.0: 1.0, 2.0: 0.5}, 0.95) == 1.0


def test_vp_ranges_hold_every_point():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(777, 5))
    order, vantage, ranges = vp_search.build(points, 32)
    depth = len(ranges).bit_length()
    for level in range(depth):
        for node in range(1 << level):
            heap, a, b, c = node + (1 << level) - 1, 777 * node >> level, 777 * (node + 1) >> level, 777 * (2 * node + 1) >> level + 1
            d = np.linalg.norm(points[order] - points[vantage[heap]], axis=1)
            low, high, far_low, far_high = ranges[heap]
            assert (d[a:c] >= low - 1e-12).all() and (d[a:c] <= high + 1e-12).all() and (d[c:b] >= far_low - 1e-12).all() and (d[c:b] <= far_high + 1e-12).all()


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert exact_topk.exact_topk(frame, "id % 100 = 0").count() == 0
    assert vp_search.nearest(frame, "id % 20 = 0").count() == 0
