"""Merkle manifest against a tree built by hand, and its defined cases."""

import hashlib
import random
import zlib
from itertools import groupby

import duckdb
import pytest

from quantloom.llm import merkle_manifest, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp int, pos string, n int, digest int, proof int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(nodes, fanout):
    """The root, and for every node its steps (left, right) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            a = at[i] // fanout * fanout
            path.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + fanout])))
            at[i] //= fanout
        nodes = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_hand(rows, fanout):
    def place(row):
        return (row[2] is not None, (row[2] or "").encode(), row[0] is not None, row[0] or 0, leaf_of(row, row[4]))

    rows = sorted(rows, key=place)
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[2])]
    trees = [tree([leaf_of(r, r[4]) for r in g], fanout) for g in groups]
    root, upper = tree([t[0] for t in trees], fanout) if groups else (None, [])
    out = []
    for own, (subroot, paths), above in zip(groups, trees, upper):
        for row, path in zip(own, paths):
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            node, proof = leaf_of(row, text), path + above
            for left, right in proof:
                node = h(left, node, right)
            out.append((row[0], leaf_of(row, row[4]), subroot, root, h(*(left + right for left, right in proof)), node, node == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("fanout", [2, 3, 8])
@pytest.mark.parametrize("sizes", [(1,), (8,), (9, 1), (65, 64, 3, 1, 1, 1, 1, 1, 1, 2), (0,)])
def test_manifest_equals_a_tree_by_hand(spark, sizes, fanout):
    rng = random.Random(sum(sizes))
    names = [None, "", "de", "en", "é", "z", "日", "-", "EN", "y"]
    rows = [(rng.randrange(10**6), rng.choice(["a", None, ""]), names[i], rng.choice([None, 7]), rng.choice([None, "", "Ab", "é Ünd Z" * 9, "low"])) for i, n in enumerate(sizes) for _ in range(n)]
    rows += [(None, None, None, None, None), (5, "s", "en", 1, "Same Row"), (5, "s", "en", 1, "Same Row"), (5, "s", "en", 1, "Other")] * (len(sizes) > 2)
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], DOCS).repartition(5)
    found = merkle_manifest.verified(merkle_manifest.manifest(docs, fanout))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert order(found.collect()) == order(by_hand(rows, fanout))


def test_manifest_matches_sql_and_hand(spark):
    found = order(queries.op12_merkle_manifest(spark, SF).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert found == order(db.execute(queries.OP12_SQL).fetchall())
    assert found == order(by_hand(db.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall(), 8))
    assert {r[-1] for r in found} == {True, False}


def test_manifest_needs_two_children(spark):
    with pytest.raises(ValueError):
        merkle_manifest.manifest(spark.createDataFrame([], DOCS), 1)
