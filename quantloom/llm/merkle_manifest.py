"""Merkle manifest of a dataset: every row a leaf, one tree per group, one tree over the groups' roots.

Method: trees are built bottom-up, level by level, and every level is persisted. Proofs are then
pushed top-down: a level's nodes are joined to their parents, and each child prepends its own
siblings to the proof its parent inherited. A proof is a list of steps, each with the digests to
the left and to the right of the node, so a changed leaf can be folded up to a root without the
tree.

Rows are numbered within groups by one sort over ranges of (group, id) and counts per range, so a
group that holds a third of all rows is no task's burden; runs of ``fanout`` nodes are the only
groups that come together. Texts are read once, when leaves are hashed; digests are all that moves.

Defined cases: a null field is hashed as ``-``; nodes of a null group form a group of their own,
before all others; a null id sorts before the others and is never tampered with; rows that share
an id are ordered by their digest, equal rows are leaves each; a single leaf is its subroot, a
single subroot the root; a last run of one node is hashed like any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import durable, shuffle_width

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, joined."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its length in bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``pos`` (from 0, within ``grp`` by the order) and ``n``, the group's number of rows.

    One sort over ranges; places come from counts per group and range, so no task holds a group.
    """
    width = shuffle_width(rows.sparkSession)
    ranged = rows.repartitionByRange(width, "grp", *order).sortWithinPartitions("grp", *order)
    ranged = durable(ranged.withColumns({"_range": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("grp", "_range").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before, whole = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("grp")
    bases = counts.select("grp", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("n"))
    placed = ranged.join(bases, ["grp", "_range"])  # in a range, numbers of a sorted group have no gaps
    return placed.withColumn("pos", F.col("_base") + F.col("_seq") - F.col("_first")).drop("_range", "_seq", "_first", "_base")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels of the trees, persisted, from ``nodes`` (grp, pos, n, digest) up.

    A level has grp, pos, n (nodes of its group on this level), digest and ``children``, the digests below in order.
    """
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = found[-1].where("n > 1").groupBy("grp", F.expr(f"pos div {fanout}").alias("pos")).agg(
            F.expr(f"(max(n) + {fanout - 1}) div {fanout}").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("run")
        )
        runs = runs.select("grp", "pos", "n", F.col("run.digest").alias("children"))
        found.append(durable(runs.withColumn("digest", digest(F.array_join("children", "")))))
        most = -(-most // fanout)
    return found


def proofs(tree: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes of the lowest level with the columns of ``tops``.

    ``tops`` has, by grp, the proof of the group's top node and whatever else its nodes inherit.
    """
    inherited = [c for c in tops.columns if c not in ("grp", "proof")]
    above = None
    for level in reversed(tree):
        nodes = level.where("n = 1").join(tops, "grp")
        if above is not None:
            nodes = nodes.unionByName(level.where("n > 1").join(above, ["grp", "pos"]))
        if level is tree[0]:
            return nodes
        children = nodes.select("grp", "pos", "proof", *inherited, "children", F.posexplode("children").alias("place", "_"))
        place = F.col("place")
        rest = F.greatest(F.size("children") - place - 1, F.lit(0))
        step = F.struct(F.array_join(F.slice("children", F.lit(1), place), "").alias("left"), F.array_join(F.slice("children", place + 2, rest), "").alias("right"))
        above = children.select("grp", (F.col("pos") * fanout + place).alias("pos"), F.concat(F.array(step), "proof").alias("proof"), *inherited)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has under a proof."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's run to the root, as one string."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def lowered(text: Column) -> Column:
    """The tampering: A-Z in lower case, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampered(id_: Column) -> Column:
    """Whether a row is tampered with: a third, by the CRC-32 of its id."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 == 0, F.lit(False))


def manifest(docs: DataFrame, fanout: int = FANOUT, group: str = "lang") -> DataFrame:
    """doc_id, leaf, changed (the leaf after tampering), subroot, root and proof of every row of ``documents``."""
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    key = F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    leaf = digest(*(field(F.col(c)) for c in FIELDS))
    changed = F.when(tampered(F.col("doc_id")), digest(*(field(lowered(F.col(c)) if c == "text" else F.col(c)) for c in FIELDS)))
    hashed = durable(docs.select(key.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), changed.alias("changed")))
    leaves = durable(numbered(hashed, "doc_id", "digest"))
    trees = levels(leaves, fanout)

    tops = reduce(DataFrame.unionByName, (level.where("n = 1").select("grp", "digest") for level in trees))
    subroots = durable(numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("sub"), "digest"), "sub"))
    above = levels(subroots, fanout)
    root = above[-1].where("n = 1").first()
    start = docs.sparkSession.createDataFrame([("", [])], "grp string, proof array<struct<left:string,right:string>>")
    groups = durable(proofs(above, start, fanout).select(F.col("sub").alias("grp"), F.col("digest").alias("subroot"), "proof"))
    return proofs(trees, groups, fanout).select(
        "doc_id", F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("changed"), "subroot", F.lit(root and root["digest"]).alias("root"), "proof"
    )


def verified(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of a manifest's rows."""
    folded = rows.withColumn("folded_root", fold(F.col("changed"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
