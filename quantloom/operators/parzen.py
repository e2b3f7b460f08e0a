"""Parameter search by Parzen densities, and Latin hypercubes: both made in tasks, by hashes, whatever their size.

A space is a dict as in ``search``: ("int", lo, hi), ("float", lo, hi) or ("categorical", values). In tables a
parameter is a double, a categorical one the place of its value in the list.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.math import hash_uniform

Space = dict[str, tuple]
BINS = 256
_EVEN = 0.3


def _bins(spec: tuple, most: int) -> int:
    kind, *ends = spec
    return len(ends[0]) if kind == "categorical" else most if kind == "float" else min(most, ends[1] - ends[0] + 1)


def _cells(spec: tuple) -> float:
    """The width of a numeric parameter's range; whole numbers fill a unit each."""
    kind, *ends = spec
    return len(ends[0]) if kind == "categorical" else ends[1] - ends[0] + (kind == "int")


def _low(spec: tuple) -> float:
    return 0 if spec[0] == "categorical" else spec[1]


def bin_of(x: Column, spec: tuple, most: int = BINS) -> Column:
    """The number of the bin that a value lies in."""
    n = _bins(spec, most)
    return F.greatest(F.lit(0), F.least(F.floor((x - float(_low(spec))) * n / float(_cells(spec))), F.lit(n - 1))).cast("int")


def value_at(place: Column, spec: tuple) -> Column:
    """The value at a place from 0 to 1 of a parameter's range."""
    x = _low(spec) + place * float(_cells(spec))
    return x if spec[0] == "float" else F.least(F.floor(x + 1e-9).cast("double"), F.lit(float(_low(spec) + _cells(spec) - 1)))


def density(counts: np.ndarray, ordered: bool, prior: float = 1.0) -> np.ndarray:
    """The share of every bin: kernels round the counted ones, and ``prior`` trials spread evenly.

    Ordered bins get normal kernels, cut off at the ends, whose width follows Scott's rule and is a bin at least.
    """
    n, k = float(counts.sum()), len(counts)
    if ordered and n:
        at = np.arange(k)
        mean = (counts * at).sum() / n
        width = max(1.0, 1.06 * math.sqrt((counts * (at - mean) ** 2).sum() / n) * n**-0.2)
        kernels = np.exp(-((at[:, None] - at) ** 2) / (2 * width**2))
        counts = (counts[:, None] * kernels / kernels.sum(1, keepdims=True)).sum(0)
    return (counts + prior / k) / (n + prior)


def densities(history: DataFrame, space: Space, value: str = "value", share: float = 0.25, prior: float = 1.0, most: int = BINS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per parameter the density of good trials and of the others, over its bins.

    Good is the best ``share`` by value, high values being good. Trials without a value are pending, and taken for average ones.
    What comes to the driver are counts per bin, however many trials there are.
    """
    assumed = history.agg(F.avg(value).alias("_mean"))  # one row
    filled = history.crossJoin(F.broadcast(assumed)).withColumn("_v", F.coalesce(value, "_mean")).drop("_mean")
    edge = filled.agg(F.percentile("_v", F.lit(1 - share)).alias("_edge"))  # one row
    judged = filled.crossJoin(F.broadcast(edge)).withColumn("_good", F.coalesce(F.col("_v") >= F.col("_edge"), F.lit(False)))
    cells = F.array(*(F.struct(F.lit(n).alias("name"), bin_of(F.col(n), spec, most).alias("bin")) for n, spec in space.items()))
    rows = judged.select("_good", F.explode(cells).alias("c")).where("c.bin IS NOT NULL").groupBy("_good", "c.name", "c.bin").count().collect()
    counts = {n: np.zeros((2, _bins(spec, most))) for n, spec in space.items()}
    for r in rows:
        counts[r["name"]][int(not r["_good"]), r["bin"]] += r["count"]
    return {n: tuple(density(side, spec[0] != "categorical", prior) for side in counts[n]) for n, spec in space.items()}


def _below(edges: Column, u: Column) -> Column:
    """How many edges are not above u."""
    return F.size(F.filter(edges, lambda edge: edge <= u))


def propose(history: DataFrame, space: Space, n: int, candidates: int = 64, explore: float = 0.25, value: str = "value", share: float = 0.25, prior: float = 1.0, most: int = BINS, seed: int = 42) -> DataFrame:
    """n new trials (slot, the parameters, score): the best of ``candidates`` each that are drawn like good trials.

    A share ``explore`` of the slots, the first ones, take what they draw first, each parameter evenly from its range with
    probability ``_EVEN``, so that a batch isn't all of one kind. The score is the logarithm of how much denser good trials lie there than the others. Where all parameters are discrete
    and have a bin for each value, trials of the history aren't proposed again; a slot all of whose candidates are known gives none.
    """
    found = densities(history, space, value, share, prior, most)
    exploring = F.col("slot") < math.ceil(explore * n)
    drawn, score = history.sparkSession.range(n * candidates).withColumn("slot", (F.col("id") % n).cast("int")), F.lit(0.0)
    for name, spec in space.items():
        good, bad = found[name]
        edges, mixed = (F.lit(np.cumsum(p)[:-1].tolist()) for p in (good, (1 - _EVEN) * good + _EVEN / len(good)))
        u = hash_uniform(seed, F.lit("bin"), F.lit(name), F.col("id"))
        drawn = drawn.withColumn(f"_{name}", F.when(exploring, _below(mixed, u)).otherwise(_below(edges, u)) if len(good) > 1 else F.lit(0))
        score = score + F.element_at(F.lit((np.log(good) - np.log(bad)).tolist()), F.col(f"_{name}") + 1)
    drawn = drawn.withColumn("score", score)
    if all(spec[0] != "float" and _bins(spec, most) == _cells(spec) for spec in space.values()):
        known = history.select(*(bin_of(F.col(name), spec, most).alias(f"_{name}") for name, spec in space.items())).distinct()
        drawn = drawn.join(known, [f"_{name}" for name in space], "left_anti")
    best = Window.partitionBy("slot").orderBy(F.desc(F.when(exploring, 0.0).otherwise(F.round("score", 9))), "id")
    chosen = drawn.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    inside = lambda name: hash_uniform(seed, F.lit("in"), F.lit(name), F.col("id"))
    return chosen.select("slot", *(value_at((F.col(f"_{name}") + inside(name)) / _bins(spec, most), spec).alias(name) for name, spec in space.items()), "score")


def optimize(spark: SparkSession, evaluate: Callable[[list[dict]], list[float]], space: Space, batches: int = 5, size: int = 8, patience: int = 10, seed: int = 42) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Search in batches, each proposed from all before it; stops after ``patience`` trials without gain.

    ``evaluate`` gets a whole batch, so each batch is one Spark job. Gives the best set, its value and the history, a row a trial.
    """
    schema = ", ".join(f"`{n}` double" for n in space) + ", value double"
    rows: list[tuple] = []
    history: list[tuple[dict, float]] = []
    best, stale = None, 0
    for batch in range(batches):
        found = propose(spark.createDataFrame(rows, schema), space, size, seed=seed + batch).orderBy("slot").collect()  # a row a slot
        trials = list({tuple(r[n] for n in space): {n: spec[1][int(r[n])] if spec[0] == "categorical" else int(r[n]) if spec[0] == "int" else r[n] for n, spec in space.items()} for r in found}.items())
        if not trials:
            break
        for (place, trial), result in zip(trials, evaluate([t for _, t in trials])):
            rows.append((*place, float(result)))
            history.append((trial, result))
            if best is None or result > best[1]:
                best, stale = (trial, result), 0
            else:
                stale += 1
        if stale >= patience:
            break
    return *best, history


# -- Latin hypercubes ---------------------------------------------------------------------------


def shuffled(i: Column, n: int, seed: int, name: str, rounds: int = 24) -> Column:
    """A permutation of 0 to n - 1 that hangs on (seed, name) alone: the place of i.

    Swap or not (Hoang, Morris and Rogaway): in each round i and its mirror image in a secret point
    change places or don't, by a bit of the hash of the larger one.
    """
    points = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.struct(r.alias("r"), F.floor(hash_uniform(seed, F.lit("point"), F.lit(name), r) * n).cast("long").alias("k")))

    def swap(x: Column, point: Column) -> Column:
        other = F.pmod(point["k"] - x, F.lit(n))
        return F.when(hash_uniform(seed, F.lit("swap"), F.lit(name), point["r"], F.greatest(x, other)) < 0.5, other).otherwise(x)

    return F.aggregate(points, i.cast("long"), swap)


def latin_hypercube(spark: SparkSession, space: Space, n: int, seed: int = 42) -> DataFrame:
    """sample_id and parameters of n samples that use each of n strata of every parameter once."""
    rows = spark.range(n).withColumnRenamed("id", "sample_id")
    place = lambda name: (shuffled(F.col("sample_id"), n, seed, name) + hash_uniform(seed, F.lit("jitter"), F.lit(name), F.col("sample_id"))) / n
    return rows.select("sample_id", *(value_at(place(name), spec).alias(name) for name, spec in space.items()))
