"""Series brought together: as-of joins, blocks, regimes, and checks of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.math import hash_uniform


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", span: str = "month", strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time (``strict``: before it); of equal times the greatest takes part.

    Time is cut into ranges of one ``span`` (a unit of date_trunc), and rows meet within (keys, range), so no task
    holds all of a key, and there may be no keys at all. The last right row of each range is carried on to
    the ranges behind it by a window that has one row a range. A left row without a time finds nothing.
    """
    within = F.date_trunc(span, ts).cast("timestamp_ntz")
    first, second = (2, 1) if strict else (1, 2)  # of a right and a left row of one time
    latest = right.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.max(F.struct(*columns)).alias("_r")).withColumn("_range", within)
    kind = latest.schema["_r"].dataType
    ranges = left.select(*keys, within.alias("_range"), F.lit(None).cast(kind).alias("_r")).distinct()
    ends = latest.groupBy(*keys, "_range").agg(F.max_by("_r", ts).alias("_r")).unionByName(ranges).groupBy(*keys, "_range").agg(F.first("_r", True).alias("_r"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_r", F.last("_r", True).over(before)).where("_r IS NOT NULL").withColumn("_side", F.lit(0))
    both = left.withColumns({"_range": within, "_side": F.lit(second), "_r": F.lit(None).cast(kind)})
    for rows in (latest.withColumn("_side", F.lit(first)), carried):
        both = both.unionByName(rows, allowMissingColumns=True)
    running = Window.partitionBy(*keys, "_range").orderBy(F.col("_side") > 0, ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_r", F.last("_r", True).over(running)).where(F.col("_side") == second)
    return found.select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))


def block_shuffle(bars: DataFrame, n: int, block: int = 20, seed: int = 42) -> DataFrame:
    """Simulated series whose returns are those of the bars in shuffled blocks; the first close stays."""
    w = Window.partitionBy("symbol").orderBy("ts")
    numbered = bars.select("symbol", "ts", "close", F.row_number().over(w).alias("n"), F.log(F.try_divide(F.col("close"), F.lag("close").over(w))).alias("step"))
    rows = numbered.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("block", F.floor((F.col("n") - 2) / block))
    order = Window.partitionBy("symbol", "sim_id").orderBy(F.col("n") > 1, "_u", "block", "n")
    placed = rows.withColumn("_u", hash_uniform(seed, F.lit("block"), F.col("sim_id"), F.col("symbol"), F.col("block"))).withColumn("place", F.row_number().over(order))
    grown = F.sum(F.coalesce("step", F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("close").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed.select("symbol", "sim_id", "place", (first * F.exp(grown)).alias("close"))


def regimes(bars: DataFrame, period: int = 20, calm: float = 0.0) -> DataFrame:
    """Bars with a regime: rising, falling or flat by the return of the last bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    change = F.try_divide(F.col("close"), F.lag("close", period).over(w)) - 1
    return bars.withColumn("regime", F.when(change > calm, "rising").when(change < -calm, "falling").otherwise("flat"))


def quality(bars: DataFrame, jump: float = 0.5) -> DataFrame:
    """Per symbol, how many bars look wrong and why."""
    w = Window.partitionBy("symbol").orderBy("ts")
    checked = bars.withColumns({"_change": F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1), "_again": F.count("*").over(Window.partitionBy("symbol", "ts")) > 1})
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return checked.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), count(F.col("high") < F.greatest("open", "close", "low")).alias("low_high"), count(F.col("low") > F.least("open", "close", "high")).alias("high_low"),
        count(F.least("open", "high", "low", "close") <= 0).alias("not_positive"), count(F.col("volume") <= 0).alias("no_volume"), count(F.col("_change") > jump).alias("jumps"), count(F.col("_again")).alias("repeated"),
    )
