"""Staged exits: positions closed in parts at targets, by a stop, or by a stop that trails the highest price.

Where a part ends is a first-touch search: the first bar behind the entry whose high reaches the target or
whose low reaches a stop. Bars are put into blocks of ``FAN``, blocks into blocks, each with its highest high,
lowest low and deepest fall from a high to a later low. A search looks through the rest of its block,
goes up to the blocks behind it while nothing is touched, and down into the one that is: a few equi-joins
on (symbol, block), whatever the distance, with no loop over bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 64
_CHILD = "struct<hi:double,lo:double,dip:double,open:double,ts:timestamp_ntz>"
_KEPT = ("symbol", "entry_id", "leg", "target", "stop", "trail", "peak")


def _levels(bars: DataFrame, fan: int) -> list[DataFrame]:
    """symbol, block and its children (hi, lo, dip, open, ts) in order; from bars up to one block a symbol.

    ``dip`` is the least low over the highest high before it inside; a bar has none.
    """
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    none = F.lit(None).cast("double")
    level = bars.select("symbol", at.cast("long").alias("pos"), F.struct(F.col("high").cast("double").alias("hi"), F.col("low").cast("double").alias("lo"), none.alias("dip"), F.col("open").cast("double").alias("open"), F.col("ts").cast("timestamp_ntz").alias("ts")).alias("child"))
    found, most = [], bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    while True:
        blocks = level.groupBy("symbol", F.expr(f"pos div {fan}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "child"))).alias("run")).select("symbol", "block", F.col("run.child").alias("children"))
        found.append(blocks)
        most = -(-most // fan)
        if most <= 1:
            return found
        start = F.struct(none.alias("hi"), none.alias("lo"), none.alias("dip"))
        whole = F.aggregate("children", start, lambda acc, x: F.struct(F.greatest(acc["hi"], x["hi"]).alias("hi"), F.least(acc["lo"], x["lo"]).alias("lo"), F.least(acc["dip"], x["dip"], F.try_divide(x["lo"], acc["hi"])).alias("dip")))
        empty = F.lit(None)
        level = blocks.withColumn("s", whole).select("symbol", F.col("block").alias("pos"), F.struct("s.hi", "s.lo", "s.dip", empty.cast("double").alias("open"), empty.cast("timestamp_ntz").alias("ts")).alias("child"))


def _search(legs: DataFrame, blocks: DataFrame, fan: int) -> DataFrame:
    """Legs with ``at`` (the child to begin with) looked through one block: ``hit`` is the first child touched, null if none is; peak is the highest before it."""
    joined = legs.withColumn("block", F.expr(f"at div {fan}")).join(blocks, ["symbol", "block"])

    def touched(x: Column, peak: Column) -> Column:
        floor = F.col("trail") * peak
        parts = (x["hi"] >= F.col("target"), x["lo"] <= F.col("stop"), x["lo"] <= floor, x["dip"] <= F.col("trail"))
        return F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False)) | F.coalesce(parts[2], F.lit(False)) | F.coalesce(parts[3], F.lit(False))

    start = F.struct(F.col("peak"), (F.col("at") % fan).cast("int").alias("i"), F.lit(False).alias("done"))
    step = lambda acc, x: F.when(acc["done"] | touched(x, acc["peak"]), F.struct(acc["peak"], acc["i"], F.lit(True).alias("done"))).otherwise(F.struct(F.greatest(acc["peak"], x["hi"]).alias("peak"), (acc["i"] + 1).alias("i"), F.lit(False).alias("done")))
    seen = joined.withColumn("s", F.aggregate(F.slice("children", (F.col("at") % fan).cast("int") + 1, F.lit(fan)), start, step))
    return seen.select(*_KEPT[:-1], F.col("s.peak").alias("peak"), "block", F.when(F.col("s.done"), F.col("block") * fan + F.col("s.i")).alias("hit"), F.when(F.col("s.done"), F.get("children", F.col("s.i"))).alias("bar"))


def first_touch(legs: DataFrame, bars: DataFrame, fan: int = FAN) -> DataFrame:
    """Legs (symbol, entry_id, leg, at, target, stop, trail, peak) with the bar that ends them: hit, bar (hi, lo, dip, open, ts), and the peak before it. Legs that nothing ends are left out.

    ``at``: the position of the first bar that counts; ``trail``: the share of the peak at which the leg ends. Null conditions never hold.
    """
    levels, ends, waiting = _levels(bars, fan), [], legs.select(*_KEPT, "at")
    for blocks in levels:
        seen = _search(waiting, blocks, fan)
        ends.append(seen.where("hit IS NOT NULL"))
        waiting = seen.where("hit IS NULL").select(*_KEPT, (F.col("block") + 1).alias("at"))
    down = ends[-1]
    for blocks, own in zip(levels[-2::-1], ends[-2::-1]):
        inside = _search(down.select(*_KEPT, (F.col("hit") * fan).alias("at")), blocks, fan)
        down = own.unionByName(inside)
    return down.select(*_KEPT, "hit", "bar")


def staged_exits(entries: DataFrame, bars: DataFrame, targets: Sequence[tuple[float, float]], stop: float | None = None, trail: float | None = None, fan: int = FAN) -> DataFrame:
    """One row for each entry and part: symbol, entry_ts, leg, fraction, entry_price, exit_ts, exit_price, reason, ret.

    ``entries``: symbol and ts of bars, bought at their close. ``targets``: for each part its gain (null: none)
    and its share of the position. ``stop`` and ``trail``: the fall from the entry and from the highest high since. Within
    a bar a stop goes before a target, and a bar that opens beyond a price fills at its open. Parts still open are closed at the last bar.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    numbered = bars.select("symbol", "ts", F.col("close").cast("double").alias("close"), F.row_number().over(w).cast("long").alias("at"))
    opened = entries.select("symbol", "ts").distinct().join(numbered, ["symbol", "ts"])
    parts = F.array(*(F.struct(F.lit(i).alias("leg"), F.lit(share).alias("fraction"), F.lit(gain).cast("double").alias("gain")) for i, (gain, share) in enumerate(targets)))
    price = F.col("close")
    legs = opened.withColumn("part", F.explode(parts)).select(
        "symbol", F.col("at").alias("entry_id"), F.col("ts").alias("entry_ts"), "at", price.alias("entry_price"), price.alias("peak"), "part.leg", "part.fraction", (price * (1 + F.col("part.gain"))).alias("target"),
        (price * (1 - F.lit(stop).cast("double"))).alias("stop"), F.lit(None if trail is None else 1 - trail).cast("double").alias("trail"),
    )
    hits = first_touch(legs, bars, fan).select("symbol", "entry_id", "leg", F.col("peak").alias("_peak"), "bar")
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last_ts"), F.max_by(F.col("close").cast("double"), "ts").alias("_last_close"))
    ended = legs.join(hits, ["symbol", "entry_id", "leg"], "left").join(last, "symbol")
    trailed = F.col("trail") * F.col("_peak")
    floor = F.greatest("stop", trailed)
    stopped = F.coalesce(F.col("bar.lo") <= floor, F.lit(False))
    reason = F.when(F.col("bar").isNull(), "end").when(~stopped, "target").when(F.coalesce(trailed > F.col("stop"), trailed.isNotNull()), "trail").otherwise("stop")
    left = F.when(F.col("bar").isNull(), F.col("_last_close")).when(stopped, F.least("bar.open", floor)).otherwise(F.greatest("bar.open", "target"))
    done = ended.withColumns({"reason": reason, "exit_price": left, "exit_ts": F.coalesce("bar.ts", "_last_ts")})
    return done.select("symbol", "entry_ts", "leg", "fraction", "entry_price", "exit_ts", "exit_price", "reason", (F.try_divide("exit_price", "entry_price") - 1).alias("ret"))
