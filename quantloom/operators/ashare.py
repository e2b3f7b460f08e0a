"""Indicators for the Chinese stock market: flows by order size, chips, boards, turnover, main force."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import clip, lag, ratio, roll, series
from quantloom.operators.indicators import C, H, L, O, V, _stage

LARGE, MEDIUM = 100.0, 20.0  # ten thousands of money per trade; fixed values


def capital_flow(bars: DataFrame) -> DataFrame:
    """In and out flows of large, medium and small trades, by the direction of the bar, with net flows."""
    size = F.col("_size")
    of = {"large": size >= LARGE, "medium": (size >= MEDIUM) & (size < LARGE), "small": size < MEDIUM}
    flows = {f"{k}_{way}": F.when(cond & (C() > O() if way == "in" else C() < O()), F.col("amount")).otherwise(0.0) for k, cond in of.items() for way in ("in", "out")}
    net = sum((F.col(f"{k}_in") - F.col(f"{k}_out") for k in ("medium", "small")), F.col("large_in") - F.col("large_out"))
    main = F.col("large_in") - F.col("large_out") + F.col("medium_in") - F.col("medium_out")
    return _stage(bars, {"_size": ratio(F.col("amount"), V()) / 1e4}, flows, {"net_flow": net, "main_net_flow": main})


def chip_concentration(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """Of the bars before the current one, by volume: (95 % price - 5 % price) / mean price."""
    before = series().rowsBetween(-lookback, -1)
    chips = F.array_sort(F.collect_list(F.struct(C().alias("p"), V().alias("v"))).over(before))
    total = F.aggregate("_chips", F.lit(0.0), lambda acc, x: acc + x["v"])

    def price_at(share: float):
        """The first price whose running share of the volume reaches it."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))
        walked = F.aggregate("_chips", start, lambda acc, x: F.struct((acc["sum"] + x["v"]).alias("sum"), F.when(acc["p"].isNotNull(), acc["p"]).when(acc["sum"] + x["v"] >= share * F.col("_total"), x["p"]).alias("p")))
        return F.coalesce(walked["p"], F.element_at("_chips", -1)["p"])

    mean = ratio(F.aggregate("_chips", F.lit(0.0), lambda acc, x: acc + x["p"] * x["v"]), F.col("_total"))
    value = F.when(F.size("_chips") == lookback, ratio(price_at(0.95) - price_at(0.05), mean))
    return _stage(bars, {"_chips": chips}, {"_total": total}, {"chip_concentration": value})


def chip_profile(bars: DataFrame, lookback: int = 60, bins: int = 50) -> DataFrame:
    """Volume by price over the last bars of each symbol: one row per bin, with the running share of volume."""
    latest = bars.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_r") <= lookback)
    ends = latest.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max_by("close", "ts").alias("last_close"))
    step = (F.col("hi") - F.col("lo")) / bins
    binned = latest.join(ends, "symbol").withColumn("bin", F.least(F.floor(ratio(C() - F.col("lo"), step)), F.lit(bins - 1)).cast("int"))
    volume = binned.groupBy("symbol", "bin").agg(F.sum("volume").alias("volume"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(volume, ["symbol", "bin"], "left").withColumns({"volume": F.coalesce("volume", F.lit(0.0)), "price": F.col("lo") + (F.col("bin") + 0.5) * step})
    whole = Window.partitionBy("symbol")
    share = F.sum("volume").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("volume").over(whole)
    profit = F.sum(F.when(F.col("price") <= F.col("last_close"), F.col("volume")).otherwise(0.0)).over(whole) / F.sum("volume").over(whole)
    return full.select("symbol", "bin", "price", "volume", share.alias("share"), profit.alias("profit_ratio"))


def limit_up_probability(bars: DataFrame) -> DataFrame:
    """A score of 0 to 100 from recent return, volume, the day's rise and its range, halved where calm."""
    volume = ratio(roll(F.avg, V(), 5), roll(F.avg, V(), 20)) - 1
    staged = {"_r1": ratio(C(), lag(C())) - 1, "_r5": ratio(C(), lag(C(), 5)) - 1, "_vol": volume, "_rise": ratio(C(), O()) - 1, "_range": ratio(H() - L(), lag(C()))}
    points = clip(F.col("_r5") * 500, 0, 30) + clip(F.col("_vol") * 20, 0, 25) + clip(F.col("_rise") * 300, 0, 25) + clip(F.col("_range") * 200, 0, 10)
    score = points * F.when(F.col("_calm") < 0.02, 0.5).otherwise(1.0)
    return _stage(bars, staged, {"_calm": roll(F.stddev_samp, F.col("_r1"), 20)}, {"limit_up_probability": F.coalesce(clip(score, 0, 100), F.lit(0.0))})


def board_effect(bars: DataFrame, board_close: str | None = None) -> DataFrame:
    """The lead over the board in 20 bars, or else the return of 5, weighted by how much volume exceeds its mean."""
    lead = ratio(C(), lag(C(), 20)) - ratio(F.col(board_close), lag(F.col(board_close), 20)) if board_close else ratio(C(), lag(C(), 5)) - 1
    excess = F.when(F.col("_v").isNotNull(), F.greatest(F.col("_v") - 1, F.lit(0.0)))
    return _stage(bars, {"_v": ratio(V(), roll(F.avg, V(), 20)), "_lead": lead}, {"_excess": excess}, {"_signal": roll(F.avg, F.col("_excess"), 5)}, {"board_effect": F.coalesce(F.col("_lead") * (1 + F.col("_signal")), F.lit(0.0))})


def turnover_zscore(bars: DataFrame, period: int = 60, threshold: float = 2.0) -> DataFrame:
    x, z = F.col("turnover_rate"), F.col("_z")
    raw = ratio(x - roll(F.avg, x, period), roll(F.stddev_samp, x, period))
    kept = F.when(F.abs(z) > threshold, z).otherwise(0.0)
    return _stage(bars, {"_z": raw}, {"turnover_zscore": kept}, {"is_anomaly": F.col("turnover_zscore") != 0, "anomaly_direction": F.when(F.col("turnover_zscore") > 0, "high").when(F.col("turnover_zscore") < 0, "low").otherwise("normal")})


def _energy():
    return V() * ratio(H() - L(), C())


def main_force(bars: DataFrame, short: int = 20, long: int = 40) -> DataFrame:
    e = F.col("_energy")
    return _stage(bars, {"_energy": _energy()}, {"main_force": F.coalesce(ratio(roll(F.avg, e, short) - roll(F.avg, e, long), roll(F.stddev_samp, e, long)), F.lit(0.0))})


def main_force_detail(bars: DataFrame, period: int = 20) -> DataFrame:
    """Energy, its mean and that over the mean volume, and a direction by where the close lies in the bar."""
    place = ratio(C() - L(), H() - L())
    staged = {"energy": _energy(), "force_direction": F.when(place > 0.6, 1).when(place < 0.4, -1).otherwise(0)}
    return _stage(bars, staged, {"energy_mean": roll(F.avg, F.col("energy"), period)}, {"energy_ratio": ratio(F.col("energy_mean"), roll(F.avg, V(), period))})
