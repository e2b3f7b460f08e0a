"""Many curves together: aligned returns, correlation, allocation, and multiple-testing corrections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.math import hash_uniform
from quantloom.operators.align import asof_join


def curve_returns(curves: DataFrame, key: str, value: str, order: str = "ts") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return curves.select(key, order, (F.try_divide(F.col(value), F.lag(value).over(w)) - 1).alias("ret")).where("ret IS NOT NULL")


def correlation(returns: DataFrame, key: str, order: str = "ts", tile: int = 256, span: str = "year") -> DataFrame:
    """Correlation and sample covariance of every two curves at the times both have (or numbers of bars); a curve has one return a time.

    Curves are dealt into tiles of about ``tile``, time into panels of one ``span``. A task holds two tiles of one panel as matrices;
    their products are the sums that each two curves need, and sums of panels add up. So a return is copied
    once for each tile, not for each curve.
    """
    tiles = max(1, -(-returns.select(key).distinct().count() // tile))
    centred = F.col("ret") - F.avg("ret").over(Window.partitionBy(key))  # covariances are the same, and sums stay small
    timed = not isinstance(returns.schema[order].dataType, T.NumericType)
    at, panel = (F.unix_micros(F.col(order).cast("timestamp")), F.date_trunc(span, order)) if timed else (F.col(order), F.floor(F.col(order) / 4096))
    rows = returns.where("ret IS NOT NULL").select(F.col(key).alias("key"), at.alias("at"), panel.alias("panel"), centred.cast("double").alias("x"))
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    placed = dealt.withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}).select("panel", "a", "b", "tile", "key", "at", "x")
    kind = returns.schema[key].dataType
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    schema = T.StructType([T.StructField("key_a", kind), T.StructField("key_b", kind), *(T.StructField(c, T.DoubleType()) for c in sums)])

    def products(frame: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(frame["at"].to_numpy(), return_inverse=True)
        sides = []
        for number in (frame.a.iloc[0], frame.b.iloc[0]):
            own = (frame.tile == number).to_numpy()
            names, column = np.unique(frame.key.to_numpy()[own], return_inverse=True)
            x, there = np.zeros((len(times), len(names))), np.zeros((len(times), len(names)))
            x[at[own], column], there[at[own], column] = frame.x.to_numpy()[own], 1.0
            sides.append((names, x, there))
        (one, x, mx), (two, y, my) = sides
        every = (mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y)
        i, j = np.nonzero(every[0])
        same = frame.a.iloc[0] == frame.b.iloc[0]
        i, j = (i[i <= j], j[i <= j]) if same else (i, j)
        out = pd.DataFrame({"key_a": one[i], "key_b": two[j]} | {c: m[i, j] for c, m in zip(sums, every)})
        turned = out.key_a > out.key_b
        out.loc[turned, list(schema.names)] = out.loc[turned, ["key_b", "key_a", "n", "sy", "sx", "syy", "sxx", "sxy"]].to_numpy()
        return out.astype(dict.fromkeys(sums, "float64"))

    whole = placed.groupBy("panel", "a", "b").applyInPandas(products, schema).groupBy("key_a", "key_b").agg(*(F.sum(c).alias(c) for c in sums))
    both, vx, vy = (F.col("n") * F.col(c) - F.col(p) * F.col(q) for c, p, q in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    corr = F.when((vx > 0) & (vy > 0), both / F.sqrt(vx) / F.sqrt(vy))
    covar = F.when(F.col("n") > 1, both / F.col("n") / (F.col("n") - 1))
    return whole.select(F.col("key_a").alias(f"{key}_a"), F.col("key_b").alias(f"{key}_b"), corr.alias("corr"), covar.alias("covar"), F.col("n").cast("long").alias("n"))


def inverse_volatility(returns: DataFrame, key: str) -> DataFrame:
    """Weights by the inverse of volatility."""
    vol = returns.groupBy(key).agg(F.stddev_samp("ret").alias("vol"))
    inverse = F.try_divide(F.lit(1.0), F.col("vol"))
    return vol.withColumn("weight", inverse / vol.agg(F.sum(inverse)).scalar())


def optimal_weights(mean: np.ndarray, cov: np.ndarray, goal: str = "max_sharpe", risk_free: float = 0.0, steps: int = 2000, rate: float = 0.05) -> np.ndarray:
    """Long-only weights for a few curves, by exponentiated gradient on the covariance that Spark computed."""
    n = len(mean)
    if goal == "max_return":
        return np.eye(n)[int(np.argmax(mean))]
    w = np.full(n, 1 / n)
    for _ in range(steps):
        var = float(w @ cov @ w)
        slope = -(cov @ w) if goal == "min_vol" else (mean - risk_free) / np.sqrt(var) - (w @ mean - risk_free) * (cov @ w) / var**1.5
        w = w * np.exp(rate * slope / (np.abs(slope).max() + 1e-12))
        w /= w.sum()
    return w


def weights_for(returns: DataFrame, key: str, goal: str = "max_sharpe", order: str = "ts") -> DataFrame:
    """key, weight: means and covariances come to the driver, one number for every two curves of the portfolio."""
    pairs = correlation(returns, key, order).collect()
    names = sorted({r[f"{key}_a"] for r in pairs})
    at = {n: i for i, n in enumerate(names)}
    cov = np.zeros((len(names),) * 2)
    for r in pairs:
        i, j = at[r[f"{key}_a"]], at[r[f"{key}_b"]]
        cov[i, j] = cov[j, i] = r["covar"] or 0.0
    means = {r[key]: r["m"] for r in returns.groupBy(key).agg(F.avg("ret").alias("m")).collect()}
    found = optimal_weights(np.array([means[n] for n in names]), cov, goal)
    return returns.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(names, found)], f"{key} {returns.schema[key].dataType.simpleString()}, weight double")


def calmar_weights(returns: DataFrame, key: str, trials: int = 200, seed: int = 42, order: str = "ts") -> DataFrame:
    """trial, calmar, and per key the weight, of the mix with the highest total return over its deepest drawdown.

    Trials are drawn by hashes, one group each; equal weights are trial 0. Mixes are rebalanced at every time. Growth is added
    up as logarithms, and gains are ranked by ``log_calmar``, so no growth is too large; it is null where a mix doesn't gain.
    """
    drawn = returns.select(key).distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    raw = F.when(F.col("trial") == 0, 1.0).otherwise(-F.ln(1e-12 + hash_uniform(seed, F.lit("weight"), F.col("trial"), F.col(key))))
    weights = drawn.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(Window.partitionBy("trial"))).drop("_raw")
    mixed = returns.join(weights, key).groupBy("trial", order).agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))
    w = Window.partitionBy("trial").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = mixed.withColumn("growth", F.sum(F.ln(1 + F.col("ret"))).over(w))
    fallen = grown.withColumn("fall", 1 - F.exp(F.col("growth") - F.greatest(F.max("growth").over(w), F.lit(0.0))))
    ends = fallen.groupBy("trial").agg(F.max_by("growth", order).alias("growth"), F.max("fall").alias("fall"))
    gain = F.col("growth") + F.ln(1 - F.exp(-F.col("growth")))
    rated = ends.select("trial", F.try_divide(F.exp("growth") - 1, F.col("fall")).alias("calmar"), F.when((F.col("growth") > 0) & (F.col("fall") > 0), gain - F.ln("fall")).alias("log_calmar"))
    best = rated.orderBy(F.desc_nulls_last(F.round("log_calmar", 9)), F.desc(F.round("calmar", 9)), "trial").limit(1)
    return weights.join(best, "trial")


def portfolio_curve(curves: DataFrame, key: str, weights: DataFrame, order: str = "ts") -> DataFrame:
    """Growth of one unit dealt out by the weights and rebalanced at every time, and its logarithm.

    Months are added up side by side; only one number a month goes through a single task.
    """
    mixed = curve_returns(curves, key, "equity", order).join(weights.select(key, "weight"), key).groupBy(order).agg(F.sum(F.col("ret") * F.col("weight")).alias("ret")).withColumn("_month", F.date_trunc("month", order))
    months = mixed.groupBy("_month").agg(F.sum(F.ln(1 + F.col("ret"))).alias("_grown"))
    before = months.select("_month", F.coalesce(F.sum("_grown").over(Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    run = Window.partitionBy("_month").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = mixed.join(before, "_month").withColumn("log_equity", F.col("_before") + F.sum(F.ln(1 + F.col("ret"))).over(run))
    return grown.withColumn("equity", F.exp("log_equity")).drop("_month", "_before")


def rebalanced(curves: DataFrame, key: str, weights: DataFrame, every: str = "month", cost: float = 0.002, order: str = "ts", span: str = "month") -> DataFrame:
    """Growth of one unit dealt out by the weights and dealt out anew at the end of every month (or other unit of date_trunc).

    Gives order, segment, log_equity, equity; and turnover and cost (a share of equity) where it was dealt out
    anew, null elsewhere. Between those times the weights drift. Turnover is the sum of changes of weight,
    and ``cost`` of it is paid out of what the next segment begins with; nothing is dealt out at the very end.
    A curve without a value at a time keeps its last one; times before all curves have begun don't count.

    Segments grow side by side; only one row a segment goes through a single task.
    """
    values = curves.select(key, order, F.col("equity").cast("double").alias("equity")).where("equity > 0").join(weights.select(key), key, "left_semi")
    begun = values.groupBy(key).agg(F.min(order).alias("_t")).agg(F.max("_t").alias("_begun"))  # one row
    times = values.select(order).distinct().crossJoin(F.broadcast(begun)).where(F.col(order) >= F.col("_begun")).drop("_begun")
    held = asof_join(times.crossJoin(weights.select(key, F.col("weight").cast("double").alias("weight"))), values, [key], ["equity"], order, span)
    held = held.withColumn("segment", F.date_trunc(every, order).cast("timestamp_ntz"))

    ends = held.groupBy(key, "weight", "segment").agg(F.max_by("equity", order).alias("_end"), F.min_by("equity", order).alias("_start"), F.max(order).alias("_last"))
    base = F.coalesce(F.lag("_end").over(Window.partitionBy(key).orderBy("segment")), F.col("_start"))
    based = ends.withColumn("_base", base)
    mixed = held.join(based.select(key, "segment", "_base"), [key, "segment"]).groupBy("segment", order).agg(F.sum(F.col("weight") * F.col("equity") / F.col("_base")).alias("_grown"))

    drift = based.withColumn("_part", F.col("weight") * F.col("_end") / F.col("_base"))
    whole = drift.groupBy("segment").agg(F.sum("_part").alias("_whole"), F.max("_last").alias("_last"))
    turned = drift.join(whole.select("segment", "_whole"), "segment").groupBy("segment").agg(F.sum(F.abs(F.col("_part") / F.col("_whole") - F.col("weight"))).alias("_turnover"))
    by = Window.orderBy("segment")  # one row a segment
    kept = F.ln("_whole") + F.ln(1 - cost * F.col("_turnover"))
    segments = whole.join(turned, "segment").select("segment", "_last", "_turnover", F.coalesce(F.sum(kept).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.lead("segment").over(by).isNull().alias("_final"))
    grown = mixed.join(segments, "segment").withColumn("log_equity", F.col("_before") + F.ln("_grown"))
    anew = (F.col(order) == F.col("_last")) & ~F.col("_final")
    return grown.select(order, "segment", "log_equity", F.exp("log_equity").alias("equity"), F.when(anew, F.col("_turnover")).alias("turnover"), F.when(anew, cost * F.col("_turnover")).alias("cost"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up for small n, else by its expansion, whose error is under 1e-10."""
    few = [0.0]
    for i in range(1, 21):
        few.append(few[-1] + 1 / i)
    x = n.cast("double")
    large = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 20, F.element_at(F.array(*map(F.lit, few)), F.least(n, F.lit(20)).cast("int") + 1)).otherwise(large)


def corrected_p_values(tests: DataFrame, p: str = "p_value", parts: int = 200) -> DataFrame:
    """Bonferroni, and Benjamini, Hochberg and Yekutieli under any dependence.

    Equal values are one, with their number; the distinct values are cut into ``parts`` ranges, in
    which ranks and minima run side by side; only one row a range goes through a single task. A
    null stays null and counts as no test.
    """
    counted = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    edges = counted.approxQuantile(p, [i / parts for i in range(1, parts)], 0.5 / parts)
    ranged = counted.withColumn("_part", sum((F.col(p) > e).cast("int") for e in sorted(set(edges))) if edges else F.lit(0))
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_t"))
    by = Window.orderBy("_part")
    starts = totals.select("_part", F.coalesce(F.sum("_t").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    m = counted.agg(F.sum("_n")).scalar()
    own = Window.partitionBy("_part").orderBy(p)
    ranked = ranged.join(starts, "_part").withColumn("_rank", F.col("_start") + F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    raw = ranked.withColumn("_m", m).withColumn("_raw", F.col(p) * F.col("_m") * harmonic(F.col("_m")) / F.col("_rank"))
    lows = raw.groupBy("_part").agg(F.min("_raw").alias("_l")).select("_part", F.min("_l").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    least = F.least(F.min("_raw").over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"))
    values = raw.join(lows, "_part").select(F.col(p).alias("_p"), F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("bonferroni"), F.least(F.lit(1.0), least).alias("bhy"))
    return tests.join(values, tests[p] == values["_p"], "left").drop("_p")


def parameter_summary(figures: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The system over its whole grid: median, quartiles, share of gains, best, and how far best and median lie apart."""
    x = F.col(metric)
    one = figures.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.25)).alias("q25"), F.percentile(x, F.lit(0.75)).alias("q75"), F.avg(F.when(x > 0, 1.0).otherwise(0.0)).alias("positive_share"), F.max(x).alias("best"))
    return one.withColumn("best_to_median", F.col("best") - F.col("median"))


def permutation_summary(figures: DataFrame, keys: list[str]) -> DataFrame:
    """The system over executed permutations of its parameters: medians, mean and deviation of profit, shares of gains."""
    median = lambda c: F.percentile(c, F.lit(0.5))
    share = lambda c: 100 * F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0))
    medians = (median(c).alias(f"median_{c}") for c in ("net_profit", "sharpe_ratio", "max_drawdown_pct", "profit_factor", "return_on_drawdown"))
    return figures.groupBy(*keys).agg(F.count("*").alias("n"), *medians, F.avg("net_profit").alias("mean_net_profit"), F.stddev_pop("net_profit").alias("std_net_profit"), share("net_profit").alias("profitable_pct"), share("sharpe_ratio").alias("sharpe_positive_pct"))


def optimization_profile(figures: DataFrame, keys: list[str], metric: str, order: str = "combo_idx") -> DataFrame:
    """How even the grid is: mean, deviation, share of gains, and share of neighbours between which the sign changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    sign = F.signum(metric)
    marked = figures.withColumn("_turn", (sign != F.lag(sign).over(w)).cast("double"))
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.avg(F.when(F.col(metric) > 0, 1.0).otherwise(0.0)).alias("positive_share"), F.coalesce(F.avg("_turn"), F.lit(0.0)).alias("turn_share"))


def multi_oos(bars_equity: DataFrame, keys: list[str], parts: int = 3, order: str = "bar_seq") -> DataFrame:
    """Total return of equal consecutive parts of every curve."""
    w = Window.partitionBy(*keys).orderBy(order)
    cut = bars_equity.withColumn("part", F.ntile(parts).over(w))
    return cut.groupBy(*keys, "part").agg((F.max_by("equity", order) / F.min_by("equity", order) - 1).alias("total_return"), F.count("*").alias("n"))
