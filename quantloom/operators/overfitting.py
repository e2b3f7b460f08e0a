"""Overfitting statistics over a long table of returns (strategy_id, period_idx, ret)."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.math import norm_cdf
from quantloom.functions.windows import average_rank


def split_table(spark: SparkSession, n_splits: int) -> DataFrame:
    """All ways to choose half of 2 * n_splits groups, as (split_id, group_id, in_sample). Its size depends on n_splits alone."""
    groups = 2 * n_splits
    if comb(groups, n_splits) > 1_000_000:
        raise ValueError("too many splits")
    masks = spark.range(1 << groups).where(F.bit_count("id") == n_splits).withColumnRenamed("id", "split_id")
    return masks.select("split_id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group_id")).withColumn("in_sample", F.getbit("split_id", "group_id") == 1)


def grouped(returns: DataFrame, groups: int) -> DataFrame:
    """The returns with the ``group_id`` of their period: equal numbers of periods each, the last takes the rest."""
    n = Window.partitionBy("strategy_id")
    sized = returns.withColumns({"_n": F.count("*").over(n), "_at": F.row_number().over(n.orderBy("period_idx")) - 1})
    size = F.floor(F.col("_n") / groups)
    group = F.least(F.floor(F.try_divide(F.col("_at"), size)), F.lit(groups - 1)).cast("int")
    return sized.withColumn("group_id", group).drop("_n", "_at")


def group_returns(returns: DataFrame, n_splits: int) -> DataFrame:
    """Sums per strategy and group of equal numbers of periods."""
    return grouped(returns, 2 * n_splits).groupBy("strategy_id", "group_id").agg(F.sum("ret").alias("ret"))


def pbo(returns: DataFrame, n_splits: int = 4) -> DataFrame:
    """Share of splits whose best strategy in sample ranks below the median out of sample."""
    summed = group_returns(returns, n_splits).join(split_table(returns.sparkSession, n_splits), "group_id")
    sides = summed.groupBy("split_id", "strategy_id").agg(F.sum(F.when(F.col("in_sample"), F.col("ret")).otherwise(0.0)).alias("is_ret"), F.sum(F.when(F.col("in_sample"), 0.0).otherwise(F.col("ret"))).alias("oos_ret"))
    rounded = sides.withColumns({"is_ret": F.round("is_ret", 10), "oos_ret": F.round("oos_ret", 10)})  # sums of equal parts stay ties
    ranked = rounded.withColumns({"oos_rank": average_rank(-F.col("oos_ret"), ["split_id"]), "best": F.row_number().over(Window.partitionBy("split_id").orderBy(F.desc("is_ret"), "strategy_id")), "n": F.count("*").over(Window.partitionBy("split_id"))})
    share = F.avg(F.when(F.col("oos_rank") > (F.col("n") + 1) / 2, 1.0).otherwise(0.0))
    one = ranked.where("best = 1").agg(F.count("*").alias("n_splits"), share.alias("pbo"))
    return one.withColumn("logit_pbo", F.when((F.col("pbo") > 0) & (F.col("pbo") < 1), F.ln(F.col("pbo") / (1 - F.col("pbo")))).otherwise(0.0))


def _moments(returns: DataFrame) -> DataFrame:
    return returns.agg(F.count("ret").cast("double").alias("t"), F.countDistinct("strategy_id").cast("double").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"))


def _probability(sharpe: Column, benchmark: Column) -> Column:
    t = F.col("t")
    inside = (1 - F.col("skew") * sharpe + (F.col("kurt") + 3) / 4 * sharpe * sharpe) / (t - 1)
    return F.when(sharpe <= benchmark, 0.0).when(F.col("sd") == 0, 1.0).when(inside <= 0, 1.0).otherwise(norm_cdf((sharpe - benchmark) / F.sqrt(inside)))


def psr(returns: DataFrame, sharpe: float | None = None, benchmark: float = 0.0) -> DataFrame:
    """Probability that the Sharpe ratio exceeds the benchmark; without one given, that of all returns together."""
    observed = F.lit(sharpe) if sharpe is not None else F.col("mean") / F.col("sd")
    return _moments(returns).select(observed.alias("sharpe"), "skew", "kurt", _probability(observed, F.lit(benchmark)).alias("psr"))


def dsr(returns: DataFrame, sharpe: float | None = None, benchmark: float = 0.0) -> DataFrame:
    """The same with the benchmark raised by what the best of so many strategies reaches by luck."""
    observed = F.lit(sharpe) if sharpe is not None else F.col("mean") / F.col("sd")
    raised = benchmark + F.sqrt(2 * F.ln("n")) / F.sqrt(F.col("t") - 1)
    return _moments(returns).select(observed.alias("sharpe"), raised.alias("benchmark"), _probability(observed, raised).alias("dsr"))


def detect_all(returns: DataFrame, n_splits: int = 4, sharpe: float | None = None) -> DataFrame:
    """One row: pbo, psr, dsr, the verdict and how sure it is."""
    parts = (pbo(returns, n_splits).select("pbo", "logit_pbo"), psr(returns, sharpe).select("psr"), dsr(returns, sharpe).select("dsr"))  # a row each
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    whole = stacked.agg(*(F.max(c).alias(c) for c in ("pbo", "logit_pbo", "psr", "dsr")))
    return whole.withColumns({"is_overfitted": (F.col("pbo") > 0.5) | (F.col("dsr") < 0.05) | (F.col("psr") < 0.95), "confidence": (1 - F.col("pbo") + F.col("dsr") + F.col("psr")) / 3})


def sharpe_probabilities(returns: DataFrame, trials: int = 100, benchmark: float = 0.0, periods: int = 252) -> DataFrame:
    """Per strategy the annual Sharpe ratio, its PSR, and the DSR as a margin: the ratio, corrected for skewness and kurtosis, less the best of so many trials.

    The published variant, beside ``psr`` and ``dsr``: (kurtosis - 1) / 4 instead of kurtosis / 4. psr is a half where its
    spread is zero and null where it has none; a strategy whose returns don't vary has a ratio of 0.
    """
    m = returns.groupBy("strategy_id").agg(F.count("ret").cast("double").alias("t"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"))
    rated = m.withColumn("sharpe", F.coalesce(F.try_divide(F.col("mean"), F.col("sd")) * periods**0.5, F.lit(0.0)))
    inside = 1 - F.coalesce("skew", F.lit(0.0)) * F.col("sharpe") + (F.coalesce("kurt", F.lit(0.0)) + 2) / 4 * F.col("sharpe") * F.col("sharpe")
    inner = rated.withColumns({"inside": inside, "error": F.when(inside > 0, F.sqrt(F.try_divide(inside, F.col("t") - 1)))})
    expected = F.sqrt(2 * F.ln(F.lit(float(trials))) / F.col("t"))
    margin = F.col("sharpe") * F.greatest("inside", F.lit(0.01)) - expected
    chance = F.when(F.col("inside") == 0, 0.5).when(F.col("inside") > 0, norm_cdf((F.col("sharpe") - benchmark) / F.col("error")))
    return inner.select("strategy_id", "sharpe", chance.alias("psr"), expected.alias("expected_max"), margin.alias("dsr"), F.coalesce(margin / F.col("error") > 1.645, F.lit(False)).alias("significant"))


def pbo_by_sharpe(returns: DataFrame, blocks: int = 16) -> DataFrame:
    """PBO whose splits rate strategies by Sharpe ratio: share of splits whose best in sample comes after the middle out of sample, and the risk it stands for.

    Blocks become three sums each, a row a strategy, which is told once for each split; no split sees single returns. Without
    any split (no returns) pbo is null.
    """
    half = blocks // 2
    if comb(blocks, half) > 1_000_000:
        raise ValueError("too many splits")
    sums = {f"{name}{i}": F.sum(F.when(F.col("group_id") == i, x).otherwise(0.0)) for i in range(blocks) for name, x in (("_n", F.lit(1.0)), ("_s", F.col("ret")), ("_q", F.col("ret") * F.col("ret")))}
    wide = grouped(returns.where("ret IS NOT NULL"), blocks).groupBy("strategy_id").agg(*(x.alias(c) for c, x in sums.items()))
    told = wide.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit((1 << blocks) - 1)))).where(F.bit_count("split_id") == half)

    def total(name: str, side: int) -> Column:
        return sum((F.when(F.getbit("split_id", F.lit(i)) == side, F.col(f"{name}{i}")).otherwise(0.0) for i in range(blocks)), F.lit(0.0))

    sides = told.select("strategy_id", "split_id", *(total(c, side).alias(f"{c}_{side}") for side in (1, 0) for c in ("_n", "_s", "_q")))

    def ratio(side: int) -> Column:
        mean = F.try_divide(F.col(f"_s_{side}"), F.col(f"_n_{side}"))
        spread = F.sqrt(F.greatest(F.try_divide(F.col(f"_q_{side}"), F.col(f"_n_{side}")) - mean * mean, F.lit(0.0)))
        return F.round(F.when(spread > 1e-9, mean / spread * 252**0.5).otherwise(0.0), 8)

    rated = sides.select("strategy_id", "split_id", ratio(1).alias("is_sharpe"), ratio(0).alias("oos_sharpe"))
    at = Window.partitionBy("split_id")
    ranked = rated.withColumns({"oos_rank": average_rank(-F.col("oos_sharpe"), ["split_id"]), "best": F.row_number().over(at.orderBy(F.desc("is_sharpe"), "strategy_id")), "n": F.count("*").over(at)})
    one = ranked.where("best = 1").agg(F.count("*").alias("n_splits"), F.avg((F.col("oos_rank") > F.col("n") / 2).cast("double")).alias("pbo"))
    return one.withColumn("risk", F.when(F.col("pbo") < 0.3, "low").when(F.col("pbo") < 0.5, "moderate").when(F.col("pbo") < 0.7, "high").when(F.col("pbo").isNotNull(), "critical"))
