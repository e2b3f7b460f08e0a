"""Bars made from event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.math import hash_normal, hash_uniform


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def to_bars(rows: DataFrame, symbol: Column, ts: Column, price: Column, order: Column, member: Column) -> DataFrame:
    """One bar per symbol and time: the first and last price by ``order``; volume counts rows, turnover counts members."""
    typed = rows.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("p"), order.alias("o"), member.alias("m"))
    return typed.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("p").alias("amount"),
        F.countDistinct("m").cast("double").alias("turnover_rate"),
    )


def bars_hourly(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    return to_bars(e, F.col("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value") + 100.0, F.col("ts"), F.col("user_id"))


def bars_minutely(spark: SparkSession, folder: str, minutes: int = 1) -> DataFrame:
    """Bars of 1, 5, 15, 30 or 60 minutes; coarser ones are made from those of one minute."""
    e = read(spark, folder, "events")
    one = to_bars(e, F.col("event_type"), F.date_trunc("minute", "ts").cast("timestamp_ntz"), F.col("value") + 100.0, F.col("ts"), F.col("user_id")).drop("turnover_rate")
    return one if minutes == 1 else resample(one, minutes)


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of a coarser timeframe: first open, last close, highest, lowest, and sums of what was traded. One shuffle, pre-aggregated."""
    if minutes < 1 or 1440 % minutes:
        raise ValueError(f"{minutes} minutes don't divide a day")
    start = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")["start"].cast("timestamp_ntz")
    return bars.groupBy("symbol", start.alias("begin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *(F.sum(c).alias(c) for c in ("volume", "amount") if c in bars.columns)
    ).withColumnRenamed("begin", "ts")


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    return to_bars(o, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"), F.col("o_totalprice") / 1000.0, F.col("o_orderkey"), F.col("o_custkey"))


def factors_daily(bars: DataFrame) -> DataFrame:
    """A table of adjustment factors for the bars, sparse on purpose: only days up to the 20th have one."""
    return bars.where(F.dayofmonth("ts") <= 20).select("symbol", "ts", (1.0 + 0.1 * (F.dayofmonth("ts") > 15).cast("int")).alias("factor"))


def with_rules(bars: DataFrame) -> DataFrame:
    """Bars with boards, suspensions and adjustment factors derived from symbol and day."""
    return bars.select(
        "*",
        F.expr("CASE WHEN symbol IN ('1-URGENT', 'click') THEN 'STAR' WHEN symbol IN ('2-HIGH', 'error') THEN 'BSE' ELSE 'MAIN' END").alias("board"),
        (F.dayofmonth("ts") == 13).alias("is_suspended"),
        (1.0 + 0.1 * (F.dayofmonth("ts") > 15).cast("int")).alias("adjustment_factor"),
    )


def synthetic_bars(spark: SparkSession, symbols: int, start: str, days: int) -> DataFrame:
    """A ramp over business days, repeatable on any engine."""
    day = F.explode(F.expr(f"sequence(DATE'{start}', date_add(DATE'{start}', {days - 1}), INTERVAL 1 DAY)"))
    rows = spark.range(symbols).select(F.format_string("S%03d", "id").alias("symbol"), "id", day.alias("d")).where(F.dayofweek("d").between(2, 6))
    n = F.datediff("d", F.lit(start).cast("date"))
    base = 10.0 + F.col("id") + n * 0.05
    return rows.select("symbol", F.col("d").cast("timestamp_ntz").alias("ts"), base.alias("open"), (base + 0.5).alias("high"), (base - 0.5).alias("low"), (base + 0.1).alias("close"), (1000.0 + n * 10).alias("volume"))


def random_walk_bars(spark: SparkSession, symbols: int, days: int, start: str = "2020-01-01", drift: float = 0.0, volatility: float = 0.02, seed: int = 42) -> DataFrame:
    """Bars on a geometric random walk over business days; the same on any engine, as every number hangs on (seed, symbol, day) alone."""
    last = f"date_add(DATE'{start}', {days * 7 // 5 + 7})"
    day = F.explode(F.expr(f"sequence(DATE'{start}', {last}, INTERVAL 1 DAY)"))
    rows = spark.range(symbols).select(F.format_string("S%03d", "id").alias("symbol"), day.alias("d")).where(F.dayofweek("d").between(2, 6))
    w = Window.partitionBy("symbol").orderBy("d")
    numbered = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= days)
    step = F.when(F.col("n") == 1, 0.0).otherwise(drift + volatility * hash_normal(seed, F.lit("step"), F.col("symbol"), F.col("n")))
    return _walk(numbered, F.lit(100.0), step, seed)


def _walk(numbered: DataFrame, base: Column, step: Column, seed: int) -> DataFrame:
    """Bars around closes that grow from ``base`` by exp(step) from day ``d`` (number ``n``) to day."""
    w = Window.partitionBy("symbol").orderBy("d")
    walked = numbered.withColumn("close", base * F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    u = lambda what: hash_uniform(seed, F.lit(what), F.col("symbol"), F.col("n"))
    opened = walked.withColumn("open", F.col("close") * (1 + 0.01 * (u("open") - 0.5)))
    ranged = opened.withColumns({"high": F.greatest("open", "close") * (1 + 0.01 * u("high")), "low": F.least("open", "close") * (1 - 0.01 * u("low")), "volume": 1e6 + F.floor(u("volume") * 49e6)})
    change = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    return ranged.select("symbol", F.col("d").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), F.coalesce(change >= 0.095, F.lit(False)).alias("limit_up"), F.coalesce(change <= -0.095, F.lit(False)).alias("limit_down"), (u("suspended") < 0.01).alias("is_suspended"), F.lit(1.0).alias("adjustment_factor"))


def ramps_over(bars: DataFrame, slope: float = 0.05) -> DataFrame:
    """A ramp in place of each symbol's bars: over the business days from its first bar to its last, from its first close on."""
    ends = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"), F.min_by("close", "ts").alias("base"))
    days = ends.select("symbol", "first", "base", F.explode(F.sequence("first", "last")).alias("d")).where(F.dayofweek("d").between(2, 6))
    n = F.datediff("d", "first")
    base = F.col("base") + n * slope
    return days.select("symbol", F.col("d").cast("timestamp_ntz").alias("ts"), base.alias("open"), (base + 0.5).alias("high"), (base - 0.5).alias("low"), (base + 0.1).alias("close"), (1000.0 + n * 10).alias("volume"))


def random_walks_after(bars: DataFrame, days: int, seed: int = 42) -> DataFrame:
    """Bars that go on after the last one of each symbol: a random walk over ``days`` business days with the mean and spread of its own log returns.

    A symbol with fewer than three bars stays where it is.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    changes = bars.select("symbol", "ts", "close", F.ln(F.try_divide("close", F.lag("close").over(w))).alias("change"))
    known = changes.groupBy("symbol").agg(F.to_date(F.max("ts")).alias("last"), F.max_by("close", "ts").alias("base"), F.coalesce(F.avg("change"), F.lit(0.0)).alias("drift"), F.stddev_samp("change").alias("spread"))
    day = F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days * 7 // 5 + 7)))
    rows = known.select("symbol", "base", F.when(F.col("spread").isNull(), 0.0).otherwise(F.col("drift")).alias("drift"), F.coalesce("spread", F.lit(0.0)).alias("spread"), day.alias("d")).where(F.dayofweek("d").between(2, 6))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("d"))).where(F.col("n") <= days)
    return _walk(numbered, F.col("base"), F.col("drift") + F.col("spread") * hash_normal(seed, F.lit("step"), F.col("symbol"), F.col("n")), seed)


def slice_bars(bars: DataFrame, first: int, last: int) -> DataFrame:
    """The bars of each symbol from position ``first`` up to, not including, ``last``; counted from 0."""
    at = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    return bars.withColumn("_at", at).where((F.col("_at") >= first) & (F.col("_at") < last)).drop("_at")
