"""Reference tables of a market, and where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.prep import limit_of

# The columns of a security master.
STOCK_COLUMNS = ("symbol", "name", "area", "industry", "market", "list_date", "list_status")


def stock_list(master: DataFrame) -> DataFrame:
    """The security master's known columns; those it lacks are null."""
    return master.select(*(F.col(c) if c in master.columns else F.lit(None).cast("string").alias(c) for c in STOCK_COLUMNS))


def trade_calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Every day with is_open, and the open day before it."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)")).alias("day"))
    work = F.dayofweek("day").between(2, 6)
    if holidays is not None:
        days = days.join(holidays.select("day", F.lit(True).alias("_off")).distinct(), "day", "left")
        work = work & F.col("_off").isNull()
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    flagged = days.withColumn("is_open", work)
    return flagged.select("day", "is_open", F.last(F.when(F.col("is_open"), F.col("day")), True).over(w).alias("open_before"))


def limit_prices(bars: DataFrame, market=None) -> DataFrame:
    """The highest and lowest price allowed at each bar, from the close before."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    limit = limit_of(market if market is not None else F.lit("main"))
    return bars.select("symbol", "ts", (before * (1 + limit)).alias("up_limit"), (before * (1 - limit)).alias("down_limit"))


def suspended_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Open days between a symbol's first and last bar on which it has none."""
    ends = bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    days = ends.select("symbol", F.explode(F.sequence("first", "last")).alias("day"))
    opened = days.join(calendar.where("is_open").select("day"), "day", "left_semi")
    return opened.join(bars.select("symbol", F.to_date("ts").alias("day")).distinct(), ["symbol", "day"], "left_anti")


def write_results(steps: DataFrame, figures: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Equity curves, trades and figures of executed runs as Parquet."""
    from quantloom.operators.backtest import equity_curve, trades_of

    equity_curve(steps).write.mode(mode).parquet(f"{folder}/equity")
    trades_of(steps).write.mode(mode).parquet(f"{folder}/trades")
    figures.write.mode(mode).parquet(f"{folder}/metrics")
