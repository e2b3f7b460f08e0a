"""Catalog queries over small tables of strategies, backtests and data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_strategies(strategies: DataFrame, status: str | None = None, text: str | None = None, skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of strategies, newest first. The page is the feature: ``limit`` is its size."""
    rows = strategies if status is None else strategies.where(F.col("status") == status)
    rows = rows if text is None else rows.where(F.lower("name").contains(text.lower()))
    return rows.orderBy(F.desc("created_at"), "id").offset(skip).limit(limit)


def owned_backtests(backtests: DataFrame, strategies: DataFrame, owner: str | int, status: str | None = None) -> DataFrame:
    """Backtests of an owner's strategies."""
    own = strategies.where(F.col("owner") == owner).select(F.col("id").alias("strategy_id"), F.col("name").alias("strategy_name"))
    rows = backtests.join(own, "strategy_id")
    return rows if status is None else rows.where(F.col("status") == status)


def running_counts(backtests: DataFrame, most: int = 10) -> DataFrame:
    """Per owner, running backtests and whether another one may start."""
    running = F.count(F.when(F.col("status").isin("pending", "running"), 1))
    return backtests.groupBy("owner").agg(running.alias("n_running")).withColumn("may_submit", F.col("n_running") < most)


def source_summary(sources: DataFrame) -> DataFrame:
    return sources.agg(F.sum("records_count").alias("records"), F.max("updated_at").alias("updated_at"), F.array_sort(F.collect_list(F.when(F.col("status") == "pending", F.col("symbol")))).alias("pending"))
