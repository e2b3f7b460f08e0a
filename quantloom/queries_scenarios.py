"""Registered queries whose scenarios, grids and strategies come from the given tables: walks, ramps, grids of series, code, published PBO and DSR."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quantloom.operators import codegen, generate, genetic, overfitting, search
from quantloom.plans.ir import threshold_strategy
from quantloom.queries import daily, hourly, query, rounded, strategy_returns
from quantloom.sources import bars as bar_sources


@query
def ramps_over(spark, d):
    """Ramps in place of the daily bars."""
    return rounded(bar_sources.ramps_over(daily(spark, d)))


@query
def random_walks_after(spark, d):
    """Sixty business days after the last hourly bar of each symbol."""
    return rounded(bar_sources.random_walks_after(hourly(spark, d), 60), 4)


SPACE = {"level": ("float", "lowest", "highest"), "period": ("int", 2, "longest"), "stop": ("float", 0.01, 0.05), "side": ("categorical", [1, 2])}


def grid_ranges(spark, d):
    return daily(spark, d).groupBy("symbol").agg(F.min("close").alias("lowest"), F.max("close").alias("highest"), F.floor(F.sqrt(F.count("*"))).cast("int").alias("longest"))


@query
def grid_over(spark, d):
    """A grid for each symbol, from its own range of prices and number of bars."""
    return rounded(search.grid_over(grid_ranges(spark, d), ["symbol"], SPACE))


@query
def grid_over_sample(spark, d):
    """A hundred of each symbol's combinations."""
    return rounded(search.grid_over(grid_ranges(spark, d), ["symbol"], SPACE, 100))


@query
def codegen_strategies(spark, d):
    """The sources of a threshold strategy a part; every fiftieth lacks its levels' node and is told so."""
    text = json.dumps(threshold_strategy("@name", "@low", "@high", period="@period").to_dict())
    key = F.col("p_partkey")
    values = {"@name": F.when(key % 2 == 0, '"RSI"').otherwise('"IND_RSI"'), "@period": F.col("p_size").cast("string"), "@low": (key % 15 + 20).cast("double").cast("string"), "@high": F.when(key % 50 > 0, (key % 20 + 65).cast("double").cast("string")).otherwise('"none"')}
    ir = F.lit(text)
    for name, value in values.items():
        ir = F.replace(ir, F.lit(f'"{name}"'), value)
    parts = bar_sources.read(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # before the texts are made
    parts = parts.select("p_partkey", F.when(key % 50 > 0, ir).otherwise(F.replace(ir, F.lit('"target": "low"'), F.lit('"target": "lost"'))).alias("ir"))
    return codegen.sources(parts, targets=("pandas", "dsl")).select("p_partkey", "target", "source", F.col("error").isNull().alias("valid"))


@query
def sharpe_probabilities(spark, d):
    return rounded(overfitting.sharpe_probabilities(strategy_returns(spark, d)), 4)


@query
def pbo_by_sharpe(spark, d):
    return rounded(overfitting.pbo_by_sharpe(strategy_returns(spark, d)))


@query
def gp_population_figures(spark, d):
    """The figures of a population: equal subtrees and equal trees once."""
    trees = genetic.random_population(40, 11, 3, ("SMA", "STDDEV", "MOM", "ROC", "ATR", "WILLR"))
    figures = generate.evaluate_all([genetic.to_ir(t) for t in trees], hourly(spark, d))
    return rounded(figures.select("run_id", "symbol", "net_profit", "total_return_pct", "sharpe_ratio", "max_drawdown_pct"), 4)
