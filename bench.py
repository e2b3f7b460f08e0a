"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantloom import queries as q
from quantloom.operators import backtest, indicators, monte_carlo, search
from quantloom.plans.ir import cross_strategy
from quantloom.plans.signals import with_signal
from quantloom.sources.bars import bars_daily

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PAIRS = [(fast, slow) for fast in range(3, 23, 2) for slow in range(30, 80, 5)]  # 100 strategies


def single_backtest(spark, d):
    """One strategy over daily bars of all symbols, from raw rows to figures."""
    signalled = with_signal(cross_strategy(20, 50), bars_daily(spark, d))
    return backtest.evaluate(signalled.withColumn("signals", F.array("signal")))


def batch_100_strategies(spark, d):
    return search.grid_search(bars_daily(spark, d), PAIRS)


def monte_carlo_10000x1000(spark, d):
    """10,000 shuffles of 1,000 trades of one run, rebuilt and summarised."""
    trades = spark.range(1, 1001).selectExpr("'r' AS run_id", "cast(id AS int) AS trade_seq", "cast(id * 7919 % 2001 - 950 AS double) AS pnl")
    return monte_carlo.run_trade_methods(trades.repartition(1), ("shuffle_trades",), 10_000)


def rolling_indicators(spark, d):
    b = bars_daily(spark, d)
    for f in (indicators.sma, indicators.wma, indicators.rsi, indicators.bbands, indicators.atr, indicators.adx, indicators.stoch, indicators.mfi, indicators.obv, indicators.vwap):
        b = f(b)
    return b


BENCH = {f.__name__: f for f in (single_backtest, batch_100_strategies, monte_carlo_10000x1000, rolling_indicators)} | {
    name: q.QUERIES[name] for name in ("backtest_metrics", "ind_macd", "chip_concentration", "mc_summary", "walk_forward", "pbo", "fifo_round_trips", "corr_matrix", "fuzzy_signal")
}


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (root, os.environ.get("PYTHONPATH"))))  # for Python workers
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, f in BENCH.items():
        best = float("inf")
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            f(spark, FOLDER).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": FOLDER}))


if __name__ == "__main__":
    main()
