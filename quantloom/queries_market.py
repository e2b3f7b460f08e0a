"""Registered queries over market data: corporate actions, staged exits, rebalanced portfolios, several timeframes, the keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import actions, exits, parzen, portfolio, prep, search
from quantloom.plans.ir import Edge, Node, StrategyIR, cross_strategy
from quantloom.plans.signals import with_signal
from quantloom.queries import daily, hourly, query, rounded
from quantloom.sources import bars as bar_sources
from quantloom.sources import connector, store


def corporate_events(spark, d) -> DataFrame:
    """An event a supplier: splits, rights issues and dividends of the five symbols, on any day of the calendar."""
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    key = F.col("s_suppkey")
    kind = F.when(key % 4 == 0, "split").when(key % 4 == 1, "rights").otherwise("dividend")
    ratio = F.when(key % 4 == 0, 1 + (key % 3 + 1) / 10.0).when(key % 4 == 1, 0.1)
    amount = F.when(key % 4 == 1, 2.0).otherwise(F.abs(F.col("s_acctbal")).cast("double") / 10000)
    day = F.date_add(F.lit("1992-01-01").cast("date"), (key * 37 % 2400).cast("int")).cast("timestamp_ntz")
    return bar_sources.read(spark, d, "supplier").select(F.element_at(names, (F.col("s_nationkey") % 5 + 1).cast("int")).alias("symbol"), day.alias("ts"), kind.alias("action_type"), ratio.alias("ratio"), amount.alias("amount"))


@query
def corporate_actions(spark, d):
    """Daily bars adjusted for splits, rights issues and dividends."""
    found = actions.factors(daily(spark, d), corporate_events(spark, d))
    return rounded(prep.forward_adjust(found).select("symbol", "ts", F.ln("factor").alias("log_factor"), "open", "high", "low", "close"))


def crossings(spark, d) -> tuple[DataFrame, DataFrame]:
    """Daily bars, and those at which the fast average comes above the slow one."""
    b = daily(spark, d)
    w = Window.partitionBy("symbol").orderBy("ts")
    turned = with_signal(cross_strategy(20, 50), b).withColumn("_before", F.lag("signal").over(w))
    return b, turned.where("signal = 1 AND _before < 1").select("symbol", "ts")


@query
def staged_exits(spark, d):
    """Entries at crossings, sold in three parts: at two targets, and by a trailing stop that holds for all."""
    b, entries = crossings(spark, d)
    return rounded(exits.staged_exits(entries, b, ((0.3, 0.5), (0.9, 0.3), (None, 0.2)), stop=0.97, trail=0.985))


@query
def portfolio_rebalanced(spark, d):
    """The five closes as curves, weights unequal, dealt out anew each month at a cost."""
    c = daily(spark, d).select("symbol", "ts", F.col("close").alias("equity"))
    weights = c.select("symbol").distinct().withColumn("weight", F.substring("symbol", 1, 1).cast("double") / 15)
    return rounded(portfolio.rebalanced(c, "symbol", weights).select("ts", "segment", "log_equity", "turnover", "cost"), 4)


TWO_TIMEFRAMES = StrategyIR(
    "two timeframes",
    [Node("root", "root"), Node("if", "condition"), Node("and", "operator", "AND"), Node("up", "operator", "GT"), Node("fine", "operator", "GT"), Node("day", "indicator", "close", {"timeframe": 1440}), Node("days", "indicator", "SMA", {"period": 3, "timeframe": 1440}), Node("close", "indicator", "close"), Node("hours", "indicator", "SMA", {"period": 10}), Node("buy", "action", "BUY"), Node("sell", "action", "SELL")],
    [Edge("root", "if"), Edge("if", "and"), Edge("and", "up"), Edge("and", "fine"), Edge("up", "day"), Edge("up", "days"), Edge("fine", "close"), Edge("fine", "hours"), Edge("if", "buy", "then"), Edge("if", "sell", "else")],
)


@query
def ir_signal_two_timeframes(spark, d):
    """Hourly bars that also look at the last day that has closed."""
    return with_signal(TWO_TIMEFRAMES, hourly(spark, d)).select("symbol", "ts", "signal")


def keyed_store(spark, d) -> store.BarStore:
    """A store with daily bars inserted in three overlapping parts, and some of them corrected."""
    b, own = daily(spark, d), store.BarStore(spark, store.scratch(spark))
    own.insert(b.where("ts < TIMESTAMP_NTZ'1996-06-15'"), "D1")
    own.insert(b.where("ts >= TIMESTAMP_NTZ'1995-01-10'"), "D1")
    own.insert(b.where("ts >= TIMESTAMP_NTZ'1995-01-10'"), "D1")
    own.insert(b.where(F.dayofmonth("ts") == 10).withColumns({"close": F.col("close") + 1, "high": F.col("high") + 1}), "D1")
    return own


@query
def store_upsert(spark, d):
    """What a store holds after bars were inserted twice, corrected and deleted."""
    own = keyed_store(spark, d)
    own.delete("2-HIGH", "D1", "1994-03-10", "1995-09-20")
    return rounded(own.rows().drop("tier"))


@query
def store_tiers(spark, d):
    """Bars by tier and timeframe, after months have moved to colder tiers twice, and a late correction has brought some back."""
    own = keyed_store(spark, d)
    own.insert(hourly(spark, d), "H1")
    own.retier("1997-03-01")
    own.retier("1999-01-01")
    own.insert(daily(spark, d).where("ts BETWEEN TIMESTAMP_NTZ'1992-05-01' AND TIMESTAMP_NTZ'1992-06-30'"), "D1")
    own.retier("1999-02-01")
    kept = own.rows()
    return rounded(kept.groupBy("timeframe", "tier").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("close").alias("closes")), 3)


TRIAL_SPACE = {"size": ("int", 1, 50), "price": ("float", 900.0, 2100.0), "kind": ("categorical", tuple("ABCDE"))}


def trials(spark, d) -> DataFrame:
    """A history of trials that SQL can make too: a part each, every tenth still pending."""
    kind = F.col("p_partkey") % 5
    value = -F.abs(F.col("p_size") - 20) - F.abs(F.col("p_retailprice").cast("double") - 1500) / 50 - 3 * kind
    return bar_sources.read(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"), kind.cast("double").alias("kind"), F.when(F.col("p_partkey") % 10 > 0, value.cast("double")).alias("value"))


@query
def tpe_proposals(spark, d):
    """The next eight trials, by the densities of good trials and of the others."""
    return rounded(parzen.propose(trials(spark, d), TRIAL_SPACE, 8))


@query
def spp_latin(spark, d):
    """Moving-average strategies over a Latin hypercube of their periods, executed and summed up."""
    figures = search.permuted(hourly(spark, d), {"fast": ("int", 3, 15), "slow": ("int", 20, 50)}, 40)
    return rounded(portfolio.permutation_summary(figures, ["symbol"]), 3)


@query
def feed_scan(spark, d):
    """Daily bars, kept by symbol, delivered by the data source; symbols and times of the query reach the feed."""
    folder = store.scratch(spark)
    daily(spark, d).repartition("symbol").sortWithinPartitions("symbol", "ts").write.partitionBy("symbol").parquet(folder)
    connector.register(spark)
    names = "1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED,5-LOW"
    feed = spark.read.format("bar_feed").options(fetch="quantloom.sources.connector:stored_bars", path=folder, symbols=names, start="1992-01-01", end="2003-12-31", errors="fail").load()
    asked = feed.where("symbol IN ('2-HIGH', '4-NOT SPECIFIED') AND ts >= TIMESTAMP'1994-02-10 00:00:00' AND ts < TIMESTAMP'1996-07-05 00:00:00'")
    return rounded(asked.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
