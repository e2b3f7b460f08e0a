"""Performance of equity curves and trades, for any number of runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISK_FREE, PERIODS = 0.02, 252


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def drawdowns(equity: DataFrame, keys: list[str], order: str = "bar_seq") -> DataFrame:
    """The curve with returns, peak, drawdown, and how long each drawdown lasts so far.

    A drawdown that is still open at the end counts one bar less there.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seq = F.row_number().over(w) - 1
    staged = equity.withColumns({"_seq": seq, "ret": F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1, "peak": F.max("equity").over(run)})
    staged = staged.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))
    under = F.col("drawdown") < -1e-12
    begins = under & ~F.coalesce(F.lag(under).over(w), F.lit(False))
    staged = staged.withColumns({"_start": F.when(begins, F.col("_seq")), "_final": F.lead(F.lit(1)).over(w).isNull()})
    lasted = F.col("_seq") - F.last("_start", True).over(run) + F.when(F.col("_final"), 0).otherwise(1)
    return staged.withColumn("under_bars", F.when(under, lasted).otherwise(0)).drop("_start", "_final", "_seq")


def with_rates(one: DataFrame) -> DataFrame:
    """Total and annual return, volatility and downside of curves summed up as n, first, last, sd and down."""
    annual = F.when(1 + F.col("total") > 0, F.pow(1 + F.col("total"), PERIODS / F.col("n")) - 1).otherwise(F.col("total") * PERIODS / F.col("n"))
    yearly = F.sqrt(F.lit(float(PERIODS)))
    out = one.withColumn("total", F.col("last") / F.col("first") - 1)
    return out.withColumns({"annual": annual, "volatility": _or_zero(F.col("sd") * yearly), "downside": _or_zero(F.col("down") * yearly)})


def equity_metrics(equity: DataFrame, keys: list[str], order: str = "bar_seq", more: dict[str, Column] | None = None) -> DataFrame:
    """One row per run: return, risk and drawdown figures; zeros where there are fewer than two bars.

    ``more`` aggregates further columns of the curve on the way.
    """
    d = drawdowns(equity, keys, order)
    negative = F.when(F.col("ret") < 0, F.col("ret"))
    one = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min_by("equity", order).alias("first"), F.max_by("equity", order).alias("last"),
        F.stddev_samp("ret").alias("sd"), F.stddev_samp(negative).alias("down"), F.min("drawdown").alias("mdd"), F.max("under_bars").alias("max_drawdown_duration"), *(x.alias(c) for c, x in (more or {}).items()),
    )
    out = with_rates(one)
    few = F.col("n") < 2
    figures = {
        "net_profit": F.col("last") - F.col("first"),
        "total_return_pct": F.col("total") * 100,
        "annual_return_pct": F.col("annual") * 100,
        "cagr": F.col("annual"),
        "volatility": F.col("volatility"),
        "sharpe_ratio": F.when(F.col("volatility") > 0, (F.col("annual") - RISK_FREE) / F.col("volatility")),
        "sortino_ratio": F.when(F.col("downside") > 0, (F.col("annual") - RISK_FREE) / F.col("downside")),
        "max_drawdown_pct": F.col("mdd") * 100,
        "max_drawdown_duration": F.col("max_drawdown_duration").cast("double"),
        "calmar_ratio": F.when(F.col("mdd") != 0, F.col("annual") / F.abs("mdd")),
        "return_on_drawdown": F.when(F.col("mdd") != 0, (F.col("last") - F.col("first")) / (F.abs("mdd") * F.col("first"))),
    }
    return out.select(*keys, *(F.when(few, 0.0).otherwise(_or_zero(x)).alias(c) for c, x in figures.items()), *(more or {}))


def fifo_round_trips(trades: DataFrame, keys: list[str], span: str | None = None) -> DataFrame:
    """Sells matched with earlier buys, first in first out: one row per lot and sell that overlap.

    Buys and sells of a symbol each cover a range of running share counts, gapless from 0; they match
    where their ranges overlap. What a sell asks for beyond the lots then open is dropped for good: the
    most by which sells were ever ahead of buys is taken off the sold count, so a later buy never meets
    an earlier sell. What is left unsold matches nothing.

    Counts run side by side over spans of a series, to which those of the spans before are added; only
    one row a span goes through a series' task. ``span`` names a column that never falls (nulls first) as
    trade_seq rises; without one, 65,536 numbers are a span. Ranges are then dealt to buckets of the
    running count and swept there by where they begin: each meets the range of the other side that is
    under way. A pair belongs to the bucket in which the later of both begins, so it is found once.
    """
    series, size = [*keys, "symbol"], 1_000_000
    buy, money = F.col("signal") > 0, F.col("shares") * F.col("price")
    net = F.when(buy, money + F.col("commission") + F.col("slippage")).otherwise(money - F.col("commission") - F.col("slippage"))
    lots = trades.where("shares > 0 AND signal != 0").dropna(subset=series)
    lots = lots.select(*series, (F.col(span) if span else F.floor(F.col("trade_seq") / 65_536)).alias("_span"), "trade_seq", "ts", "shares", buy.alias("_buy"), net.alias("money"))

    w = Window.partitionBy(*series, "_span").orderBy("trade_seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    bought, sold = (F.sum(F.when(side, F.col("shares")).otherwise(0)).over(run) for side in (F.col("_buy"), ~F.col("_buy")))
    counted = lots.withColumns({"_bought": bought, "_sold": sold}).withColumn("_ahead", F.max(F.col("_sold") - F.col("_bought")).over(run))
    counted = counted.withColumn("_ahead_before", F.lag("_ahead").over(w))

    earlier = Window.partitionBy(*series).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    spans = counted.groupBy(*series, "_span").agg(F.min("trade_seq").alias("_at"), F.max("_bought").alias("_b"), F.max("_sold").alias("_s"), F.max("_ahead").alias("_a"))
    spans = spans.withColumns({f"{c}0": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("_b", "_s")})
    spans = spans.withColumn("_d0", F.greatest(F.lit(0), F.max(F.col("_s0") - F.col("_b0") + F.col("_a")).over(earlier))).select(*series, "_span", "_b0", "_s0", "_d0")
    # a span that is null comes first, so nothing is before it
    b0, s0, d0 = (F.coalesce(F.col(c), F.lit(0)) for c in ("_b0", "_s0", "_d0"))
    before, dropped = (F.greatest(d0, s0 - b0 + F.col(c)) for c in ("_ahead_before", "_ahead"))  # greatest passes over a null
    lo = F.when(F.col("_buy"), b0 + F.col("_bought")).otherwise(s0 + F.col("_sold") - before) - F.col("shares")
    hi = F.when(F.col("_buy"), b0 + F.col("_bought")).otherwise(s0 + F.col("_sold") - dropped)
    ranged = counted.join(spans, [*series, "_span"], "left").select(*series, "trade_seq", "ts", "shares", "_buy", "money", lo.alias("lo"), hi.alias("hi")).where("hi > lo")

    spread = ranged.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / size), F.ceil(F.col("hi") / size) - 1)))
    sweep = Window.partitionBy(*series, "bucket").orderBy("lo", "_buy").rowsBetween(Window.unboundedPreceding, 0)
    lot = F.struct("trade_seq", "ts", "shares", "money", "hi")
    met = spread.withColumns({side: F.last(F.when(own, lot), True).over(sweep) for side, own in (("_buyer", F.col("_buy")), ("_seller", ~F.col("_buy")))})
    both = met.where(F.floor(F.col("lo") / size) == F.col("bucket")).withColumn("_met", F.least("_buyer.hi", "_seller.hi") - F.col("lo")).where("_buyer IS NOT NULL AND _seller IS NOT NULL AND _met > 0")
    cost = F.col("_buyer.money") * F.col("_met") / F.col("_buyer.shares")
    proceeds = F.col("_seller.money") * F.col("_met") / F.col("_seller.shares")
    named = [F.col(f"{who}.{c}").alias(f"{side}_{c}") for c in ("trade_seq", "ts") for side, who in (("buy", "_buyer"), ("sell", "_seller"))]
    return both.select(*series, *named, F.col("_met").alias("shares"), cost.alias("cost"), proceeds.alias("proceeds"), (proceeds - cost).alias("pnl"))


def trade_metrics(trades: DataFrame, keys: list[str], span: str | None = None) -> DataFrame:
    """One row per run with fills: rates and means of the round trips, and the number of fills."""
    trips = fifo_round_trips(trades, keys, span)
    win, loss = F.col("pnl") > 0, F.col("pnl") <= 0
    one = trips.groupBy(*keys).agg(
        F.avg(F.when(win, 1.0).otherwise(0.0)).alias("wr"), F.sum(F.when(win, F.col("pnl")).otherwise(0.0)).alias("won"), F.sum(F.when(loss, -F.col("pnl")).otherwise(0.0)).alias("lost"),
        F.avg(F.when(win, F.col("pnl"))).alias("aw"), F.avg(F.when(loss, -F.col("pnl"))).alias("al"),
    )
    fills = trades.groupBy(*keys).agg(F.count("*").cast("double").alias("total_trades"))
    rate, won, lost = _or_zero(F.col("wr")), _or_zero(F.col("aw")), _or_zero(F.col("al"))
    factor = F.when(F.col("lost") > 0, F.col("won") / F.col("lost"))
    return fills.join(one, keys, "left").select(*keys, rate.alias("win_rate"), _or_zero(factor).alias("profit_factor"), won.alias("avg_win"), lost.alias("avg_loss"), (rate * won - (1 - rate) * lost).alias("expectancy"), "total_trades")


def performance(steps: DataFrame, keys: list[str]) -> DataFrame:
    """All figures of executed runs (rows of ``execute``, whose sells carry their round trips), in one pass."""
    won, lost, n_won, n_lost = (F.coalesce(F.sum(c), F.lit(0)) for c in ("won", "lost", "n_won", "n_lost"))
    sums = {"_won": won, "_lost": lost, "_nw": n_won, "_nl": n_lost, "_fills": F.count("side")}
    one = equity_metrics(steps, keys, more={k: v for k, v in sums.items()})
    rate = _or_zero(F.try_divide(F.col("_nw"), F.col("_nw") + F.col("_nl")))
    mean_won, mean_lost = _or_zero(F.try_divide(F.col("_won"), F.col("_nw"))), _or_zero(F.try_divide(F.col("_lost"), F.col("_nl")))
    figures = {"win_rate": rate, "profit_factor": F.when(F.col("_lost") > 0, F.col("_won") / F.col("_lost")).otherwise(0.0), "avg_win": mean_won, "avg_loss": mean_lost, "expectancy": rate * mean_won - (1 - rate) * mean_lost, "total_trades": F.col("_fills").cast("double")}
    return one.withColumns(figures).drop(*sums)


def excursions(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each time in the market: its bars, and how far equity rose above and fell below where it began."""
    w = Window.partitionBy(*keys).orderBy("bar_seq")
    held = F.col("market_value") > 0
    begins = held & ~F.coalesce(F.lag(held).over(w), F.lit(False))
    numbered = steps.withColumn("stay", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where(held)
    first = F.min_by("equity", "bar_seq")
    return numbered.groupBy(*keys, "stay").agg(F.min("ts").alias("entry_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"), (F.max("equity") / first - 1).alias("mfe"), (F.min("equity") / first - 1).alias("mae"))


def pnl_histogram(trips: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Round trips by pnl in equal bins between least and largest; the last bin holds its right edge."""
    ends = trips.groupBy(*keys).agg(F.min("pnl").alias("lo"), F.max("pnl").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    number = F.coalesce(F.least(F.floor(F.try_divide(F.col("pnl") - F.col("lo"), step)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return trips.join(ends, keys).withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))
