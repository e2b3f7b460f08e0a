"""Registered queries of the strategy engine, each over whole tables; their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import math as fm
from quantloom.functions import text
from quantloom.operators import align, ashare, backtest, catalog, codegen, formula, fuzzy, generate, genetic, indicators, metrics, monte_carlo, overfitting, parzen, portfolio, prep, report, rules, search
from quantloom.oracles import ORACLES
from quantloom.plans.ir import Edge, Node, StrategyIR, cross_strategy, threshold_strategy
from quantloom.plans.signals import bind, with_signal
from quantloom.sources import bars as bar_sources
from quantloom.sources import connector, reference, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PAIRS = [(5, 20), (5, 40), (10, 20), (10, 40), (20, 40)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded half up; first to three digits more, as prices and their means are decimals and the last bits of a sum must not decide a tie."""
    return F.round(F.round(x, digits + 3), digits) + 0.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zeros."""
    return df.select(*(tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return bar_sources.bars_daily(spark, d)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return bar_sources.bars_hourly(spark, d)


# -- sources and scans


@query
def bars_hourly(spark, d):
    return rounded(hourly(spark, d))


@query
def bars_daily(spark, d):
    return rounded(daily(spark, d))


def minutely(minutes: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(bar_sources.bars_minutely(spark, d, minutes))

    QUERIES[f"bars_{minutes}min"] = run


for _minutes in (1, 5, 15, 30, 60):
    minutely(_minutes)


@query
def range_scan(spark, d):
    return rounded(store.range_scan(daily(spark, d), ["1-URGENT", "5-LOW"], "1996-01-01", "1996-12-31"))


def stored(spark, d) -> store.BarStore:
    """A store with daily and hourly bars, inserted under other column names."""
    own = store.BarStore(spark, store.scratch(spark))
    own.insert(daily(spark, d).withColumnRenamed("ts", "time"), "D1")
    own.insert(hourly(spark, d), "H1")
    return own


@query
def store_query(spark, d):
    """Bars of two symbols and some months, read back from a store."""
    return rounded(stored(spark, d).query(["1-URGENT", "5-LOW"], "D1", "1996-01-15", "1996-12-31"))


@query
def store_coverage(spark, d):
    return stored(spark, d).coverage()


@query
def store_delete(spark, d):
    """What a store holds after two ranges of a symbol and another symbol are deleted."""
    own = stored(spark, d)
    own.delete("3-MEDIUM", "D1", "1995-03-10", "1995-09-20")
    own.delete("3-MEDIUM", "D1", "1996-02-01")
    own.delete("click", "H1")
    return rounded(own.query(["1-URGENT", "3-MEDIUM"], "D1", "1992-01-01", "2003-12-31"))


@query
def result_sink(spark, d):
    """Trades of executed runs, written and read back."""
    steps, folder = executed(spark, d), store.scratch(spark)
    reference.write_results(steps, metrics.performance(steps, ["symbol"]), folder)
    return rounded(spark.read.parquet(f"{folder}/trades").drop("bar_seq"), 4)


@query
def iso_times(spark, d):
    return hourly(spark, d).groupBy("symbol").agg(text.iso(F.min("ts")).alias("first"), text.iso(F.max("ts")).alias("last"))


@query
def coverage(spark, d):
    return store.coverage(hourly(spark, d))


@query
def last_bars(spark, d):
    latest = daily(spark, d).withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    return rounded(latest.where("_r <= 10").drop("_r"))


@query
def delete_range(spark, d):
    gone = (F.col("symbol") == "3-MEDIUM") & (F.year("ts") == 1995)
    return rounded(daily(spark, d).where(~gone))


@query
def synthetic_bars(spark, d):
    return rounded(bar_sources.synthetic_bars(spark, 3, "2020-01-01", 60))


@query
def random_walk_bars(spark, d):
    return rounded(bar_sources.random_walk_bars(spark, 4, 100), 4)


@query
def bar_slice(spark, d):
    return rounded(bar_sources.slice_bars(daily(spark, d), 50, 150))


@query
def bar_feed(spark, d):
    """The same bars delivered symbol by symbol through the data source."""
    connector.register(spark)
    read = spark.read.format("bar_feed").options(fetch="quantloom.sources.connector:ramp", symbols="S000,S001,S002,broken", start="2020-01-01", end="2020-02-29").load()
    return rounded(read.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query
def stock_list(spark, d):
    s = bar_sources.read(spark, d, "supplier").join(bar_sources.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return reference.stock_list(s.select(F.col("s_name").alias("symbol"), F.col("n_name").alias("area"), F.lit("L").alias("list_status")))


@query
def trade_calendar(spark, d):
    holidays = bar_sources.read(spark, d, "orders").where("dayofmonth(o_orderdate) = 1").select(F.to_date("o_orderdate").alias("day"))
    return reference.trade_calendar(spark, "1996-01-01", "1997-12-31", holidays)


@query
def suspended_days(spark, d):
    calendar = reference.trade_calendar(spark, "1992-01-01", "2003-12-31")
    return reference.suspended_days(daily(spark, d), calendar)


@query
def limit_prices(spark, d):
    return rounded(reference.limit_prices(daily(spark, d)))


@query
def code_list(spark, d):
    s = bar_sources.read(spark, d, "supplier")
    key = F.col("s_suppkey")
    listed = F.concat(F.lpad(key.cast("string"), 6, "0"), F.lit(", "), key.cast("string"), F.lit("  "), F.lpad((key * 7919).cast("string"), 6, "9"), F.lit(","), F.lpad(key.cast("string"), 6, "0"))
    return s.select("s_suppkey", F.array_join(text.valid_codes(listed), " ").alias("codes"))


# -- preparation


@query
def bar_quality(spark, d):
    return align.quality(daily(spark, d))


@query
def asof_join(spark, d):
    """Hourly bars with the latest purchase bar before them."""
    b = hourly(spark, d)
    board = b.where("symbol = 'purchase'").select("ts", F.col("close").alias("board_close"))
    return rounded(align.asof_join(b.where("symbol <> 'purchase'").select("symbol", "ts", "close"), board, [], ["board_close"], span="day"))


def factored(spark, d):
    b = daily(spark, d)
    return prep.join_factors(b, bar_sources.factors_daily(b))


@query
def factor_left_join(spark, d):
    return rounded(factored(spark, d).select("symbol", "ts", "close", "factor"))


@query
def forward_adjust(spark, d):
    return rounded(prep.forward_adjust(factored(spark, d)).select("symbol", "ts", "open", "high", "low", "close"))


@query
def backward_adjust(spark, d):
    return rounded(prep.backward_adjust(factored(spark, d)).select("symbol", "ts", "open", "high", "low", "close"))


@query
def mark_suspension(spark, d):
    b = hourly(spark, d)
    off = b.where((F.hour("ts") == 0) & (F.dayofmonth("ts") % 7 == 0)).select("ts")
    return prep.mark_suspension(b, off).select("symbol", "ts", "is_suspended")


@query
def mark_limit(spark, d):
    market = F.expr("CASE symbol WHEN '1-URGENT' THEN 'main' WHEN '2-HIGH' THEN 'kcb' WHEN '3-MEDIUM' THEN 'st' WHEN '4-NOT SPECIFIED' THEN 'bse' ELSE 'other' END")
    return rounded(prep.mark_limits(daily(spark, d), market).select("symbol", "ts", "change_pct", "limit_up", "limit_down"))


def gapped(spark, d):
    """Closes with holes of one and of three bars."""
    b = daily(spark, d)
    return b.withColumn("close", F.when(~F.dayofmonth("ts").isin(5, 11, 12, 13), F.col("close"))).select("symbol", "ts", "close")


@query
def fill_ffill(spark, d):
    return rounded(prep.fill_missing(gapped(spark, d), ("close",), "ffill", 2))


@query
def fill_bfill(spark, d):
    return rounded(prep.fill_missing(gapped(spark, d), ("close",), "bfill"))


@query
def fill_linear(spark, d):
    return rounded(prep.fill_missing(gapped(spark, d), ("close",), "linear"))


@query
def clean_ohlcv(spark, d):
    """Bars spoiled on purpose: highs below closes, prices of nearly zero, no volume."""
    b = daily(spark, d)
    day = F.dayofmonth("ts")
    spoiled = b.withColumns({"high": F.when(day == 3, F.col("low") - 1).otherwise(F.col("high")), "open": F.when(day == 4, F.lit(0.001)).otherwise(F.col("open")), "volume": F.when(day == 6, 0.0).otherwise(F.col("volume"))})
    return rounded(prep.clean_ohlcv(spoiled).select("symbol", "ts", "open", "high", "low", "close", "volume"))


@query
def returns(spark, d):
    return rounded(prep.add_returns(daily(spark, d)).select("symbol", "ts", "returns", "log_returns"))


@query
def tech_features(spark, d):
    return rounded(prep.add_technical_features(daily(spark, d)).select("symbol", "ts", "ma_5", "ma_10", "ma_20", "volatility_20"))


# -- joins, search and catalog


@query
def owner_inner_join(spark, d):
    o = bar_sources.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("strategy_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), "o_totalprice")
    c = bar_sources.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner"))
    return rounded(catalog.owned_backtests(o, c, 7, "running").select("id", "strategy_id", "strategy_name", "o_totalprice"))


@query
def running_counts(spark, d):
    o = bar_sources.read(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"))
    return catalog.running_counts(o)


@query
def strategy_page(spark, d):
    p = bar_sources.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return catalog.list_strategies(p, "O", "urgent", 20, 20).select("id", "name", "status", "created_at")


@query
def source_summary(spark, d):
    s = bar_sources.read(spark, d, "supplier").select(F.col("s_name").alias("symbol"), F.col("s_suppkey").alias("records_count"), F.col("s_suppkey").alias("updated_at"), F.when(F.col("s_acctbal") < 0, "pending").otherwise("ready").alias("status"))
    out = catalog.source_summary(s)
    return out.withColumn("pending", F.array_join("pending", ","))


@query
def marketplace_search(spark, d):
    p = bar_sources.read(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("display_name"), F.col("p_type").alias("description"), F.array("p_type", "p_brand").alias("tags"), F.lit("x").alias("category"), F.lit("active").alias("status"), F.col("p_retailprice").alias("rating"))
    return rounded(formula.search_listings(c, "BRAND#1", "x").select("id", "name", "display_name", "rating"))


@query
def grid_cross_join(spark, d):
    g = search.grid(spark, search.grid_values({"fast": ("int", 2, 10), "slow": ("int", 20, 60), "stop": ("float", 0.01, 0.05), "side": ("categorical", [1, 2])}))
    return rounded(g)


@query
def grid_sample(spark, d):
    """Twenty combinations of a larger grid, chosen by a hash; taking a sample is the feature."""
    values = search.grid_values({"fast": ("int", 2, 10), "slow": ("int", 20, 60), "stop": ("float", 0.01, 0.05), "side": ("categorical", [1, 2])})
    return rounded(search.grid(spark, values, 20))


# -- indicators


def indicator(name: str, f: Callable[..., DataFrame], *outputs: str, source=daily, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(f(source(spark, d), **params).select("symbol", "ts", *outputs))

    run.__name__ = name
    QUERIES[name] = run


for _name, _f, _outputs in (
    ("ind_sma", indicators.sma, "sma"), ("ind_wma", indicators.wma, "wma"), ("ind_trima", indicators.trima, "trima"), ("ind_rsi", indicators.rsi, "rsi"), ("ind_cmo", indicators.cmo, "cmo"),
    ("ind_bbands", indicators.bbands, "upperband middleband lowerband"), ("ind_atr", indicators.atr, "atr"), ("ind_natr", indicators.natr, "natr"), ("ind_trange", indicators.trange, "trange"),
    ("ind_adx", indicators.adx, "adx"), ("ind_dx", indicators.dx, "dx"), ("ind_directional", indicators.directional, "plus_di minus_di plus_dm minus_dm"), ("ind_cci", indicators.cci, "cci"),
    ("ind_stoch", indicators.stoch, "slowk slowd"), ("ind_stochf", indicators.stochf, "fastk fastd"), ("ind_stochrsi", indicators.stochrsi, "fastk fastd"), ("ind_mom", indicators.mom, "mom"),
    ("ind_roc", indicators.roc, "roc"), ("ind_rocr", indicators.rocr, "rocr"), ("ind_willr", indicators.willr, "willr"), ("ind_mfi", indicators.mfi, "mfi"), ("ind_obv", indicators.obv, "obv"), ("ind_vwap", indicators.vwap, "vwap"),
    ("ind_pivot", indicators.pivot, "pivot resistance1 support1 resistance2 support2"), ("ind_fibo", indicators.fibo, "fib_0_0 fib_0_236 fib_0_382 fib_0_5 fib_0_618 fib_0_786 fib_1_0"),
    ("ind_stddev", indicators.stddev, "stddev"), ("ind_var", indicators.var, "var"), ("ind_bop", indicators.bop, "bop"), ("ind_ad", indicators.ad, "ad"), ("ind_ultosc", indicators.ultosc, "ultosc"),
    ("ind_aroon", indicators.aroon, "aroon_up aroon_down aroonosc"), ("ind_linearreg", indicators.linearreg, "linearreg linearreg_slope linearreg_intercept linearreg_angle tsf"),
    ("ind_correl", indicators.correl, "correl"), ("ind_macdext", indicators.macdext, "macd macdsignal macdhist"), ("ind_prices", indicators.prices, "avgprice medprice typprice wclprice"),
    ("ind_ema", indicators.ema, "ema"), ("ind_macd", indicators.macd, "macd macdsignal macdhist"), ("ind_dema", indicators.dema, "dema"), ("ind_tema", indicators.tema, "tema"), ("ind_t3", indicators.t3, "t3"),
    ("ind_trix", indicators.trix, "trix"), ("ind_ppo", indicators.ppo, "ppo"), ("ind_apo", indicators.apo, "apo"), ("ind_keltner", indicators.keltner, "keltner_upper keltner_middle keltner_lower"),
    ("ind_adosc", indicators.adosc, "adosc"), ("ind_kama", indicators.kama, "kama"), ("ind_hilbert", indicators.hilbert, " ".join(indicators.HILBERT)),
    ("capital_flow", ashare.capital_flow, "large_in large_out medium_in medium_out small_in small_out net_flow main_net_flow"), ("chip_concentration", ashare.chip_concentration, "chip_concentration"),
    ("limit_up_probability", ashare.limit_up_probability, "limit_up_probability"), ("board_effect", ashare.board_effect, "board_effect"),
    ("turnover_zscore", ashare.turnover_zscore, "turnover_zscore is_anomaly anomaly_direction"), ("main_force", ashare.main_force, "main_force"), ("main_force_detail", ashare.main_force_detail, "energy energy_mean energy_ratio force_direction"),
):
    indicator(_name, _f, *_outputs.split())


@query
def board_effect_relative(spark, d):
    """Against a board: the mean close of all symbols at the time."""
    b = daily(spark, d)
    board = b.groupBy("ts").agg(F.avg("close").alias("board_close"))
    return rounded(ashare.board_effect(b.join(board, "ts"), "board_close").select("symbol", "ts", "board_effect"))


@query
def chip_profile(spark, d):
    return rounded(ashare.chip_profile(daily(spark, d)))


for _listing in formula.BUILT_IN:
    indicator(f"formula_{codegen.snake_case(_listing.name)}", lambda b, text=_listing.formula: formula.Formula(text).apply(b, "value"), "value")
indicator("formula_mixed", lambda b: formula.Formula("max(close, 5) - min(sqrt(abs(low)), log(volume + 1), 3) + shift(close, 2) ** 2 / -open").apply(b, "value"), "value")
indicator("formula_params", lambda b: formula.Formula("sma(close, fast) / sma(close, slow) - level + max(close, slow) * weight", {"fast": 5, "slow": 12, "level": 1.5, "weight": 0.001}).apply(b, "value"), "value")
indicator("formula_ema", lambda b: formula.Formula("ema(close, 10) / sma(close, 10) - 1").apply(b, "value"), "value")


@query
def protected_math(spark, d):
    line = bar_sources.read(spark, d, "lineitem")
    a, b = F.col("l_quantity"), F.col("l_discount")
    s = line.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(fm.protected_div(a, b), 6)).alias("div"), F.sum(F.round(fm.protected_sqrt(-a), 6)).alias("root"), F.sum(F.round(fm.protected_log(b), 6)).alias("log"), F.sum(F.round(fm.protected_power(-b, F.lit(0.5)), 6)).alias("power"), F.sum(fm.nearly_equal(b, F.lit(0.05)).cast("int")).alias("near"))
    return rounded(s, 2)


# -- signals and rules


def signal_query(name: str, ir: StrategyIR, source=daily) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_signal(ir, source(spark, d)).select("symbol", "ts", "signal")

    QUERIES[name] = run


signal_query("ir_signal_ma_cross", cross_strategy(20, 50))
signal_query("ir_signal_rsi", threshold_strategy("RSI", 40.0, 60.0, period=14))
signal_query(
    "ir_signal_logic",
    StrategyIR("logic", [Node("root", "root"), Node("if", "condition"), Node("and", "operator", "AND"), Node("not", "operator", "NOT"), Node("lt", "operator", "LT"), Node("x", "operator", "CROSSOVER"), Node("close", "indicator", "close"), Node("sma", "indicator", "SMA", {"period": 10}), Node("rsi", "indicator", "RSI", {"period": 14}), Node("v", "value", "", {"value": 45}), Node("buy", "action", "BUY"), Node("hold", "action", "HOLD")],
               [Edge("root", "if"), Edge("if", "and"), Edge("and", "not"), Edge("and", "x"), Edge("not", "lt"), Edge("lt", "rsi"), Edge("lt", "v"), Edge("x", "close"), Edge("x", "sma"), Edge("if", "buy", "then"), Edge("if", "hold", "else")]),
)


NAMED = ("MINUS_DI", "PLUS_DI", "PLUS_DM", "AROON", "AROONOSC", "LINEARREG", "LINEARREG_ANGLE", "TSF", "TYPPRICE", "WCLPRICE", "BBANDS")


@query
def ir_signal_named_outputs(spark, d):
    """Indicator nodes that are some column of a function, as strategies see them."""
    bound, columns = bind(StrategyIR("named", [Node(n, "indicator", n) for n in NAMED]), daily(spark, d))
    return rounded(bound.select("symbol", "ts", *(F.col(columns[n]).alias(n.lower()) for n in NAMED)))


@query
def ir_signal_arithmetic(spark, d):
    """Arithmetic, IF, LAG and crossings within each other."""
    t, ind, const = genetic.Tree, lambda n, p=0: genetic.Tree("IND", (), n, p), lambda x: genetic.Tree("CONST", (), "", x)
    ma, mom, lagged = ind("SMA", 5), ind("MOM", 10), lambda x, n: t("LAG", (x,), "", n)
    trees = [
        t("GT", (t("ADD", (ma, t("MUL", (const(0.5), mom)))), lagged(ma, 3))),
        t("CROSSOVER", (t("SUB", (ma, lagged(ma, 2))), t("NEG", (t("DIV", (mom, const(4.0))),)))),
        t("OR", (t("LE", (t("IF", (t("CROSSUNDER", (ma, ind("SMA", 20))), ma, lagged(mom, 1))), const(3.0))), t("AND", (t("NOT", (t("GE", (mom, const(0.0))),)), t("TRUE"))))),
        t("LT", (t("SQRT", (mom,)), t("LOG", (t("POW", (mom, const(2.0))),)))),
        t("EQ", (t("IF", (t("GT", (mom, const(0.0))), const(1.0), const(1.0 + 5e-7))), const(1.0))),
    ]
    b = daily(spark, d)
    for i, tree in enumerate(trees):
        b = with_signal(genetic.to_ir(tree), b).withColumnRenamed("signal", f"s{i}")
    return b.select("symbol", "ts", *(f"s{i}" for i in range(len(trees))))


@query
def rule_flags(spark, d):
    b = bar_sources.with_rules(daily(spark, d))
    return rules.RuleChain().apply(b).select("symbol", "ts", "can_buy", "can_sell", "no_buy_reason", "no_sell_reason")


# -- execution and metrics


def executed(spark, d, config=backtest.BacktestConfig(), ir=None, source=hourly):
    return backtest.execute(with_signal(ir or cross_strategy(20, 50), bar_sources.with_rules(source(spark, d))), config)


@query
def backtest_ma_cross(spark, d):
    return rounded(backtest.equity_curve(executed(spark, d)), 2)


@query
def backtest_trades(spark, d):
    return rounded(backtest.trades_of(executed(spark, d)).drop("bar_seq"), 4)


@query
def backtest_percent(spark, d):
    config = backtest.BacktestConfig(sizing="percent", slippage_twice=False)
    return rounded(backtest.equity_curve(executed(spark, d, config)), 2)


@query
def backtest_next_open(spark, d):
    return rounded(backtest.trades_of(executed(spark, d, backtest.BacktestConfig(fill="next_open"))).drop("bar_seq"), 4)


@query
def backtest_shared_cash(spark, d):
    """All symbols in one account."""
    b = with_signal(cross_strategy(20, 50), bar_sources.with_rules(hourly(spark, d))).withColumn("run_id", F.lit("all"))
    return rounded(backtest.equity_curve(backtest.execute(b, backtest.BacktestConfig(sizing="percent"), ("run_id",))), 2)


@query
def backtest_metrics(spark, d):
    """The flagship: bars, averages, signal, rules, execution, figures."""
    return rounded(metrics.performance(executed(spark, d), ["symbol"]))


@query
def excursions(spark, d):
    return rounded(metrics.excursions(executed(spark, d), ["symbol"]))


def curve(spark, d):
    """A curve per symbol that SQL can make too: the close as equity."""
    return daily(spark, d).select("symbol", "ts", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).alias("bar_seq"), F.col("close").alias("equity"))


@query
def equity_metrics(spark, d):
    return rounded(metrics.equity_metrics(curve(spark, d), ["symbol"]))


@query
def drawdown_islands(spark, d):
    return rounded(metrics.drawdowns(curve(spark, d), ["symbol"]).select("symbol", "bar_seq", "peak", "drawdown", "under_bars"))


def fills(spark, d):
    """Fills that SQL can make too: line items as buys and sells, many lots a symbol; more is bought than sold.

    Numbered inside each symbol and day, side by side, after the number of fills before that day.
    """
    line = bar_sources.read(spark, d, "lineitem")
    t = line.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").alias("ts"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", tidy(F.col("l_extendedprice") / F.col("l_quantity") / 100, 4).alias("price"), F.col("l_tax").alias("commission"), F.col("l_discount").alias("slippage"))
    # tax and discount last: whatever is read of the fills, they are dealt out by one and the same exchange
    day = Window.partitionBy("symbol", "ts").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "price", "commission", "slippage")
    earlier = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = t.groupBy("symbol", "ts").agg(F.count("*").alias("_n")).select("symbol", "ts", F.sum("_n").over(earlier).alias("_before"))
    numbered = t.withColumn("_in_day", F.row_number().over(day)).join(days, ["symbol", "ts"], "left")
    seq = (F.coalesce("_before", F.lit(0)) + F.col("_in_day")).cast("int")
    return numbered.select("symbol", "ts", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1).alias("signal"), (F.col("l_quantity") * 100).cast("long").alias("shares"), "price", "commission", "slippage", seq.alias("trade_seq"))


@query
def fifo_round_trips(spark, d):
    trips = metrics.fifo_round_trips(fills(spark, d), [], "ts")
    return rounded(trips.select("symbol", "buy_trade_seq", "sell_trade_seq", F.col("shares").cast("long").alias("shares"), "cost", "proceeds", "pnl"), 4)


@query
def trade_metrics(spark, d):
    return rounded(metrics.trade_metrics(fills(spark, d).withColumn("run_id", F.col("symbol")), ["run_id"], "ts"), 4)


@query
def pnl_histogram(spark, d):
    trips = metrics.fifo_round_trips(fills(spark, d), [], "ts")
    return rounded(metrics.pnl_histogram(trips.withColumn("pnl", tidy(F.col("pnl"), 4)), ["symbol"]), 2)


# -- robustness


def outcomes(spark, d, source=daily):
    """Trades with profits that SQL can make too: the change of each bar."""
    b = source(spark, d)
    w = Window.partitionBy("symbol").orderBy("ts")
    return b.select(F.col("symbol").alias("run_id"), F.row_number().over(w).alias("trade_seq"), tidy((F.col("close") - F.col("open")) * 100, 4).alias("pnl"))


def mc_query(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = monte_carlo.perturb(outcomes(spark, d), method, 20)
        w = Window.partitionBy(*monte_carlo.SIMULATION).orderBy("place", "trade_seq")
        return rounded(out.select("run_id", "sim_id", "trade_seq", "pnl", F.row_number().over(w).alias("at")))

    QUERIES[f"mc_{method}"] = run


for _method in monte_carlo.TRADE_METHODS:
    mc_query(_method)


@query
def mc_summary(spark, d):
    return rounded(monte_carlo.run_trade_methods(outcomes(spark, d), n=20), 4)


@query
def mc_overall(spark, d):
    return rounded(monte_carlo.overall(monte_carlo.run_trade_methods(outcomes(spark, d), n=20)), 4)


@query
def mc_block_shuffle(spark, d):
    paths = align.block_shuffle(daily(spark, d), 3)
    return rounded(paths.select("symbol", "sim_id", "place", F.ln("close").alias("log_close")))  # of very different sizes


@query
def regime_returns(spark, d):
    """Mean and number of daily changes by regime of the day before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = align.regimes(daily(spark, d), 20, 0.1)
    changes = r.select("symbol", F.lag("regime").over(w).alias("regime"), (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("ret")).where("regime IS NOT NULL")
    return rounded(changes.groupBy("symbol", "regime").agg(F.avg("ret").alias("mean_ret"), F.count("*").alias("n")))


@query
def mc_data_noise(spark, d):
    return rounded(monte_carlo.noisy_bars(daily(spark, d), 3).select("symbol", "ts", "sim_id", "open", "high", "low", "close"), 4)


@query
def mc_atr_noise(spark, d):
    return rounded(monte_carlo.atr_noise(daily(spark, d), 3).select("symbol", "ts", "sim_id", "open", "high", "low", "close"), 4)


@query
def mc_against_original(spark, d):
    """What simulations keep of the runs they come from."""
    own = outcomes(spark, d)
    w = Window.partitionBy("run_id").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    curve = own.withColumn("equity", 1_000_000.0 + F.sum("pnl").over(w)).withColumnRenamed("trade_seq", "bar_seq")
    figures = metrics.equity_metrics(curve, ["run_id"])
    out = monte_carlo.against_original(monte_carlo.run_trade_methods(own, ("skip_trades", "delete_trades"), 10), figures)
    return rounded(out.select("run_id", "method", "original_return", "original_drawdown", "profit_kept", "drawdown_grown"), 4)


@query
def mc_start_offset(spark, d):
    out = monte_carlo.start_offsets(daily(spark, d), 5)
    return out.groupBy("symbol", "sim_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


def mc_anew_query(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = monte_carlo.bar_simulation(hourly(spark, d), cross_strategy(10, 30), method, 4)
        return rounded(out.select("run_id", "sim_id", "net_profit", "total_return_pct", "sharpe_ratio", "max_drawdown_pct"), 4)

    QUERIES[f"mc_anew_{method}"] = run


for _method in monte_carlo.BAR_METHODS:
    mc_anew_query(_method)


@query
def mc_all_methods(spark, d):
    """All nine methods over every symbol, and whether it passes them."""
    summary = monte_carlo.simulate_all(outcomes(spark, d, hourly), hourly(spark, d), cross_strategy(10, 30), 4)
    return rounded(monte_carlo.overall(summary), 4)


@query
def grid_search(spark, d):
    out = search.grid_search(hourly(spark, d), PAIRS)
    return rounded(out.select("symbol", "combo_idx", "fast", "slow", "rank", "total_return_pct", "sharpe_ratio", "max_drawdown_pct"), 4)


@query
def grid_best(spark, d):
    return rounded(search.grid_search(hourly(spark, d), PAIRS).where("rank = 1").select("symbol", "fast", "slow", "total_return_pct", "sharpe_ratio"), 4)


@query
def grid_search_levels(spark, d):
    """A grid over the levels and the period of an RSI strategy."""
    ir = threshold_strategy("RSI", 40.0, 60.0, period=14)
    out = search.strategy_grid(ir, {"period": [7, 14], "low.value": [35.0, 45.0], "high.value": [55.0, 65.0]}, hourly(spark, d))
    return rounded(out.select("symbol", "combo_idx", "period", "low_value", "high_value", "rank", "total_return_pct", "sharpe_ratio"), 4)


@query
def wfo_windows(spark, d):
    return search.wfo_windows(hourly(spark, d), 200, 100, 100).select("symbol", "window_idx", *(F.col(c).cast("long").alias(c) for c in ("is_start", "oos_start", "oos_end")))


@query
def walk_forward(spark, d):
    return rounded(search.walk_forward(hourly(spark, d), PAIRS, 60, 40, 40), 4)


@query
def wfo_summary(spark, d):
    windows = search.walk_forward(hourly(spark, d), PAIRS, 60, 40, 40)
    return rounded(search.wfo_summary(windows, ["symbol"]), 4)


@query
def wfo_matrix(spark, d):
    return rounded(search.wfo_matrix(hourly(spark, d), PAIRS[:3], [(60, 40, 40), (80, 40, 40)]), 4)


def strategy_returns(spark, d):
    """Returns of eight made-up strategies: hourly changes by user."""
    e = bar_sources.read(spark, d, "events")
    p = e.groupBy((F.col("user_id") % 8).alias("strategy_id"), F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("strategy_id").orderBy("h")
    change = F.try_divide(F.col("v") - F.lag("v").over(w), F.col("v") + F.lag("v").over(w))
    return p.select("strategy_id", F.row_number().over(w).alias("period_idx"), F.round(change, 8).alias("ret")).where("ret IS NOT NULL")


@query
def pbo(spark, d):
    return rounded(overfitting.pbo(strategy_returns(spark, d)))


@query
def psr(spark, d):
    return rounded(overfitting.psr(strategy_returns(spark, d), 0.02), 4)


@query
def dsr(spark, d):
    return rounded(overfitting.dsr(strategy_returns(spark, d), 0.05), 4)


@query
def overfitting_report(spark, d):
    return rounded(overfitting.detect_all(strategy_returns(spark, d), 4, 0.05), 4)


# -- reports, portfolios, fuzzy rules


@query
def corr_matrix(spark, d):
    r = portfolio.curve_returns(daily(spark, d), "symbol", "close")
    return rounded(portfolio.correlation(r, "symbol"))


@query
def risk_parity(spark, d):
    return rounded(portfolio.inverse_volatility(portfolio.curve_returns(daily(spark, d), "symbol", "close"), "symbol"))


@query
def calmar_weights(spark, d):
    r = portfolio.curve_returns(daily(spark, d), "symbol", "close")
    return rounded(portfolio.calmar_weights(r, "symbol", 40).drop("calmar"))  # the growth itself is too large for decimals


@query
def portfolio_weights(spark, d):
    """Highest Sharpe ratio, least volatility and highest return, from covariances that Spark computes."""
    r = portfolio.curve_returns(daily(spark, d), "symbol", "close")
    out = [portfolio.weights_for(r, "symbol", goal).withColumn("goal", F.lit(goal)) for goal in ("max_sharpe", "min_vol", "max_return")]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


@query
def portfolio_curve(spark, d):
    c = daily(spark, d).select("symbol", "ts", F.col("close").alias("equity"))
    weights = c.select("symbol").distinct().withColumn("weight", F.lit(0.2))
    grown = portfolio.portfolio_curve(c, "symbol", weights)
    return rounded(grown.select("ts", "ret", "log_equity"), 4)  # growth is too large for decimals


@query
def corrected_p_values(spark, d):
    s = bar_sources.read(spark, d, "supplier")
    return rounded(portfolio.corrected_p_values(s.select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37 % 101) / 5000.0).alias("p_value"))))


@query
def spp_summary(spark, d):
    figures = curve_grid(spark, d)
    return rounded(portfolio.parameter_summary(figures, ["symbol"], "ret"))


@query
def opt_profile(spark, d):
    return rounded(portfolio.optimization_profile(curve_grid(spark, d), ["symbol"], "ret"))


def curve_grid(spark, d):
    """Figures over a grid that SQL can make too: the mean change over several horizons."""
    b = daily(spark, d)
    w = Window.partitionBy("symbol").orderBy("ts")
    changes = [F.struct(F.lit(i).alias("combo_idx"), (F.col("close") / F.lag("close", n).over(w) - 1).alias("change")) for i, n in enumerate((1, 2, 3, 5, 8, 13, 21))]
    return b.select("symbol", F.array(*changes).alias("all")).select("symbol", F.explode("all").alias("c")).groupBy("symbol", "c.combo_idx").agg(F.avg("c.change").alias("m")).select("symbol", "combo_idx", F.round(F.col("m") - 0.3, 8).alias("ret"))


@query
def multi_oos(spark, d):
    return rounded(portfolio.multi_oos(curve(spark, d), ["symbol"]))


@query
def fuzzy_degrees(spark, d):
    inputs = fuzzy.fuzzy_inputs(daily(spark, d))
    out = fuzzy.fuzzy_degrees(inputs, fuzzy.FuzzySpec.template())
    return rounded(out.select("symbol", "ts", *(f"{v}_{m.label}" for v, ms in fuzzy.VARIABLES.items() for m in ms)), 4)


def fuzzy_query(template: str, name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        spec = fuzzy.FuzzySpec.template(template, 0.35, 0.3)
        out = fuzzy.fuzzy_signal(fuzzy.fuzzy_inputs(daily(spark, d)), spec)
        return rounded(out.select("symbol", "ts", *(f"fuzzy_score_{i}" for i in range(len(spec.rules))), "signal"), 4)

    QUERIES[name] = run


for _template, _name in (("balanced", "fuzzy_signal"), ("momentum", "fuzzy_momentum"), ("reversal", "fuzzy_reversal")):
    fuzzy_query(_template, _name)


@query
def fuzzy_graph(spark, d):
    """The balanced rules as a strategy graph over their scores."""
    spec = fuzzy.FuzzySpec.template("balanced", 0.35, 0.3)
    scored = fuzzy.fuzzy_scores(fuzzy.fuzzy_inputs(daily(spark, d)), spec)
    return with_signal(spec.to_ir(), scored).select("symbol", "ts", "signal")


@query
def results_scores(spark, d):
    """The report over one made-up run per customer."""
    c = bar_sources.read(spark, d, "customer")
    k = F.col("c_custkey")
    figures = c.select(k.alias("run_id"), (-(k % 31)).cast("double").alias("max_drawdown_pct"), (k % 53 - 20).cast("double").alias("total_return_pct"), ((k % 41) / 10.0 - 1).alias("sharpe_ratio"), ((k % 7) / 10.0).alias("win_rate"), ((k % 23) / 10.0).alias("profit_factor"), (k % 90).cast("double").alias("total_trades"), ((k % 19) / 10.0).alias("calmar_ratio"), (k % 60).cast("int").alias("flat_run"))
    out = report.analyze(figures)
    return rounded(out.select("run_id", "regime", "quality_score", "risk_score", "opportunity_score", F.size("insights").alias("n_insights"), F.size("suggested_actions").alias("n_actions"), F.element_at("suggested_actions", 1).alias("first_action")))


@query
def flat_run(spark, d):
    return report.longest_flat_run(curve(spark, d), ["symbol"])


# -- generation; rows only


def two_sided(fast: int, slow: int) -> StrategyIR:
    """Buy above, sell below, with a level called a stop in between."""
    nodes = [Node("root", "root"), Node("up", "condition", "IF"), Node("gt", "operator", "GT"), Node("f", "indicator", "SMA", {"period": fast}), Node("s", "indicator", "SMA", {"period": slow}), Node("buy", "action", "BUY"), Node("down", "condition", "IF"), Node("lt", "operator", "LT"), Node("mom", "indicator", "MOM", {"period": 10}), Node("stop_level", "value", "", {"value": -0.4}), Node("sell", "action", "SELL"), Node("hold", "action", "HOLD")]
    edges = [Edge("root", "up"), Edge("up", "gt"), Edge("gt", "f"), Edge("gt", "s"), Edge("up", "buy", "then"), Edge("up", "down", "else"), Edge("down", "lt"), Edge("lt", "mom"), Edge("lt", "stop_level"), Edge("down", "sell", "then"), Edge("down", "hold", "else")]
    return StrategyIR("two-sided", nodes, edges)


@query
def improver_candidates(spark, d):
    """Every kind of candidate for a strategy with entry, exit and stop: entries, exits, filters, stops, periods."""
    ir = two_sided(10, 30)
    trials = [ir, *generate.entry_candidates(ir), *generate.exit_candidates(ir), *generate.filter_candidates(ir), *generate.stop_candidates(ir), *generate.period_candidates(ir)]
    return rounded(generate.evaluate_all(trials, hourly(spark, d)).select("run_id", "symbol", "net_profit", "total_return_pct", "sharpe_ratio", "max_drawdown_pct"), 4)


@query
def gp_population_eval(spark, d):
    import random

    rng = random.Random(5)
    return rounded(generate.evaluate_all([genetic.to_ir(genetic.random_tree(rng, depth=2)) for _ in range(8)], hourly(spark, d)), 4)


@query
def gp_evolution(spark, d):
    best = genetic.evolve(genetic.rater(hourly(spark, d)), population=6, generations=2, indicators=("SMA", "RSI", "MOM", "ATR", "STOCH"), several=True)
    return spark.createDataFrame([(i, str(t), *map(float, f)) for i, (t, f) in enumerate(best)], "place int, tree string, sharpe double, drawdown double, win double")


@query
def gp_nsga2_ranks(spark, d):
    """Fronts and crowding of the grid's pairs by three objectives."""
    figures = search.grid_search(hourly(spark, d), PAIRS)
    rated = genetic.objectives(figures, F.col("fast") + F.col("slow")).select("symbol", "combo_idx", *(F.round(c, 6).alias(c) for c in genetic.OBJECTIVES))
    return rounded(genetic.nsga2_ranks(rated, ["symbol"], genetic.OBJECTIVES), 4)


@query
def optimizer_batch(spark, d):
    b = hourly(spark, d)
    run = lambda trials: generate.mean_metric([cross_strategy(t["fast"], t["slow"]) for t in trials], b)
    best, value, history = parzen.optimize(spark, run, {"fast": ("int", 3, 15), "slow": ("int", 20, 50)}, batches=2, size=4)
    return spark.createDataFrame([(i, float(t["fast"]), float(t["slow"]), float(v), v == value) for i, (t, v) in enumerate(history)], "trial int, fast double, slow double, value double, best boolean")


@query
def pareto_front(spark, d):
    figures = search.grid_search(hourly(spark, d), PAIRS)
    return rounded(genetic.pareto_front(figures.select("symbol", "combo_idx", *(F.round(c, 6).alias(c) for c in ("total_return_pct", "max_drawdown_pct"))), ["symbol"], ("total_return_pct", "max_drawdown_pct")), 4)


def rated(spark, d):
    """Fitness of the grid's pairs, in two generations."""
    figures = search.grid_search(hourly(spark, d), PAIRS)
    return generate.fitness(figures, F.col("fast") + F.col("slow")).withColumn("generation", F.col("combo_idx") % 2)


@query
def gp_fitness(spark, d):
    return rounded(rated(spark, d).select("symbol", "combo_idx", "fitness"), 4)


@query
def gp_generation_stats(spark, d):
    return rounded(generate.generation_stats(rated(spark, d)), 4)


@query
def hall_of_fame(spark, d):
    named = rated(spark, d).withColumns({"fitness": F.round("fitness", 6), "expression": F.format_string("SMA%d>SMA%d", "fast", "slow")})
    return rounded(generate.hall_of_fame(named, "expression", 3), 4)


@query
def codegen_sources(spark, d):
    ir = threshold_strategy("RSI", 30.0, 70.0, period=14)
    return spark.createDataFrame([(t, codegen.generate(ir, t)) for t in codegen.TARGETS], "target string, source string")


from quantloom import oracles_market, oracles_scenarios, queries_market, queries_scenarios  # noqa: E402, F401  they register themselves


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
