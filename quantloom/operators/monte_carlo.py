"""Monte Carlo over trades and bars: simulations are rows of one job, and their random numbers come
from hashes of (seed, simulation, trade), so any engine and any partitioning repeats them.

Trade methods change a run's list of trades and add its profits up again. Bar methods change
bars, parameters or both and execute the strategy anew.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.math import hash_normal, hash_uniform
from quantloom.operators.backtest import BacktestConfig, evaluate
from quantloom.operators.generate import signals_of
from quantloom.operators.indicators import atr
from quantloom.operators.metrics import RISK_FREE, with_rates
from quantloom.operators.rules import RuleChain
from quantloom.plans.ir import StrategyIR

TRADE_METHODS = ("shuffle_trades", "skip_trades", "randomize_trades_order", "position_size", "delete_trades")
BAR_METHODS = ("param_perturb", "data_noise", "start_offset", "comprehensive")
# The rates a simulation draws one from, by method.
RATES = {"skip_trades": (0.1, 0.2, 0.3), "delete_trades": (0.1, 0.2), "param_perturb": (0.1, 0.2, 0.3), "data_noise": (0.01, 0.02, 0.05), "start_offset": (0.1, 0.2, 0.3)}
SIMULATION = ("sim_id", "stretch", "run_id")  # numbers first, as rows are sorted by them
STRETCH = 20


def simulations(trades: DataFrame, n: int) -> DataFrame:
    """Every trade once for each simulation 0 to n - 1.

    Trades are dealt out by run and stretch of ``STRETCH`` simulations, and copied for each
    simulation after that; windows over ``SIMULATION`` need no other shuffle, and what is
    shuffled is a twentieth of the simulated trades. ``n`` is a parameter, so no join is needed.
    """
    dealt = trades.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // STRETCH))))
    dealt = dealt.repartition(int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run_id", "stretch")  # with a number, as few bytes here are many simulated trades later
    first = F.col("stretch") * STRETCH
    return dealt.withColumn("sim_id", F.explode(F.sequence(first, F.least(first + (STRETCH - 1), F.lit(n - 1)))))


def drawn_rate(method: str, seed: int, rates: tuple[float, ...]):
    """The rate that a simulation (column sim_id) draws."""
    at = F.floor(hash_uniform(seed, F.lit("rate"), F.lit(method), F.col("sim_id")) * len(rates))
    return F.element_at(F.array(*map(F.lit, rates)), (at + 1).cast("int"))


def perturb(trades: DataFrame, method: str, n: int, seed: int = 42) -> DataFrame:
    """Simulated trades (run_id, stretch, sim_id, trade_seq, pnl and the other columns): ``place`` is their order in the simulation."""
    rows = simulations(trades, n)
    key = (F.col("sim_id"), F.col("trade_seq"))
    u = hash_uniform(seed, F.lit(method), *key)
    rate = drawn_rate(method, seed, RATES[method]) if method in RATES else None
    if method == "shuffle_trades":
        return rows.withColumn("place", u)
    if method == "skip_trades":
        return rows.where(u > rate).withColumn("place", F.col("trade_seq").cast("double"))
    if method == "randomize_trades_order":
        flipped = hash_uniform(seed, F.lit("flip"), *key) < 0.5
        turned = {c: F.when(flipped, -F.col(c)).otherwise(F.col(c)) for c in ("pnl", "signal") if c in trades.columns}
        return rows.withColumns({"place": u} | turned)
    if method == "position_size":
        factor = 0.8 + 0.4 * u
        sized = {c: F.col(c) * factor for c in ("pnl", "commission", "slippage") if c in trades.columns}
        if "shares" in trades.columns:
            sized["shares"] = F.greatest(F.floor(F.col("shares") * factor), F.lit(1)).cast("long")
        return rows.withColumns(sized | {"place": F.col("trade_seq").cast("double")})
    if method == "delete_trades":
        w = Window.partitionBy(*SIMULATION)
        counted = rows.withColumn("_u", u).withColumns({"_rank": F.row_number().over(w.orderBy("_u", "trade_seq")), "_n": F.count("*").over(w), "_rate": rate})
        return counted.where(F.col("_rank") > F.floor(F.col("_n") * F.col("_rate"))).drop("_u", "_rank", "_n", "_rate").withColumn("place", F.col("trade_seq").cast("double"))
    raise ValueError(method)


def rebuild(simulated: DataFrame, initial: float = 1_000_000.0) -> DataFrame:
    """Equity curves of simulations after each trade, with return and drawdown; they begin at ``initial``."""
    w = Window.partitionBy(*SIMULATION).orderBy("place", "trade_seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    curve = simulated.withColumn("equity", initial + F.sum("pnl").over(run))
    before, peak = F.coalesce(F.lag("equity").over(w), F.lit(initial)), F.greatest(F.max("equity").over(run), F.lit(initial))
    return curve.withColumns({"ret": F.try_divide(F.col("equity"), before) - 1, "drawdown": (F.col("equity") - peak) / peak})


def rebuilt_figures(simulated: DataFrame, initial: float = 1_000_000.0) -> DataFrame:
    """Per simulation: total_return_pct, sharpe_ratio and max_drawdown_pct of its curve; one sort does for all."""
    one = rebuild(simulated, initial).groupBy(*SIMULATION).agg(
        (F.count("*") + 1).alias("n"), F.lit(initial).alias("first"), (initial + F.sum("pnl")).alias("last"),
        F.stddev_samp("ret").alias("sd"), F.lit(None).cast("double").alias("down"), F.least(F.min("drawdown"), F.lit(0.0)).alias("mdd"),
    )
    sharpe = F.when(F.col("volatility") > 0, (F.col("annual") - RISK_FREE) / F.col("volatility")).otherwise(0.0)
    return with_rates(one).select("run_id", "sim_id", (F.col("total") * 100).alias("total_return_pct"), sharpe.alias("sharpe_ratio"), (F.col("mdd") * 100).alias("max_drawdown_pct"))


def summarize(figures: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """Per method: share of profitable simulations, quantiles of profit, Sharpe and the worst drawdown."""
    p = F.col("total_return_pct") / 100
    one = figures.groupBy(*keys).agg(
        F.count("*").alias("n_simulations"), F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("profitable_pct"), F.percentile(p, F.lit(0.5)).alias("profit_median"),
        F.percentile(p, F.lit(0.05)).alias("profit_pct5"), F.percentile(p, F.lit(0.95)).alias("profit_pct95"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("profit_std"),
        F.percentile(F.col("sharpe_ratio"), F.lit(0.5)).alias("sharpe_median"), F.coalesce(F.stddev_samp("sharpe_ratio"), F.lit(0.0)).alias("sharpe_std"), F.min(F.col("max_drawdown_pct") / 100).alias("worst_drawdown"),
    )
    return one.withColumn("pass_status", F.col("profitable_pct") >= threshold)


def run_trade_methods(trades: DataFrame, methods: tuple[str, ...] = TRADE_METHODS, n: int = 100, seed: int = 42) -> DataFrame:
    """Summaries of all trade methods, for every run of the trades (columns run_id, trade_seq, pnl)."""
    parts = []
    for method in methods:
        figures = rebuilt_figures(perturb(trades, method, n, seed))
        parts.append(summarize(figures.withColumn("method", F.lit(method)), ["run_id", "method"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(summary: DataFrame) -> DataFrame:
    """Per run, whether all methods pass, and the worst of them."""
    return summary.groupBy("run_id").agg(F.bool_and("pass_status").alias("pass_status"), F.min("profitable_pct").alias("least_profitable"), F.min("worst_drawdown").alias("worst_drawdown"), F.count("*").alias("n_methods"))


def noisy_bars(bars: DataFrame, n: int, rate: float | None = None, seed: int = 42) -> DataFrame:
    """Every bar once per simulation with normal noise of ``rate`` standard deviations (None: one drawn by the simulation) on its prices; high and low hold the others."""
    whole, prices = Window.partitionBy("symbol"), ("open", "high", "low", "close")
    scaled = bars.withColumns({f"_{c}": F.coalesce(F.stddev_samp(c).over(whole), F.lit(0.0)) for c in prices})
    rows = scaled.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rate = drawn_rate("data_noise", seed, RATES["data_noise"]) if rate is None else F.lit(rate)
    noise = {c: F.col(c) + rate * F.col(f"_{c}") * hash_normal(seed, F.lit(c), F.col("sim_id"), F.col("symbol"), F.unix_micros(F.col("ts").cast("timestamp"))) for c in prices}
    moved = rows.withColumns(noise).drop(*(f"_{c}" for c in prices))
    return moved.withColumns({"high": F.greatest("high", "open", "close", "low"), "low": F.least("low", "open", "close", "high")})


def atr_noise(bars: DataFrame, n: int, share: float = 0.5, period: int = 14, seed: int = 42) -> DataFrame:
    """Every bar once per simulation, all its prices moved by the same normal number times a share of the average true range (none before there is one)."""
    ranged = atr(bars, period)
    rows = ranged.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    move = share * F.coalesce("atr", F.lit(0.0)) * hash_normal(seed, F.lit("atr"), F.col("sim_id"), F.col("symbol"), F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.withColumn("_move", move).withColumns({c: F.col(c) + F.col("_move") for c in ("open", "high", "low", "close")}).drop("_move", "atr")


def against_original(summary: DataFrame, original: DataFrame) -> DataFrame:
    """Summaries next to the run itself (run_id, total_return_pct, max_drawdown_pct): the share of its profit that the median simulation keeps, and how much deeper the worst one falls."""
    own = original.select("run_id", (F.col("total_return_pct") / 100).alias("original_return"), (F.col("max_drawdown_pct") / 100).alias("original_drawdown"))
    both = summary.join(own, "run_id")
    return both.withColumns({"profit_kept": F.try_divide(F.col("profit_median"), F.col("original_return")), "drawdown_grown": F.try_divide(F.col("worst_drawdown"), F.col("original_drawdown"))})


def start_offsets(bars: DataFrame, n: int, rate: float | None = None, seed: int = 42) -> DataFrame:
    """Every simulation without its first bars, up to a share of them (None: one drawn by the simulation)."""
    w = Window.partitionBy("symbol")
    counted = bars.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy("ts"))})
    rows = counted.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rate = drawn_rate("start_offset", seed, RATES["start_offset"]) if rate is None else F.lit(rate)
    most = F.floor(F.col("_n") * rate)
    offset = F.when(most > 0, F.floor(hash_uniform(seed, F.lit("offset"), F.col("sim_id"), F.col("symbol")) * most) + 1).otherwise(0)
    return rows.where(F.col("_at") > offset).drop("_n", "_at")


def uniform(seed: int, *keys) -> float:
    """The number that ``hash_uniform`` gives for the same keys; for draws on strategies, which are made on the driver."""
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16) / 4294967296.0


def perturbed_strategy(ir: StrategyIR, sim: int, seed: int = 42) -> StrategyIR:
    """The strategy with normal noise on its numeric parameters, in proportion to them; whole numbers stay whole and at least 1."""
    rates = RATES["param_perturb"]
    rate = rates[int(uniform(seed, "rate", "param_perturb", sim) * len(rates))]

    def moved(node: str, name: str, value):
        if isinstance(value, bool) or not isinstance(value, int | float) or abs(value) <= 1e-12:
            return value
        u, v = (uniform(seed, node, name, sim, x) for x in "uv")
        out = value + rate * abs(value) * math.sqrt(-2 * math.log(u + 1e-12)) * math.cos(2 * math.pi * v)
        return max(1, round(out)) if isinstance(value, int) else out

    return replace(ir, nodes=[replace(n, params={k: moved(n.id, k, v) for k, v in n.params.items()}) for n in ir.nodes])


def executed_anew(simulated: DataFrame, strategies: list[StrategyIR], config: BacktestConfig = BacktestConfig(), registry=None) -> DataFrame:
    """Figures per run_id (the symbol) and sim_id of bars with a column sim_id, each simulation under its own strategy.

    Every symbol of a simulation is a series of its own. Indicators that several strategies share
    are computed once.
    """
    own = RuleChain().apply(simulated.withColumns({"run_id": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", "sim_id")}))
    base, by = own.columns, {}
    for sim, ir in enumerate(strategies):
        by.setdefault(ir.fingerprint(), (ir, []))[1].append(sim)
    wide, signals = signals_of([ir for ir, _ in by.values()], own, registry)
    signal = F.lit(0)
    for (_, sims), x in zip(by.values(), signals):
        signal = F.when(F.col("sim_id").isin(sims), x).otherwise(signal)
    figures = evaluate(wide.withColumn("signals", F.array(signal)).select(*base, "signals"), config, ("run_id", "sim_id", "symbol"))
    return figures.drop("symbol", "combo_idx")


def bar_simulation(bars: DataFrame, ir: StrategyIR, method: str, n: int, config: BacktestConfig = BacktestConfig(), seed: int = 42) -> DataFrame:
    """Figures per run_id (the symbol) and sim_id of a method that executes the strategy anew."""
    moved = [perturbed_strategy(ir, sim, seed) for sim in range(n)] if method in ("param_perturb", "comprehensive") else [ir] * n
    if method in ("data_noise", "comprehensive"):
        rows = noisy_bars(bars, n, None, seed)
    elif method == "start_offset":
        rows = start_offsets(bars, n, None, seed)
    elif method == "param_perturb":
        rows = bars.withColumn("sim_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    else:
        raise ValueError(method)
    return executed_anew(rows, moved, config)


def run_bar_methods(bars: DataFrame, ir: StrategyIR, methods: tuple[str, ...] = BAR_METHODS, n: int = 100, config: BacktestConfig = BacktestConfig(), seed: int = 42) -> DataFrame:
    """Summaries of the methods that execute anew, for every symbol."""
    parts = [summarize(bar_simulation(bars, ir, m, n, config, seed).withColumn("method", F.lit(m)), ["run_id", "method"]) for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def simulate_all(trades: DataFrame, bars: DataFrame, ir: StrategyIR, n: int = 100, config: BacktestConfig = BacktestConfig(), seed: int = 42) -> DataFrame:
    """Summaries of all nine methods; trades have the symbol for run_id."""
    return run_trade_methods(trades, TRADE_METHODS, n, seed).unionByName(run_bar_methods(bars, ir, BAR_METHODS, n, config, seed))
