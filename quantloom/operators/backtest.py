"""Execution of signals: cash, positions, fills and equity.

Signals, prices and rule flags are columns before this point, so the step that has to go bar by
bar gets a few numbers per bar and runs as a grouped map, one group per run and account. With
``keys`` of run and symbol every symbol is an account; with the run alone, symbols share cash.
Many runs (grids, windows, simulations) are many groups of one job.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators import metrics
from quantloom.operators.rules import RuleChain


@dataclass(frozen=True)
class BacktestConfig:
    """``sizing``: fixed_value (all cash but the reserve), percent (of equity) or lot (100 shares).

    ``fill``: close, or next_open. ``slippage_twice`` charges slippage in the price and again as
    a cost; without it only the price carries it.
    """

    initial_capital: float = 1_000_000.0
    commission: float = 0.0003
    slippage: float = 0.001
    stamp_tax: float = 0.0005
    sizing: str = "fixed_value"
    reserve: float = 0.05
    percent: float = 0.10
    lot: int = 100
    fill: str = "close"
    slippage_twice: bool = True


_STEP = "bar_seq int, ts timestamp_ntz, equity double, cash double, market_value double, trade_id string, side int, price double, shares long, commission double, trade_slippage double, reason string, n_won int, won double, n_lost int, lost double"
FIGURES = (
    "net_profit", "total_return_pct", "annual_return_pct", "cagr", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "max_drawdown_duration", "calmar_ratio", "return_on_drawdown",
    "win_rate", "profit_factor", "avg_win", "avg_loss", "expectancy", "total_trades",
)


def _lean(bars: DataFrame, ids: list[str], signal: str, chain: RuleChain | None) -> DataFrame:
    """The few columns that execution reads."""
    if not {"can_buy", "can_sell"} <= set(bars.columns):
        bars = (chain or RuleChain()).apply(bars)
    factor = F.coalesce("adjustment_factor", F.lit(1.0)) if "adjustment_factor" in bars.columns else F.lit(1.0)
    return bars.select(*ids, "ts", "open", "close", "can_buy", "can_sell", factor.alias("factor"), signal)


def execute(bars: DataFrame, config: BacktestConfig = BacktestConfig(), keys: tuple[str, ...] = ("symbol",), chain: RuleChain | None = None) -> DataFrame:
    """One row per bar (columns ``signal`` and prices needed): equity, the fill if there was one, and what its round trips gained and lost."""
    ids = list(dict.fromkeys((*keys, "symbol")))
    lean = _lean(bars, ids, "signal", chain)
    schema = T.StructType([lean.schema[c] for c in ids] + T.StructType.fromDDL(_STEP).fields)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "symbol"], kind="stable", ignore_index=True)
        curve, fills = _account(_columns(frame), frame.signal.fillna(0).astype(int).tolist(), config)
        out = frame[ids].assign(bar_seq=np.arange(len(frame), dtype=np.int32), ts=frame.ts, **dict(zip(("equity", "cash", "market_value"), np.array(curve).reshape(-1, 3).T)))
        names = ["trade_id", "side", "price", "shares", "commission", "trade_slippage", "reason", "n_won", "won", "n_lost", "lost"]
        traded = pd.DataFrame([f[1:] for f in fills], columns=names, index=[f[0] for f in fills], dtype=object)
        return pd.concat([out, traded.reindex(out.index)], axis=1)

    return lean.groupBy(*keys).applyInPandas(run, schema)


def evaluate(bars: DataFrame, config: BacktestConfig = BacktestConfig(), keys: tuple[str, ...] = ("symbol",), chunk: int = 25, chain: RuleChain | None = None) -> DataFrame:
    """Figures of many runs over the same bars: one row for each group and entry of the array column ``signals``.

    Bars are copied once for each ``chunk`` runs only, not for each run, and a group gives back
    its figures instead of its curve.
    """
    size = F.ceil(F.size("signals") / chunk).cast("int")
    ids = list(dict.fromkeys((*keys, "symbol")))
    lean = _lean(bars, ids, "signals", chain)
    parts = lean.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))))).withColumn("signals", F.slice("signals", F.col("_chunk") * chunk + 1, chunk))
    schema = T.StructType([lean.schema[k] for k in keys] + [T.StructField("combo_idx", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in FIGURES])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "symbol"], kind="stable", ignore_index=True)
        columns, first = _columns(frame), int(frame._chunk.iloc[0]) * chunk
        rows = []
        for i, signal in enumerate(np.stack(frame.signals.to_list()).T):
            curve, fills = _account(columns, signal.tolist(), config)
            rows.append((*(frame[k].iloc[0] for k in keys), first + i, *figures(np.array([c[0] for c in curve]), fills)))
        return pd.DataFrame(rows, columns=[*keys, "combo_idx", *FIGURES])

    return parts.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def _columns(frame: pd.DataFrame) -> tuple[list, ...]:
    days = frame.ts.to_numpy().astype("datetime64[D]").astype(np.int64).tolist()
    return (frame.symbol.tolist(), days, *(frame[c].tolist() for c in ("open", "close", "can_buy", "can_sell", "factor")))


def _account(columns: tuple[list, ...], signals: list[int], c: BacktestConfig) -> tuple[list[tuple], list[tuple]]:
    """(equity, cash, market value) after every bar, and the fills with the bar they belong to."""
    cash = equity = c.initial_capital
    held: dict[str, list] = {}  # shares, entry price, day of the last buy, factor
    lots: dict[str, deque] = {}  # shares and cost of buys that aren't sold yet
    last: dict[str, float] = {}
    waiting: dict[str, int] = {}
    later, twice, sizing, lot = c.fill == "next_open", c.slippage_twice, c.sizing, c.lot
    curve, fills = [], []
    for i, (symbol, day, opened, close, can_buy, can_sell, factor, signal) in enumerate(zip(*columns, signals)):
        own = held.get(symbol)
        if own and own[3] != factor and factor > 0 and own[3] > 0 and (shares := int(own[0] / (factor / own[3]))) > 0:
            own[0], own[1], own[3] = shares, own[1] * factor / own[3], factor
        base = close
        if later:
            signal, waiting[symbol], base = waiting.get(symbol, 0), signal, opened
        if signal > 0:
            if can_buy:
                slip = base * c.slippage if twice else 0.0
                price = base * (1 + c.slippage)
                money = cash * (1 - c.reserve) if sizing == "fixed_value" else equity * c.percent if sizing == "percent" else None
                shares = int(money / price / lot) * lot if money is not None else lot
                amount = shares * price
                cost = amount * c.commission + slip * shares
                if shares > 0 and cash >= amount + cost:
                    cash -= amount + cost
                    if own:
                        own[1] = (own[0] * own[1] + amount + cost) / (own[0] + shares)
                        own[0], own[2] = own[0] + shares, day
                    else:
                        held[symbol] = [shares, price, day, factor]
                    lots.setdefault(symbol, deque()).append([shares, (amount + cost) / shares])
                    fills.append((i, f"T{len(fills) + 1:05d}", 1, price, shares, amount * c.commission, slip * shares, "buy", 0, 0.0, 0, 0.0))
        elif signal < 0 and own and can_sell and own[2] != day:
            slip = base * c.slippage if twice else 0.0
            price = base * (1 - c.slippage)
            shares = own[0]
            amount = shares * price
            cash += amount - (amount * c.commission + amount * c.stamp_tax + slip * shares)
            del held[symbol]
            net = (amount - amount * c.commission - slip * shares) / shares
            fills.append((i, f"T{len(fills) + 1:05d}", -1, price, shares, amount * c.commission, slip * shares, "sell", *_matched(lots[symbol], shares, net)))
        last[symbol] = close
        value = 0.0
        for s, p in held.items():
            value += p[0] * last[s]
        equity = cash + value
        curve.append((equity, cash, value))
    return curve, fills


def _matched(queue: deque, shares: int, net: float) -> tuple[int, float, int, float]:
    """Sell against the oldest lots: how many round trips gained and lost, and how much."""
    n_won, won, n_lost, lost = 0, 0.0, 0, 0.0
    while shares > 0 and queue:
        lot = queue[0]
        n = min(shares, lot[0])
        gain = n * (net - lot[1])
        if gain > 0:
            n_won, won = n_won + 1, won + gain
        else:
            n_lost, lost = n_lost + 1, lost - gain
        shares -= n
        lot[0] -= n
        if not lot[0]:
            queue.popleft()
    return n_won, won, n_lost, lost


def figures(equity: np.ndarray, fills: list[tuple]) -> tuple[float, ...]:
    """The values of FIGURES for one run."""
    n_won, won, n_lost, lost = (sum(f[k] for f in fills) for k in (8, 9, 10, 11))
    trips = n_won + n_lost
    rate, mean_won, mean_lost = n_won / trips if trips else 0.0, won / n_won if n_won else 0.0, lost / n_lost if n_lost else 0.0
    traded = (rate, won / lost if lost > 0 else 0.0, mean_won, mean_lost, rate * mean_won - (1 - rate) * mean_lost, float(len(fills)))
    n = len(equity)
    if n < 2:
        return (*(0.0,) * 11, *traded)
    changes = equity[1:] / equity[:-1] - 1
    total = equity[-1] / equity[0] - 1
    annual = (1 + total) ** (metrics.PERIODS / n) - 1 if 1 + total > 0 else total * metrics.PERIODS / n
    spread = lambda x: float(np.std(x, ddof=1)) * metrics.PERIODS**0.5 if len(x) > 1 else 0.0
    volatility, downside = spread(changes), spread(changes[changes < 0])
    peak = np.maximum.accumulate(equity)
    drop = (equity - peak) / peak
    deepest = float(drop.min())
    under = np.flatnonzero(np.diff(np.r_[0, (drop < -1e-12).astype(np.int8), 0]))
    lengths = under[1::2] - under[::2] - (under[1::2] == n)
    excess = annual - metrics.RISK_FREE
    return (
        equity[-1] - equity[0], total * 100, annual * 100, annual, volatility, excess / volatility if volatility > 0 else 0.0, excess / downside if downside > 0 else 0.0, deepest * 100,
        float(lengths.max(initial=0)), annual / abs(deepest) if deepest else 0.0, (equity[-1] - equity[0]) / (abs(deepest) * equity[0]) if deepest else 0.0, *traded,
    )


def equity_curve(steps: DataFrame) -> DataFrame:
    return steps.drop("trade_id", "side", "price", "shares", "commission", "trade_slippage", "reason", "n_won", "won", "n_lost", "lost")


def trades_of(steps: DataFrame) -> DataFrame:
    """The fills, as TRADES without pnl."""
    return steps.where("side IS NOT NULL").drop("equity", "cash", "market_value", "n_won", "won", "n_lost", "lost").withColumnsRenamed({"side": "signal", "trade_slippage": "slippage"}).withColumn("trade_seq", F.substring("trade_id", 2, 10).cast("int"))
