"""Technical indicators as functions from bars to bars with more columns.

Rolling indicators are window expressions that share one sort. Averages with an exponential
memory are linear recurrences and window expressions too (``decayed``); only the cycle measures
run symbol by symbol in grouped maps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.windows import KEYS, diff, lag, ratio, roll, running, series, trailing


def C() -> Column:  # noqa: N802
    return F.col("close")


def H() -> Column:  # noqa: N802
    return F.col("high")


def L() -> Column:  # noqa: N802
    return F.col("low")


def O() -> Column:  # noqa: N802, E743
    return F.col("open")


def V() -> Column:  # noqa: N802
    return F.col("volume")


def typical() -> Column:
    return (H() + L() + C()) / 3


def _stage(bars: DataFrame, *steps: dict[str, Column], drop: bool = True) -> DataFrame:
    """Add columns step by step; those whose names begin with _ don't stay."""
    for columns in steps:
        bars = bars.withColumns(columns)
    return bars.drop(*(c for columns in steps for c in columns if c.startswith("_"))) if drop else bars


# -- rolling -----------------------------------------------------------------------------------


def sma(bars: DataFrame, period: int = 14, column: str = "close", name: str = "sma") -> DataFrame:
    return bars.withColumn(name, roll(F.avg, F.col(column), period))


def wma(bars: DataFrame, period: int = 14) -> DataFrame:
    """Weights rise from 1 for the oldest bar to the period for the latest."""
    weighted = sum(((period - i) * lag(C(), i) for i in range(1, period)), period * C())
    return bars.withColumn("wma", F.when(F.count(C()).over(trailing(period)) == period, weighted / (period * (period + 1) / 2)))


def trima(bars: DataFrame, period: int = 14) -> DataFrame:
    inner, outer = ((period + 1) // 2,) * 2 if period % 2 else (period // 2, period // 2 + 1)
    return _stage(bars, {"_inner": roll(F.avg, C(), inner)}, {"trima": roll(F.avg, F.col("_inner"), outer)})


def _gain_loss(period: int, f=F.avg) -> list[dict[str, Column]]:
    return [
        {"_change": diff(C())},
        {"_up": F.when(F.col("_change") > 0, F.col("_change")).otherwise(0.0), "_down": F.when(F.col("_change") < 0, -F.col("_change")).otherwise(0.0)},
        {"_gain": roll(f, F.col("_up"), period), "_loss": roll(f, F.col("_down"), period)},
    ]


def _rsi(gain: Column, loss: Column) -> Column:
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """From simple means of gains and losses; no losses give 100, no change at all null."""
    return _stage(bars, *_gain_loss(period), {"rsi": _rsi(F.col("_gain"), F.col("_loss"))})


def cmo(bars: DataFrame, period: int = 14) -> DataFrame:
    gain, loss = F.col("_gain"), F.col("_loss")
    return _stage(bars, *_gain_loss(period, F.sum), {"cmo": 100 * ratio(gain - loss, gain + loss)})


def bbands(bars: DataFrame, period: int = 14, nbdev: float = 2.0) -> DataFrame:
    middle, spread = F.col("middleband"), F.col("_spread")
    return _stage(bars, {"middleband": roll(F.avg, C(), period), "_spread": nbdev * roll(F.stddev_samp, C(), period)}, {"upperband": middle + spread, "lowerband": middle - spread})


def _true_range() -> Column:
    before = lag(C())
    return F.greatest(H() - L(), F.abs(H() - before), F.abs(L() - before))  # skips nulls, so the first bar has high - low


def trange(bars: DataFrame) -> DataFrame:
    return bars.withColumn("trange", _true_range())


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    return _stage(bars, {"_tr": _true_range()}, {"atr": roll(F.avg, F.col("_tr"), period)})


def natr(bars: DataFrame, period: int = 14) -> DataFrame:
    return _stage(bars, {"_tr": _true_range()}, {"natr": 100 * ratio(roll(F.avg, F.col("_tr"), period), C())})


def _directional(period: int) -> list[dict[str, Column]]:
    up, down = diff(H()), -diff(L())
    rises = {"_tr": _true_range(), "_pdm": F.when(up.isNotNull(), F.greatest(up, F.lit(0.0))), "_mdm": F.when(down.isNotNull(), F.greatest(down, F.lit(0.0)))}
    means = {f"_m{c}": roll(F.avg, F.col(f"_{c}"), period) for c in ("tr", "pdm", "mdm")}
    return [rises, means, {"_pdi": 100 * ratio(F.col("_mpdm"), F.col("_mtr")), "_mdi": 100 * ratio(F.col("_mmdm"), F.col("_mtr"))}]


def _dx() -> Column:
    p, m = F.col("_pdi"), F.col("_mdi")
    return 100 * ratio(F.abs(p - m), p + m)


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    return _stage(bars, *_directional(period), {"_dx": _dx()}, {"adx": roll(F.avg, F.col("_dx"), period)})


def dx(bars: DataFrame, period: int = 14) -> DataFrame:
    return _stage(bars, *_directional(period), {"dx": _dx()})


def directional(bars: DataFrame, period: int = 14) -> DataFrame:
    """plus_di, minus_di and the rolling means of the directional movements."""
    return _stage(bars, *_directional(period), {"plus_di": F.col("_pdi"), "minus_di": F.col("_mdi"), "plus_dm": F.col("_mpdm"), "minus_dm": F.col("_mmdm")})


def cci(bars: DataFrame, period: int = 14) -> DataFrame:
    """Deviation of the typical price from its mean, over the mean absolute deviation in the same window."""
    near = F.collect_list("_tp").over(trailing(period))
    spread = F.aggregate(near, F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_mean"))) / period
    return _stage(bars, {"_tp": typical()}, {"_mean": roll(F.avg, F.col("_tp"), period)}, {"cci": F.when(F.col("_mean").isNotNull(), ratio(F.col("_tp") - F.col("_mean"), 0.015 * spread))})


def _range_position(period: int, x: Column | None = None, high: Column | None = None, low: Column | None = None) -> Column:
    x, high, low = (given if given is not None else own() for given, own in ((x, C), (high, H), (low, L)))
    top, bottom = roll(F.max, high, period), roll(F.min, low, period)
    return 100 * ratio(x - bottom, top - bottom)


def stoch(bars: DataFrame, fastk: int = 14, slowk: int = 3, slowd: int = 3) -> DataFrame:
    return _stage(bars, {"_k": _range_position(fastk)}, {"slowk": roll(F.avg, F.col("_k"), slowk)}, {"slowd": roll(F.avg, F.col("slowk"), slowd)})


def stochf(bars: DataFrame, fastk: int = 14, fastd: int = 3) -> DataFrame:
    return _stage(bars, {"fastk": _range_position(fastk)}, {"fastd": roll(F.avg, F.col("fastk"), fastd)})


def stochrsi(bars: DataFrame, period: int = 14, fastk: int = 14, fastd: int = 3) -> DataFrame:
    r = F.col("_rsi")
    return _stage(bars, *_gain_loss(period), {"_rsi": _rsi(F.col("_gain"), F.col("_loss"))}, {"fastk": _range_position(fastk, r, r, r)}, {"fastd": roll(F.avg, F.col("fastk"), fastd)})


def mom(bars: DataFrame, period: int = 14) -> DataFrame:
    return bars.withColumn("mom", diff(C(), period))


def roc(bars: DataFrame, period: int = 14) -> DataFrame:
    return bars.withColumn("roc", 100 * (ratio(C(), lag(C(), period)) - 1))


def rocr(bars: DataFrame, period: int = 14) -> DataFrame:
    return bars.withColumn("rocr", ratio(C(), lag(C(), period)))


def willr(bars: DataFrame, period: int = 14) -> DataFrame:
    top, bottom = roll(F.max, H(), period), roll(F.min, L(), period)
    return bars.withColumn("willr", -100 * ratio(top - C(), top - bottom))


def mfi(bars: DataFrame, period: int = 14) -> DataFrame:
    tp, move = F.col("_tp"), F.col("_move")
    flows = {"_in": F.when(move > 0, tp * V()).otherwise(0.0), "_out": F.when(move < 0, tp * V()).otherwise(0.0)}
    return _stage(bars, {"_tp": typical()}, {"_move": diff(tp)}, flows, {"_i": roll(F.sum, F.col("_in"), period), "_o": roll(F.sum, F.col("_out"), period)}, {"mfi": _rsi(F.col("_i"), F.col("_o"))})


def obv(bars: DataFrame) -> DataFrame:
    sign = F.when(F.col("_d") > 0, V()).when(F.col("_d") < 0, -V()).otherwise(0.0)
    return _stage(bars, {"_d": diff(C())}, {"_signed": sign}, {"obv": F.sum("_signed").over(running())})


def vwap(bars: DataFrame, period: int = 20) -> DataFrame:
    return _stage(bars, {"_pv": typical() * V()}, {"vwap": ratio(roll(F.sum, F.col("_pv"), period), roll(F.sum, V(), period))})


def pivot(bars: DataFrame) -> DataFrame:
    p = F.col("pivot")
    return _stage(bars, {"pivot": typical()}, {"resistance1": 2 * p - L(), "support1": 2 * p - H(), "resistance2": p + (H() - L()), "support2": p - (H() - L())})


FIBO_LEVELS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)  # fixed values


def fibo(bars: DataFrame, lookback: int = 100) -> DataFrame:
    top, bottom = F.col("_top"), F.col("_bottom")
    return _stage(bars, {"_top": roll(F.max, H(), lookback), "_bottom": roll(F.min, L(), lookback)}, {f"fib_{x}".replace(".", "_"): top - x * (top - bottom) for x in FIBO_LEVELS})


def stddev(bars: DataFrame, period: int = 14, nbdev: float = 1.0) -> DataFrame:
    return bars.withColumn("stddev", nbdev * roll(F.stddev_pop, C(), period))


def var(bars: DataFrame, period: int = 14) -> DataFrame:
    return bars.withColumn("var", roll(F.var_pop, C(), period))


def bop(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bop", ratio(C() - O(), H() - L()))


def _money_flow() -> Column:
    return F.coalesce(ratio((C() - L()) - (H() - C()), H() - L()), F.lit(0.0)) * V()


def ad(bars: DataFrame) -> DataFrame:
    return _stage(bars, {"_flow": _money_flow()}, {"ad": F.sum("_flow").over(running())})


def ultosc(bars: DataFrame, short: int = 7, middle: int = 14, long: int = 28) -> DataFrame:
    """Buying pressure over true range in three windows; the first bar has neither."""
    before = lag(C())
    parts = {"_bp": F.when(before.isNotNull(), C() - F.least(L(), before)), "_tr": F.when(before.isNotNull(), _true_range())}
    share = {f"_s{n}": ratio(roll(F.sum, F.col("_bp"), n), roll(F.sum, F.col("_tr"), n)) for n in (short, middle, long)}
    return _stage(bars, parts, share, {"ultosc": 100 * (4 * F.col(f"_s{short}") + 2 * F.col(f"_s{middle}") + F.col(f"_s{long}")) / 7})


def aroon(bars: DataFrame, period: int = 14) -> DataFrame:
    """How long ago, of period + 1 bars, the highest high and the lowest low were; the latest of equals counts."""
    w = trailing(period + 1)
    full = F.count(C()).over(w) == period + 1
    at = F.col("_n")
    highest, lowest = (F.max(F.struct(x.alias("x"), at.alias("n"))).over(w)["n"] for x in (H(), -L()))
    staged = _stage(bars, {"_n": F.row_number().over(series())}, {"aroon_up": F.when(full, 100.0 * (period - (at - highest)) / period), "aroon_down": F.when(full, 100.0 * (period - (at - lowest)) / period)})
    return staged.withColumn("aroonosc", F.col("aroon_up") - F.col("aroon_down"))


def linearreg(bars: DataFrame, period: int = 14) -> DataFrame:
    """Least squares line over the last bars: its end, slope, angle, start and next value."""
    n, w = F.col("_n").cast("double"), trailing(period)
    full = F.count(C()).over(w) == period
    slope = F.when(full, F.regr_slope(C(), n).over(w))
    m, mean = F.col("linearreg_slope"), F.avg(C()).over(w)
    start = mean - m * (period - 1) / 2
    return _stage(bars, {"_n": F.row_number().over(series())}, {"linearreg_slope": slope}, {"linearreg_intercept": start, "linearreg": start + m * (period - 1), "tsf": start + m * period, "linearreg_angle": F.degrees(F.atan(m))})


def correl(bars: DataFrame, period: int = 30) -> DataFrame:
    return bars.withColumn("correl", F.when(F.count(C()).over(trailing(period)) == period, F.corr(H(), L()).over(trailing(period))))


def prices(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"avgprice": (O() + H() + L() + C()) / 4, "medprice": (H() + L()) / 2, "typprice": typical(), "wclprice": (H() + L() + 2 * C()) / 4})


# -- recursive ---------------------------------------------------------------------------------


def per_series(bars: DataFrame, outputs: list[str], f: Callable[[pd.DataFrame], dict[str, np.ndarray]], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Add columns that f computes from one series of bars in time order.

    A series is one task, whatever its length.
    """
    schema = T.StructType(bars.schema.fields + [T.StructField(c, T.DoubleType()) for c in outputs])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable", ignore_index=True)
        return frame.assign(**{c: pd.Series(x, dtype="float64") for c, x in f(frame).items()})

    return bars.groupBy(*keys).applyInPandas(run, schema)


_REACH = 45.0  # what lies behind so much decay weighs less than 1e-19; in a block exponents stay small, and so their errors


def decayed(bars: DataFrame, wanted: dict[str, tuple[Column, Column | float]]) -> DataFrame:
    """Add exponential means: each is p * x + (1 - p) * the mean before, from the first x on, for (x, p) under its name.

    A mean is a linear recurrence. The decay is added up along a series and cut into blocks of ``_REACH``; in a block the
    mean is a running sum of values weighted by how little they have decayed since, and of the blocks before only
    the end of the last one matters. So these are window functions, with no loop over bars.
    A null x leaves the mean as it is. p may differ from bar to bar, but is below 1, unless it is 1 throughout.
    """
    w, run = series(), running()
    plain = {n: x for n, (x, p) in wanted.items() if isinstance(p, (int, float)) and p >= 1}
    bars = bars.withColumns({n: F.last(x, True).over(run) for n, x in plain.items()})
    rest = {n: v for n, v in wanted.items() if n not in plain}
    if not rest:
        return bars
    col = lambda n, what: F.col(f"_{n}_{what}")
    block = lambda n: Window.partitionBy(*KEYS, f"_{n}_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first = {n: F.count(x).over(run) == 1 for n, (x, _) in rest.items()}
    lost = {n: F.when(x.isNotNull() & ~first[n], -F.ln(1 - (F.lit(float(p)) if isinstance(p, (int, float)) else p))).otherwise(0.0) for n, (x, p) in rest.items()}
    weighted = {n: F.when(first[n], x).otherwise(x * p) for n, (x, p) in rest.items()}
    steps = [
        {f"_{n}_lost": lost[n] for n in rest} | {f"_{n}_x": weighted[n] for n in rest},
        {f"_{n}_cum": F.sum(f"_{n}_lost").over(run) for n in rest},
        {f"_{n}_block": F.floor(col(n, "cum") / _REACH) for n in rest},
        {f"_{n}_next": F.lead(f"_{n}_block").over(w) for n in rest},
        {f"_{n}_in": F.sum(f"_{n}_lost").over(block(n)) for n in rest},
        {f"_{n}_own": F.exp(-col(n, "in")) * F.sum(col(n, "x") * F.exp(col(n, "in"))).over(block(n)) for n in rest},
        {f"_{n}_end": F.last(F.when(col(n, "next") > col(n, "block"), col(n, "own")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n in rest},
        {n: col(n, "own") + F.coalesce(F.exp(-col(n, "in")) * col(n, "end"), F.lit(0.0)) for n in rest},
    ]
    return _stage(bars, *steps[:-1], steps[-1], drop=False).drop(*{f"_{n}_{what}" for n in rest for what in ("lost", "x", "cum", "block", "next", "in", "own", "end")})


def _rate(period: int) -> float:
    return 2 / (period + 1)


def _chain(bars: DataFrame, x: Column, period: int, times: int, name: str = "_e") -> DataFrame:
    """Add the exponential mean, its mean, and so on, as name1, name2, ..."""
    for i in range(1, times + 1):
        bars = decayed(bars, {f"{name}{i}": (x, _rate(period))})
        x = F.col(f"{name}{i}")
    return bars


def _chained(bars: DataFrame, period: int, times: int, outputs: dict[str, Column]) -> DataFrame:
    """Columns made of chained means of the close."""
    return _chain(bars, C(), period, times).withColumns(outputs).drop(*(f"_e{i}" for i in range(1, times + 1)))


def E(i: int) -> Column:  # noqa: N802
    return F.col(f"_e{i}")


def ema(bars: DataFrame, period: int = 14) -> DataFrame:
    """Starts from the first value."""
    return decayed(bars, {"ema": (C(), _rate(period))})


def _fast_slow(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    return decayed(bars, {"_fast": (C(), _rate(fast)), "_slow": (C(), _rate(slow))})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    line = _fast_slow(bars, fast, slow).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return decayed(line, {"macdsignal": (F.col("macd"), _rate(signal))}).withColumn("macdhist", F.col("macd") - F.col("macdsignal"))


def _smoothed(bars: DataFrame, column: str, period: int, kind: int, name: str) -> DataFrame:
    """The column's mean of a kind: 0 plain, 1 exponential, 2 weighted, 3 and 4 double and triple exponential."""
    if kind == 0:
        return sma(bars, period, column, name)
    if kind == 2:
        weighted = sum((F.lag(column, period - i).over(series()) * float(i) for i in range(1, period)), F.col(column) * float(period))
        return bars.withColumn(name, weighted / (period * (period + 1) / 2))
    if kind not in (1, 3, 4):
        raise ValueError(f"{kind} is no kind of mean")
    times, value = {1: (1, E(1)), 3: (2, 2 * E(1) - E(2)), 4: (3, 3 * E(1) - 3 * E(2) + E(3))}[kind]
    return _chain(bars, F.col(column), period, times).withColumn(name, value).drop(*(f"_e{i}" for i in range(1, times + 1)))


def macdext(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, fast_kind: int = 0, slow_kind: int = 0, signal_kind: int = 0) -> DataFrame:
    """MACD over means of any kind."""
    both = _smoothed(_smoothed(bars, "close", fast, fast_kind, "_fast"), "close", slow, slow_kind, "_slow")
    line = both.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return _smoothed(line, "macd", signal, signal_kind, "macdsignal").withColumn("macdhist", F.col("macd") - F.col("macdsignal"))


def dema(bars: DataFrame, period: int = 14) -> DataFrame:
    return _chained(bars, period, 2, {"dema": 2 * E(1) - E(2)})


def tema(bars: DataFrame, period: int = 14) -> DataFrame:
    return _chained(bars, period, 3, {"tema": 3 * E(1) - 3 * E(2) + E(3)})


def t3(bars: DataFrame, period: int = 14, v: float = 0.7) -> DataFrame:
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2
    return _chained(bars, period, 6, {"t3": c1 * E(6) + c2 * E(5) + c3 * E(4) + c4 * E(3)})


def trix(bars: DataFrame, period: int = 14) -> DataFrame:
    return _chained(bars, period, 3, {"trix": 100 * (ratio(E(3), lag(E(3))) - 1)})


def ppo(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    return _fast_slow(bars, fast, slow).withColumn("ppo", 100 * ratio(F.col("_fast") - F.col("_slow"), F.col("_slow"))).drop("_fast", "_slow")


def apo(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    return _fast_slow(bars, fast, slow).withColumn("apo", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def keltner(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """An exponential mean of typical prices, and two mean true ranges on either side."""
    ranged = decayed(_stage(bars, {"_tr": _true_range()}, {"_atr": roll(F.avg, F.col("_tr"), period)}, drop=False), {"_middle": (typical(), _rate(period))})
    middle, reach = F.col("_middle"), width * F.col("_atr")
    return ranged.withColumns({"keltner_upper": middle + reach, "keltner_middle": middle, "keltner_lower": middle - reach}).drop("_tr", "_atr", "_middle")


def adosc(bars: DataFrame, fast: int = 3, slow: int = 10) -> DataFrame:
    both = decayed(ad(bars), {"_fast": (F.col("ad"), _rate(fast)), "_slow": (F.col("ad"), _rate(slow))})
    return both.withColumn("adosc", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow", "ad")


def kama(bars: DataFrame, period: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman's adaptive mean: it follows faster the straighter the way of the last bars was."""
    moved = F.abs(C() - lag(C(), period))
    straight = F.when(F.col("_path") > 0, moved / F.col("_path")).otherwise(0.0)
    pace = F.pow(F.col("_straight") * (_rate(fast) - _rate(slow)) + _rate(slow), 2)
    told = _stage(bars, {"_step": F.abs(diff(C())), "_n": F.row_number().over(series())}, {"_path": roll(F.sum, F.col("_step"), period)}, {"_straight": straight}, drop=False)
    begun = decayed(told, {"_mean": (F.when(F.col("_n") >= period, C()), pace)})  # the value before the first mean is the close
    return begun.withColumn("kama", F.when(F.col("_n") > period, F.col("_mean"))).drop("_step", "_n", "_path", "_straight", "_mean")


HILBERT = ("ht_dcperiod", "ht_dcphase", "ht_inphase", "ht_quadrature", "ht_sine", "ht_leadsine", "ht_trendline", "ht_trendmode", "mama", "fama")


def hilbert(bars: DataFrame, fast_limit: float = 0.5, slow_limit: float = 0.05) -> DataFrame:
    """Cycle measures after Ehlers: period, phase, phasor, sine and lead sine, trend line and mode, MAMA and FAMA."""

    def f(b):
        return dict(zip(HILBERT, _cycles(((b.high + b.low) / 2).to_numpy(), fast_limit, slow_limit).T))

    return per_series(bars, list(HILBERT), f)


def _cycles(price: np.ndarray, fast_limit: float, slow_limit: float) -> np.ndarray:
    n = len(price)
    names = "smooth detrend i1 q1 ji jq i2 q2 re im period soft phase dc sine lead trend mama fama".split()
    s = {k: np.zeros(n) for k in names}
    out = np.full((n, len(HILBERT)), np.nan)
    quiet = 0

    def turned(x: np.ndarray, i: int) -> float:
        return (0.0962 * x[i] + 0.5769 * x[i - 2] - 0.5769 * x[i - 4] - 0.0962 * x[i - 6]) * (0.075 * s["period"][i - 1] + 0.54)

    for i in range(n):
        if i < 6:
            for k in ("mama", "fama", "trend", "smooth"):
                s[k][i] = price[i]
            continue
        s["smooth"][i] = (4 * price[i] + 3 * price[i - 1] + 2 * price[i - 2] + price[i - 3]) / 10
        s["detrend"][i] = turned(s["smooth"], i)
        s["q1"][i], s["i1"][i] = turned(s["detrend"], i), s["detrend"][i - 3]
        s["ji"][i], s["jq"][i] = turned(s["i1"], i), turned(s["q1"], i)
        s["i2"][i] = 0.2 * (s["i1"][i] - s["jq"][i]) + 0.8 * s["i2"][i - 1]
        s["q2"][i] = 0.2 * (s["q1"][i] + s["ji"][i]) + 0.8 * s["q2"][i - 1]
        s["re"][i] = 0.2 * (s["i2"][i] * s["i2"][i - 1] + s["q2"][i] * s["q2"][i - 1]) + 0.8 * s["re"][i - 1]
        s["im"][i] = 0.2 * (s["i2"][i] * s["q2"][i - 1] - s["q2"][i] * s["i2"][i - 1]) + 0.8 * s["im"][i - 1]
        before = s["period"][i - 1]
        period = 2 * math.pi / angle if s["re"][i] and s["im"][i] and (angle := math.atan(s["im"][i] / s["re"][i])) else before
        period = min(max(period, 0.67 * before), 1.5 * before) if before else period
        s["period"][i] = 0.2 * min(max(period, 6.0), 50.0) + 0.8 * before
        s["soft"][i] = 0.33 * s["period"][i] + 0.67 * s["soft"][i - 1]
        turn = math.degrees(math.atan(s["q1"][i] / s["i1"][i])) if s["i1"][i] else 0.0
        s["phase"][i] = turn
        pace = min(max(fast_limit / max(s["phase"][i - 1] - turn, 1.0), slow_limit), fast_limit)
        s["mama"][i] = pace * price[i] + (1 - pace) * s["mama"][i - 1]
        s["fama"][i] = 0.5 * pace * s["mama"][i] + (1 - 0.5 * pace) * s["fama"][i - 1]
        span = max(1, min(int(s["soft"][i] + 0.5), i + 1))
        back = s["smooth"][i - span + 1 : i + 1][::-1]
        angles = 2 * math.pi * np.arange(span) / span
        real, imag = float(np.sin(angles) @ back), float(np.cos(angles) @ back)
        dc = math.degrees(math.atan(real / imag)) if abs(imag) > 0.001 else 90.0 * ((real > 0) - (real < 0))
        dc += 90 + (360 / s["soft"][i] if s["soft"][i] else 0.0) + 180 * (imag < 0)
        s["dc"][i] = dc - 360 * (dc > 315)
        s["sine"][i], s["lead"][i] = math.sin(math.radians(s["dc"][i])), math.sin(math.radians(s["dc"][i] + 45))
        s["trend"][i] = price[max(0, i - span + 1) : i + 1].mean()
        crossed = (s["sine"][i] > s["lead"][i]) != (s["sine"][i - 1] > s["lead"][i - 1])
        quiet = 0 if crossed else quiet + 1
        step, period = s["dc"][i] - s["dc"][i - 1], s["soft"][i]
        cyclic = quiet < 0.5 * period or (period and 0.67 * 360 / period < step < 1.5 * 360 / period)
        out[i] = (s["soft"][i], s["dc"][i], s["i1"][i], s["q1"][i], s["sine"][i], s["lead"][i], s["trend"][i], 0.0 if cyclic else 1.0, s["mama"][i], s["fama"][i])
    return out
