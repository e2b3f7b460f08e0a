"""Indicators by name: built-in ones, formulas, and whatever a user registers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quantloom.operators import ashare, indicators


class IndicatorError(ValueError):
    pass


@dataclass(frozen=True)
class Param:
    """A parameter's type and range."""

    kind: type
    low: float | None = None
    high: float | None = None

    def checked(self, name: str, value):
        try:
            value = self.kind(value)
        except (TypeError, ValueError) as e:
            raise IndicatorError(f"{name}: {value!r} is no {self.kind.__name__}") from e
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise IndicatorError(f"{name}: {value!r} isn't within {self.low} and {self.high}")
        return value


@dataclass
class Entry:
    compute: Callable[..., DataFrame]
    params: dict[str, Param] = field(default_factory=dict)
    columns: tuple[str, ...] = ()  # what it adds, where the function adds more; the first stands for it in a strategy


PERIOD = {"period": Param(int, 1, 100_000)}


class Registry:
    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def register(self, name: str, compute: Callable[..., DataFrame], params: dict[str, Param] | None = None, columns: tuple[str, ...] = ()) -> None:
        """``compute(bars, **params)`` gives bars with more columns; ``columns`` names those that belong to the indicator, if not all do."""
        self._entries[name.upper()] = Entry(compute, params or {}, columns)

    def get(self, name: str) -> Entry:
        try:
            return self._entries[name.upper()]
        except KeyError:
            raise IndicatorError(f"there is no indicator {name}") from None

    def list(self) -> list[str]:
        return sorted(self._entries)

    def outputs(self, name: str, bars: DataFrame, **params) -> list[str]:
        """The columns that an indicator adds."""
        return [c for c in self.compute(name, bars, **params).columns if c not in bars.columns]

    def compute(self, name: str, bars: DataFrame, **params) -> DataFrame:
        """Bars with the indicator's columns; nothing runs until the result is used, and equal expressions are shared by the plan."""
        entry = self.get(name)
        if "timeperiod" in params:
            params["period"] = params.pop("timeperiod")
        wide = entry.compute(bars, **{k: entry.params[k].checked(k, v) if k in entry.params else v for k, v in params.items()})
        return wide.select(*(c for c in bars.columns if c not in entry.columns), *entry.columns) if entry.columns else wide


def default_registry() -> Registry:
    own = Registry()
    with_period = "sma wma trima rsi cmo atr natr adx dx cci stochrsi mom roc rocr willr mfi vwap stddev var correl ema dema tema t3 trix keltner kama".split()
    for name in with_period:
        own.register(name, getattr(indicators, name), PERIOD)
    for name in "trange stoch stochf obv pivot fibo bop ad ultosc macd macdext ppo apo adosc hilbert prices directional".split():
        own.register(name, getattr(indicators, name))
    parts = {  # indicators that are some columns of a function, or have them in another order
        "bbands": ("bbands", "upperband middleband lowerband"),
        "aroon": ("aroon", "aroon_down aroon_up"), "aroonosc": ("aroon", "aroonosc"),
        "linearreg": ("linearreg", "linearreg"), "linearreg_slope": ("linearreg", "linearreg_slope"), "linearreg_angle": ("linearreg", "linearreg_angle"), "linearreg_intercept": ("linearreg", "linearreg_intercept"), "tsf": ("linearreg", "tsf"),
        "plus_di": ("directional", "plus_di"), "minus_di": ("directional", "minus_di"), "plus_dm": ("directional", "plus_dm"), "minus_dm": ("directional", "minus_dm"),
        "avgprice": ("prices", "avgprice"), "medprice": ("prices", "medprice"), "typprice": ("prices", "typprice"), "wclprice": ("prices", "wclprice"),
        "ht_dcperiod": ("hilbert", "ht_dcperiod"), "ht_dcphase": ("hilbert", "ht_dcphase"), "ht_phasor": ("hilbert", "ht_inphase ht_quadrature"), "ht_sine": ("hilbert", "ht_sine ht_leadsine"),
        "ht_trendline": ("hilbert", "ht_trendline"), "ht_trendmode": ("hilbert", "ht_trendmode"), "mama": ("hilbert", "mama fama"),
    }
    for name, (whole, columns) in parts.items():
        own.register(name, getattr(indicators, whole), PERIOD if whole in ("bbands", "aroon", "linearreg", "directional") else None, tuple(columns.split()))
    for names, f in ((("AShareCapitalFlow", "CapitalFlow"), ashare.capital_flow), (("ChipDistribution", "CYQ"), ashare.chip_concentration), (("LimitUpProbability", "LimitUpProb"), ashare.limit_up_probability), (("BoardEffect", "SectorEffect"), ashare.board_effect), (("TurnoverZScore", "TurnoverAnomaly"), ashare.turnover_zscore), (("MainForceIndicator", "MainForce"), ashare.main_force)):
        for name in names:
            own.register(name, f)
    return own
