"""Formula indicators: arithmetic over bar columns and rolling functions, turned into columns.

A formula is read by Python's own parser and checked against a list of what is allowed; nothing
in it is ever evaluated as code.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.math import protected_log
from quantloom.functions.windows import lag, ratio, roll
from quantloom.operators.indicators import decayed
from quantloom.operators.registry import IndicatorError

# What a formula may name.
COLUMNS = ("open", "high", "low", "close", "volume", "amount", "turnover_rate")
FUNCTIONS = ("sma", "ema", "std", "min", "max", "abs", "log", "sqrt", "pct_change", "shift", "zscore")


class Formula:
    """A checked formula. ``params`` are numbers that it may name; a column of the same name goes first."""

    def __init__(self, text: str, params: dict[str, float] | None = None):
        try:
            self.tree = ast.parse(text, mode="eval").body
        except SyntaxError as e:
            raise IndicatorError(f"{text!r} is no formula") from e
        self.text, self.params = text, dict(params or {})
        for name, x in self.params.items():
            if isinstance(x, bool) or not isinstance(x, int | float):
                raise IndicatorError(f"{name}: {x!r} is no number")
        self._check(self.tree)

    def _check(self, node: ast.AST) -> None:
        match node:
            case ast.Constant(value=int() | float()):
                return
            case ast.Name(id=name) if name in COLUMNS or name in self.params:
                return
            case ast.UnaryOp(op=ast.USub() | ast.UAdd(), operand=x):
                return self._check(x)
            case ast.BinOp(left=a, op=ast.Add() | ast.Sub() | ast.Mult() | ast.Div() | ast.Pow(), right=b):
                self._check(a)
                return self._check(b)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS and args:
                for x in args:
                    self._check(x)
                return
        raise IndicatorError(f"{ast.unparse(node)!r} isn't allowed in a formula")

    def apply(self, bars: DataFrame, name: str) -> DataFrame:
        """Bars with the formula's value; windows over windows become columns of their own on the way."""
        stages: list[str] = []

        def kept(value: Column) -> Column:
            nonlocal bars
            stages.append(f"_{name}_{len(stages)}")
            bars = bars.withColumn(stages[-1], value)
            return F.col(stages[-1])

        def fixed(node: ast.AST) -> float | None:
            """The value of a number or a parameter."""
            if isinstance(node, ast.Name) and node.id not in COLUMNS:
                return self.params[node.id]
            return node.value if isinstance(node, ast.Constant) else None

        def number(node: ast.AST) -> int:
            x = fixed(node)
            if x is not None and (isinstance(x, int) or isinstance(node, ast.Name)) and int(x) > 0:
                return int(x)
            raise IndicatorError(f"{ast.unparse(node)!r} must be a positive whole number")

        def smooth(x: Column, n: int) -> Column:
            nonlocal bars
            kept(x)
            column, out = stages[-1], f"_{name}_{len(stages)}"
            stages.append(out)
            bars = decayed(bars, {out: (F.col(column), 2 / (n + 1))})
            return F.col(out)

        def value(node: ast.AST) -> Column:
            match node:
                case ast.Constant(value=x):
                    return F.lit(float(x))
                case ast.Name(id=c) if c in COLUMNS:
                    return F.col(c).cast("double")
                case ast.Name(id=c):
                    return F.lit(float(self.params[c]))
                case ast.UnaryOp(op=op, operand=x):
                    return -value(x) if isinstance(op, ast.USub) else value(x)
                case ast.BinOp(left=a, op=op, right=b):
                    a, b = value(a), value(b)
                    match op:
                        case ast.Add():
                            return a + b
                        case ast.Sub():
                            return a - b
                        case ast.Mult():
                            return a * b
                        case ast.Div():
                            return ratio(a, b)
                    return F.pow(a, b)
                case ast.Call(func=ast.Name(id=f), args=args):
                    return call(f, args)
            raise IndicatorError(ast.unparse(node))

        def call(f: str, args: list[ast.expr]) -> Column:
            x = value(args[0])
            match f, len(args):
                case ("abs", 1):
                    return F.abs(x)
                case ("log", 1):
                    return protected_log(x, 1e-12)
                case ("sqrt", 1):
                    return F.sqrt(F.abs(x))
                case (("min" | "max"), 2) if fixed(args[0]) is None and fixed(args[1]) is not None:
                    return kept(roll(getattr(F, f), kept(x), number(args[1])))
                case (("min" | "max"), n) if n > 1:
                    return (F.least if f == "min" else F.greatest)(x, *(value(a) for a in args[1:]))
                case ("sma", 2):
                    return kept(roll(F.avg, kept(x), number(args[1])))
                case ("std", 2):
                    return kept(roll(F.stddev_samp, kept(x), number(args[1])))
                case ("ema", 2):
                    return smooth(x, number(args[1]))
                case (("shift" | "pct_change" | "zscore"), (1 | 2)):
                    n = number(args[1]) if len(args) == 2 else 20 if f == "zscore" else 1
                    x = kept(x)
                    if f == "shift":
                        return kept(lag(x, n))
                    if f == "pct_change":
                        return kept(ratio(x, lag(x, n)) - 1)
                    return kept(ratio(x - roll(F.avg, x, n), roll(F.stddev_samp, x, n)))
            raise IndicatorError(f"{f} with {len(args)} arguments")

        result = value(self.tree)
        return bars.withColumn(name, result).drop(*stages)


@dataclass(frozen=True)
class Listing:
    """A formula in the catalog."""

    name: str
    display_name: str
    formula: str
    description: str = ""
    category: str = "custom"
    tags: tuple[str, ...] = ()
    rating: float = 0.0
    downloads: int = 0
    status: str = "draft"
    author: str = "user"
    params: tuple[tuple[str, float], ...] = ()


# The formulas of the three ready-made indicators.
BUILT_IN = (
    Listing("CapitalPressureScore", "Capital pressure", "zscore(pct_change(amount, 1), 20) + (close - low) / (high - low + 0.000001)", "Change of money traded and place of the close", "flow", ("amount", "short term"), 4.7, 1280, "active", "system"),
    Listing("TrendVolumeConfirm", "Trend confirmed by volume", "(sma(close, 10) - sma(close, 30)) / close + volume / sma(volume, 20)", "A trend with rising volume", "trend", ("trend", "volume"), 4.5, 970, "active", "system"),
    Listing("RangeSqueeze", "Range squeeze", "std(close, 20) / sma(close, 20) + sma(high - low, 10) / close", "Narrow ranges before a breakout", "volatility", ("range", "breakout"), 4.3, 812, "active", "system"),
)


@dataclass
class Marketplace:
    """A catalog of formulas, kept on the driver."""

    listings: dict[str, Listing] = field(default_factory=lambda: {x.name: x for x in BUILT_IN})

    def create(self, listing: Listing) -> Listing:
        Formula(listing.formula, dict(listing.params))
        self.listings[listing.name] = replace(listing, status="draft", downloads=0)
        return self.listings[listing.name]

    def get(self, name: str) -> Listing:
        return self.listings[name]

    def install(self, name: str, **params: float) -> Formula:
        """The formula with its own parameters, but for those that are given."""
        listing = self.listings[name] = replace(self.listings[name], downloads=self.listings[name].downloads + 1)
        return Formula(listing.formula, dict(listing.params) | params)

    def search(self, text: str = "", category: str | None = None) -> list[Listing]:
        """Active ones first, then by falling rating and name."""
        text = text.lower()
        found = [x for x in self.listings.values() if (category is None or x.category == category) and any(text in s.lower() for s in (x.name, x.display_name, x.description, *x.tags))]
        return sorted(found, key=lambda x: (x.status != "active", -x.rating, x.display_name))


def search_listings(catalog: DataFrame, text: str, category: str | None = None) -> DataFrame:
    """The same search over a catalog table with the columns of Listing."""
    wanted = text.lower()
    hit = F.lower("name").contains(wanted) | F.lower("display_name").contains(wanted) | F.lower("description").contains(wanted) | F.exists("tags", lambda t: F.lower(t).contains(wanted))
    rows = catalog.where(hit if category is None else hit & (F.col("category") == category))
    return rows.orderBy(F.col("status") != "active", F.desc("rating"), "display_name")
