"""Fuzzy strategies: memberships and weighted rules as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import ratio, roll
from quantloom.operators import indicators
from quantloom.plans.ir import Edge, Node, StrategyIR


@dataclass(frozen=True)
class Membership:
    """A label whose degree rises, stays one and falls between its points (three or four of them).

    Edges are exclusive, as in the engine this follows: a shoulder scores 0 at the edge of the
    variable's range.
    """

    label: str
    points: tuple[float, ...]

    def degree(self, x: Column) -> Column:
        a, b, *c, d = self.points
        top = c[0] if c else b
        inside = F.when((x <= a) | (x >= d), 0.0).when(x < b, (x - a) / (b - a) if b > a else F.lit(1.0)).when(x <= top, 1.0).otherwise((d - x) / (d - top) if d > top else F.lit(1.0))
        return F.when(x.isNotNull(), inside).otherwise(0.0)


@dataclass(frozen=True)
class Clause:
    variable: str
    label: str
    weight: float


@dataclass(frozen=True)
class FuzzyRule:
    name: str
    clauses: tuple[Clause, ...]
    action: str
    threshold: float

    def score(self, degrees: dict[tuple[str, str], Column]) -> Column:
        """Weighted sum of the clauses' degrees."""
        return sum((degrees[c.variable, c.label] * c.weight for c in self.clauses), F.lit(0.0))


# The default variables and the rules of the three templates.
VARIABLES: dict[str, tuple[Membership, ...]] = {
    "trend_strength": (Membership("weak", (0, 0, 15, 25)), Membership("medium", (18, 30, 42)), Membership("strong", (35, 45, 60, 60))),
    "volume_pressure": (Membership("low", (0, 0, 0.7, 1.0)), Membership("normal", (0.8, 1.1, 1.6)), Membership("high", (1.4, 2.0, 4.0, 4.0))),
    "risk_heat": (Membership("calm", (0, 0, 0.018, 0.035)), Membership("normal", (0.025, 0.05, 0.075)), Membership("hot", (0.065, 0.09, 0.12, 0.12))),
    "reversal_pressure": (Membership("oversold", (0, 0, 25, 35)), Membership("neutral", (30, 50, 70)), Membership("overbought", (65, 75, 100, 100))),
}
TEMPLATES: dict[str, tuple[tuple[str, str, tuple[tuple[str, str, float], ...]], ...]] = {
    "momentum": (
        ("strong, high, calm", "buy", (("trend_strength", "strong", 0.45), ("volume_pressure", "high", 0.30), ("risk_heat", "calm", 0.25))),
        ("weak, hot", "sell", (("trend_strength", "weak", 0.55), ("risk_heat", "hot", 0.45))),
    ),
    "reversal": (
        ("oversold, normal, calm", "buy", (("reversal_pressure", "oversold", 0.45), ("volume_pressure", "normal", 0.25), ("risk_heat", "calm", 0.30))),
        ("overbought, hot", "sell", (("reversal_pressure", "overbought", 0.60), ("risk_heat", "hot", 0.40))),
    ),
    "balanced": (
        ("strong, high, calm, neutral", "buy", (("trend_strength", "strong", 0.40), ("volume_pressure", "high", 0.25), ("risk_heat", "calm", 0.20), ("reversal_pressure", "neutral", 0.15))),
        ("oversold, calm, normal", "buy", (("reversal_pressure", "oversold", 0.45), ("risk_heat", "calm", 0.35), ("volume_pressure", "normal", 0.20))),
        ("overbought, hot, weak", "sell", (("reversal_pressure", "overbought", 0.45), ("risk_heat", "hot", 0.35), ("trend_strength", "weak", 0.20))),
    ),
}


@dataclass(frozen=True)
class FuzzySpec:
    rules: tuple[FuzzyRule, ...]
    variables: dict[str, tuple[Membership, ...]] = field(default_factory=lambda: VARIABLES)

    @staticmethod
    def template(name: str = "balanced", buy: float = 0.62, sell: float = 0.58) -> "FuzzySpec":
        return FuzzySpec(tuple(FuzzyRule(title, tuple(Clause(*c) for c in clauses), action, buy if action == "buy" else sell) for title, action, clauses in TEMPLATES[name]))

    def to_ir(self) -> StrategyIR:
        """The rules as a graph: a condition per rule, tried in order, over a number node with the rule's score."""
        nodes, edges, at = [Node("root", "root")], [], "root"
        kind = "child"
        for i, rule in enumerate(self.rules):
            nodes += [Node(f"if{i}", "condition", "IF"), Node(f"ge{i}", "operator", "GTE"), Node(f"score{i}", "indicator", f"fuzzy_score_{i}"), Node(f"level{i}", "value", "", {"value": rule.threshold}), Node(f"act{i}", "action", rule.action.upper())]
            edges += [Edge(at, f"if{i}", kind), Edge(f"if{i}", f"ge{i}"), Edge(f"ge{i}", f"score{i}"), Edge(f"ge{i}", f"level{i}"), Edge(f"if{i}", f"act{i}", "then")]
            at, kind = f"if{i}", "else"
        return StrategyIR("fuzzy", [*nodes, Node("hold", "action", "HOLD")], [*edges, Edge(at, "hold", "else")])


def fuzzy_inputs(bars: DataFrame, period: int = 14) -> DataFrame:
    """Bars with the four default variables."""
    wide = indicators.rsi(indicators.atr(indicators.adx(bars, period), period), period)
    return wide.withColumns({"trend_strength": F.col("adx"), "volume_pressure": ratio(F.col("volume"), roll(F.avg, F.col("volume"), 20)), "risk_heat": ratio(F.col("atr"), F.col("close")), "reversal_pressure": F.col("rsi")}).drop("adx", "atr", "rsi")


def fuzzy_degrees(inputs: DataFrame, spec: FuzzySpec) -> DataFrame:
    return inputs.withColumns({f"{v}_{m.label}": m.degree(F.col(v)) for v, ms in spec.variables.items() for m in ms})


def fuzzy_scores(inputs: DataFrame, spec: FuzzySpec) -> DataFrame:
    degrees = {(v, m.label): m.degree(F.col(v)) for v, ms in spec.variables.items() for m in ms}
    return inputs.withColumns({f"fuzzy_score_{i}": r.score(degrees) for i, r in enumerate(spec.rules)})


def fuzzy_signal(inputs: DataFrame, spec: FuzzySpec) -> DataFrame:
    """The first rule that reaches its threshold acts."""
    scored = fuzzy_scores(inputs, spec)
    fired = F.coalesce(*(F.when(F.col(f"fuzzy_score_{i}") >= r.threshold, F.lit(1 if r.action == "buy" else -1)) for i, r in enumerate(spec.rules)), F.lit(0))
    return scored.withColumn("signal", fired.cast("int"))
