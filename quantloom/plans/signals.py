"""From a strategy graph to a signal column.

The binder adds each distinct (indicator, parameters) pair to the bars once; the compiler turns
the graph into one row-wise expression over those columns. Signals don't look at positions, so
this is all a strategy is until it is executed.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.math import nearly_equal, protected_div, protected_log, protected_power, protected_sqrt
from quantloom.functions.windows import KEYS, lag
from quantloom.operators.align import asof_join
from quantloom.operators.registry import IndicatorError, Registry, default_registry
from quantloom.plans.ir import Node, StrategyError, StrategyIR
from quantloom.sources.bars import resample

# The names of comparisons, and signals by action.
COMPARE = {"GT": ("GT", "GREATER_THAN"), "LT": ("LT", "LESS_THAN"), "EQ": ("EQ", "EQUAL", "EQUALS"), "GE": ("GTE", "GE", "GREATER_EQUAL"), "LE": ("LTE", "LE", "LESS_EQUAL"), "NE": ("NEQ", "NE", "NOT_EQUAL", "NOT_EQUALS")}
SIGNALS = {"BUY": 1, "SELL": -1}
_COMPARE = {name: kind for kind, names in COMPARE.items() for name in names}


def bind(ir: StrategyIR, bars: DataFrame, registry: Registry | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Bars with the indicators of the graph, and the column of each indicator node.

    A name that is a column already (IND_<name> first, then <name>) stays that column; one that
    is neither column nor indicator is zero, as node without a column. A node with a ``timeframe`` (minutes)
    looks at bars of that timeframe, made from these: each bar sees the last one that has closed by its time.
    """
    registry, made, columns = registry or default_registry(), {}, {}
    for node in ir.indicators():
        if minutes := node.params.get("timeframe"):
            key = f"{minutes}m" + node.name.upper() + json.dumps(node.params, sort_keys=True)
            if key not in made:
                coarse = resample(bars, int(minutes))
                plain = replace(node, params={k: v for k, v in node.params.items() if k != "timeframe"})
                wide, found = bind(StrategyIR("coarse", [plain]), coarse, registry)
                if node.id not in found:
                    continue
                made[key] = f"_ind{len(made)}"
                known = wide.select("symbol", (F.col("ts") + F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("ts"), F.col(found[node.id]).alias(made[key]))
                bars = asof_join(bars, known, ["symbol"], [made[key]])
            columns[node.id] = made[key]
            continue
        own = next((c for c in (f"IND_{node.name}", node.name) if c in bars.columns), None)
        if own is None:
            name = node.name.upper().removeprefix("IND_")
            key = name + json.dumps(node.params, sort_keys=True)
            if key not in made:
                params = {k: v for k, v in node.params.items() if k != "output"}
                try:
                    wide = registry.compute(name, bars, **params)
                except IndicatorError:
                    if name in registry.list():
                        raise
                    continue
                new = registry.get(name).columns or [c for c in wide.columns if c not in bars.columns]
                made[key] = f"_ind{len(made)}"
                bars = wide.withColumnRenamed(node.params.get("output", new[0]), made[key]).drop(*(c for c in new if c != node.params.get("output", new[0])))
            own = made[key]
        columns[node.id] = own
    return bars, columns


class Stages:
    """Columns that are made level by level: windows of a level look at columns of the levels below. Equal ones are made once."""

    def __init__(self, prefix: str = "_y"):
        self.prefix, self.names, self.levels = prefix, {}, []

    def window(self, key: str, level: int, value: Column) -> Column:
        """The column for a window over values of ``level`` windows within each other, known by its key."""
        if key not in self.names:
            self.names[key] = f"{self.prefix}{len(self.names)}"
            self.levels += [{} for _ in range(level + 1 - len(self.levels))]
            self.levels[level][self.names[key]] = value
        return F.col(self.names[key])

    def added(self, bars: DataFrame) -> DataFrame:
        """Bars with all of these columns, one step a level."""
        for columns in self.levels:
            bars = bars.withColumns(columns)
        return bars


def compile_signal(ir: StrategyIR, columns: dict[str, str], keys: tuple[str, ...] = KEYS, stages: Stages | None = None) -> Column:
    """1, -1 or 0 for each bar. ``stages`` takes up what looks back, to be added to the bars first; only LAG and crossings within each other need it."""

    def depth(node: Node) -> int:
        """How many windows lie within each other."""
        inside = max((depth(n) for n in ir.next_of(node.id)), default=0)
        return inside + (node.node_type == "operator" and node.name.upper() in ("LAG", "CROSSOVER", "CROSSUNDER"))

    def told(node: Node) -> str:
        """The subtree as text; the same for equal ones of all strategies that share columns."""
        if node.node_type == "indicator":
            return columns.get(node.id, "0")
        return f"{node.node_type}.{node.name.upper()}{json.dumps(node.params, sort_keys=True)}({','.join(told(n) for n in ir.next_of(node.id))})"

    def back(nodes: list[Node], x: Column, n: int) -> Column:
        """A number made of some nodes, n bars ago."""
        level = max(map(depth, nodes))
        if stages is None:
            if level:
                raise StrategyError(f"{nodes[0].id} looks back within what looks back")
            return lag(x, n, keys)
        return stages.window(f"{n}:{'-'.join(map(told, nodes))}", level, lag(x, n, keys))

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def boolean(node: Node) -> Column:
        name, under = node.name.upper(), ir.next_of(node.id)
        if node.node_type == "operator":
            if name == "NOT":
                return ~boolean(under[0]) if under else F.lit(False)
            if name in ("AND", "OR") and len(under) >= 2:
                out = boolean(under[0])
                for n in under[1:]:
                    out = out & boolean(n) if name == "AND" else out | boolean(n)
                return out
            if (kind := _COMPARE.get(name)) and len(under) >= 2:
                a, b = number(under[0]), number(under[1])
                plain = {"GT": a > b, "LT": a < b, "EQ": a == b, "GE": a >= b, "LE": a <= b, "NE": a != b}[kind]
                return F.coalesce(plain, F.lit(kind == "NE"))  # a missing value differs from everything
            if name == "NEAR" and len(under) >= 2:
                return known(nearly_equal(number(under[0]), number(under[1])))
            if name in ("CROSSOVER", "CROSSUNDER") and len(under) >= 2:
                a, b = number(under[0]), number(under[1])
                before = back(under[:2], a - b, 1)
                return known((a > b) & (before <= 0) if name == "CROSSOVER" else (a < b) & (before >= 0))
            return F.lit(False)
        return known(number(node) != 0)

    def number(node: Node) -> Column:
        name, under = node.name.upper(), ir.next_of(node.id)
        if node.node_type == "value":
            return F.lit(float(node.params.get("value", 0)))
        if node.node_type == "indicator":
            return F.col(columns[node.id]) if node.id in columns else F.lit(0.0)
        if node.node_type == "operator":
            if name == "IF" and len(under) == 3:
                return F.when(boolean(under[0]), number(under[1])).otherwise(number(under[2]))
            if name == "LAG" and under:
                return back(under[:1], number(under[0]), int(node.params.get("period", 1)))
            x = [number(n) for n in under] if name in ("ADD", "SUB", "MUL", "DIV", "SQRT", "LOG", "POW", "NEG") else []
            match name, len(x):
                case "ADD", 2:
                    return x[0] + x[1]
                case "SUB", 2:
                    return x[0] - x[1]
                case "MUL", 2:
                    return x[0] * x[1]
                case "DIV", 2:
                    return protected_div(x[0], x[1])
                case "POW", 2:
                    return protected_power(x[0], x[1])
                case "SQRT", 1:
                    return protected_sqrt(x[0])
                case "LOG", 1:
                    return protected_log(x[0])
                case "NEG", 1:
                    return -x[0]
            return boolean(node).cast("double")
        raise StrategyError(f"{node.node_type} {node.id} is no number")

    def signal(node: Node | None) -> Column:
        if node is None:
            return F.lit(0)
        if node.node_type == "action":
            return F.lit(SIGNALS.get(node.name.upper(), 0))
        if node.node_type == "root":
            return signal(next(iter(ir.next_of(node.id)), None))
        if node.node_type == "condition":
            test, then, other = ([*ir.next_of(node.id, e)][:1] for e in ("child", "then", "else"))
            if not test:
                test, then, other = ([n] for n in (ir.next_of(node.id) + [None] * 3)[:3])
            return F.when(boolean(test[0]), signal(*then or [None])).otherwise(signal(*other or [None])) if test[0] else F.lit(0)
        return F.lit(0)

    return signal(ir.root()).cast("int")


def with_signal(ir: StrategyIR, bars: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Bars with the column ``signal``; helper columns are gone."""
    if problems := ir.validate():
        raise StrategyError("; ".join(problems))
    bound, columns = bind(ir, bars, registry)
    stages = Stages()
    signal = compile_signal(ir, columns, stages=stages)
    return stages.added(bound).withColumn("signal", signal).select(*bars.columns, "signal")
