"""Strategy improvement and ratings. Proposals are made on the driver; each generation or set of
candidates is evaluated as one Spark job over all bars."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.backtest import BacktestConfig, evaluate
from quantloom.operators.registry import Registry, default_registry
from quantloom.operators.rules import RuleChain
from quantloom.plans.ir import Edge, Node, StrategyIR
from quantloom.plans.signals import Stages, bind, compile_signal
from quantloom.schema import BARS

Evaluate = Callable[[list[StrategyIR]], list[float]]


BATCH = 12  # indicators that are added to each other's bars; more than that are computed side by side


def with_indicators(nodes: list[Node], bars: DataFrame, registry: Registry) -> tuple[DataFrame, dict[str, str]]:
    """As ``bind``, for any number of indicator nodes: more than ``BATCH`` go through plans of their own, side by side, and come together by symbol and time."""
    there = {n.id: c for n in nodes for c in (n.name, f"IND_{n.name}") if c in bars.columns and "timeframe" not in n.params}
    fresh = [n for n in nodes if n.id not in there]
    if len(fresh) <= BATCH:
        return bind(StrategyIR("all", nodes), bars, registry)
    base = bars.select(*(c for c in bars.columns if c in BARS.names))
    parts, places = [], {}
    for at in range(0, len(fresh), BATCH):
        bound, found = bind(StrategyIR("some", fresh[at : at + BATCH]), base, registry)
        if own := sorted(set(found.values())):
            places |= {i: (len(parts), own.index(c)) for i, c in found.items()}
            parts.append(bound.select("symbol", "ts", F.lit(len(parts)).alias("_part"), F.array(*(F.col(c).cast("double") for c in own)).alias("_values")))
    sides = reduce(DataFrame.unionByName, parts).groupBy("symbol", "ts").agg(*(F.max(F.when(F.col("_part") == i, F.col("_values"))).alias(f"_part{i}") for i in range(len(parts))))
    columns = {node: f"_ind{k}" for k, node in enumerate(places)}
    wide = bars.join(sides, ["symbol", "ts"]).select(*bars.columns, *(F.get(f"_part{i}", F.lit(j)).alias(columns[node]) for node, (i, j) in places.items()))
    return wide, there | columns


def signals_of(strategies: list[StrategyIR], bars: DataFrame, registry: Registry | None = None) -> tuple[DataFrame, list[Column]]:
    """Bars with what many strategies look at, and the signal of each.

    Equal indicators of all strategies are one column; so are equal things that look back, which are added
    level by level for all strategies together.
    """
    wanted: dict[tuple[str, str], Node] = {}
    for ir in strategies:
        for node in ir.indicators():
            wanted.setdefault((node.name, json.dumps(node.params, sort_keys=True)), replace(node, id=str(len(wanted))))
    bound, columns = with_indicators(list(wanted.values()), bars, registry or default_registry())
    stages = Stages()
    own = [{n.id: columns[i] for n in ir.indicators() if (i := wanted[n.name, json.dumps(n.params, sort_keys=True)].id) in columns} for ir in strategies]
    signals = [compile_signal(ir, named, stages=stages) for ir, named in zip(strategies, own)]
    return stages.added(bound), signals


def evaluate_all(strategies: list[StrategyIR], bars: DataFrame, config: BacktestConfig = BacktestConfig(), registry: Registry | None = None) -> DataFrame:
    """Figures of many strategies, run_id being the place in the list: equal indicators are computed once, equal strategies executed once."""
    wide = RuleChain().apply(bars)
    keys = [ir.fingerprint() for ir in strategies]
    different = dict(zip(keys, strategies))
    runs: dict[str, list[int]] = {key: [] for key in different}
    for i, key in enumerate(keys):
        runs[key].append(i)
    with_all, signals = signals_of(list(different.values()), wide, registry or default_registry())
    figures = evaluate(with_all.select(*wide.columns, F.array(*signals).alias("signals")), config)
    wanted = F.expr(f"map({', '.join(f'{at}, array({", ".join(map(str, ids))})' for at, ids in enumerate(runs.values()))})")
    return figures.withColumn("run_id", F.explode(wanted[F.col("combo_idx")])).drop("combo_idx")


def mean_metric(strategies: list[StrategyIR], bars: DataFrame, metric: str = "sharpe_ratio", config: BacktestConfig = BacktestConfig()) -> list[float]:
    """A number per strategy: the mean over symbols. One job for all of them."""
    if not strategies:
        return []
    rows = evaluate_all(strategies, bars, config).groupBy("run_id").agg(F.avg(metric).alias("v")).collect()  # one row per strategy
    by = {r["run_id"]: r["v"] or 0.0 for r in rows}
    return [by.get(i, 0.0) for i in range(len(strategies))]


def evaluator(bars: DataFrame, metric: str = "sharpe_ratio") -> Evaluate:
    return lambda strategies: mean_metric(strategies, bars, metric)


# -- improvement -------------------------------------------------------------------------------

# Steps and factors of the improver.
PERIOD_STEPS, STOP_FACTORS = (-5, -2, 2, 5), (0.8, 1.0, 1.2, 1.5)
STOP_WORDS = ("stop", "loss", "atr", "trailing", "sl")
EXITS = (("RSI", "GT", 70.0), ("CCI", "GT", 100.0), ("MOM", "LT", 0.0))
ENTRIES = (("RSI", "LT", 30.0), ("CCI", "LT", -100.0), ("MOM", "GT", 0.0))


def _with_clause(ir: StrategyIR, condition: Node, clause: tuple[str, str, float], joint: str, tag: str) -> StrategyIR | None:
    """The condition's test joined with one more comparison."""
    test = next(iter(ir.next_of(condition.id, "child")), None)
    if test is None or ir.node(f"{tag}_j"):
        return None
    name, compare, level = clause
    grown = replace(ir, edges=[e for e in ir.edges if not (e.source == condition.id and e.target == test.id and e.edge_type == "child")])
    return (
        grown.with_node(Node(f"{tag}_j", "operator", joint), Edge(condition.id, f"{tag}_j"), Edge(f"{tag}_j", test.id))
        .with_node(Node(f"{tag}_c", "operator", compare), Edge(f"{tag}_j", f"{tag}_c"))
        .with_node(Node(f"{tag}_x", "indicator", name, {"period": 14}), Edge(f"{tag}_c", f"{tag}_x"))
        .with_node(Node(f"{tag}_v", "value", "", {"value": level}), Edge(f"{tag}_c", f"{tag}_v"))
    )


def _conditions(ir: StrategyIR, action: str) -> list[Node]:
    return [n for n in ir.of_type("condition") if any(a.name.upper() == action for a in ir.next_of(n.id, "then"))]


def entry_candidates(ir: StrategyIR) -> list[StrategyIR]:
    return [c for n in _conditions(ir, "BUY") for i, e in enumerate(ENTRIES) if (c := _with_clause(ir, n, e, "OR", f"en{i}_{n.id}"))]


def exit_candidates(ir: StrategyIR) -> list[StrategyIR]:
    return [c for n in _conditions(ir, "SELL") for i, e in enumerate(EXITS) if (c := _with_clause(ir, n, e, "OR", f"ex{i}_{n.id}"))]


def filter_candidates(ir: StrategyIR) -> list[StrategyIR]:
    """With one more filter, or with one side of an AND taken out."""
    out = [c for n in _conditions(ir, "BUY") for i, e in enumerate(ENTRIES) if (c := _with_clause(ir, n, e, "AND", f"fi{i}_{n.id}"))]
    for n in ir.of_type("operator"):
        under = ir.next_of(n.id)
        if n.name.upper() == "AND" and len(under) == 2:
            for kept in under:
                slim = replace(ir, nodes=[x for x in ir.nodes if x.id != n.id], edges=[replace(e, target=kept.id) if e.target == n.id else e for e in ir.edges if e.source != n.id])
                live = {x.id for x in slim.subtree(slim.root().id).nodes}
                out.append(replace(slim, nodes=[x for x in slim.nodes if x.id in live], edges=[e for e in slim.edges if e.source in live and e.target in live]))
    return out


def stop_candidates(ir: StrategyIR) -> list[StrategyIR]:
    named = [n for n in ir.nodes if any(w in f"{n.id} {n.name}".lower() for w in STOP_WORDS)]
    return [ir.replaced(replace(n, params={**n.params, k: v * f})) for n in named for k, v in n.params.items() if isinstance(v, (int, float)) for f in STOP_FACTORS if f != 1.0]


def period_candidates(ir: StrategyIR) -> list[StrategyIR]:
    return [ir.replaced(replace(n, params={**n.params, k: v + d})) for n in ir.indicators() for k, v in n.params.items() if isinstance(v, int) for d in PERIOD_STEPS if v + d >= 2]


CANDIDATES = {"entry": entry_candidates, "exit": exit_candidates, "filters": filter_candidates, "stoploss": stop_candidates, "indicator_params": period_candidates}


def improve(ir: StrategyIR, evaluate: Evaluate, what: str | None = None, rounds: int = 1, seed: int = 42) -> tuple[StrategyIR, list[dict]]:
    """The best of the strategy and its candidates after some rounds, and what was accepted on the way."""
    rng, log = random.Random(seed), []
    for _ in range(rounds):
        kind = what or rng.choice(list(CANDIDATES))
        trials = [ir, *CANDIDATES[kind](ir)]
        values = evaluate(trials)
        best = max(range(len(trials)), key=lambda i: (values[i], -i))
        log.append({"kind": kind, "candidates": len(trials) - 1, "before": values[0], "after": values[best], "accepted": best > 0})
        ir = trials[best]
    return ir, log


# -- ratings ----------------------------------------------------------------------------------


def fitness(figures: DataFrame, complexity, metric: str = "sharpe_ratio", cost: float = 0.001) -> DataFrame:
    """Figures with fitness: the metric less a cost for the strategy's size (a column)."""
    return figures.withColumn("fitness", F.col(metric) - cost * complexity)


def generation_stats(rated: DataFrame, generation: str = "generation") -> DataFrame:
    """Per generation: mean, population deviation and range of fitness."""
    return rated.groupBy(generation).agg(F.count("*").alias("n"), F.avg("fitness").alias("avg"), F.stddev_pop("fitness").alias("std"), F.min("fitness").alias("min"), F.max("fitness").alias("max"))


def hall_of_fame(rated: DataFrame, expression: str, keep: int) -> DataFrame:
    """The best rows with different expressions. Keeping so many is the feature."""
    best = rated.groupBy(expression).agg(F.max("fitness").alias("fitness"))
    return best.orderBy(F.desc("fitness"), expression).limit(keep)
