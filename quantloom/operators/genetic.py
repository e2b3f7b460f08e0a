"""Genetic search over strategy trees. Trees are made, crossed and changed on the driver; every
generation is evaluated as one Spark job over all bars.

A tree is a test; the strategy buys where it holds and sells elsewhere. Operators are typed: a
test (``b``) takes tests or numbers (``n``), a number takes numbers, or a test for IF.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.operators.generate import evaluate_all
from quantloom.operators.registry import default_registry
from quantloom.plans.ir import Edge, Node, StrategyIR

# Operators with the types of their arguments, indicators, periods and lags.
TESTS = {"AND": "bb", "OR": "bb", "NOT": "b", "GT": "nn", "LT": "nn", "EQ": "nn", "GE": "nn", "LE": "nn", "CROSSOVER": "nn", "CROSSUNDER": "nn", "TRUE": "", "FALSE": ""}
NUMBERS = {"IF": "bnn", "ADD": "nn", "SUB": "nn", "MUL": "nn", "DIV": "nn", "SQRT": "n", "LOG": "n", "POW": "nn", "NEG": "n", "LAG": "n"}
INDICATORS = tuple("SMA EMA WMA DEMA TEMA TRIMA KAMA MAMA RSI MACD MACDEXT STOCH STOCHF STOCHRSI BBANDS ATR ADX CCI MOM ROC ROCR WILLR ULTOSC TRIX DX MINUS_DI PLUS_DI MFI NATR TRANGE OBV VWAP AD ADOSC HT_TRENDLINE PPO APO CMO BOP CORREL".split())
PERIODS, LAGS = (5, 10, 15, 20, 30, 50, 60, 100, 200), (1, 2, 3, 5, 10, 20)
HIGHEST, REPEATED = 17, -999.0  # height of a tree; fitness of one that was met before


@dataclass(frozen=True)
class Tree:
    """``op`` is an operator, IND (an indicator ``name`` with period ``value``, 0 for none) or CONST (``value``); LAG has its distance in ``value``."""

    op: str
    kids: tuple["Tree", ...] = ()
    name: str = ""
    value: float = 0

    @property
    def kind(self) -> str:
        return "b" if self.op in TESTS else "n"

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def height(self) -> int:
        return 1 + max(k.height() for k in self.kids) if self.kids else 0

    def complexity(self) -> int:
        return self.size() + self.height()

    def places(self, at: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], "Tree"]]:
        """All subtrees with their ways from the root."""
        yield at, self
        for i, k in enumerate(self.kids):
            yield from k.places((*at, i))

    def put(self, at: tuple[int, ...], other: "Tree") -> "Tree":
        if not at:
            return other
        return replace(self, kids=tuple(k.put(at[1:], other) if i == at[0] else k for i, k in enumerate(self.kids)))

    def __str__(self) -> str:
        if self.op == "CONST":
            return f"{self.value:g}"
        if self.op == "IND":
            return f"{self.name}({self.value:g})" if self.value else self.name
        inside = [*map(str, self.kids), *([f"{self.value:g}"] if self.op == "LAG" else [])]
        return f"{self.op}({', '.join(inside)})" if inside else self.op


def random_tree(rng: random.Random, kind: str = "b", depth: int = 3, indicators: tuple[str, ...] = INDICATORS, grow: float = 0.3) -> Tree:
    """A tree of a kind, no deeper than ``depth``; on the way down it may end with probability ``grow``."""
    if kind == "n" and (depth <= 0 or rng.random() < grow):
        if rng.random() < 0.7:
            name = rng.choice(indicators)
            return Tree("IND", (), name, rng.choice(PERIODS) if takes_period(name) else 0)
        return Tree("CONST", (), "", float(rng.choice(PERIODS)) if rng.random() < 0.5 else rng.uniform(-10.0, 10.0))
    if kind == "b" and depth <= 0:
        return Tree(rng.choice(("TRUE", "FALSE")))
    ops = TESTS if kind == "b" else NUMBERS
    op = rng.choice([o for o, args in ops.items() if args])
    kids = tuple(random_tree(rng, k, depth - 1, indicators, grow) for k in ops[op])
    return Tree(op, kids, "", rng.choice(LAGS) if op == "LAG" else 0)


def random_population(size: int, seed: int, depth: int = 3, indicators: tuple[str, ...] = INDICATORS) -> list[Tree]:
    """Tests that a first generation starts with; the same for the same seed."""
    rng = random.Random(seed)
    return [random_tree(rng, "b", depth, indicators) for _ in range(size)]


_registry = default_registry()


def takes_period(name: str) -> bool:
    return "period" in _registry.get(name).params


def mutate(tree: Tree, rng: random.Random, indicators: tuple[str, ...] = INDICATORS) -> Tree:
    """A subtree is replaced by a new one of its kind; a tree that gets too high stays as it was."""
    at, old = rng.choice(list(tree.places()))
    new = tree.put(at, random_tree(rng, old.kind, 2, indicators))
    return new if new.height() <= HIGHEST else tree


def mate(a: Tree, b: Tree, rng: random.Random) -> tuple[Tree, Tree]:
    """Subtrees of one kind change places; trees that get too high stay as they were."""
    at, old = rng.choice(list(a.places()))
    fitting = [(way, x) for way, x in b.places() if x.kind == old.kind]
    if not fitting:
        return a, b
    way, x = rng.choice(fitting)
    one, two = a.put(at, x), b.put(way, old)
    return (one if one.height() <= HIGHEST else a), (two if two.height() <= HIGHEST else b)


def to_ir(tree: Tree) -> StrategyIR:
    """Buy where the test holds, else sell. Equality is that of the search: within a tolerance."""
    nodes, edges = [Node("root", "root"), Node("if", "condition", "IF")], [Edge("root", "if")]

    def add(x: Tree, parent: str, at: str) -> None:
        if x.op == "IND":
            nodes.append(Node(at, "indicator", x.name, {"period": int(x.value)} if x.value else {}))
        elif x.op in ("CONST", "TRUE", "FALSE"):
            nodes.append(Node(at, "value", "", {"value": x.value if x.op == "CONST" else float(x.op == "TRUE")}, {"test": x.op} if x.op != "CONST" else {}))
        else:
            nodes.append(Node(at, "operator", "NEAR" if x.op == "EQ" else x.op, {"period": int(x.value)} if x.op == "LAG" else {}))
        edges.append(Edge(parent, at))
        for i, k in enumerate(x.kids):
            add(k, at, f"{at}.{i}")

    add(tree, "if", "t")
    return StrategyIR("tree", [*nodes, Node("buy", "action", "BUY"), Node("sell", "action", "SELL")], [*edges, Edge("if", "buy", "then"), Edge("if", "sell", "else")])


def from_ir(ir: StrategyIR) -> Tree:
    """The test of the first condition as a tree."""

    def read(n: Node) -> Tree:
        if n.node_type == "indicator":
            return Tree("IND", (), n.name, int(n.params.get("period", n.params.get("timeperiod", 0))))
        if n.node_type == "value":
            return Tree(n.meta["test"]) if "test" in n.meta else Tree("CONST", (), "", float(n.params.get("value", 0)))
        op = {"NEAR": "EQ", "GTE": "GE", "LTE": "LE"}.get(n.name.upper(), n.name.upper())
        return Tree(op, tuple(read(c) for c in ir.next_of(n.id)), "", int(n.params.get("period", 1)) if op == "LAG" else 0)

    condition = ir.of_type("condition")[0]
    return read((ir.next_of(condition.id, "child") or ir.next_of(condition.id))[0])


# -- objectives and selection --------------------------------------------------------------------

OBJECTIVES = ("sharpe", "drawdown", "win")


def objectives(figures: DataFrame, complexity, cost: float = 0.001) -> DataFrame:
    """Three figures to be high, each less a cost for the tree's size (a column): Sharpe ratio, drawdown turned round, share of gains."""
    less = cost * complexity
    return figures.withColumns({"sharpe": F.col("sharpe_ratio") - less, "drawdown": -F.col("max_drawdown_pct") / 100 - less, "win": F.col("win_rate") - less})


def front_numbers(points: np.ndarray) -> np.ndarray:
    """Number of the front of each row, from 1; high values are good, and a missing one is the worst.

    Different points come by falling first value, so only those before can beat one. Who beats a point in the other two of
    three values is told by a front's staircase, in one bisection, and a point beaten in a front is beaten in
    all fronts before, so its own is bisected too: n log n log n steps. More values than three are compared one by one.
    """
    points = np.where(np.isnan(points), -np.inf, points)
    different, which = np.unique(points, axis=0, return_inverse=True)
    ranked = different[::-1]
    found = np.zeros(len(ranked), np.int64)
    if points.shape[1] > 3:
        members: list[list[np.ndarray]] = []
        for i, p in enumerate(ranked):
            found[i] = bisect_left(members, True, key=lambda own, p=p: not (np.array(own) >= p).all(1).any())
            if found[i] == len(members):
                members.append([])
            members[found[i]].append(p)
    else:
        stairs: list[tuple[list[float], list[float]]] = []  # of each front: rising second values, falling third ones
        padded = np.c_[ranked, np.zeros((len(ranked), 3 - ranked.shape[1]))]

        def clear(stair: tuple[list[float], list[float]], y: float, z: float) -> bool:
            at = bisect_left(stair[0], y)
            return at == len(stair[0]) or stair[1][at] < z

        for i, (_, y, z) in enumerate(padded.tolist()):
            found[i] = at = bisect_left(stairs, True, key=lambda stair, y=y, z=z: clear(stair, y, z))
            if at == len(stairs):
                stairs.append(([], []))
            ys, zs = stairs[at]
            stop = bisect_right(ys, y)
            start = stop
            while start and zs[start - 1] <= z:
                start -= 1
            ys[start:stop], zs[start:stop] = [y], [z]
    return found[::-1][which.ravel()] + 1


def fronts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the front, from 1, and crowding distance of each row; high values are good."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    front = front_numbers(points)
    number = int(front.max())
    crowd = np.zeros(n)
    by_front = np.argsort(front, kind="stable")
    for own in np.split(by_front, np.searchsorted(front[by_front], np.arange(2, number + 1))):
        for x in points[own].T:
            order = np.argsort(x, kind="stable")
            ranked, gap = x[order], np.full(len(own), np.inf)
            width = ranked[-1] - ranked[0]
            gap[1:-1] = (ranked[2:] - ranked[:-2]) / width if width > 0 else 0.0
            gap[(ranked == ranked[0]) | (ranked == ranked[-1])] = np.inf
            crowd[own[order]] += gap
    return front, crowd


def nsga2_ranks(figures: DataFrame, keys: list[str], high: tuple[str, ...]) -> DataFrame:
    """Rows with ``front`` (1 is beaten by none) and ``crowding`` (null at either end of a front). A group is one generation of one search, so as large as a population."""
    schema = T.StructType([*figures.schema.fields, T.StructField("front", T.LongType()), T.StructField("crowding", T.DoubleType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        front, crowd = fronts(frame[list(high)].to_numpy(float))
        return frame.assign(front=front, crowding=np.where(np.isinf(crowd), np.nan, crowd))

    return figures.groupBy(*keys).applyInPandas(run, schema).withColumn("crowding", F.nanvl("crowding", F.lit(None).cast("double")))


def pareto_front(figures: DataFrame, keys: list[str], high: tuple[str, str], salts: int = 64) -> DataFrame:
    """Rows that no other row of their keys reaches in both figures and beats in one.

    Fronts of ``salts`` parts of each group come first; what is left of them meets once more. Each
    is one sort by the first figure with a running maximum of the second, whatever the group's size.
    """

    def unbeaten(rows: DataFrame, by: list[str]) -> DataFrame:
        first, second = high
        best = rows.groupBy(*by, first).agg(F.max(second).alias("_top"))
        ahead = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
        steps = best.withColumn("_ahead", F.max("_top").over(ahead)).where("_ahead IS NULL OR _top > _ahead").drop("_ahead")
        match = [rows[c].eqNullSafe(steps[c]) for c in [*by, first]]
        return rows.join(steps, [*match, rows[second] == steps["_top"]], "left_semi")

    salted = figures.withColumn("_salt", F.pmod(F.xxhash64(*high), F.lit(salts)))
    return unbeaten(unbeaten(salted, [*keys, "_salt"]).drop("_salt"), keys)


# -- evolution -----------------------------------------------------------------------------------

Rate = Callable[[list[StrategyIR]], list[dict[str, float]]]


def rater(bars: DataFrame) -> Rate:
    """Figures of many strategies, means over symbols, as one job."""

    def rate(strategies: list[StrategyIR]) -> list[dict[str, float]]:
        if not strategies:
            return []
        wanted = ("sharpe_ratio", "max_drawdown_pct", "win_rate", "total_return_pct")
        rows = evaluate_all(strategies, bars).groupBy("run_id").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in wanted)).collect()  # one row per strategy
        by = {r["run_id"]: r.asDict() for r in rows}
        return [by.get(i, dict.fromkeys(wanted, 0.0)) for i in range(len(strategies))]

    return rate


def evolve(rate: Rate, population: int = 12, generations: int = 3, keep: int = 5, cost: float = 0.001, crossover: float = 0.8, mutation: float = 0.2, tournament: int = 3, several: bool = False, indicators: tuple[str, ...] = INDICATORS, seed: int = 42) -> list[tuple[Tree, tuple[float, ...]]]:
    """The best distinct trees of all generations with their fitness.

    Fitness is the Sharpe ratio less a cost for complexity, selected by tournaments; with
    ``several`` it is the three objectives, selected by fronts and crowding. A tree that was met
    before isn't evaluated again and counts as ``REPEATED``.
    """
    rng, met = random.Random(seed), {}

    def rated(trees: list[Tree]) -> list[tuple[Tree, tuple[float, ...]]]:
        fresh = [t for t in dict.fromkeys(trees) if t not in met]
        for t, f in zip(fresh, rate([to_ir(t) for t in fresh])):
            less = cost * t.complexity()
            met[t] = (f["sharpe_ratio"] - less, -f["max_drawdown_pct"] / 100 - less, f["win_rate"] - less) if several else (f["sharpe_ratio"] - less,)
        new = set(fresh)
        return [(t, met[t]) if t in new and not new.discard(t) else (t, (REPEATED,) * (3 if several else 1)) for t in trees]

    now = rated([random_tree(rng, indicators=indicators) for _ in range(population)])
    for _ in range(generations):
        pick = (lambda: now[rng.randrange(len(now))][0]) if several else (lambda: max(rng.sample(now, min(tournament, len(now))), key=lambda x: x[1])[0])
        young: list[Tree] = []
        while len(young) < population:
            a, b = pick(), pick()
            if rng.random() < crossover:
                a, b = mate(a, b, rng)
            young += [mutate(x, rng, indicators) if rng.random() < mutation else x for x in (a, b)]
        children = rated(young[:population])
        now = _survivors(now + children, population) if several else children
    best = sorted(met.items(), key=lambda x: ([-v for v in x[1]], x[0].complexity(), str(x[0])))
    return best[:keep]


def _survivors(rows: list[tuple[Tree, tuple[float, ...]]], n: int) -> list[tuple[Tree, tuple[float, ...]]]:
    front, crowd = fronts(np.array([f for _, f in rows]))
    return [rows[i] for i in np.lexsort((-crowd, front))[:n]]
