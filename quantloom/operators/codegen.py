"""Source code from strategies: a PySpark job, a pandas script, or a plain-text strategy."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from pathlib import Path
from string import Template

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantloom.plans.ir import Node, StrategyError, StrategyIR

TARGETS = ("pyspark", "pandas", "dsl")
KEPT = 10_000  # strategies whose sources a task remembers
_SIGNS = {"GT": ">", "GREATER_THAN": ">", "LT": "<", "LESS_THAN": "<", "GTE": ">=", "GE": ">=", "LTE": "<=", "LE": "<=", "EQ": "==", "EQUAL": "==", "NEQ": "!=", "NOT_EQUAL": "!=", "ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/"}

_PYSPARK = Template('''"""$title, as a Spark job."""

import json

from pyspark.sql import SparkSession
from quantloom.operators.backtest import execute
from quantloom.operators.metrics import performance
from quantloom.plans.ir import StrategyIR
from quantloom.plans.signals import with_signal

STRATEGY = json.loads($ir)


def run(spark: SparkSession, bars_path: str):
    bars = spark.read.parquet(bars_path)
    return performance(execute(with_signal(StrategyIR.from_dict(STRATEGY), bars)), ["symbol"])
''')
_PANDAS = Template('''"""$title, as a pandas script. ``bars`` has a column for every indicator named below."""

import pandas as pd


def signal(bars: pd.DataFrame) -> pd.Series:
    out = pd.Series(0, index=bars.index)
$rules
    return out
''')
_DSL = Template("""strategy $title
$rules
""")


def snake_case(name: str) -> str:
    return re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)).strip("_").lower()


def class_name(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"\W+|_", name) if w)


def column_name(node: Node) -> str:
    plain = re.sub(r"^IND_", "", node.name)
    return "_".join([snake_case(plain), *(str(v) for _, v in sorted(node.params.items()))])


def _text(ir: StrategyIR, node: Node, column) -> str:
    under = [_text(ir, n, column) for n in ir.next_of(node.id)]
    name = node.name.upper()
    if node.node_type == "value":
        return repr(float(node.params.get("value", 0)))
    if node.node_type == "indicator":
        return column(column_name(node))
    if name == "NOT":
        return f"~({under[0]})"
    if name in ("AND", "OR"):
        return (" & " if name == "AND" else " | ").join(f"({u})" for u in under)
    if name in _SIGNS and len(under) == 2:
        return f"{under[0]} {_SIGNS[name]} {under[1]}"
    raise StrategyError(f"{node.name} has no text")


def _paths(ir: StrategyIR, column, negate: str) -> list[tuple[list[str], str]]:
    """Conditions (all must hold) and the action they lead to, in order."""

    def walk(node: Node | None, so_far: list[str]) -> list[tuple[list[str], str]]:
        if node is None or node.node_type == "action":
            return [(so_far, node.name.upper() if node else "HOLD")]
        test = _text(ir, ir.next_of(node.id, "child")[0], column)
        then, other = (next(iter(ir.next_of(node.id, e)), None) for e in ("then", "else"))
        return walk(then, [*so_far, f"({test})"]) + walk(other, [*so_far, f"{negate}({test})"])

    root = ir.root()
    return walk(next(iter(ir.next_of(root.id)), None) if root else None, [])


def generate(ir: StrategyIR, target: str = "pyspark") -> str:
    """The source; a strategy that isn't valid raises."""
    if target not in TARGETS:
        raise StrategyError(f"there is no target {target}")
    if problems := ir.validate():
        raise StrategyError("; ".join(problems))
    if target == "pyspark":
        return _PYSPARK.substitute(title=class_name(ir.name), ir=repr(ir.to_json()))
    if target == "pandas":
        rules = [f"    out[{' & '.join(tests) or 'slice(None)'}] = {dict(BUY=1, SELL=-1)[action]}" for tests, action in _paths(ir, lambda c: f'bars["{c}"]', "~") if action in ("BUY", "SELL")]
        return _PANDAS.substitute(title=class_name(ir.name), rules="\n".join(rules))
    rules = [f"  when {' and '.join(tests) or 'always'}: {action.lower()}" for tests, action in _paths(ir, lambda c: c, "not ")]
    return _DSL.substitute(title=snake_case(ir.name), rules="\n".join(rules))


def generate_to_file(ir: StrategyIR, path: str, target: str = "pyspark") -> Path:
    out = Path(path)
    out.write_text(generate(ir, target), encoding="utf-8")
    return out


def sources(strategies: DataFrame, ir: str = "ir", targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """The source of every strategy (JSON in column ``ir``) for every target, made in tasks: the other columns, ``fingerprint``, ``target``, ``source`` and ``error``.

    A strategy that can't be read or isn't valid has an error and no source. Strategies are dealt to
    tasks first, as a million of them may lie in one small file; a task makes equal ones once, as
    long as it remembers them.
    """
    kept = [f for f in strategies.schema.fields if f.name != ir]
    made = T.StructType.fromDDL("fingerprint string, target string, source string, error string").fields

    def read(text: str | None) -> tuple[StrategyIR | None, str | None]:
        try:
            found = json.loads(text or "")
            if not isinstance(found, dict):
                raise StrategyError("no strategy")
            strategy = StrategyIR.from_dict(found)
            return strategy, strategy.fingerprint()
        except (ValueError, KeyError, TypeError, StrategyError) as e:
            return None, type(e).__name__

    def all_of(text: str | None) -> list[tuple]:
        strategy, said = read(text)
        out = []
        for target in targets:
            try:
                out.append((said, target, generate(strategy, target), None) if strategy else (None, target, None, said))
            except (ValueError, KeyError, TypeError, StrategyError) as e:
                out.append((None, target, None, type(e).__name__))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources_of = functools.lru_cache(KEPT)(all_of)
        for frame in frames:
            found, rest = [sources_of(x) for x in frame[ir]], frame.drop(columns=ir)
            for i in range(len(targets)):
                rows = pd.DataFrame([x[i] for x in found], columns=[f.name for f in made], index=frame.index, dtype=object)
                yield pd.concat([rest, rows], axis=1)

    width = int(strategies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strategies.repartition(width).mapInPandas(run, T.StructType(kept + made))
