"""Scenarios, grids, code and published statistics made from tables: brute force, and the defined odd cases."""

import datetime
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import codegen, overfitting, portfolio, search
from quantloom.plans.ir import threshold_strategy
from quantloom.sources import bars as bar_sources

DAY = datetime.datetime(2024, 1, 5)  # a Friday
BARS = "symbol string, ts timestamp_ntz, close double"


def bars_of(spark, closes):
    return spark.createDataFrame([(s, DAY + datetime.timedelta(hours=i), float(x)) for s, xs in closes.items() for i, x in enumerate(xs)], BARS)


def test_sources_of_one_file_are_made_by_several_tasks(spark):
    """However few partitions strategies lie in; equal ones have equal sources, bad ones their error."""
    text = json.dumps(threshold_strategy("RSI", 30, 70).to_dict())
    rows = [(i, (text, text.replace("30", "31"), "{", None)[i % 4]) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, ir string").coalesce(1)
    found = codegen.sources(frame, targets=("pandas", "dsl")).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 800 and len({r.task for r in found}) > 1
    by = {(r.id % 4, r.target, r.source, r.error) for r in found}
    assert len(by) == 8 and {(k, e) for k, _, x, e in by if x is None} == {(2, "JSONDecodeError"), (3, "JSONDecodeError")}


def test_walks_go_on_from_the_last_close(spark):
    b = bars_of(spark, {"a": [10, 11, 10, 12], "few": [5, 6], "one": [7]})
    found = bar_sources.random_walks_after(b, 9).orderBy("symbol", "ts").collect()
    by = {s: list(rows) for s, rows in itertools.groupby(found, lambda r: r.symbol)}
    assert {s: len(x) for s, x in by.items()} == {"a": 9, "few": 9, "one": 9}
    assert all(r.ts.weekday() < 5 and r.ts > DAY for r in found) and by["a"][0].ts == datetime.datetime(2024, 1, 8)
    assert {r.close for r in by["few"]} == {6.0} and {r.close for r in by["one"]} == {7.0} and len({r.close for r in by["a"]}) == 9
    again = bar_sources.random_walks_after(b.repartition(5), 9).orderBy("symbol", "ts").collect()
    assert [(r.symbol, r.ts, round(r.close, 9)) for r in again] == [(r.symbol, r.ts, round(r.close, 9)) for r in found]
    assert bar_sources.random_walks_after(b.where("false"), 9).count() == 0


def test_ramps_cover_the_business_days(spark):
    days = [DAY + datetime.timedelta(days=i) for i in (0, 5)]
    found = bar_sources.ramps_over(spark.createDataFrame([("a", t, 3.0) for t in days], BARS)).orderBy("ts").collect()
    assert [r.ts.day for r in found] == [5, 8, 9, 10] and [r.open for r in found] == pytest.approx([3.0, 3.15, 3.2, 3.25])


def test_grid_of_each_row_equals_the_grid(spark):
    rows = [("a", 1.0, 3.0, 2, 9), ("b", 0.0, 10.0, 5, 5), ("none", None, 1.0, 1, 3), ("back", 0.0, 1.0, 4, 3)]
    ranges = spark.createDataFrame(rows, "k string, lo double, hi double, a int, b int")
    space = {"x": ("float", "lo", "hi"), "n": ("int", "a", "b"), "side": ("categorical", [1, 2])}
    found = {k: sorted((r.combo_idx, r.x, r.n, r.side) for r in rs) for k, rs in itertools.groupby(search.grid_over(ranges, ["k"], space).orderBy("k").collect(), lambda r: r.k)}
    want = {}
    for k, lo, hi, a, b in rows[:2]:
        values = search.grid_values({"x": ("float", lo, hi), "n": ("int", a, b), "side": ("categorical", [1.0, 2.0])})
        want[k] = [(i, *map(float, c)) for i, c in enumerate(itertools.product(*values.values()))]
    assert found == want
    sampled = search.grid_over(ranges, ["k"], space, 7).groupBy("k").count().collect()
    assert {(r.k, r["count"]) for r in sampled} == {("a", 7), ("b", 7)}


def test_sources_of_good_and_bad_strategies(spark):
    good = threshold_strategy("IND_RSI", 30.0, 70.0, period=14)
    rows = [(1, good.to_json()), (2, "not json"), (3, None), (4, json.dumps({"name": "x"})), (5, "[]")]
    found = codegen.sources(spark.createDataFrame(rows, "id int, ir string")).collect()
    assert len(found) == 5 * len(codegen.TARGETS)
    assert {r.target: r.source for r in found if r.id == 1} == {t: codegen.generate(good, t) for t in codegen.TARGETS}
    assert {r.fingerprint for r in found if r.id == 1} == {good.fingerprint()} and "rsi_14" in next(r.source for r in found if r.id == 1 and r.target == "dsl")
    assert all(r.source is None and r.error for r in found if r.id > 1)


def test_published_probabilities(spark):
    rng = np.random.default_rng(3)
    table = rng.normal(0.02, 1, size=(5, 83))
    table[4] = 0.5
    returns = spark.createDataFrame([(s, p, float(x)) for (s, p), x in np.ndenumerate(table)], "strategy_id int, period_idx int, ret double")
    for r in overfitting.sharpe_probabilities(returns, trials=20).collect():
        x, t = table[r.strategy_id], table.shape[1]
        if r.strategy_id == 4:
            assert r.sharpe == 0 and r.psr == pytest.approx(0.5) and not r.significant
            continue
        sharpe, z = x.mean() / x.std(ddof=1) * 252**0.5, (x - x.mean()) / x.std()
        inside = 1 - (z**3).mean() * sharpe + ((z**4).mean() - 1) / 4 * sharpe**2
        error = math.sqrt(inside / (t - 1))
        assert r.sharpe == pytest.approx(sharpe) and r.psr == pytest.approx(0.5 * (1 + math.erf(sharpe / error / 2**0.5)), abs=1e-6)
        assert r.dsr == pytest.approx(sharpe * max(inside, 0.01) - math.sqrt(2 * math.log(20) / t)) and r.significant == (r.dsr / error > 1.645)

    blocks = np.array_split(np.arange(80), 8)
    blocks[-1] = np.arange(70, 83)  # the last takes the rest

    def rate(chosen):
        part = table[:, np.concatenate([blocks[i] for i in chosen])]
        return [round(m / s * 252**0.5, 8) if s > 1e-9 else 0.0 for m, s in zip(part.mean(axis=1), part.std(axis=1))]

    after = 0
    for chosen in itertools.combinations(range(8), 4):
        inner, outer = rate(chosen), rate([i for i in range(8) if i not in chosen])
        best = inner.index(max(inner))
        after += sum(x > outer[best] for x in outer) + (sum(x == outer[best] for x in outer) + 1) / 2 > len(outer) / 2
    found = overfitting.pbo_by_sharpe(returns, 8).first()
    assert found.n_splits == 70 and found.pbo == pytest.approx(after / 70)
    none = overfitting.pbo_by_sharpe(returns.where("false"), 8).first()
    assert none.n_splits == 0 and none.pbo is None and none.risk is None
    with pytest.raises(ValueError):
        overfitting.pbo_by_sharpe(returns, 30)


def test_calmar_of_growth_beyond_doubles(spark):
    steps = [2.0, -0.5, 3.0] * 900  # grows threefold every three steps: beyond the largest double
    returns = spark.createDataFrame([(k, t, x if k == "up" else -x / 10) for k in ("up", "other") for t, x in enumerate(steps)], "k string, ts int, ret double")
    best = portfolio.calmar_weights(returns, "k", 5).collect()
    assert len(best) == 2 and all(math.isfinite(r.log_calmar) and r.log_calmar > 100 for r in best)
    falling = portfolio.calmar_weights(returns.where("k = 'up'").withColumn("ret", F.lit(-0.01)), "k", 2).collect()
    assert [(r.log_calmar, r.trial) for r in falling] == [(None, 0)] and falling[0].calmar == pytest.approx(-1, abs=1e-6)
