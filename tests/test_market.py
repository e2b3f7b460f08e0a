"""As-of joins, corporate actions, staged exits and rebalanced portfolios against plain loops."""

import datetime
import math
import random

import pytest

from quantloom.operators import actions, align, exits, portfolio, prep
from quantloom.plans.ir import Edge, Node, StrategyIR
from quantloom.plans.signals import with_signal

DAY = datetime.datetime(2020, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, amount double"


def day(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def plan(frame):
    return frame._jdf.queryExecution().toString()


@pytest.mark.parametrize("span", ["day", "month", "year"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"], ["k", "m"]])
def test_asof_join_equals_a_search(spark, span, strict, keys):
    rng = random.Random(1)
    one = lambda n: (rng.choice(["a", "b", None]), rng.randint(0, 1), day(rng.choice([None, *range(0, 900, 7)])), n)
    left, right = [one(n) for n in range(150)], [one(n if rng.random() < 0.8 else None) for n in range(60)]
    l = spark.createDataFrame(left, "k string, m int, ts timestamp_ntz, id int")
    r = spark.createDataFrame(right, "k string, m int, ts timestamp_ntz, x int")
    found = {row.id: row.x for row in align.asof_join(l, r, keys, ["x"], span=span, strict=strict).collect()}
    assert len(found) == len(left)
    for k, m, ts, n in left:
        own = {"k": k, "m": m}
        before = [row for row in right if all(own[c] == {"k": row[0], "m": row[1]}[c] for c in keys) and ts and row[2] and (row[2] < ts if strict else row[2] <= ts)]
        best = max(before, key=lambda row: (row[2], row[3] is not None, row[3] or 0)) if before else None
        assert found[n] == (best and best[3]), (k, m, ts)


def test_asof_join_has_no_exchange_on_one_key(spark):
    l = spark.createDataFrame([(day(1), 1)], "ts timestamp_ntz, id int")
    text = plan(align.asof_join(l, l.withColumnRenamed("id", "x"), [], ["x"]))
    assert "_range" in text and "hashpartitioning(1" not in text


def bars_of(spark, closes, symbol="s"):
    return spark.createDataFrame([(symbol, day(i), c, c + 1, c - 1, c, 1.0, c) for i, c in enumerate(closes)], BARS)


def test_corporate_actions_by_hand(spark):
    b = bars_of(spark, [10.0, 10.0, 5.0, 4.5, 4.5, 4.0]).unionByName(bars_of(spark, [7.0] * 6, "calm"))
    events = [("s", day(2), "split", 2.0, None), ("s", day(3), "dividend", None, 0.5), ("s", day(5), "Rights", 0.25, 2.5), ("s", day(5), "dividend", None, 0.25), ("s", day(5), "merger", 3.0, 3.0), ("s", day(0), "split", 9.0, None), ("s", day(4), "dividend", None, 99.0), ("s", day(90), "split", 2.0, None), ("gone", day(2), "split", 2.0, None)]
    e = spark.createDataFrame(events, "symbol string, ts timestamp_ntz, action_type string, ratio double, amount double")
    rights = (4.5 - 0.25 + 0.25 * 2.5) / 1.25 / 4.5
    found = {(r.symbol, r.ts): r.factor for r in actions.factors(b, e).collect()}
    after = 0.5  # a split behind the last bar
    want = [0.5 * 0.9 * rights, 0.5 * 0.9 * rights, 0.9 * rights, rights, rights, 1.0]
    assert [found["s", day(i)] for i in range(6)] == pytest.approx([w * after for w in want])
    assert {found["calm", day(i)] for i in range(6)} == {1.0} and len(found) == 12
    adjusted = prep.forward_adjust(actions.factors(b, e)).where("symbol = 's'").orderBy("ts").collect()
    assert [r.close for r in adjusted] == pytest.approx([c * w for c, w in zip([10.0, 10.0, 5.0, 4.5, 4.5, 4.0], want)])
    assert actions.factors(b, e.limit(0)).where("factor <> 1").isEmpty()


def test_periods_are_cut_into_ranges(spark):
    """Over some years, whatever the range."""
    rng = random.Random(2)
    b = bars_of(spark, [100.0 + rng.random() for _ in range(1500)])
    events = [("s", day(rng.randrange(1, 1600)), "split", 1 + rng.random()) for _ in range(40)]
    e = spark.createDataFrame([(*x, 0.0) for x in events], "symbol string, ts timestamp_ntz, action_type string, ratio double, amount double")
    held = actions.periods(actions.multipliers(e, b))
    for span in ("month", "year"):
        found = {r.ts: r.factor for r in actions.with_factors(b, held, span).collect()}
        assert all(found[day(i)] == pytest.approx(math.prod(1 / ratio for _, ts, _, ratio in events if ts > day(i))) for i in range(1500))


def walk(bars, at, target, stop, trail):
    peak = bars[at][3]
    entry = peak
    goal, low_stop = (None if target is None else entry * (1 + target)), (None if stop is None else entry * (1 - stop))
    for i in range(at + 1, len(bars)):
        o, h, low, c = bars[i]
        trailed = None if trail is None else (1 - trail) * peak
        floors = [x for x in (low_stop, trailed) if x is not None]
        if floors and low <= max(floors):
            return i, min(o, max(floors)), "trail" if low_stop is None or (trailed is not None and trailed > low_stop) else "stop"
        if goal is not None and h >= goal:
            return i, max(o, goal), "target"
        peak = max(peak, h)
    return len(bars) - 1, bars[-1][3], "end"


@pytest.mark.parametrize("fan, stop, trail", [(3, 0.1, None), (4, None, 0.08), (5, 0.06, 0.07), (64, 0.2, 0.3), (7, None, None)])
def test_staged_exits_equal_a_walk_over_bars(spark, fan, stop, trail):
    rng = random.Random(fan)
    series = {}
    for symbol, n in (("a", 700), ("b", 63), ("c", 64), ("d", 1), ("e", 65)):
        price, own = 100.0, []
        for _ in range(n):
            o = price
            price *= math.exp(rng.gauss(0, 0.01))
            own.append((o, max(o, price) * (1 + 0.004 * rng.random()), min(o, price) * (1 - 0.004 * rng.random()), price))
        series[symbol] = own
    rows = [(s, day(i), *b, 1.0, 1.0) for s, own in series.items() for i, b in enumerate(own)]
    bars = spark.createDataFrame(rows, BARS).repartition(3)
    entries = [(s, i) for s, own in series.items() for i in range(len(own)) if i % 11 == 0 or i == len(own) - 1]
    targets = ((0.02, 0.4), (0.15, 0.4), (None, 0.2))
    frame = spark.createDataFrame([(s, day(i)) for s, i in entries] + [("a", day(99_999)), ("zz", day(1))], "symbol string, ts timestamp_ntz")
    found = {(r.symbol, r.entry_ts, r.leg): r for r in exits.staged_exits(frame, bars, targets, stop, trail, fan).collect()}
    assert len(found) == 3 * len(entries)
    for s, i in entries:
        for leg, (target, share) in enumerate(targets):
            j, price, reason = walk(series[s], i, target, stop, trail)
            r = found[s, day(i), leg]
            assert (r.exit_ts, r.reason, r.fraction) == (day(j), reason, share), (s, i, leg)
            assert r.exit_price == pytest.approx(price) and r.ret == pytest.approx(price / series[s][i][3] - 1)


def test_staged_exits_of_nothing(spark):
    bars = bars_of(spark, [1.0, 2.0])
    assert exits.staged_exits(bars.select("symbol", "ts").limit(0), bars, ((0.1, 1.0),)).count() == 0
    assert exits.staged_exits(bars.select("symbol", "ts"), bars.limit(0), ((0.1, 1.0),)).count() == 0


def test_rebalanced_portfolio_equals_a_loop(spark):
    rng = random.Random(3)
    weights, curves = {"a": 0.5, "b": 0.3, "c": 0.2}, {}
    for k, gap in (("a", 1), ("b", 3), ("c", 2)):
        x, own = 50.0, {}
        for i in range(5 if k == "b" else 0, 400, gap):
            x *= math.exp(rng.gauss(0.001, 0.03))
            own[i] = x
        curves[k] = own
    times = sorted({i for own in curves.values() for i in own if i >= 5})
    at = lambda k, i: curves[k][max(j for j in curves[k] if j <= i)]
    value, base, want, months = 1.0, {k: at(k, 5) for k in weights}, {}, [day(i).month + 12 * day(i).year for i in times]
    for n, i in enumerate(times):
        parts = {k: w * at(k, i) / base[k] for k, w in weights.items()}
        grown = value * sum(parts.values())
        want[day(i)] = (grown, None)
        if n + 1 < len(times) and months[n + 1] != months[n]:
            turnover = sum(abs(p / sum(parts.values()) - weights[k]) for k, p in parts.items())
            want[day(i)] = (grown, turnover)
            value, base = grown * (1 - 0.01 * turnover), {k: at(k, i) for k in weights}
    c = spark.createDataFrame([(k, day(i), x) for k, own in curves.items() for i, x in own.items()] + [("other", day(1), 5.0)], "k string, ts timestamp_ntz, equity double").repartition(3)
    w = spark.createDataFrame(list(weights.items()), "k string, weight double")
    found = portfolio.rebalanced(c, "k", w, cost=0.01).collect()
    assert len(found) == len(want)
    for r in found:
        equity, turnover = want[r.ts]
        assert r.equity == pytest.approx(equity) and r.log_equity == pytest.approx(math.log(equity))
        assert (r.turnover is None) == (turnover is None) and (turnover is None or (r.turnover == pytest.approx(turnover) and r.cost == pytest.approx(0.01 * turnover)))


def test_a_coarser_timeframe_is_seen_once_it_has_closed(spark):
    hour = lambda n: DAY + datetime.timedelta(hours=n)
    rows = [("s", hour(n), float(n), n + 1.0, n - 1.0, float(n), 1.0, 1.0) for n in range(60)]
    ir = StrategyIR("x", [Node("root", "root"), Node("if", "condition"), Node("gt", "operator", "EQ"), Node("day", "indicator", "close", {"timeframe": 1440}), Node("v", "value", "", {"value": 23}), Node("buy", "action", "BUY")], [Edge("root", "if"), Edge("if", "gt"), Edge("gt", "day"), Edge("gt", "v"), Edge("if", "buy", "then")])
    found = with_signal(ir, spark.createDataFrame(rows, BARS)).orderBy("ts").collect()
    assert [r.signal for r in found] == [0] * 24 + [1] * 24 + [0] * 12
    assert found[0].asDict().keys() == {*("symbol ts open high low close volume amount signal".split())}


def test_equal_coarse_indicators_are_made_once(spark):
    nodes = [Node("a", "indicator", "SMA", {"period": 3, "timeframe": 1440}), Node("b", "indicator", "SMA", {"period": 3, "timeframe": 1440}), Node("c", "indicator", "SMA", {"period": 3})]
    from quantloom.plans.signals import bind

    bound, columns = bind(StrategyIR("x", nodes), bars_of(spark, [1.0, 2.0, 3.0, 4.0, 5.0]))
    assert columns["a"] == columns["b"] != columns["c"]
    rows = bound.orderBy("ts").collect()
    assert [r[columns["a"]] for r in rows] == [None, None, None, 2.0, 3.0] and [r[columns["c"]] for r in rows] == [None, None, 2.0, 3.0, 4.0]
