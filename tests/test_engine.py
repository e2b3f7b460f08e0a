"""Hand-computed cases and invariants."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, codegen, formula, fuzzy, generate, genetic, indicators, metrics, monte_carlo, overfitting, parzen, portfolio, prep, registry, report, rules, search
from quantloom.plans.ir import Edge, Node, StrategyError, StrategyIR, cross_strategy, threshold_strategy
from quantloom.plans.signals import bind, with_signal
from quantloom.schema import BARS, normalize_bars
from quantloom.sources.bars import random_walk_bars
from quantloom.sources.store import BarStore, coverage

DAY = dt.datetime(2020, 1, 1)


def bars_of(spark, closes, **more):
    """Bars of one symbol, a day each."""
    rows = [{"symbol": "A", "ts": DAY + dt.timedelta(days=i), "open": float(c), "high": float(c), "low": float(c), "close": float(c), "volume": 1000.0, "amount": 1000.0 * c, "turnover_rate": 1.0} for i, c in enumerate(closes)]
    for name, values in more.items():
        for r, v in zip(rows, values):
            r[name] = v
    return spark.createDataFrame(pd.DataFrame(rows)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def signalled(spark, closes, signals, **more):
    return bars_of(spark, closes, signal=signals, **more)


def steps_of(frame, config=backtest.BacktestConfig(), **kw):
    return [r.asDict() for r in backtest.execute(frame, config, **kw).orderBy("bar_seq").collect()]


# -- bars and preparation


def test_bars_are_brought_into_shape(spark):
    raw = spark.createDataFrame([("A", DAY, 10.0, float("nan"), 5.0, True, 1.1)], "symbol string, trade_date timestamp_ntz, close double, amount double, vol double, suspended boolean, adj_factor double")
    got = normalize_bars(raw)
    assert [f.name for f in got.schema] == [f.name for f in BARS]
    r = got.first()
    assert (r.high, r.amount, r.volume, r.is_suspended, r.limit_up, r.adjustment_factor) == (10.0, None, 5.0, True, False, 1.1)


def test_adjustment_and_flags(spark):
    b = bars_of(spark, [10, 11, 12.1], factor=[1.0, 1.0, 2.0])
    assert [r.close for r in prep.forward_adjust(b).orderBy("ts").collect()] == [5.0, 5.5, 12.1]
    assert [r.close for r in prep.backward_adjust(b).orderBy("ts").collect()] == [10.0, 11.0, 24.2]
    marked = prep.mark_limits(bars_of(spark, [10, 11.1, 9.8]), F.lit("nowhere")).orderBy("ts").collect()
    assert [(r.limit_up, r.limit_down) for r in marked] == [(False, False), (True, False), (False, True)]


@pytest.mark.parametrize("method, limit", [("ffill", None), ("ffill", 1), ("bfill", None), ("bfill", 1), ("linear", None)])
def test_fill_like_pandas(spark, method, limit):
    x = [None, 1.0, None, None, 4.0, None]
    b = bars_of(spark, range(6)).drop("close").join(spark.createDataFrame([(DAY + dt.timedelta(days=i), v) for i, v in enumerate(x)], "ts timestamp_ntz, close double"), "ts")
    s = pd.Series(x, dtype=float)
    want = s.interpolate("linear", limit=limit) if method == "linear" else getattr(s, method)(limit=limit)
    got = [r.close for r in prep.fill_missing(b, ("close",), method, limit).orderBy("ts").collect()]
    assert got == [None if np.isnan(v) else v for v in want]


def test_store(spark, tmp_path):
    s = BarStore(spark, f"file://{tmp_path}/bars")
    rows = bars_of(spark, range(1, 61))
    s.insert(rows.drop("symbol").withColumnRenamed("ts", "time"), "D1", "X")
    s.insert(rows, "D1")
    assert s.query("X", "D1", "2020-01-10", "2020-02-05").count() == 27
    assert [r.symbol for r in s.query(["X", "A"], "D1", "2020-01-31", "2020-02-01").collect()] == ["A", "A", "X", "X"]
    assert [r.close for r in s.last("X", "D1", 2).collect()] == [60.0, 59.0]
    s.delete("X", "D1", "2020-01-05", "2020-02-10")
    assert {r.symbol: r.n_bars for r in coverage(s._rows()).collect()} == {"A": 60, "X": 60 - 37}
    s.delete("X", "D1")
    assert {r.symbol for r in s.coverage().collect()} == {"A"}


# -- indicators


def test_rolling_indicators_like_pandas(spark):
    rng = np.random.default_rng(1)
    x = 100 + rng.normal(size=60).cumsum()
    b, s = bars_of(spark, x), pd.Series(x)

    def column(frame, name):
        return frame.orderBy("ts").toPandas()[name].to_numpy(dtype=float)

    np.testing.assert_allclose(column(indicators.sma(b, 7), "sma"), s.rolling(7).mean())
    np.testing.assert_allclose(column(indicators.bbands(b, 7), "upperband"), s.rolling(7).mean() + 2 * s.rolling(7).std())
    np.testing.assert_allclose(column(indicators.ema(b, 7), "ema"), s.ewm(span=7, adjust=False).mean())
    up, down = s.diff().clip(lower=0).fillna(0).rolling(7).mean(), (-s.diff().clip(upper=0)).fillna(0).rolling(7).mean()
    np.testing.assert_allclose(column(indicators.rsi(b, 7), "rsi"), 100 - 100 / (1 + up / down))
    np.testing.assert_allclose(column(indicators.linearreg(b, 7), "linearreg_slope"), s.rolling(7).apply(lambda v: np.polyfit(range(7), v, 1)[0]))
    np.testing.assert_allclose(column(indicators.aroon(b, 7), "aroon_up"), s.rolling(8).apply(lambda v: 100 * (7 - (7 - v.to_numpy().argmax())) / 7))


def test_rsi_without_losses(spark):
    found = [r.rsi for r in indicators.rsi(bars_of(spark, [1, 2, 3, 3, 3, 3]), 3).orderBy("ts").collect()]
    assert found[2] == 100.0 and found[5] is None


def test_registry(spark):
    own = registry.default_registry()
    assert {"SMA", "EMA", "MACD", "HT_SINE", "MAMA", "CYQ", "MAINFORCE", "PLUS_DI", "TSF"} <= set(own.list())
    b = bars_of(spark, range(1, 30))
    assert own.outputs("macd", b) == ["macd", "macdsignal", "macdhist"]
    assert own.compute("sma", b, timeperiod=5).columns[-1] == "sma"
    for bad in (lambda: own.compute("nothing", b), lambda: own.compute("sma", b, period=0), lambda: own.compute("sma", b, period="x")):
        with pytest.raises(registry.IndicatorError):
            bad()
    own.register("double", lambda bars, by=2.0: bars.withColumn("double", F.col("close") * by))
    assert own.compute("DOUBLE", b).orderBy("ts").first()["double"] == 2.0


def test_every_name_is_its_own_column(spark):
    own, b = registry.default_registry(), random_walk_bars(spark, 1, 120)
    # a name stands for the column called like it, with these exceptions
    other = {"BBANDS": "upperband", "AROON": "aroon_down", "STOCH": "slowk", "STOCHF": "fastk", "STOCHRSI": "fastk", "KELTNER": "keltner_upper", "FIBO": "fib_0_0", "HT_PHASOR": "ht_inphase", "MACDEXT": "macd"}
    wholes = {"DIRECTIONAL", "HILBERT", "PRICES"}
    names = [n for n in own.list() if hasattr(indicators, n.lower()) or n.startswith(("HT_", "LINEARREG", "PLUS_", "MINUS_")) or n in ("AROONOSC", "TSF", "MAMA", "AVGPRICE", "MEDPRICE", "TYPPRICE", "WCLPRICE")]
    assert len(names) > 60
    for name in sorted(set(names) - wholes):
        column = other.get(name, name.lower())
        assert own.outputs(name, b)[0] == column, name
    wide = indicators.directional(indicators.aroon(indicators.linearreg(b)))
    for name in ("MINUS_DI", "PLUS_DM", "AROONOSC", "LINEARREG", "LINEARREG_ANGLE", "TSF", "AROON"):
        bound, columns = bind(StrategyIR("one", [Node("x", "indicator", name)]), b)
        found = [r[0] for r in bound.orderBy("ts").select(columns["x"]).collect()]
        assert found == [r[0] for r in wide.orderBy("ts").select(other.get(name, name.lower())).collect()] and found[-1] is not None, name


def test_cycles_of_a_sine(spark):
    """The measured period of a pure wave is its own, its sine leads by an eighth of a turn, and a flat price is its own mean."""
    for period in (16, 24):
        x = 100 + 5 * np.sin(2 * np.pi * np.arange(300) / period)
        tail = indicators.hilbert(bars_of(spark, x)).where("ts > '2020-08-01'").toPandas()
        assert abs(tail.ht_dcperiod.mean() - period) < 0.06 * period and tail.ht_trendmode.mean() < 0.1
        assert np.corrcoef(tail.ht_sine[period // 8 :], tail.ht_leadsine[: -(period // 8)])[0, 1] > 0.95
        assert abs(tail.ht_trendline.mean() - 100) < 0.5
    flat = indicators.hilbert(bars_of(spark, [7.0] * 60)).toPandas().dropna()
    assert (flat.mama == 7).all() and (flat.fama == 7).all() and np.allclose(flat.ht_trendline, 7)


def test_macdext_kinds(spark):
    b = bars_of(spark, [float(x * x % 17) for x in range(60)])
    plain = [r.macd for r in indicators.macdext(b, 3, 6, 4).orderBy("ts").collect()]
    closes = pd.Series([float(x * x % 17) for x in range(60)])
    np.testing.assert_allclose(np.array(plain, float), closes.rolling(3).mean() - closes.rolling(6).mean())
    both = [[tuple(r)[-3:] for r in f.orderBy("ts").collect()] for f in (indicators.macdext(b, 3, 6, 4, 1, 1, 1), indicators.macd(b, 3, 6, 4))]
    np.testing.assert_allclose(*both)
    weighted = np.array([r.macd for r in indicators.macdext(b, 3, 6, 4, 2, 2).orderBy("ts").collect()], float)
    mean = lambda n: closes.rolling(n).apply(lambda x: np.dot(x, np.arange(1, n + 1)) / (n * (n + 1) / 2))
    np.testing.assert_allclose(weighted, mean(3) - mean(6))


@pytest.mark.parametrize("text", ["__import__('os')", "close.real", "open if close else low", "foo(close)", "sma(close)", "sma(close, -1)", "close[0]", "'x'", "sma(close, n=3)", "secret", "1 +"])
def test_formulas_allow_nothing_else(spark, text):
    with pytest.raises(registry.IndicatorError):
        formula.Formula(text).apply(bars_of(spark, [1, 2]), "v")


def test_formula_and_marketplace(spark):
    b = bars_of(spark, range(1, 41))
    assert formula.Formula("sma(close, 3) + shift(close, 1) * 2").apply(b, "v").orderBy(F.desc("ts")).first()["v"] == 39 + 39 * 2
    m = formula.Marketplace()
    assert [x.name for x in m.search("", None)] == ["CapitalPressureScore", "TrendVolumeConfirm", "RangeSqueeze"]
    m.create(formula.Listing("Mine", "Mine", "close / open", rating=5.0))
    assert m.search()[-1].name == "Mine" and m.search("MINE")[0].status == "draft"
    m.install("Mine")
    assert m.get("Mine").downloads == 1
    with pytest.raises(registry.IndicatorError):
        m.create(formula.Listing("Bad", "Bad", "eval(close)"))


# -- strategy graphs


def test_graph_checks_and_edits():
    ir = cross_strategy(5, 20)
    assert ir.validate() == [] and StrategyIR.from_json(ir.to_json()) == ir and hash(StrategyIR.from_json(ir.to_json())) == hash(ir)
    assert ir.expression() == "IF GT(SMA(period=5), SMA(period=20)) THEN BUY ELSE SELL"
    assert ir.depth() == 4 and ir.complexity() == 7 + 4 + 6
    assert ir.rename({"gt": "x"}).validate() == [] and ir.with_params({"fast.period": 9}).node("fast").params == {"period": 9} and ir.with_params({"period": 3}).node("slow").params == {"period": 3}
    assert len(ir.subtree("gt").nodes) == 3 and ir.topological()[0] == "root"
    loop = StrategyIR(nodes=ir.nodes, edges=[*ir.edges, Edge("fast", "if")])
    assert "there is a cycle" in loop.validate()
    assert any("can't be reached" in p for p in StrategyIR(nodes=[*ir.nodes, Node("z", "value")], edges=ir.edges).validate())
    assert any("leads to no node" in p for p in StrategyIR(nodes=ir.nodes, edges=[*ir.edges, Edge("if", "nowhere")]).validate())
    with pytest.raises(StrategyError):
        ir.without("root")
    with pytest.raises(StrategyError):
        ir.with_node(Node("if", "value"))


def test_signals(spark):
    b = bars_of(spark, [5, 4, 3, 4, 5, 6])
    assert [r.signal for r in with_signal(cross_strategy(1, 3), b).orderBy("ts").collect()] == [-1, -1, -1, 1, 1, 1]
    never = StrategyIR(nodes=[Node("r", "root"), Node("i", "condition"), Node("g", "operator", "GT"), Node("a", "value", "", {"value": 1000}), Node("b", "value", "", {"value": 2000}), Node("y", "action", "BUY"), Node("h", "action", "HOLD")], edges=[Edge("r", "i"), Edge("i", "g"), Edge("g", "a"), Edge("g", "b"), Edge("i", "y", "then"), Edge("i", "h", "else")])
    steps = steps_of(with_signal(never, b))
    assert all(s["equity"] == 1_000_000 and s["side"] is None for s in steps)
    with pytest.raises(StrategyError):
        with_signal(StrategyIR(), b)


# -- rules and execution


def test_rule_chain(spark):
    b = bars_of(spark, [100, 110, 109, 90, 90], limit_up=[False] * 4 + [True], is_suspended=[False, False, True, False, False], board=["MAIN"] * 5)
    got = rules.RuleChain().apply(b).orderBy("ts").collect()
    assert [(r.can_buy, r.can_sell) for r in got] == [(True, True), (False, True), (False, False), (True, False), (False, True)]
    assert [r.no_buy_reason for r in got] == [None, "price limit", "suspended", None, "price limit"]
    star = rules.RuleChain().apply(b.withColumn("board", F.lit("star"))).orderBy("ts").collect()
    assert star[1].can_buy
    assert rules.RuleChain().remove("suspended").apply(b).where("no_buy_reason = 'suspended'").count() == 0


def test_buying_and_selling_by_hand(spark):
    steps = steps_of(signalled(spark, [100, 101, 102], [1, 0, -1]))
    price = 100 * 1.001
    shares = int(950_000 / price / 100) * 100
    cash = 1_000_000 - shares * price * 1.0003 - 0.1 * shares
    assert (steps[0]["shares"], round(steps[0]["cash"], 6)) == (shares, round(cash, 6)) and steps[0]["trade_id"] == "T00001"
    assert round(steps[1]["equity"], 6) == round(cash + shares * 101, 6)
    out = 102 * 0.999 * shares
    assert round(steps[2]["cash"], 6) == round(cash + out - out * 0.0008 - 0.102 * shares, 6) and steps[2]["market_value"] == 0
    assert steps[2]["n_won"] == 1 and round(steps[2]["won"], 4) == round(out * 0.9997 - 0.102 * shares - (shares * price * 1.0003 + 0.1 * shares), 4)


def test_shares_bought_today_stay(spark):
    times = [DAY, DAY.replace(hour=5), DAY + dt.timedelta(days=1)]
    frame = bars_of(spark, [100, 100, 100], signal=[1, -1, -1], ts=times)
    assert [s["side"] for s in steps_of(frame)] == [1, None, -1]


def test_limits_and_suspensions_block(spark):
    flags = [False] * 3
    assert all(s["side"] is None for s in steps_of(signalled(spark, [100, 100, 100], [1, 1, 1], limit_up=[True] * 3)))
    assert all(s["side"] is None for s in steps_of(signalled(spark, [100, 100, 100], [1, 1, 1], is_suspended=[True] * 3)))
    assert [s["side"] for s in steps_of(signalled(spark, [100, 100, 100], [1, 0, -1], limit_down=[*flags[:2], True]))] == [1, None, None]


def test_rights_adjustment(spark):
    config = backtest.BacktestConfig(sizing="lot", lot=1000)
    steps = steps_of(signalled(spark, [100, 100], [1, 0], adjustment_factor=[1.0, 1.1]), config)
    assert steps[1]["market_value"] == 909 * 100


def test_other_fills_and_sizes(spark):
    later = steps_of(signalled(spark, [100, 120], [1, 0], open=[100.0, 110.0], board=["STAR"] * 2, limit_up=[False] * 2, high=[100.0, 110.0]), backtest.BacktestConfig(fill="next_open"))
    assert [s["side"] for s in later] == [None, 1] and later[1]["price"] == pytest.approx(110.11)
    part = steps_of(signalled(spark, [100], [1]), backtest.BacktestConfig(sizing="percent"))
    assert part[0]["shares"] == 900
    two = bars_of(spark, [100, 100], signal=[1, 0]).unionByName(bars_of(spark, [10, 12], signal=[1, 0]).withColumn("symbol", F.lit("B"))).withColumn("run_id", F.lit(1))
    shared = steps_of(two, backtest.BacktestConfig(sizing="percent"), keys=("run_id",))
    a, b = shared[0]["shares"], shared[1]["shares"]
    assert shared[-1]["market_value"] == a * 100 + b * 12


def test_figures_agree_in_both_forms(spark):
    rng = np.random.default_rng(5)
    closes = 100 * np.exp(rng.normal(0, 0.02, 300).cumsum())
    b = bars_of(spark, closes)
    signal = np.where(rng.random(300) < 0.4, 1, -1).tolist()
    one = metrics.performance(backtest.execute(signalled(spark, closes, signal)), ["symbol"]).first().asDict()
    many = backtest.evaluate(b.join(spark.createDataFrame([(DAY + dt.timedelta(days=i), [0, s, 1]) for i, s in enumerate(signal)], "ts timestamp_ntz, signals array<int>"), "ts"), chunk=2)
    got = {r.combo_idx: r.asDict() for r in many.collect()}
    assert sorted(got) == [0, 1, 2] and got[0]["net_profit"] == 0
    for name in backtest.FIGURES:
        assert got[1][name] == pytest.approx(one[name], rel=1e-9, abs=1e-9), name


def test_drawdown_and_fifo_by_hand(spark):
    curve = spark.createDataFrame([("r", i, float(e)) for i, e in enumerate([1_000_000, 1_100_000, 1_050_000, 900_000, 950_000, 1_200_000])], "k string, bar_seq int, equity double")
    m = metrics.equity_metrics(curve, ["k"]).first()
    assert m.max_drawdown_pct == pytest.approx(-18.181818, abs=1e-6) and m.max_drawdown_duration == 3
    trades = spark.createDataFrame([(1, "A", 1, 1000, 100.0, 30.0, 10.0, DAY), (2, "A", -1, 1000, 110.0, 33.0, 11.0, DAY)], "trade_seq int, symbol string, signal int, shares long, price double, commission double, slippage double, ts timestamp_ntz")
    assert metrics.fifo_round_trips(trades, []).first().pnl == pytest.approx(9_916)
    assert metrics.equity_metrics(curve.limit(0), ["k"]).count() == 0
    assert metrics.equity_metrics(curve.limit(1), ["k"]).first().sharpe_ratio == 0


def queue_trips(trades):
    """Round trips by a queue of lots for each symbol."""
    lots, out = {}, []
    for symbol, seq, signal, shares, price, commission, slippage in sorted(trades, key=lambda t: t[1]):
        queue = lots.setdefault(symbol, [])
        if signal > 0:
            queue.append([seq, shares, shares, shares * price + commission + slippage])
            continue
        left, net = shares, shares * price - commission - slippage
        while left and queue:
            lot = queue[0]
            n = min(left, lot[1])
            out.append((symbol, lot[0], seq, n, round(net * n / shares - lot[3] * n / lot[2], 6)))
            left, lot[1] = left - n, lot[1] - n
            if not lot[1]:
                queue.pop(0)
    return sorted(out)


def test_fifo_drops_what_sells_ask_for_beyond_open_lots(spark):
    names = "symbol string, trade_seq int, signal int, shares long, price double, commission double, slippage double"
    timed = lambda rows: spark.createDataFrame(rows, names).withColumn("ts", F.lit(DAY))
    found = lambda rows: sorted((r.symbol, r.buy_trade_seq, r.sell_trade_seq, r.shares, round(r.pnl, 6)) for r in metrics.fifo_round_trips(timed(rows), []).collect())
    sold_first = [("A", 1, -1, 100, 10.0, 0.0, 0.0), ("A", 2, 1, 100, 5.0, 0.0, 0.0), ("A", 3, -1, 100, 8.0, 0.0, 0.0)]
    assert found(sold_first) == [("A", 2, 3, 100, 300.0)] == queue_trips(sold_first)
    rng = np.random.default_rng(6)
    rows = [("AB"[int(rng.integers(2))], i, int(rng.choice([1, -1])), int(rng.integers(1, 900)) * 100, float(rng.integers(5, 50)), 1.5, 0.25) for i in range(400)]
    assert found(rows) == queue_trips(rows)


def test_fifo_counts_run_over_spans(spark):
    """Counts, and what is dropped, pass from span to span and from bucket to bucket; a span that is null comes first."""
    names = "symbol string, trade_seq long, signal int, shares long, price double, commission double, slippage double"
    rng = np.random.default_rng(8)
    for most in (30, 9_000):  # many lots a bucket, and lots across several
        rows = [("AB"[int(rng.integers(2))], i * 5_000, int(rng.choice([1, -1], p=[0.52, 0.48])), int(rng.integers(1, most)) * 300, float(rng.integers(5, 50)), 1.5, 0.25) for i in range(500)]
        trades = spark.createDataFrame(rows, names).withColumn("ts", F.lit(DAY)).withColumn("day", F.when(F.col("trade_seq") >= 60_000, F.floor(F.col("trade_seq") / 35_000)))
        want = queue_trips(rows)
        for span in (None, "day"):
            found = metrics.fifo_round_trips(trades, [], span).collect()
            assert sorted((r.symbol, r.buy_trade_seq, r.sell_trade_seq, r.shares, round(r.pnl, 6)) for r in found) == want and len(want) > 200


# -- robustness and search


def test_monte_carlo_is_repeatable_and_keeps_sums(spark):
    trades = spark.createDataFrame([("r", i, float(i % 7 - 3)) for i in range(50)], "run_id string, trade_seq int, pnl double")
    a, b = (sorted(map(tuple, monte_carlo.perturb(t, "shuffle_trades", 5).select("sim_id", "trade_seq", "place").collect())) for t in (trades, trades.repartition(7)))
    assert a == b
    sums = {r.sim_id: r.s for r in monte_carlo.perturb(trades, "shuffle_trades", 5).groupBy("sim_id").agg(F.sum("pnl").alias("s")).collect()}
    assert set(sums.values()) == {sum(i % 7 - 3 for i in range(50))}
    kept = {r.n for r in monte_carlo.perturb(trades, "delete_trades", 40).groupBy("sim_id").agg(F.count("*").alias("n")).collect()}
    assert kept == {45, 40}
    with pytest.raises(ValueError):
        monte_carlo.perturb(trades, "nothing", 2)


def test_overfitting_bounds(spark):
    rng = np.random.default_rng(2)
    noise = spark.createDataFrame([(s, p, float(x)) for (s, p), x in np.ndenumerate(rng.normal(size=(10, 100)))], "strategy_id int, period_idx int, ret double")
    skilled = noise.withColumn("ret", F.col("ret") + F.when(F.col("strategy_id") == 3, 5.0).otherwise(0.0))
    assert 0 <= overfitting.pbo(noise).first().pbo <= 1 and overfitting.pbo(skilled).first().pbo == 0
    assert overfitting.psr(noise, -1.0).first().psr == 0 and overfitting.psr(noise, 5.0).first().psr > 0.99
    assert overfitting.split_table(spark, 4).select("split_id").distinct().count() == 70


def test_windows_and_efficiency(spark):
    w = search.wfo_windows(bars_of(spark, range(1, 201)), 50, 30, 20).orderBy("window_idx").collect()
    assert [(r.is_start, r.oos_start, r.oos_end) for r in w] == [(20 * i, 20 * i + 50, 20 * i + 80) for i in range(7)]
    got = [r.e for r in spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (-1.0, 1.0), (1.0, -1.0)], "a double, b double").select(search.efficiency(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == [1.0, 0.5, 0.0, 0.0]
    assert search.grid_values({"n": ("int", 2, 10), "m": ("int", 1, 2), "x": ("float", 0.0, 1.0)}) == {"n": [2, 4, 6, 8, 10], "m": [1, 2], "x": [0.0, 0.25, 0.5, 0.75, 1.0]}
    assert search.grid(spark, {"a": list(range(20)), "b": list(range(20))}, 100).count() == 100


def test_optimizer_finds_a_peak(spark):
    best, value, history = parzen.optimize(spark, lambda trials: [-((t["x"] - 3) ** 2) - (t["k"] != "b") for t in trials], {"x": ("float", -10.0, 10.0), "k": ("categorical", ["a", "b"])}, batches=12, size=12, patience=100)
    assert abs(best["x"] - 3) < 1 and best["k"] == "b" and len(history) == 144


def test_latin_hypercube_uses_every_stratum(spark):
    rows = parzen.latin_hypercube(spark, {"x": ("float", 0.0, 1.0), "k": ("categorical", ["a", "b"]), "n": ("int", 0, 100)}, 10).collect()
    assert sorted(int(r["x"] * 10) for r in rows) == list(range(10)) and [r["k"] for r in rows].count(0.0) == 5 and len({r["n"] for r in rows}) >= 9
    for n in (1, 2, 7, 1000):
        rows = parzen.latin_hypercube(spark, {"x": ("float", 0.0, float(n)), "y": ("float", 0.0, float(n))}, n, seed=n).collect()
        assert sorted(int(r.x) for r in rows) == sorted(int(r.y) for r in rows) == list(range(n))
    x, y = ([getattr(r, c) for r in rows] for c in "xy")
    assert abs(np.corrcoef(x, y)[0, 1]) < 0.1 and abs(np.corrcoef(x, range(n))[0, 1]) < 0.1


@pytest.mark.parametrize("period", [1, 2, 14, 200, 3000])
def test_exponential_means_over_long_series(spark, period):
    """Against pandas, over many blocks of decay, for several symbols of other lengths and with values missing at the beginning."""
    rng, frames = np.random.default_rng(period), []
    for symbol, n in (("a", 20_000), ("b", 1), ("c", 777)):
        x = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        x[: min(n - 1, 5)] = np.nan
        frames.append(pd.DataFrame({"symbol": symbol, "ts": pd.Timestamp("2000-01-01") + pd.to_timedelta(np.arange(n), "h"), "close": x}))
    whole = pd.concat(frames)
    bars = spark.createDataFrame(whole).withColumn("close", F.nanvl("close", F.lit(None).cast("double"))).repartition(4)
    found = indicators.dema(indicators.ema(bars, period), period).toPandas().sort_values(["symbol", "ts"])
    for symbol, f in found.groupby("symbol"):
        e = f.close.ewm(span=period, adjust=False).mean()
        assert np.allclose(f.ema, e, rtol=1e-10, equal_nan=True)
        assert np.allclose(f.dema, 2 * e - e.ewm(span=period, adjust=False).mean(), rtol=1e-8, equal_nan=True)


def plain_fronts(points):
    front, left, number = np.zeros(len(points), int), np.arange(len(points)), 0
    while len(left):
        number += 1
        own = points[left]
        beaten = np.array([((own >= x).all(1) & (own > x).any(1)).any() for x in own])
        front[left[~beaten]] = number
        left = left[beaten]
    return front


@pytest.mark.parametrize("values", [1, 2, 3, 4])
def test_fronts_equal_peeling_them_off(values):
    rng = np.random.default_rng(values)
    for n, levels in ((1, 3), (50, 3), (200, 8), (300, 1000)):
        points = rng.integers(0, levels, (n, values)).astype(float)
        assert (genetic.front_numbers(points) == plain_fronts(points)).all()
    assert genetic.fronts(np.zeros((0, values)))[0].shape == (0,)
    assert genetic.front_numbers(np.array([[1.0] * values, [np.nan] * values])).tolist() == [1, 2]


def test_fronts_of_a_large_population(spark):
    """A hundred thousand rows under one key."""
    rows = spark.range(100_000).selectExpr("1 AS k", *(f"(id * {m} % 100003) / 100003.0 AS {c}" for c, m in (("x", 7919), ("y", 104729), ("z", 1299709))))
    found = genetic.nsga2_ranks(rows, ["k"], ("x", "y", "z"))
    got = found.agg(F.count("*").alias("n"), F.max("front").alias("last"), F.sum((F.col("front") == 1).cast("int")).alias("first")).first()
    assert got.n == 100_000 and got.last > 20 and 0 < got.first < 5000


def test_correlation_by_tiles(spark):
    """Many tiles and panels, gaps, and curves that never meet."""
    rng = np.random.default_rng(4)
    names = [f"c{i}" for i in range(12)]
    values = pd.DataFrame(rng.normal(size=(400, 12)) + rng.normal(size=(400, 1)), columns=names).where(rng.random((400, 12)) > 0.3)
    values.loc[:199, "c0"], values.loc[200:, "c1"] = np.nan, np.nan
    days = pd.Timestamp("2019-11-01") + pd.to_timedelta(range(400), "D")
    long = values.assign(ts=days).melt("ts", var_name="k", value_name="ret").dropna()
    for tile, span in ((3, "month"), (256, "year")):
        found = {(r.k_a, r.k_b): r for r in portfolio.correlation(spark.createDataFrame(long), "k", tile=tile, span=span).collect()}
        assert ("c0", "c1") not in found and len(found) == 12 * 13 // 2 - 1
        for (a, b), r in found.items():
            both = values[[a, b]].dropna() if a != b else values[[a]].dropna().assign(other=values[a])
            assert a <= b and r.n == len(both) and abs(r["corr"] - both.corr().iloc[0, 1]) < 1e-9 and abs(r.covar - both.cov().iloc[0, 1]) < 1e-9


def plan_of(frame):
    return frame._jdf.queryExecution().analyzed().toString()


def test_strategies_share_indicators_and_what_looks_back(spark):
    """Six strategies over one mean plan the windows of one."""
    t, ind, const = genetic.Tree, lambda n, p=0: genetic.Tree("IND", (), n, p), lambda x: genetic.Tree("CONST", (), "", x)
    lagged = t("LAG", (ind("EMA", 14),), "", 2)
    many = [genetic.to_ir(t("AND", (t("CROSSOVER", (ind("EMA", 14), lagged)), t("GT", (ind("RSI", 14), const(float(i))))))) for i in range(6)]
    b = bars_of(spark, 100 + np.sin(np.arange(60)))
    plans = [plan_of(generate.signals_of(x, b)[0].select("symbol", "ts", F.array(*generate.signals_of(x, b)[1]).alias("s"))) for x in (many[:1], many)]
    wide = [generate.signals_of(x, b)[0].columns for x in (many[:1], many)]
    assert wide[0] == wide[1] and plans[0].count("windowspecdefinition") == plans[1].count("windowspecdefinition") > 0
    alone = [with_signal(ir, b).orderBy("ts").select("signal").collect() for ir in many]
    frame, signals = generate.signals_of(many, b)
    together = frame.select("ts", *(x.alias(f"s{i}") for i, x in enumerate(signals))).orderBy("ts").collect()
    assert all([r[f"s{i}"] for r in together] == [r.signal for r in own] for i, own in enumerate(alone))


@pytest.mark.parametrize("batch", [3, 100])
def test_random_populations_equal_each_strategy_alone(spark, batch, monkeypatch):
    monkeypatch.setattr(generate, "BATCH", batch)
    rng = random.Random(11)
    b = bars_of(spark, 100 + 10 * np.sin(np.arange(90) / 5))
    names = ("SMA", "EMA", "RSI", "MOM", "BBANDS", "KAMA")
    many = [genetic.to_ir(genetic.random_tree(rng, depth=4, indicators=names)) for _ in range(12)]
    frame, signals = generate.signals_of(many, b)
    together = frame.select("ts", *(x.alias(f"s{i}") for i, x in enumerate(signals))).orderBy("ts").collect()
    for i, ir in enumerate(many):
        assert [r[f"s{i}"] for r in together] == [r.signal for r in with_signal(ir, b).orderBy("ts").collect()], i


def test_exponential_means_need_no_python(spark):
    b = bars_of(spark, range(1, 30))
    for f in (indicators.ema, indicators.macd, indicators.dema, indicators.tema, indicators.t3, indicators.trix, indicators.ppo, indicators.apo, indicators.keltner, indicators.adosc, indicators.kama):
        text = f(b)._jdf.queryExecution().optimizedPlan().toString()
        assert "Pandas" not in text and "Python" not in text, f.__name__


def test_densities_follow_the_trials(spark):
    space = {"x": ("float", 0.0, 1.0), "k": ("categorical", ["a", "b", "c"]), "n": ("int", 1, 4)}
    rows = [((i % 100) / 100, float(i % 3), float(1 + i % 4), (10.0 if i % 100 < 20 else 0.0) - (i % 3)) for i in range(600)] + [(0.9, 0.0, 1.0, None)] * 50
    found = parzen.densities(spark.createDataFrame(rows, "x double, k double, n double, value double"), space, share=0.05)
    for name, spec in space.items():
        for side in found[name]:
            assert abs(side.sum() - 1) < 1e-9 and (side > 0).all()
    good, bad = found["x"]
    assert good[:51].sum() > 0.9 and bad[:51].sum() < 0.2 and found["k"][0][0] > 0.9
    proposed = parzen.propose(spark.createDataFrame(rows, "x double, k double, n double, value double"), space, 5, seed=3).collect()
    assert len(proposed) == 5 and all(0 <= r.x <= 1 and r.n in (1, 2, 3, 4) for r in proposed) and all(r.x < 0.25 and r.k == 0.0 and r.score > 0 for r in proposed if r.slot > 1)


def test_known_trials_are_not_proposed_again(spark):
    space = {"n": ("int", 0, 2), "k": ("categorical", ["a", "b"])}
    known = [(float(n), float(k), 1.0 * n) for n in range(3) for k in range(2) if (n, k) != (1, 1)]
    found = parzen.propose(spark.createDataFrame(known, "n double, k double, value double"), space, 3, 200).collect()
    assert found and {(r.n, r.k) for r in found} == {(1.0, 1.0)}
    assert parzen.propose(spark.createDataFrame(known + [(1.0, 1.0, None)], "n double, k double, value double"), space, 3).count() == 0
    assert len(parzen.propose(spark.createDataFrame([], "n double, k double, value double"), space, 3).collect()) == 3


def test_random_walks_differ_by_symbol_and_repeat(spark):
    a, b = (sorted(map(tuple, random_walk_bars(spark, 2, 50).repartition(n).collect())) for n in (1, 5))
    assert a == b and len(a) == 100 and {r[5] for r in a if r[0] == "S000"} != {r[5] for r in a if r[0] == "S001"}
    assert all(r[3] >= max(r[2], r[5]) and r[4] <= min(r[2], r[5]) for r in a)


def test_generation(spark):
    b = bars_of(spark, 100 + 10 * np.sin(np.arange(120) / 6))
    better, log = generate.improve(cross_strategy(5, 20), generate.evaluator(b, "total_return_pct"), "indicator_params", 2)
    assert len(log) == 2 and log[-1]["after"] >= log[0]["before"] and better.validate() == []
    for make in generate.CANDIDATES.values():
        assert all(c.validate() == [] for c in make(cross_strategy(5, 20)))
    twice = generate.evaluate_all([cross_strategy(5, 20), cross_strategy(5, 20)], b)
    assert twice.select("net_profit").distinct().count() == 1 and twice.count() == 2


def test_trees_cross_and_change():
    rng = random.Random(3)
    for _ in range(60):
        one, two = genetic.mate(genetic.random_tree(rng), genetic.random_tree(rng), rng)
        for tree in (one, genetic.mutate(two, rng)):
            assert genetic.from_ir(genetic.to_ir(tree)) == tree and genetic.to_ir(tree).validate() == [] and tree.height() <= genetic.HIGHEST
            for _, x in tree.places():
                kinds = (genetic.TESTS | genetic.NUMBERS).get(x.op, "")
                assert "".join(k.kind for k in x.kids) == kinds
    ops = {x.op for _ in range(300) for _, x in genetic.random_tree(rng, depth=4).places()}
    assert ops == set(genetic.TESTS) | set(genetic.NUMBERS) | {"IND", "CONST"}
    assert {x.name for _ in range(400) for _, x in genetic.random_tree(rng).places()} - {""} == set(genetic.INDICATORS)


def test_every_terminal_can_be_evaluated(spark):
    b = random_walk_bars(spark, 1, 60)
    for name in genetic.INDICATORS:
        tree = genetic.Tree("GT", (genetic.Tree("IND", (), name, 5 if genetic.takes_period(name) else 0), genetic.Tree("CONST")))
        assert with_signal(genetic.to_ir(tree), b).columns[-1] == "signal"


def test_evolution(spark):
    met = []

    def rate(strategies):
        met.extend(strategies)
        return [{"sharpe_ratio": float(len(ir.nodes) % 7), "max_drawdown_pct": -float(len(ir.nodes) % 5), "win_rate": 0.5} for ir in strategies]

    for several in (False, True):
        met.clear()
        best = genetic.evolve(rate, population=20, generations=4, several=several)
        assert len(best) == 5 and len(set(met)) == len(met) and best == sorted(best, key=lambda x: [-v for v in x[1]])
        assert best[0][1][0] <= max(len(ir.nodes) % 7 for ir in met)
    found = genetic.evolve(genetic.rater(bars_of(spark, 100 + 10 * np.sin(np.arange(120) / 6))), population=4, generations=1, indicators=("SMA", "MOM"))
    assert found == genetic.evolve(genetic.rater(bars_of(spark, 100 + 10 * np.sin(np.arange(120) / 6))), population=4, generations=1, indicators=("SMA", "MOM"))


def test_fronts_by_hand(spark):
    points = np.array([(1, 5), (2, 4), (3, 3), (5, 1), (2, 2), (1, 1), (3, 3)], float)
    front, crowd = genetic.fronts(points)
    assert front.tolist() == [1, 1, 1, 1, 2, 3, 1]
    assert np.isinf(crowd[[0, 3, 4, 5]]).all() and crowd[1] == pytest.approx(2 / 4 + 2 / 4)
    rng = np.random.default_rng(4)
    rows = [(int(k), float(a), float(b)) for k, a, b in zip(rng.integers(0, 3, 3000), rng.integers(0, 60, 3000), rng.integers(0, 60, 3000))]
    frame = spark.createDataFrame(rows, "k int, a double, b double")
    top = {k: {(a, b) for q, a, b in rows if q == k and not any(p == k and x >= a and y >= b and (x > a or y > b) for p, x, y in rows)} for k in range(3)}
    found = genetic.pareto_front(frame, ["k"], ("a", "b")).collect()
    assert {k: {(r.a, r.b) for r in found if r.k == k} for k in range(3)} == top
    assert len(found) == sum((a, b) in top[k] for k, a, b in rows)
    whole = genetic.pareto_front(frame.drop("k"), [], ("a", "b")).collect()
    assert {(r.a, r.b) for r in whole} == {(a, b) for _, a, b in rows if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in rows)}


def test_weights_and_p_values(spark):
    rng = np.random.default_rng(5)
    returns = spark.createDataFrame([(k, t, float(0.001 * (i + 1) + 0.01 * (3 - i) * x)) for i, k in enumerate("abc") for t, x in enumerate(rng.normal(size=80))], "k string, ts int, ret double")
    least = {r.k: r.weight for r in portfolio.weights_for(returns, "k", "min_vol").collect()}
    assert sum(least.values()) == pytest.approx(1) and 0.6 < least["c"] < 0.8
    best = portfolio.calmar_weights(returns, "k", 30).collect()
    assert len(best) == 3 and sum(r.weight for r in best) == pytest.approx(1) and len({r.calmar for r in best}) == 1
    assert [spark.range(1).select(portfolio.harmonic(F.lit(n)).alias("h")).first().h for n in (1, 3, 20, 21, 1000)] == pytest.approx([sum(1 / i for i in range(1, n + 1)) for n in (1, 3, 20, 21, 1000)], abs=1e-10)
    p = [float(x) for x in np.round(rng.uniform(0, 0.2, 300), 2)] + [None]
    rows = portfolio.corrected_p_values(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id int, p_value double"), parts=7).collect()
    m, ranked = 300, sorted(x for x in p if x is not None)
    c = sum(1 / i for i in range(1, m + 1))
    raw = [x * m * c / (i + 1) for i, x in enumerate(ranked)]
    want = {x: min(1.0, min(raw[i] for i in range(m) if ranked[i] >= x)) for x in set(ranked)}
    assert len(rows) == 301 and all(r.bhy == pytest.approx(want[r.p_value]) if r.p_value is not None else r.bhy is None for r in rows)


def test_formula_parameters(spark):
    b = bars_of(spark, range(1, 41))
    f = formula.Formula("sma(close, n) * k + max(close, n)", {"n": 3, "k": 2.0})
    assert f.apply(b, "v").orderBy(F.desc("ts")).first().v == 39 * 2 + 40
    market = formula.Marketplace()
    market.create(formula.Listing("Mine", "Mine", "shift(close, n)", params=(("n", 1),)))
    assert [market.install("Mine", **more).apply(b, "v").orderBy(F.desc("ts")).first().v for more in ({}, {"n": 4})] == [39, 36]
    for text, params in (("close + other", {"n": 1}), ("sma(close, n)", {"n": 0}), ("close * n", {"n": "x"})):
        with pytest.raises(registry.IndicatorError):
            formula.Formula(text, params).apply(b, "v")


# -- fuzzy rules, reports, portfolios, code


def test_membership_edges(spark):
    m = fuzzy.Membership("x", (0, 0, 15, 25))
    got = [r.d for r in spark.createDataFrame([(v,) for v in (0.0, 0.1, 15.0, 20.0, 25.0, None)], "v double").select(m.degree(F.col("v")).alias("d")).collect()]
    assert got == [0.0, 1.0, 1.0, 0.5, 0.0, 0.0]
    assert all(fuzzy.FuzzySpec.template(t).to_ir().validate() == [] for t in fuzzy.TEMPLATES)


def test_fuzzy_graph_gives_the_same_signal(spark):
    spec = fuzzy.FuzzySpec.template("balanced", 0.35, 0.3)
    inputs = fuzzy.fuzzy_inputs(bars_of(spark, 100 + 10 * np.sin(np.arange(80) / 5)))
    direct = fuzzy.fuzzy_signal(inputs, spec)
    graph = with_signal(spec.to_ir(), fuzzy.fuzzy_scores(inputs, spec))
    assert direct.join(graph.withColumnRenamed("signal", "other"), "ts").where("signal <> other").count() == 0 and direct.where("signal <> 0").count() > 0


def test_report_by_hand(spark):
    rows = spark.createDataFrame([(1, -8.0, 30.0, 1.8, 0.55, 1.8, 120.0, 1.2), (2, -25.0, -5.0, 0.2, 0.3, 0.9, 10.0, 0.1)], "run_id int, max_drawdown double, total_return double, sharpe double, win_rate double, profit_factor double, trades double, calmar double")
    good, bad = report.analyze(rows).orderBy("run_id").collect()
    assert good.regime == "steady" and good.quality_score == pytest.approx(50 + 21.6 + 15 + 6) and [i.severity for i in good.insights] == ["low"]
    assert bad.regime == "unconvincing" and len(bad.suggested_actions) <= 6 and {i.title for i in bad.insights} == {"drawdown of 20 % or more", "Sharpe ratio under 0.8", "profit factor under 1.2", "under 20 trades"}


def test_weights():
    cov, mean = np.diag([0.04, 0.01]), np.array([0.05, 0.05])
    assert portfolio.optimal_weights(mean, cov, "min_vol") == pytest.approx([0.2, 0.8], abs=0.01)
    assert portfolio.optimal_weights(mean, cov, "max_return").tolist() == [1, 0]
    assert portfolio.optimal_weights(mean, cov).sum() == pytest.approx(1)


def test_generated_code_runs(spark, tmp_path):
    ir = threshold_strategy("RSI", 30.0, 70.0, period=14)
    scope = {}
    exec(compile(codegen.generate(ir, "pandas"), "strategy", "exec"), scope)
    assert scope["signal"](pd.DataFrame({"rsi_14": [20.0, 50.0, 80.0]})).tolist() == [1, 0, -1]
    scope = {}
    exec(compile(codegen.generate_to_file(ir, str(tmp_path / "s.py")).read_text(), "strategy", "exec"), scope)
    bars_of(spark, 100 + 10 * np.sin(np.arange(80) / 5)).write.parquet(f"file://{tmp_path}/bars")
    assert scope["run"](spark, f"file://{tmp_path}/bars").count() == 1
    assert "when (rsi_14 < 30.0): buy" in codegen.generate(ir, "dsl")
    for bad in (lambda: codegen.generate(StrategyIR(), "pandas"), lambda: codegen.generate(ir, "cobol")):
        with pytest.raises(StrategyError):
            bad()
    assert codegen.snake_case("MyFastRSI x") == "my_fast_rsi_x" and codegen.class_name("my fast_rsi") == "MyFastRsi"
