"""SQL twins of the queries over scenarios, and the long ones: an account of many symbols, the cycle measures, a population of trees."""

from __future__ import annotations

from quantloom.operators.genetic import Tree, random_population
from quantloom.operators.indicators import HILBERT
from quantloom.oracles import _STEP, _WALK, ALL, B_COLUMNS, CROSS, DAILY, HOURLY, ORACLES, PLAIN_RULES, RETS, RULED, TR, S, cdf, div, execution, lag, metric_tables, r, roll, staged

ORACLES["ramps_over"] = f"""WITH {DAILY}, e AS (SELECT symbol, min(ts)::DATE AS first, max(ts)::DATE AS last, arg_min(close, ts) AS base FROM bars GROUP BY symbol),
x AS (SELECT symbol, (first + i::INT)::TIMESTAMP AS ts, i AS n, base + i * 0.05::DOUBLE AS base FROM e, range(20000) g(i) WHERE first + i::INT <= last AND isodow(first + i::INT) <= 5)
SELECT symbol, ts, {r('base', 'open')}, {r('base + 0.5', 'high')}, {r('base - 0.5', 'low')}, {r('base + 0.1', 'close')}, 1000.0::DOUBLE + n * 10 AS volume FROM x"""

ORACLES["random_walks_after"] = f"""WITH {HOURLY}, l AS (SELECT symbol, ts, close, ln({div('close', lag('close'))}) AS ch FROM bars),
e AS (SELECT symbol, max(ts)::DATE AS last, arg_max(close, ts) AS base, avg(ch) AS drift, stddev_samp(ch) AS spread FROM l GROUP BY symbol),
n AS (SELECT symbol, base, CASE WHEN spread IS NULL THEN 0.0 ELSE drift END AS drift, coalesce(spread, 0.0) AS spread, (last + i::INT)::TIMESTAMP AS ts, row_number() OVER (PARTITION BY symbol ORDER BY i) AS n FROM e, range(1, 92) g(i) WHERE isodow(last + i::INT) <= 5 QUALIFY n <= 60),
c AS (SELECT *, base * exp(sum(drift + spread * {_STEP}) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS close FROM n),
o AS (SELECT *, close * (1 + 0.01::DOUBLE * ({_WALK('open')} - 0.5)) AS open FROM c),
h AS (SELECT *, greatest(open, close) * (1 + 0.01::DOUBLE * {_WALK('high')}) AS high, least(open, close) * (1 - 0.01::DOUBLE * {_WALK('low')}) AS low, 1e6 + floor({_WALK('volume')} * 49e6) AS volume, {div('close', lag('close'))} - 1 AS ch FROM o)
SELECT symbol, ts, {', '.join(r(x, digits=4) for x in ALL[:5])}, coalesce(ch >= 0.095, false) AS limit_up, coalesce(ch <= -0.095, false) AS limit_down, {_WALK('suspended')} < 0.01 AS is_suspended, 1.0::DOUBLE AS adjustment_factor FROM h"""

ORACLES["grid_over"] = f"""WITH {DAILY}, g AS (SELECT symbol, min(close) AS lowest, max(close) AS highest, floor(sqrt(count(*)))::INT AS longest, least(5, floor(sqrt(count(*)))::INT - 1) AS k FROM bars GROUP BY symbol)
SELECT symbol, (((i * k + j) * 5 + m) * 2 + s)::INT AS combo_idx, {r('lowest + (highest - lowest) * i / 4', 'level')}, trunc(2 + (longest - 2) * j / greatest(1, k - 1)::DOUBLE)::DOUBLE AS period, {r('0.01::DOUBLE + 0.04::DOUBLE * m / 4', 'stop')}, s + 1.0::DOUBLE AS side
FROM g, range(5) a(i), range(5) b(j), range(5) c(m), range(2) d(s) WHERE j < k"""
ORACLES["grid_over_sample"] = f"SELECT * FROM ({ORACLES['grid_over']}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY md5(combo_idx::VARCHAR)) <= 100"

_PANDAS = '''"""Threshold, as a pandas script. ``bars`` has a column for every indicator named below."""

import pandas as pd


def signal(bars: pd.DataFrame) -> pd.Series:
    out = pd.Series(0, index=bars.index)
    out[(bars["rsi_@p"] < @l)] = 1
    out[~(bars["rsi_@p"] < @l) & (bars["rsi_@p"] > @h)] = -1
    return out
'''
_DSL = """strategy threshold
  when (rsi_@p < @l): buy
  when not (rsi_@p < @l) and (rsi_@p > @h): sell
  when not (rsi_@p < @l) and not (rsi_@p > @h): hold
"""
ORACLES["codegen_strategies"] = f"""WITH p AS (SELECT p_partkey, p_partkey % 50 > 0 AS valid, p_size::VARCHAR AS p, (p_partkey % 15 + 20)::DOUBLE::VARCHAR AS l, (p_partkey % 20 + 65)::DOUBLE::VARCHAR AS h FROM part),
t(target, text) AS (VALUES ('pandas', '{_PANDAS}'), ('dsl', '{_DSL}'))
SELECT p_partkey, target, CASE WHEN valid THEN replace(replace(replace(text, '@p', p), '@l', l), '@h', h) END AS source, valid FROM p, t"""

_SHARPE = RETS + f""", m AS (SELECT strategy_id, count(ret)::DOUBLE AS t, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0::DOUBLE), 0.0) AS sharpe, skewness(ret) * (count(ret) - 2) / sqrt(count(ret)::DOUBLE * (count(ret) - 1)) AS skew, kurtosis_pop(ret) AS kurt FROM rets GROUP BY strategy_id),
i AS (SELECT *, 1 - coalesce(skew, 0.0) * sharpe + (coalesce(kurt, 0.0) + 2) / 4 * sharpe * sharpe AS inside, sqrt(2 * ln(100.0::DOUBLE) / t) AS expected_max FROM m),
e AS (SELECT *, CASE WHEN inside > 0 THEN sqrt(inside / (t - 1)) END AS error, sharpe * greatest(inside, 0.01::DOUBLE) - expected_max AS dsr FROM i)
SELECT strategy_id, {r('sharpe', digits=4)}, {r(f"CASE WHEN inside = 0 THEN 0.5::DOUBLE WHEN inside > 0 THEN {cdf('(sharpe / error)')} END", 'psr', 4)}, {r('expected_max', digits=4)}, {r('dsr', digits=4)}, coalesce(dsr / error > 1.645, false) AS significant FROM e"""
ORACLES["sharpe_probabilities"] = _SHARPE

ORACLES["pbo_by_sharpe"] = RETS + f""", sized AS (SELECT *, count(*) OVER (PARTITION BY strategy_id) AS n, row_number() OVER (PARTITION BY strategy_id ORDER BY period_idx) - 1 AS k FROM rets),
grp AS (SELECT strategy_id, coalesce(least(floor(k / nullif(floor(n / 16), 0)), 15), 15)::INT AS g, count(*)::DOUBLE AS n, sum(ret) AS s, sum(ret * ret) AS q FROM sized GROUP BY ALL),
masks AS (SELECT i FROM range(65536) x(i) WHERE bit_count(i) = 8),
sums AS (SELECT i, strategy_id, (i >> g) & 1 AS side, sum(n) AS n, sum(s) / sum(n) AS m, sqrt(greatest(sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 0.0)) AS sd FROM grp, masks GROUP BY ALL),
rates AS (SELECT i, strategy_id, side, round(CASE WHEN sd > 1e-9 THEN m / sd * sqrt(252.0::DOUBLE) ELSE 0.0 END, 8) AS x FROM sums),
sides AS (SELECT i, strategy_id, coalesce(max(x) FILTER (side = 1), 0.0) AS a, coalesce(max(x) FILTER (side = 0), 0.0) AS o FROM rates GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY o DESC) + (count(*) OVER (PARTITION BY i, o) - 1) / 2 AS rk, row_number() OVER (PARTITION BY i ORDER BY a DESC, strategy_id) AS best, count(*) OVER (PARTITION BY i) AS m FROM sides),
pb AS (SELECT count(*) AS n_splits, avg((rk > m / 2)::INT) AS pbo FROM ranked WHERE best = 1)
SELECT n_splits, {r('pbo')}, CASE WHEN pbo < 0.3 THEN 'low' WHEN pbo < 0.5 THEN 'moderate' WHEN pbo < 0.7 THEN 'high' WHEN pbo IS NOT NULL THEN 'critical' END AS risk FROM pb"""


def nested(source: str, steps: list[dict[str, str]]) -> str:
    """Columns added step by step inside one FROM clause, as a recursion wants it."""
    for columns in steps:
        source = f"(SELECT *, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {source})"
    return source


# -- one account for all symbols: what is held, its factor and day, and the last close are lists over the symbols


def put_in(values: str, new: str) -> str:
    return f"list_transform(range(1, len({values}) + 1), lambda i: CASE WHEN i = si THEN {new} ELSE {values}[i] END)"


_COST = "{0} * {1} * 0.0003::DOUBLE + extra * {0}"
_SHARED = nested(
    "(SELECT b.*, e.cash, e.equity, e.held, e.fac, e.days, e.lasts, e.held[b.si] AS own, e.fac[b.si] AS own_factor, e.days[b.si] AS own_day FROM st e JOIN b ON b.rn = e.rn + 1)",
    [
        {"extra": "close * 0.001::DOUBLE", "px": "close * 1.001::DOUBLE", "spx": "close * 0.999::DOUBLE", "adj": "own > 0 AND factor > 0 AND own_factor > 0 AND factor <> own_factor AND trunc(own / (factor / own_factor)) > 0"},
        {"sh": "CASE WHEN adj THEN trunc(own / (factor / own_factor)) ELSE own END", "f1": "CASE WHEN adj THEN factor ELSE own_factor END", "n": "trunc(equity * 0.1::DOUBLE / px / 100) * 100"},
        {"buy": f"signal > 0 AND can_buy AND n > 0 AND cash >= n * px + {_COST.format('n', 'px')}", "sell": "signal < 0 AND sh > 0 AND can_sell AND own_day <> ts::DATE"},
        {"cash2": f"CASE WHEN buy THEN cash - (n * px + {_COST.format('n', 'px')}) WHEN sell THEN cash + sh * spx - ({_COST.format('sh', 'spx')} + sh * spx * 0.0005::DOUBLE) ELSE cash END", "sh2": "CASE WHEN buy THEN sh + n WHEN sell THEN 0.0 ELSE sh END", "f2": "CASE WHEN buy AND sh = 0 THEN factor ELSE f1 END", "day2": "CASE WHEN buy THEN ts::DATE ELSE own_day END"},
        {"held2": put_in("held", "sh2"), "fac2": put_in("fac", "f2"), "days2": put_in("days", "day2"), "lasts2": put_in("lasts", "close")},
        {"mv2": "list_sum(list_transform(range(1, len(held2) + 1), lambda i: held2[i] * lasts2[i]))"},
    ],
)
ORACLES["backtest_shared_cash"] = staged([*CROSS, *RULED], HOURLY)[:-1] + f""",
b AS (SELECT symbol, row_number() OVER (ORDER BY ts, symbol) AS rn, dense_rank() OVER (ORDER BY symbol)::INT AS si, {B_COLUMNS} FROM last), k AS (SELECT count(DISTINCT symbol) AS k FROM b),
st AS (
  SELECT 0::BIGINT AS rn, NULL::VARCHAR AS symbol, NULL::TIMESTAMP AS ts, 1000000.0::DOUBLE AS cash, 1000000.0::DOUBLE AS equity, 0.0::DOUBLE AS mv, list_transform(range(k), lambda i: 0.0::DOUBLE) AS held, list_transform(range(k), lambda i: 1.0::DOUBLE) AS fac, list_transform(range(k), lambda i: NULL::DATE) AS days, list_transform(range(k), lambda i: 0.0::DOUBLE) AS lasts FROM k
  UNION ALL SELECT rn, symbol, ts, cash2, cash2 + mv2, mv2, held2, fac2, days2, lasts2 FROM {_SHARED})
SELECT 'all' AS run_id, symbol, (rn - 1)::INT AS bar_seq, ts, {r('equity', digits=2)}, {r('cash', digits=2)}, {r('mv', 'market_value', 2)} FROM st WHERE rn > 0"""

# -- cycles: only the transforms hang on the period before them, so they alone recur; phase and trend look at lists of smoothed and plain prices


def turned(values: str, newest: int) -> str:
    """The transform of a list at its place ``newest``."""
    return f"(0.0962::DOUBLE * {values}[{newest}] + 0.5769::DOUBLE * {values}[{newest - 2}] - 0.5769::DOUBLE * {values}[{newest - 4}] - 0.0962::DOUBLE * {values}[{newest - 6}])"


_CYCLE = nested(
    "(SELECT b.symbol, b.i, b.price, b.hs, e.det, e.quad, e.i2, e.q2, e.re, e.im, e.period, e.soft, e.phase, e.mama, e.fama, 0.075::DOUBLE * e.period + 0.54::DOUBLE AS adj FROM cyc e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1)",
    [
        {"det_": "list_append(det[2:10], hs * adj)"},
        {"i1_": "det_[7]", "ji": f"{turned('det_', 7)} * adj", "quad_": f"list_append(quad[2:7], {turned('det_', 10)} * adj)"},
        {"i2_": f"0.2::DOUBLE * (i1_ - {turned('quad_', 7)} * adj) + 0.8::DOUBLE * i2", "q2_": "0.2::DOUBLE * (quad_[7] + ji) + 0.8::DOUBLE * q2"},
        {"re_": "0.2::DOUBLE * (i2_ * i2 + q2_ * q2) + 0.8::DOUBLE * re", "im_": "0.2::DOUBLE * (i2_ * q2 - q2_ * i2) + 0.8::DOUBLE * im"},
        {"raw": "CASE WHEN re_ <> 0 AND im_ <> 0 THEN 2 * pi() / atan(im_ / re_) ELSE period END"},
        {"near": "CASE WHEN period <> 0 THEN least(greatest(raw, 0.67::DOUBLE * period), 1.5::DOUBLE * period) ELSE raw END"},
        {"period_": "0.2::DOUBLE * least(greatest(near, 6.0), 50.0) + 0.8::DOUBLE * period", "turn": "CASE WHEN i1_ <> 0 THEN degrees(atan(quad_[7] / i1_)) ELSE 0.0 END"},
        {"soft_": "0.33::DOUBLE * period_ + 0.67::DOUBLE * soft", "pace": "least(greatest(0.5::DOUBLE / greatest(phase - turn, 1.0), 0.05::DOUBLE), 0.5::DOUBLE)"},
        {"mama_": "pace * price + (1 - pace) * mama"},
        {"fama_": "0.5::DOUBLE * pace * mama_ + (1 - 0.5::DOUBLE * pace) * fama"},
    ],
)
_BACK = "list_sum(list_transform(range(span), lambda j: {}(2 * pi() * j / span) * sms[len(sms) - j]))"
ORACLES["ind_hilbert"] = f"""WITH RECURSIVE {DAILY}, p AS (SELECT symbol, ts, (high + low) / 2 AS price, row_number() OVER ({S}) - 1 AS i FROM bars),
s AS (SELECT *, CASE WHEN i < 6 THEN price ELSE (4 * price + 3 * {lag('price')} + 2 * {lag('price', 2)} + {lag('price', 3)}) / 10 END AS sm FROM p),
b AS (SELECT *, 0.0962::DOUBLE * sm + 0.5769::DOUBLE * {lag('sm', 2)} - 0.5769::DOUBLE * {lag('sm', 4)} - 0.0962::DOUBLE * {lag('sm', 6)} AS hs FROM s),
x AS (SELECT symbol, ts, i, list(price) OVER v AS prices, list(sm) OVER v AS sms FROM b WINDOW v AS ({S} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)),
cyc AS (
  SELECT symbol, i, list_transform(range(10), lambda j: 0.0::DOUBLE) AS det, list_transform(range(7), lambda j: 0.0::DOUBLE) AS quad, {', '.join(f'0.0::DOUBLE AS {c}' for c in ('i1', 'i2', 'q2', 're', 'im', 'period', 'soft', 'phase'))}, price::DOUBLE AS mama, price::DOUBLE AS fama FROM b WHERE i = 5
  UNION ALL SELECT symbol, i, det_, quad_, i1_, i2_, q2_, re_, im_, period_, soft_, turn, mama_, fama_ FROM {_CYCLE}),
c AS (SELECT x.*, i1, quad[7] AS q1, soft, mama, fama, greatest(1, least(floor(soft + 0.5), i + 1))::INT AS span FROM cyc JOIN x USING (symbol, i) WHERE i > 5),
w AS (SELECT *, {_BACK.format('sin')} AS re, {_BACK.format('cos')} AS im, list_avg(prices[len(prices) - span + 1:]) AS trend FROM c),
d AS (SELECT *, CASE WHEN abs(im) > 0.001 THEN degrees(atan(re / im)) ELSE 90.0 * sign(re) END + 90 + CASE WHEN soft <> 0 THEN 360 / soft ELSE 0.0 END + CASE WHEN im < 0 THEN 180 ELSE 0 END AS dc0 FROM w),
f AS (SELECT *, dc0 - CASE WHEN dc0 > 315 THEN 360 ELSE 0 END AS dc FROM d),
g AS (SELECT *, sin(radians(dc)) AS sine, sin(radians(dc + 45)) AS lead_sine FROM f),
h AS (SELECT *, (sine > lead_sine) <> coalesce(lag(sine > lead_sine) OVER ({S}), false) AS crossed, dc - coalesce(lag(dc) OVER ({S}), 0.0) AS step FROM g),
q AS (SELECT *, i - coalesce(max(CASE WHEN crossed THEN i END) OVER ({S} ROWS UNBOUNDED PRECEDING), 5) AS quiet FROM h),
o AS (SELECT symbol, ts, soft AS ht_dcperiod, dc AS ht_dcphase, i1 AS ht_inphase, q1 AS ht_quadrature, sine AS ht_sine, lead_sine AS ht_leadsine, trend AS ht_trendline, CASE WHEN quiet < 0.5 * soft OR soft <> 0 AND step > 0.67::DOUBLE * 360 / soft AND step < 1.5::DOUBLE * 360 / soft THEN 0.0 ELSE 1.0 END AS ht_trendmode, mama, fama FROM q)
SELECT symbol, ts, {', '.join(r(c) for c in HILBERT)} FROM bars LEFT JOIN o USING (symbol, ts)"""

# -- a population: every different subtree is a column of the stage of its height

_WORDS = {"GT": ">", "LT": "<", "GE": ">=", "LE": "<=", "ADD": "+", "SUB": "-", "MUL": "*"}
_SERIES = {
    "SMA": lambda n: roll("avg", "close", n), "STDDEV": lambda n: roll("stddev_pop", "close", n), "MOM": lambda n: f"(close - {lag('close', n)})", "ROC": lambda n: f"(100 * ({div('close', lag('close', n))} - 1))",
    "ATR": lambda n: roll("avg", "tr", n), "WILLR": lambda n: f"(-100 * {div(roll('max', 'high', n) + ' - close', roll('max', 'high', n) + ' - ' + roll('min', 'low', n))})",
}


def height(t: Tree) -> int:
    return 1 + max(map(height, t.kids), default=-1)


def of_tree(t: Tree, names: dict[Tree, str]) -> str:
    """The value of a tree over the columns of its subtrees."""
    a, b, *_ = [*(names[k] for k in t.kids), "", ""]
    if t.op == "IND":
        return _SERIES[t.name](int(t.value))
    if t.op in ("CONST", "TRUE", "FALSE"):
        return f"{t.value!r}::DOUBLE" if t.op == "CONST" else t.op.lower()
    if t.op in ("GT", "LT", "GE", "LE"):
        return f"coalesce({a} {_WORDS[t.op]} {b}, false)"
    if t.op in ("ADD", "SUB", "MUL"):
        return f"({a} {_WORDS[t.op]} {b})"
    return {
        "AND": f"({a} AND {b})", "OR": f"({a} OR {b})", "NOT": f"(NOT {a})", "EQ": f"coalesce(abs({a} - {b}) < 1e-6, false)",
        "CROSSOVER": f"coalesce({a} > {b} AND {lag(f'{a} - {b}')} <= 0, false)", "CROSSUNDER": f"coalesce({a} < {b} AND {lag(f'{a} - {b}')} >= 0, false)",
        "IF": f"CASE WHEN {a} THEN {b} ELSE {names[t.kids[-1]]} END", "DIV": f"CASE WHEN abs({b}) > 1e-10 THEN {a} / nullif({b}, 0) ELSE 1.0 END", "SQRT": f"sqrt(abs({a}))", "LOG": f"ln(abs({a}) + 1e-10::DOUBLE)",
        "POW": f"power(abs({a}), {b})", "NEG": f"(-{a})", "LAG": lag(a, int(t.value)),
    }[t.op]


def grown(trees: list[Tree]) -> tuple[list[dict[str, str]], dict[Tree, str]]:
    """Stages of columns, and the column of every subtree."""
    different: dict[Tree, None] = {}

    def gather(t: Tree) -> None:
        for k in t.kids:
            gather(k)
        different.setdefault(t)

    for t in trees:
        gather(t)
    names = {t: f"t{i}" for i, t in enumerate(different)}
    stages = [{} for _ in range(1 + max(map(height, different)))]
    for t in different:
        stages[height(t)][names[t]] = of_tree(t, names)
    return stages, names


_TREES = random_population(40, 11, 3, tuple(_SERIES))
_STAGES, _NAMES = grown(_TREES)
_VOTES = ", ".join(f"CASE WHEN {_NAMES[t]} THEN 1 ELSE -1 END" for t in _TREES)
ORACLES["gp_population_figures"] = staged([{"tr": TR}, *_STAGES, *PLAIN_RULES], HOURLY)[:-1] + f""",
trials AS (SELECT symbol, ts, open, close, no_buy_reason, no_sell_reason, factor, unnest([{_VOTES}]) AS signal, unnest(range({len(_TREES)}))::INT AS run_id FROM last),
b AS (SELECT run_id || '|' || symbol AS key, row_number() OVER (PARTITION BY run_id, symbol ORDER BY ts) AS rn, {B_COLUMNS} FROM trials)""" + execution() + ", curve AS (SELECT key, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "key") + f"""
SELECT split_part(key, '|', 1)::INT AS run_id, split_part(key, '|', 2) AS symbol, {', '.join(r(c, digits=4) for c in ('net_profit', 'total_return_pct', 'sharpe_ratio', 'max_drawdown_pct'))} FROM mx"""
