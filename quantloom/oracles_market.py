"""SQL twins of the queries over market data."""

from __future__ import annotations

from quantloom.oracles import ALL, B_COLUMNS, CROSS, DAILY, HOURLY, ORACLES, PLAIN_RULES, S, execution, fifo_tables, lag, metric_tables, r, roll, staged, trade_figures, u

EVENTS = """ev AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(s_nationkey % 5 + 1)::INT] AS symbol, (DATE '1992-01-01' + (s_suppkey * 37 % 2400)::INT)::TIMESTAMP AS ts,
  CASE s_suppkey % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'rights' ELSE 'dividend' END AS kind, CASE s_suppkey % 4 WHEN 0 THEN 1 + (s_suppkey % 3 + 1) / 10.0::DOUBLE WHEN 1 THEN 0.1::DOUBLE END AS ratio, CASE WHEN s_suppkey % 4 = 1 THEN 2.0::DOUBLE ELSE abs(s_acctbal)::DOUBLE / 10000 END AS amount FROM supplier)"""
LAST = "last_value(factor) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
ORACLES["corporate_actions"] = f"""WITH {DAILY}, {EVENTS},
days AS (SELECT symbol, ts, coalesce(product(ratio) FILTER (kind = 'split'), 1.0) AS split, coalesce(sum(amount) FILTER (kind = 'dividend'), 0.0) AS paid, coalesce(sum(ratio) FILTER (kind = 'rights'), 0.0) AS issued, coalesce(sum(ratio * amount) FILTER (kind = 'rights'), 0.0) AS raised FROM ev GROUP BY symbol, ts),
m AS (SELECT d.symbol, d.ts, (close - paid + raised) / (split * (1 + issued)) / close AS multiplier FROM days d ASOF JOIN bars b ON d.symbol = b.symbol AND d.ts > b.ts),
f AS (SELECT bars.*, coalesce(exp((SELECT sum(ln(multiplier)) FROM m WHERE multiplier > 0 AND m.symbol = bars.symbol AND m.ts > bars.ts)), 1.0) AS factor FROM bars)
SELECT symbol, ts, {r('ln(factor)', 'log_factor')}, {', '.join(r(f'{c} * factor / {LAST}', c) for c in ALL[:4])} FROM f"""

ORACLES["staged_exits"] = staged(CROSS)[:-1] + f""",
e AS (SELECT symbol, ts, close, row_number() OVER ({S}) AS rn, high, low, open, signal = 1 AND {lag('signal')} < 1 AS enters FROM last),
legs AS (SELECT symbol, ts AS entry_ts, rn AS ern, close AS entry_price, leg, fraction, close * (1 + gain) AS target, close * (1 - 0.97::DOUBLE) AS stop FROM e, (VALUES (0, 0.5::DOUBLE, 0.3::DOUBLE), (1, 0.3::DOUBLE, 0.9::DOUBLE), (2, 0.2::DOUBLE, NULL)) p(leg, fraction, gain) WHERE enters),
walk AS (SELECT l.*, e.rn, e.ts, e.open, e.high, e.low, (1 - 0.985::DOUBLE) * greatest(entry_price, max(e.high) OVER (PARTITION BY l.symbol, l.ern, l.leg ORDER BY e.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS trailed FROM legs l JOIN e ON e.symbol = l.symbol AND e.rn > l.ern),
hit AS (SELECT *, greatest(stop, trailed) AS floor FROM walk WHERE coalesce(high >= target, false) OR low <= greatest(stop, trailed) QUALIFY row_number() OVER (PARTITION BY symbol, ern, leg ORDER BY rn) = 1),
fin AS (SELECT symbol, max(ts) AS last_ts, arg_max(close, ts) AS last_close FROM e GROUP BY symbol),
x AS (SELECT l.symbol, l.entry_ts, l.leg, l.fraction, l.entry_price, coalesce(h.ts, last_ts) AS exit_ts, CASE WHEN h.ts IS NULL THEN last_close WHEN h.low <= floor THEN least(h.open, floor) ELSE greatest(h.open, h.target) END AS exit_price,
  CASE WHEN h.ts IS NULL THEN 'end' WHEN h.low > floor THEN 'target' WHEN trailed > h.stop THEN 'trail' ELSE 'stop' END AS reason FROM legs l LEFT JOIN hit h USING (symbol, ern, leg) JOIN fin USING (symbol))
SELECT symbol, entry_ts, leg, {r('fraction')}, {r('entry_price')}, exit_ts, {r('exit_price')}, reason, {r('exit_price / entry_price - 1', 'ret')} FROM x"""

ORACLES["portfolio_rebalanced"] = f"""WITH RECURSIVE {DAILY}, w AS (SELECT DISTINCT symbol, left(symbol, 1)::DOUBLE / 15 AS weight FROM bars),
t AS (SELECT DISTINCT ts FROM bars WHERE ts >= (SELECT max(a) FROM (SELECT min(ts) AS a FROM bars GROUP BY symbol))),
h AS (SELECT g.symbol, g.weight, g.ts, date_trunc('month', g.ts) AS segment, b.close AS equity FROM (SELECT * FROM t, w) g ASOF JOIN bars b ON b.symbol = g.symbol AND g.ts >= b.ts),
n AS (SELECT segment, row_number() OVER (ORDER BY segment) AS k, count(*) OVER () AS last_k, max(ts) AS last_ts FROM h GROUP BY segment),
e AS (SELECT symbol, weight, k, arg_max(equity, ts) AS fin, arg_min(equity, ts) AS first FROM h JOIN n USING (segment) GROUP BY ALL),
p AS (SELECT e.*, coalesce(b.fin, e.first) AS base FROM e LEFT JOIN e b ON b.symbol = e.symbol AND b.k = e.k - 1),
q AS (SELECT k, sum(weight * fin / base) AS whole FROM p GROUP BY k),
z AS (SELECT k, any_value(whole) AS whole, sum(abs(weight * fin / base / whole - weight)) AS turnover FROM p JOIN q USING (k) GROUP BY k),
walk AS (SELECT 1::BIGINT AS k, 0.0::DOUBLE AS log_start UNION ALL SELECT walk.k + 1, log_start + ln(whole * (1 - 0.002::DOUBLE * turnover)) FROM walk JOIN z USING (k)),
g AS (SELECT k, ts, segment, last_ts, last_k, sum(weight * equity / base) AS grown FROM h JOIN n USING (segment) JOIN p USING (symbol, weight, k) GROUP BY ALL)
SELECT ts, segment::TIMESTAMP AS segment, {r('log_start + ln(grown)', 'log_equity', 4)}, {r('CASE WHEN ts = last_ts AND k < last_k THEN turnover END', 'turnover', 4)}, {r('CASE WHEN ts = last_ts AND k < last_k THEN 0.002::DOUBLE * turnover END', 'cost', 4)} FROM g JOIN walk USING (k) JOIN z USING (k)"""

ORACLES["ir_signal_two_timeframes"] = f"""WITH {HOURLY}, c AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS day, arg_max(close, ts) AS close FROM bars GROUP BY ALL),
k AS (SELECT symbol, day + INTERVAL 1 DAY AS known, close AS dc, CASE WHEN count(close) OVER v = 3 THEN avg(close) OVER v END AS dm FROM c WINDOW v AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, {roll('avg', 'close', 10)} AS m FROM bars)
SELECT b.symbol, b.ts, CASE WHEN coalesce(dc > dm, false) AND coalesce(b.close > m, false) THEN 1 ELSE -1 END AS signal FROM b ASOF LEFT JOIN k ON k.symbol = b.symbol AND b.ts >= k.known"""

ORACLES["feed_scan"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL[:5]))} FROM bars WHERE symbol IN ('2-HIGH', '4-NOT SPECIFIED') AND ts >= TIMESTAMP '1994-02-10' AND ts < TIMESTAMP '1996-07-05'"
CORRECTED = f"{DAILY}, fixed AS (SELECT * REPLACE (CASE WHEN day(ts) = 10 THEN close + 1 ELSE close END AS close, CASE WHEN day(ts) = 10 THEN high + 1 ELSE high END AS high) FROM bars)"
ORACLES["store_upsert"] = f"WITH {CORRECTED} SELECT symbol, ts, {', '.join(map(r, ALL))}, 'D1' AS timeframe FROM fixed WHERE NOT (symbol = '2-HIGH' AND ts BETWEEN TIMESTAMP '1994-03-10' AND TIMESTAMP '1995-09-20')"
ORACLES["store_tiers"] = f"""WITH {CORRECTED}, h AS (WITH {HOURLY} SELECT * FROM bars), late AS (SELECT f.* REPLACE (coalesce(b.close, f.close) AS close) FROM fixed f LEFT JOIN bars b ON b.symbol = f.symbol AND b.ts = f.ts AND f.ts BETWEEN TIMESTAMP '1992-05-01' AND TIMESTAMP '1992-06-30'),
u AS (SELECT 'D1' AS timeframe, ts, close FROM late UNION ALL SELECT 'H1', ts, close FROM h)
SELECT timeframe, CASE WHEN strftime(ts, '%Y-%m') < '1994-02' THEN 'cold' WHEN strftime(ts, '%Y-%m') < '1997-02' THEN 'warm' ELSE 'hot' END AS tier, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, {r('sum(close)', 'closes', 3)} FROM u GROUP BY ALL"""

_CELLS = "(VALUES ('size', 50, true, 1.0::DOUBLE, 50.0::DOUBLE), ('price', 256, true, 900.0, 1200.0), ('kind', 5, false, 0.0, 5.0)) s(name, k, ordered, low, cells)"
ORACLES["tpe_proposals"] = f"""WITH t AS (SELECT p_size::DOUBLE AS size, p_retailprice::DOUBLE AS price, (p_partkey % 5)::DOUBLE AS kind, CASE WHEN p_partkey % 10 > 0 THEN -abs(p_size - 20) - abs(p_retailprice::DOUBLE - 1500) / 50 - 3 * (p_partkey % 5) END::DOUBLE AS value FROM part),
v AS (SELECT *, coalesce(value, (SELECT avg(value) FROM t)) AS filled FROM t),
j AS (SELECT *, filled >= (SELECT quantile_cont(filled, 0.75) FROM v) AS good FROM v),
x AS (SELECT good, name, k, greatest(0, least(floor((val - low) * k / cells), k - 1))::INT AS bin FROM (SELECT good, unnest(['size', 'price', 'kind']) AS name, unnest([size, price, kind]) AS val FROM j) JOIN {_CELLS} USING (name)),
c AS (SELECT good, name, bin, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
g AS (SELECT good, name, sum(n) AS total, greatest(1.0, 1.06::DOUBLE * sqrt(sum(n * bin * bin) / sum(n) - (sum(n * bin) / sum(n)) ** 2) * power(sum(n), -0.2::DOUBLE)) AS width FROM c GROUP BY ALL),
b AS (SELECT good, name, k, ordered, total, width, unnest(range(k)) AS b FROM g JOIN {_CELLS} USING (name)),
e AS (SELECT good, name, c.bin, sum(exp(-((b - c.bin) ** 2) / (2 * width ** 2))) AS mass FROM b JOIN c USING (good, name) GROUP BY ALL),
p AS (SELECT good, name, b, (coalesce(sum(n * CASE WHEN ordered THEN exp(-((b - bin) ** 2) / (2 * width ** 2)) / mass ELSE (b = bin)::INT END), 0) + 1.0::DOUBLE / any_value(k)) / (any_value(total) + 1) AS p FROM b JOIN c USING (good, name) JOIN e USING (good, name, bin) GROUP BY good, name, b),
f AS (SELECT name, b, p.p AS good_p, q.p AS bad_p, sum(p.p) OVER (PARTITION BY name ORDER BY b) AS cum FROM p JOIN p q USING (name, b) WHERE p.good AND NOT q.good),
d AS (SELECT id, name, {u("'bin'", 'name', 'id')} AS spot, {u("'in'", 'name', 'id')} AS inside FROM range(512) r(id), {_CELLS}),
h AS (SELECT id, name, any_value(inside) AS inside, count(*) FILTER (CASE WHEN id % 8 < 2 THEN 0.7::DOUBLE * cum + 0.3::DOUBLE * (b + 1) / k ELSE cum END <= spot AND b < k - 1)::INT AS bin FROM d JOIN f USING (name) JOIN {_CELLS} USING (name) GROUP BY id, name),
y AS (SELECT id, h.name, low + (bin + inside) / k * cells AS val, ln(good_p) - ln(bad_p) AS part FROM h JOIN f ON f.name = h.name AND f.b = h.bin JOIN {_CELLS} ON s.name = h.name),
z AS (SELECT id, (id % 8)::INT AS slot, least(floor(max(val) FILTER (name = 'size') + 1e-9), 50)::DOUBLE AS size, max(val) FILTER (name = 'price') AS price, least(floor(max(val) FILTER (name = 'kind') + 1e-9), 4)::DOUBLE AS kind, sum(part) AS score FROM y GROUP BY id)
SELECT slot, {r('size')}, {r('price')}, {r('kind')}, {r('score')} FROM z QUALIFY row_number() OVER (PARTITION BY slot ORDER BY CASE WHEN slot < 2 THEN 0.0 ELSE round(score, 9) END DESC, id) = 1"""


def latin(name: str, lo: int, hi: int, n: int) -> str:
    """A whole number of a Latin hypercube for ``id``: the stratum by swap or not, and a place inside."""
    point = f"floor({u(repr('point'), repr(name), 'r')} * {n})::BIGINT"
    other = f"((({point} - x) % {n} + {n}) % {n})"
    stratum = f"list_reduce([id] || range(1, 25), lambda x, r: CASE WHEN {u(repr('swap'), repr(name), 'r', f'greatest(x, {other})')} < 0.5 THEN {other} ELSE x END)"
    return f"least(floor({lo} + ({stratum} + {u(repr('jitter'), repr(name), 'id')}) / {n} * {hi - lo + 1}.0::DOUBLE + 1e-9), {hi})::INT AS {name}"


_PERIODS = [*range(3, 16), *range(20, 51)]
_SPP = staged([{f"sma{p}": roll("avg", "close", p) for p in _PERIODS}, *PLAIN_RULES], HOURLY)[:-1] + f""",
lhs AS (SELECT id::INT AS combo_idx, {latin('fast', 3, 15, 40)}, {latin('slow', 20, 50, 40)} FROM range(40) q(id)),
b AS (SELECT combo_idx || '|' || symbol AS key, row_number() OVER (PARTITION BY combo_idx, symbol ORDER BY ts) AS rn, {B_COLUMNS.replace('signal', f"CASE WHEN coalesce([{', '.join(f'sma{p}' for p in _PERIODS)}][list_position({_PERIODS}, fast)] > [{', '.join(f'sma{p}' for p in _PERIODS)}][list_position({_PERIODS}, slow)], false) THEN 1 ELSE -1 END AS signal")} FROM last, lhs)"""
_MEDIANS = ("net_profit", "sharpe_ratio", "max_drawdown_pct", "profit_factor", "return_on_drawdown")
ORACLES["spp_latin"] = (
    _SPP + execution() + ", curve AS (SELECT key, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "key")
    + ", fl AS (SELECT key, key AS symbol, trades AS trade_seq, side AS signal, fshares AS shares, price, commission, slip AS slippage FROM st WHERE side IS NOT NULL)" + fifo_tables("fl", "key") + trade_figures("key", "fl")
    + f", z AS (SELECT split_part(key, '|', 2) AS symbol, mx.* EXCLUDE (key), coalesce(profit_factor, 0.0) AS profit_factor FROM mx LEFT JOIN tm USING (key)) SELECT symbol, count(*) AS n, {', '.join(r(f'quantile_cont({c}, 0.5)', f'median_{c}', 3) for c in _MEDIANS)}, {r('avg(net_profit)', 'mean_net_profit', 3)}, {r('stddev_pop(net_profit)', 'std_net_profit', 3)}, {r('100 * avg((net_profit > 0)::INT)', 'profitable_pct', 3)}, {r('100 * avg((sharpe_ratio > 0)::INT)', 'sharpe_positive_pct', 3)} FROM z GROUP BY symbol"
)
