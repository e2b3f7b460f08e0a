"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

DAILY = """bars AS (
  SELECT symbol, ts, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, count(*)::DOUBLE AS volume, sum(p) AS amount, count(DISTINCT m)::DOUBLE AS turnover_rate
  FROM (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_totalprice / 1000.0 AS p, o_orderkey AS o, o_custkey AS m FROM orders) GROUP BY symbol, ts)"""
HOURLY = """bars AS (
  SELECT symbol, ts, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, count(*)::DOUBLE AS volume, sum(p) AS amount, count(DISTINCT m)::DOUBLE AS turnover_rate
  FROM (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, value + 100.0 AS p, ts AS o, user_id AS m FROM events) GROUP BY symbol, ts)"""
ALL = ("open", "high", "low", "close", "volume", "amount", "turnover_rate")
S = "PARTITION BY symbol ORDER BY ts"
TP = "((high + low + close) / 3)"
TR = f"greatest(high - low, abs(high - lag(close) OVER ({S})), abs(low - lag(close) OVER ({S})))"


def tidy(x: str, digits: int = 6) -> str:
    """Rounded as in the queries: first to three digits more, so that the last bits of a sum don't decide a tie."""
    return f"round(({x})::DECIMAL(38, {digits + 3}), {digits})::DOUBLE"


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"{tidy(x, digits)} AS {name or x}"


def w(n: int) -> str:
    return f"({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {w(n)} = {n} THEN {f}({x}) OVER {w(n)} END)"


def lag(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) OVER ({S}))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def staged(steps: list[dict[str, str]], source: str = DAILY, first: str = "bars") -> str:
    """The WITH clause of columns added step by step; the last table is named last."""
    tables, before = [source], first
    for i, columns in enumerate(steps):
        name = "last" if i == len(steps) - 1 else f"s{i}"
        tables.append(f"{name} AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {before})")
        before = name
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n"


def put(name: str, steps: list[dict[str, str]], outputs: list[str], source: str = DAILY, plain: tuple[str, ...] = (), digits: int = 6) -> None:
    ORACLES[name] = staged(steps, source) + f"SELECT symbol, ts, {', '.join([*plain, *(r(o, digits=digits) for o in outputs)])} FROM last"


# -- sources and scans

ORACLES["bars_hourly"] = f"WITH {HOURLY} SELECT symbol, ts, {', '.join(map(r, ALL))} FROM bars"
ORACLES["bars_daily"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))} FROM bars"
ORACLES["store_query"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))}, 'D1' AS timeframe FROM bars WHERE symbol IN ('1-URGENT', '5-LOW') AND ts BETWEEN TIMESTAMP '1996-01-15' AND TIMESTAMP '1996-12-31'"
ORACLES["store_coverage"] = f"WITH {DAILY}, h AS (WITH {HOURLY} SELECT * FROM bars), a AS (SELECT symbol, ts, 'D1' AS timeframe FROM bars UNION ALL SELECT symbol, ts, 'H1' FROM h) SELECT symbol, timeframe, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM a GROUP BY ALL"
ORACLES["store_delete"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))}, 'D1' AS timeframe FROM bars WHERE symbol = '1-URGENT' OR symbol = '3-MEDIUM' AND ts < TIMESTAMP '1996-02-01' AND NOT (ts BETWEEN TIMESTAMP '1995-03-10' AND TIMESTAMP '1995-09-20')"
ORACLES["iso_times"] = f"WITH {HOURLY} SELECT symbol, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM bars GROUP BY symbol"
for _m in (1, 5, 15, 30, 60):
    ORACLES[f"bars_{_m}min"] = f"""WITH x AS (SELECT event_type AS symbol, time_bucket(INTERVAL '{_m} minutes', ts)::TIMESTAMP AS b, value + 100.0 AS p, ts FROM events)
SELECT symbol, b AS ts, {r('arg_min(p, ts)', 'open')}, {r('max(p)', 'high')}, {r('min(p)', 'low')}, {r('arg_max(p, ts)', 'close')}, count(*)::DOUBLE AS volume, {r('sum(p)', 'amount')} FROM x GROUP BY symbol, b"""
ORACLES["range_scan"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))} FROM bars WHERE symbol IN ('1-URGENT', '5-LOW') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' ORDER BY symbol, ts"
ORACLES["coverage"] = f"WITH {HOURLY} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM bars GROUP BY symbol"
ORACLES["last_bars"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10"
ORACLES["delete_range"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))} FROM bars WHERE NOT (symbol = '3-MEDIUM' AND year(ts) = 1995)"
ORACLES["synthetic_bars"] = """
WITH days AS (SELECT i, d::TIMESTAMP AS ts, datediff('day', DATE '2020-01-01', d::DATE) AS n FROM range(3) x(i), generate_series(DATE '2020-01-01', DATE '2020-02-29', INTERVAL 1 DAY) g(d) WHERE isodow(d) <= 5),
bars AS (SELECT 'S' || lpad(i::VARCHAR, 3, '0') AS symbol, ts, 10.0::DOUBLE + i + n * 0.05::DOUBLE AS base, n FROM days)
SELECT symbol, ts, round((base)::DECIMAL(38, 9), 6)::DOUBLE AS open, round((base + 0.5)::DECIMAL(38, 9), 6)::DOUBLE AS high, round((base - 0.5)::DECIMAL(38, 9), 6)::DOUBLE AS low, round((base + 0.1)::DECIMAL(38, 9), 6)::DOUBLE AS close, 1000.0::DOUBLE + n * 10 AS volume FROM bars"""

ORACLES["bar_slice"] = f"WITH {DAILY} SELECT symbol, ts, {', '.join(map(r, ALL))} FROM bars QUALIFY row_number() OVER ({S}) BETWEEN 51 AND 150"
ORACLES["bar_feed"] = ORACLES["synthetic_bars"]
ORACLES["stock_list"] = "SELECT s_name AS symbol, NULL::VARCHAR AS name, n_name AS area, NULL::VARCHAR AS industry, NULL::VARCHAR AS market, NULL::VARCHAR AS list_date, 'L' AS list_status FROM supplier JOIN nation ON s_nationkey = n_nationkey"
CALENDAR = """SELECT d::DATE AS day, isodow(d) <= 5 AND d::DATE NOT IN (SELECT day FROM off) AS is_open FROM generate_series(DATE '{}', DATE '{}', INTERVAL 1 DAY) g(d)"""
ORACLES["trade_calendar"] = f"WITH off AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE day(o_orderdate) = 1), c AS ({CALENDAR.format('1996-01-01', '1997-12-31')}) SELECT day, is_open, last_value(CASE WHEN is_open THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_before FROM c"
ORACLES["suspended_days"] = f"""WITH {DAILY}, off AS (SELECT NULL::DATE AS day WHERE false), c AS ({CALENDAR.format('1992-01-01', '2003-12-31')}), e AS (SELECT symbol, min(ts)::DATE AS a, max(ts)::DATE AS b FROM bars GROUP BY symbol)
SELECT symbol, day FROM e JOIN c ON day BETWEEN a AND b AND is_open WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.symbol = e.symbol AND x.ts::DATE = c.day)"""
ORACLES["limit_prices"] = f"WITH {DAILY} SELECT symbol, ts, {r(f'{lag("close")} * 1.1::DOUBLE', 'up_limit')}, {r(f'{lag("close")} * 0.9::DOUBLE', 'down_limit')} FROM bars"
ORACLES["code_list"] = "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 6, '0') || CASE WHEN lpad((s_suppkey * 7919)::VARCHAR, 6, '9') <> lpad(s_suppkey::VARCHAR, 6, '0') THEN ' ' || lpad((s_suppkey * 7919)::VARCHAR, 6, '9') ELSE '' END AS codes FROM supplier"

# -- preparation

ORACLES["bar_quality"] = f"""WITH {DAILY}, c AS (SELECT *, abs({div('close', lag('close'))} - 1) AS ch, count(*) OVER (PARTITION BY symbol, ts) AS k FROM bars)
SELECT symbol, count(*) AS n_bars, count(*) FILTER (high < greatest(open, close, low)) AS low_high, count(*) FILTER (low > least(open, close, high)) AS high_low, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive, count(*) FILTER (volume <= 0) AS no_volume, count(*) FILTER (ch > 0.5) AS jumps, count(*) FILTER (k > 1) AS repeated FROM c GROUP BY symbol"""
ORACLES["asof_join"] = f"WITH {HOURLY}, board AS (SELECT ts, close AS board_close FROM bars WHERE symbol = 'purchase') SELECT symbol, b.ts, {r('close')}, {r('board_close')} FROM bars b ASOF LEFT JOIN board o ON b.ts >= o.ts WHERE symbol <> 'purchase'"

FACTORED = DAILY + """, factors AS (SELECT symbol, ts, CASE WHEN day(ts) > 15 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM bars WHERE day(ts) <= 20),
factored AS (SELECT bars.*, coalesce(factor, 1.0::DOUBLE) AS factor FROM bars LEFT JOIN factors USING (symbol, ts))"""
ORACLES["factor_left_join"] = f"WITH {FACTORED} SELECT symbol, ts, {r('close')}, {r('factor')} FROM factored"
LAST_FACTOR = "last_value(factor) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
ORACLES["forward_adjust"] = f"WITH {FACTORED} SELECT symbol, ts, {', '.join(r(f'{c} * factor / {LAST_FACTOR}', c) for c in ALL[:4])} FROM factored"
ORACLES["backward_adjust"] = f"WITH {FACTORED} SELECT symbol, ts, {', '.join(r(f'{c} * factor', c) for c in ALL[:4])} FROM factored"
ORACLES["mark_suspension"] = f"WITH {HOURLY}, off AS (SELECT DISTINCT ts FROM bars WHERE hour(ts) = 0 AND day(ts) % 7 = 0) SELECT symbol, ts, ts IN (SELECT ts FROM off) AS is_suspended FROM bars"
MARKET = "CASE symbol WHEN '1-URGENT' THEN 0.10 WHEN '2-HIGH' THEN 0.20 WHEN '3-MEDIUM' THEN 0.05 WHEN '4-NOT SPECIFIED' THEN 0.30 ELSE 0.10 END::DOUBLE"
ORACLES["mark_limit"] = staged([{"c": f"{div('close', lag('close'))} - 1", "l": MARKET}]) + f"SELECT symbol, ts, {r('c', 'change_pct')}, coalesce(c >= l, false) AS limit_up, coalesce(c <= -l, false) AS limit_down FROM last"
GAPPED = [{"x": "CASE WHEN day(ts) NOT IN (5, 11, 12, 13) THEN close END", "n": f"row_number() OVER ({S})"}, {
    "p": f"last_value(x IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "pn": f"last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "q": f"first_value(x IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "qn": f"first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER ({S} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}]
for _name, _value in {"fill_ffill": "CASE WHEN x IS NOT NULL THEN x WHEN n - pn <= 2 THEN p END", "fill_bfill": "coalesce(x, q)", "fill_linear": "CASE WHEN x IS NOT NULL THEN x WHEN q IS NULL THEN p WHEN p IS NOT NULL THEN p + (q - p) * (n - pn) / (qn - pn) END"}.items():
    ORACLES[_name] = staged(GAPPED) + f"SELECT symbol, ts, {r(_value, 'close')} FROM last"
ORACLES["clean_ohlcv"] = staged([
    {"o1": "greatest(CASE WHEN day(ts) = 4 THEN 0.001 ELSE open END, 0.01)", "h1": "greatest(CASE WHEN day(ts) = 3 THEN low - 1 ELSE high END, 0.01)", "l1": "greatest(low, 0.01)", "c1": "greatest(close, 0.01)"},
    {"h2": "greatest(o1, h1, l1, c1)", "l2": "least(o1, h1, l1, c1)"},
]) + f"SELECT symbol, ts, {r('greatest(l2, least(h2, o1))', 'open')}, {r('h2', 'high')}, {r('l2', 'low')}, {r('greatest(l2, least(h2, c1))', 'close')}, volume FROM last WHERE day(ts) <> 6 AND volume > 0"
RETURNS = {"returns": f"{div('close', lag('close'))} - 1", "log_returns": f"ln({div('close', lag('close'))})"}
put("returns", [RETURNS], ["returns", "log_returns"])
put("tech_features", [RETURNS, {f"ma_{n}": roll("avg", "close", n) for n in (5, 10, 20)} | {"volatility_20": roll("stddev_samp", "returns", 20)}], ["ma_5", "ma_10", "ma_20", "volatility_20"])

# -- joins, search and catalog

ORACLES["owner_inner_join"] = f"SELECT o_orderkey AS id, o_custkey AS strategy_id, c_name AS strategy_name, {r('o_totalprice')} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderstatus = 'O'"
ORACLES["running_counts"] = "SELECT o_custkey AS owner, count(*) FILTER (o_orderstatus = 'O') AS n_running, count(*) FILTER (o_orderstatus = 'O') < 10 AS may_submit FROM orders GROUP BY o_custkey"
ORACLES["strategy_page"] = "SELECT o_orderkey AS id, o_orderpriority AS name, o_orderstatus AS status, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority ILIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20"
ORACLES["source_summary"] = "SELECT sum(s_suppkey)::BIGINT AS records, max(s_suppkey) AS updated_at, coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (s_acctbal < 0), '') AS pending FROM supplier"
ORACLES["marketplace_search"] = f"SELECT p_partkey AS id, p_name AS name, p_brand AS display_name, {r('p_retailprice', 'rating')} FROM part WHERE p_name ILIKE '%brand#1%' OR p_brand ILIKE '%brand#1%' OR p_type ILIKE '%brand#1%'"
ORACLES["grid_cross_join"] = """
WITH f(i, fast) AS (VALUES (0, 2.0), (1, 4.0), (2, 6.0), (3, 8.0), (4, 10.0)), s(j, slow) AS (VALUES (0, 20.0), (1, 30.0), (2, 40.0), (3, 50.0), (4, 60.0)),
p(k, stop) AS (VALUES (0, 0.01), (1, 0.02), (2, 0.03), (3, 0.04), (4, 0.05)), d(l, side) AS (VALUES (0, 1.0), (1, 2.0))
SELECT (((i * 5 + j) * 5 + k) * 2 + l)::INT AS combo_idx, fast::DOUBLE AS fast, slow::DOUBLE AS slow, stop::DOUBLE AS stop, side::DOUBLE AS side FROM f, s, p, d"""
ORACLES["grid_sample"] = f"SELECT * FROM ({ORACLES['grid_cross_join']}) ORDER BY md5(combo_idx::VARCHAR) LIMIT 20"

# -- rolling indicators

N = 14
GAIN_LOSS = [{"change": f"close - {lag('close')}"}, {"up": "CASE WHEN change > 0 THEN change ELSE 0.0 END", "down": "CASE WHEN change < 0 THEN -change ELSE 0.0 END"}]
RSI = "CASE WHEN loss = 0 AND gain > 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END"
MEANS = {"gain": roll("avg", "up", N), "loss": roll("avg", "down", N)}
DIRECTION = [
    {"tr": TR, "pdm": f"CASE WHEN {lag('high')} IS NOT NULL THEN greatest(high - {lag('high')}, 0.0) END", "mdm": f"CASE WHEN {lag('low')} IS NOT NULL THEN greatest({lag('low')} - low, 0.0) END"},
    {f"m{c}": roll("avg", c, N) for c in ("tr", "pdm", "mdm")},
    {"pdi": f"100 * {div('mpdm', 'mtr')}", "mdi": f"100 * {div('mmdm', 'mtr')}"},
]
DX = f"100 * {div('abs(pdi - mdi)', 'pdi + mdi')}"
BP = f"CASE WHEN {lag('close')} IS NOT NULL THEN close - least(low, {lag('close')}) END"
ULT = {f"u{n}": div(roll("sum", "bp", n), roll("sum", "tr", n)) for n in (7, 14, 28)}


def k_of(n: int, x: str = "close", hi: str = "high", lo: str = "low") -> str:
    return f"100 * {div(f'{x} - {roll("min", lo, n)}', f'{roll("max", hi, n)} - {roll("min", lo, n)}')}"


put("ind_sma", [{"sma": roll("avg", "close", N)}], ["sma"])
put("ind_wma", [{"wma": f"CASE WHEN count(close) OVER {w(N)} = {N} THEN ({' + '.join([f'{N} * close'] + [f'{N - i} * {lag("close", i)}' for i in range(1, N)])}) / {N * (N + 1) / 2} END"}], ["wma"])
put("ind_trima", [{"i": roll("avg", "close", 7)}, {"trima": roll("avg", "i", 8)}], ["trima"])
put("ind_rsi", [*GAIN_LOSS, MEANS, {"rsi": RSI}], ["rsi"])
put("ind_cmo", [*GAIN_LOSS, {"gain": roll("sum", "up", N), "loss": roll("sum", "down", N)}, {"cmo": f"100 * {div('gain - loss', 'gain + loss')}"}], ["cmo"])
put("ind_bbands", [{"middleband": roll("avg", "close", N), "sd": roll("stddev_samp", "close", N)}, {"upperband": "middleband + 2 * sd", "lowerband": "middleband - 2 * sd"}], ["upperband", "middleband", "lowerband"])
put("ind_atr", [{"tr": TR}, {"atr": roll("avg", "tr", N)}], ["atr"])
put("ind_natr", [{"tr": TR}, {"natr": f"100 * {roll('avg', 'tr', N)} / nullif(close, 0)"}], ["natr"])
put("ind_trange", [{"trange": TR}], ["trange"])
put("ind_adx", [*DIRECTION, {"dx": DX}, {"adx": roll("avg", "dx", N)}], ["adx"])
put("ind_dx", [*DIRECTION, {"dx": DX}], ["dx"])
put("ind_directional", [*DIRECTION, {"plus_di": "pdi", "minus_di": "mdi", "plus_dm": "mpdm", "minus_dm": "mmdm"}], ["plus_di", "minus_di", "plus_dm", "minus_dm"])
put("ind_cci", [{"tp": TP}, {"mean": roll("avg", "tp", N), "near": f"list(tp) OVER {w(N)}"}, {"mad": f"list_sum(list_transform(near, lambda x: abs(x - mean))) / {N}"}, {"cci": f"CASE WHEN mean IS NOT NULL THEN {div('tp - mean', '0.015 * mad')} END"}], ["cci"])
put("ind_stoch", [{"k": k_of(N)}, {"slowk": roll("avg", "k", 3)}, {"slowd": roll("avg", "slowk", 3)}], ["slowk", "slowd"])
put("ind_stochf", [{"fastk": k_of(N)}, {"fastd": roll("avg", "fastk", 3)}], ["fastk", "fastd"])
put("ind_stochrsi", [*GAIN_LOSS, MEANS, {"rsi": RSI}, {"fastk": k_of(N, "rsi", "rsi", "rsi")}, {"fastd": roll("avg", "fastk", 3)}], ["fastk", "fastd"])
put("ind_mom", [{"mom": f"close - {lag('close', N)}"}], ["mom"])
put("ind_roc", [{"roc": f"100 * ({div('close', lag('close', N))} - 1)"}], ["roc"])
put("ind_rocr", [{"rocr": div("close", lag("close", N))}], ["rocr"])
put("ind_willr", [{"hh": roll("max", "high", N), "ll": roll("min", "low", N)}, {"willr": f"-100 * {div('hh - close', 'hh - ll')}"}], ["willr"])
put("ind_mfi", [{"tp": TP}, {"move": f"tp - {lag('tp')}"}, {"up": "CASE WHEN move > 0 THEN tp * volume ELSE 0.0 END", "down": "CASE WHEN move < 0 THEN tp * volume ELSE 0.0 END"}, {"gain": roll("sum", "up", N), "loss": roll("sum", "down", N)}, {"mfi": RSI}], ["mfi"])
put("ind_obv", [{"dd": f"close - {lag('close')}"}, {"signed": "CASE WHEN dd > 0 THEN volume WHEN dd < 0 THEN -volume ELSE 0.0 END"}, {"obv": f"sum(signed) OVER ({S} ROWS UNBOUNDED PRECEDING)"}], ["obv"])
put("ind_vwap", [{"pv": f"{TP} * volume"}, {"vwap": div(roll("sum", "pv", 20), roll("sum", "volume", 20))}], ["vwap"])
put("ind_pivot", [{'"pivot"': TP}, {"resistance1": '2 * "pivot" - low', "support1": '2 * "pivot" - high', "resistance2": '"pivot" + (high - low)', "support2": '"pivot" - (high - low)'}], ['"pivot"', "resistance1", "support1", "resistance2", "support2"])
FIBO = ("0.0", "0.236", "0.382", "0.5", "0.618", "0.786", "1.0")
put("ind_fibo", [{"hh": roll("max", "high", 100), "ll": roll("min", "low", 100)}, {f"fib_{x.replace('.', '_')}": f"hh - {x} * (hh - ll)" for x in FIBO}], [f"fib_{x.replace('.', '_')}" for x in FIBO])
put("ind_stddev", [{"stddev": roll("stddev_pop", "close", N)}], ["stddev"])
put("ind_var", [{"var": roll("var_pop", "close", N)}], ["var"])
put("ind_bop", [{"bop": div("close - open", "high - low")}], ["bop"])
AD = [{"flow": f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0.0) * volume"}, {"ad": f"sum(flow) OVER ({S} ROWS UNBOUNDED PRECEDING)"}]
put("ind_ad", AD, ["ad"])
put("ind_ultosc", [{"bp": BP, "tr": f"CASE WHEN {lag('close')} IS NOT NULL THEN {TR} END"}, ULT, {"ultosc": "100 * (4 * u7 + 2 * u14 + u28) / 7"}], ["ultosc"])
put("ind_aroon", [{"n": f"row_number() OVER ({S})"}, {"hi": f"max({{'x': high, 'n': n}}) OVER {w(N + 1)}", "lo": f"max({{'x': -low, 'n': n}}) OVER {w(N + 1)}", "full_": f"count(*) OVER {w(N + 1)} = {N + 1}"}, {"aroon_up": f"CASE WHEN full_ THEN 100.0 * ({N} - (n - hi.n)) / {N} END", "aroon_down": f"CASE WHEN full_ THEN 100.0 * ({N} - (n - lo.n)) / {N} END"}, {"aroonosc": "aroon_up - aroon_down"}], ["aroon_up", "aroon_down", "aroonosc"])
put("ind_linearreg", [{"n": f"row_number() OVER ({S})"}, {"linearreg_slope": f"CASE WHEN count(close) OVER {w(N)} = {N} THEN regr_slope(close, n) OVER {w(N)} END", "mean": f"avg(close) OVER {w(N)}"}, {"linearreg_intercept": f"mean - linearreg_slope * {(N - 1) / 2}"}, {"linearreg": f"linearreg_intercept + linearreg_slope * {N - 1}", "tsf": f"linearreg_intercept + linearreg_slope * {N}", "linearreg_angle": "degrees(atan(linearreg_slope))"}], ["linearreg", "linearreg_slope", "linearreg_intercept", "linearreg_angle", "tsf"])
put("ind_correl", [{"correl": f"CASE WHEN count(close) OVER {w(30)} = 30 THEN corr(high, low) OVER {w(30)} END"}], ["correl"])
put("ind_prices", [{"avgprice": "(open + high + low + close) / 4", "medprice": "(high + low) / 2", "typprice": TP, "wclprice": "(high + low + 2 * close) / 4"}], ["avgprice", "medprice", "typprice", "wclprice"])

# -- recursive indicators


def recursive(states: dict[str, tuple[str, int]], outputs: dict[str, str], steps: list[dict[str, str]] | None = None) -> str:
    """Exponential means by recursion over bars. ``states``: name to (input, span); an input may hold {other means}.
    Outputs are expressions over the means and the columns of the bar."""

    def first(name: str) -> str:
        return "(" + states[name][0].format_map({k: first(k) for k in states if "{" + k + "}" in states[name][0]}) + ")"

    def new(name: str) -> str:
        x, span = states[name]
        x = x.format_map({k: new(k) for k in states if "{" + k + "}" in x})
        return f"({2 / (span + 1)!r}::DOUBLE * ({x}) + {1 - 2 / (span + 1)!r}::DOUBLE * e.{name})"

    head = staged([*(steps or []), {"rn": f"row_number() OVER ({S})"}])[:-1]
    start = ", ".join(f"{first(k)} AS {k}" for k in states)
    step = ", ".join(new(k) for k in states)
    body = f"{head},\ne AS (SELECT symbol, rn, {start} FROM last WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {step} FROM e JOIN last b ON b.symbol = e.symbol AND b.rn = e.rn + 1)\n"
    return body + f"SELECT b.symbol, b.ts, {', '.join(r(x, c) for c, x in outputs.items())} FROM e JOIN last b USING (symbol, rn)"


def means(x: str, span: int, times: int) -> dict[str, tuple[str, int]]:
    return {f"e{i}": (x if i == 1 else f"{{e{i - 1}}}", span) for i in range(1, times + 1)}


FAST_SLOW = {"f": ("close", 12), "g": ("close", 26)}
ORACLES["ind_ema"] = recursive(means("close", N, 1), {"ema": "e1"})
ORACLES["ind_macd"] = recursive(FAST_SLOW | {"sig": ("{f} - {g}", 9)}, {"macd": "f - g", "macdsignal": "sig", "macdhist": "f - g - sig"})
ORACLES["ind_dema"] = recursive(means("close", N, 2), {"dema": "2 * e1 - e2"})
ORACLES["ind_tema"] = recursive(means("close", N, 3), {"tema": "3 * e1 - 3 * e2 + e3"})
_V = 0.7
ORACLES["ind_t3"] = recursive(means("close", N, 6), {"t3": f"{-(_V**3)!r}::DOUBLE * e6 + {3 * _V**2 + 3 * _V**3!r}::DOUBLE * e5 + {-6 * _V**2 - 3 * _V - 3 * _V**3!r}::DOUBLE * e4 + {1 + 3 * _V + _V**3 + 3 * _V**2!r}::DOUBLE * e3"})
ORACLES["ind_trix"] = recursive(means("close", N, 3), {"trix": "100 * (e3 / lag(e3) OVER (PARTITION BY b.symbol ORDER BY b.ts) - 1)"})
ORACLES["ind_ppo"] = recursive(FAST_SLOW, {"ppo": "100 * (f - g) / g"})
ORACLES["ind_apo"] = recursive(FAST_SLOW, {"apo": "f - g"})
ORACLES["ind_keltner"] = recursive({"m": (TP, 20)}, {"keltner_upper": "m + 2 * atr", "keltner_middle": "m", "keltner_lower": "m - 2 * atr"}, [{"tr": TR}, {"atr": roll("avg", "tr", 20)}])
ORACLES["ind_adosc"] = recursive({"f": ("ad", 3), "g": ("ad", 10)}, {"adosc": "f - g"}, AD)
ORACLES["ind_kama"] = staged([{"step": f"abs(close - {lag('close')})", "rn": f"row_number() OVER ({S})"}, {"path": roll("sum", "step", 10), "before": lag("close"), "far": f"abs(close - {lag('close', 10)})"}, {"pace": f"power(CASE WHEN path > 0 THEN far / path ELSE 0.0 END * {2 / 3 - 2 / 31!r}::DOUBLE + {2 / 31!r}::DOUBLE, 2)"}])[:-1] + f""",
e AS (SELECT symbol, rn, before + pace * (close - before) AS k FROM last WHERE rn = 11 UNION ALL SELECT b.symbol, b.rn, e.k + b.pace * (b.close - e.k) FROM e JOIN last b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
SELECT b.symbol, b.ts, {r('k', 'kama')} FROM last b LEFT JOIN e USING (symbol, rn)"""

# -- stock market indicators

_FLOWS = {f"{k}_{way}": f"CASE WHEN {cond} AND close {'>' if way == 'in' else '<'} open THEN amount ELSE 0.0 END" for k, cond in {"large": "size >= 100", "medium": "size >= 20 AND size < 100", "small": "size < 20"}.items() for way in ("in", "out")}
put("capital_flow", [{"size": f"{div('amount', 'volume')} / 10000.0"}, _FLOWS, {"net_flow": "large_in - large_out + medium_in - medium_out + small_in - small_out", "main_net_flow": "large_in - large_out + medium_in - medium_out"}], [*_FLOWS, "net_flow", "main_net_flow"])
ORACLES["chip_concentration"] = staged([{"rn": f"row_number() OVER ({S})"}])[:-1] + """,
pairs AS (SELECT a.symbol, a.rn, b.close AS p, b.volume AS v FROM last a JOIN last b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 60 AND a.rn - 1 WHERE a.rn > 60),
cum AS (SELECT *, sum(v) OVER (PARTITION BY symbol, rn ORDER BY p, v ROWS UNBOUNDED PRECEDING) AS c, sum(v) OVER (PARTITION BY symbol, rn) AS t FROM pairs),
value AS (SELECT symbol, rn, (min(p) FILTER (c >= 0.95::DOUBLE * t) - min(p) FILTER (c >= (1 - 0.95)::DOUBLE * t)) / (sum(p * v) / max(t)) AS x FROM cum GROUP BY symbol, rn)
SELECT symbol, ts, round((x)::DECIMAL(38, 9), 6)::DOUBLE AS chip_concentration FROM last LEFT JOIN value USING (symbol, rn)""".replace("(1 - 0.95)::DOUBLE", "0.05::DOUBLE")
ORACLES["chip_profile"] = f"""WITH {DAILY}, latest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60),
ends AS (SELECT symbol, min(low) AS lo, max(high) AS hi, arg_max(close, ts) AS last_close FROM latest GROUP BY symbol),
vol AS (SELECT symbol, least(floor((close - lo) / nullif((hi - lo) / 50, 0)), 49)::INT AS bin, sum(volume) AS volume FROM latest JOIN ends USING (symbol) GROUP BY ALL),
full_ AS (SELECT e.symbol, b.bin::INT AS bin, lo + (b.bin + 0.5) * ((hi - lo) / 50) AS price, coalesce(volume, 0.0) AS volume, last_close FROM ends e CROSS JOIN range(50) b(bin) LEFT JOIN vol v ON v.symbol = e.symbol AND v.bin = b.bin)
SELECT symbol, bin, {r('price')}, {r('volume')}, {r('sum(volume) OVER (PARTITION BY symbol ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(volume) OVER (PARTITION BY symbol)', 'share')}, {r('sum(CASE WHEN price <= last_close THEN volume ELSE 0.0 END) OVER (PARTITION BY symbol) / sum(volume) OVER (PARTITION BY symbol)', 'profit_ratio')} FROM full_"""


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END)"


put("limit_up_probability", [
    {"r1": f"{div('close', lag('close'))} - 1", "r5": f"{div('close', lag('close', 5))} - 1", "vol": f"{div(roll('avg', 'volume', 5), roll('avg', 'volume', 20))} - 1", "rise": f"{div('close', 'open')} - 1", "rng": div("high - low", lag("close"))},
    {"calm": roll("stddev_samp", "r1", 20)},
    {"score": f"({clip('r5 * 500', 0, 30)} + {clip('vol * 20', 0, 25)} + {clip('rise * 300', 0, 25)} + {clip('rng * 200', 0, 10)}) * CASE WHEN calm < 0.02 THEN 0.5 ELSE 1.0 END"},
    {"limit_up_probability": f"coalesce({clip('score', 0, 100)}, 0.0)"},
], ["limit_up_probability"])
_BOARD = [{"v": div("volume", roll("avg", "volume", 20))}, {"excess": "CASE WHEN v IS NOT NULL THEN greatest(v - 1, 0.0) END"}, {"sig": roll("avg", "excess", 5)}]
put("board_effect", [*_BOARD, {"board_effect": f"coalesce(({div('close', lag('close', 5))} - 1) * (1 + sig), 0.0)"}], ["board_effect"])
put("board_effect_relative", [{"bc": "avg(close) OVER (PARTITION BY ts)"}, *_BOARD, {"board_effect": f"coalesce(({div('close', lag('close', 20))} - {div('bc', lag('bc', 20))}) * (1 + sig), 0.0)"}], ["board_effect"])
put("turnover_zscore", [{"z": div(f"turnover_rate - {roll('avg', 'turnover_rate', 60)}", roll("stddev_samp", "turnover_rate", 60))}, {"turnover_zscore": "CASE WHEN abs(z) > 2 THEN z ELSE 0.0 END"}, {"is_anomaly": "turnover_zscore <> 0", "anomaly_direction": "CASE WHEN turnover_zscore > 0 THEN 'high' WHEN turnover_zscore < 0 THEN 'low' ELSE 'normal' END"}], ["turnover_zscore"], plain=("is_anomaly", "anomaly_direction"))
_ENERGY = {"energy": f"volume * {div('high - low', 'close')}"}
put("main_force", [_ENERGY, {"main_force": f"coalesce({div(f'{roll("avg", "energy", 20)} - {roll("avg", "energy", 40)}', roll('stddev_samp', 'energy', 40))}, 0.0)"}], ["main_force"])
_PLACE = div("close - low", "high - low")
put("main_force_detail", [_ENERGY | {"force_direction": f"CASE WHEN {_PLACE} > 0.6 THEN 1 WHEN {_PLACE} < 0.4 THEN -1 ELSE 0 END"}, {"energy_mean": roll("avg", "energy", 20)}, {"energy_ratio": div("energy_mean", roll("avg", "volume", 20))}], ["energy", "energy_mean", "energy_ratio"], plain=("force_direction",))
put("formula_capital_pressure_score", [{"pc": f"{div('amount', lag('amount'))} - 1"}, {"value": f"{div(f'pc - {roll("avg", "pc", 20)}', roll('stddev_samp', 'pc', 20))} + {div('close - low', 'high - low + 0.000001::DOUBLE')}"}], ["value"])
put("formula_trend_volume_confirm", [{"value": f"{div(f'{roll("avg", "close", 10)} - {roll("avg", "close", 30)}', 'close')} + {div('volume', roll('avg', 'volume', 20))}"}], ["value"])
put("formula_range_squeeze", [{"hl": "high - low"}, {"value": f"{div(roll('stddev_samp', 'close', 20), roll('avg', 'close', 20))} + {div(roll('avg', 'hl', 10), 'close')}"}], ["value"])
put("formula_params", [{"value": f"{div(roll('avg', 'close', 5), roll('avg', 'close', 12))} - 1.5 + {roll('max', 'close', 12)} * 0.001::DOUBLE"}], ["value"])
put("ind_macdext", [{"macd": f"{roll('avg', 'close', 12)} - {roll('avg', 'close', 26)}"}, {"macdsignal": roll("avg", "macd", 9)}, {"macdhist": "macd - macdsignal"}], ["macd", "macdsignal", "macdhist"])
put("formula_mixed", [{"value": f"{roll('max', 'close', 5)} - least(sqrt(abs(low)), ln(abs(volume + 1) + 1e-12), 3) + {div(f'power({lag("close", 2)}, 2)', '-open')}"}], ["value"])
ORACLES["formula_ema"] = recursive(means("close", 10, 1), {"value": "e1 / sma - 1"}, [{"sma": roll("avg", "close", 10)}])
ORACLES["protected_math"] = """
SELECT l_returnflag, l_linestatus, count(*) AS n,
  round((sum(round(CASE WHEN abs(l_discount) > 1e-10 THEN l_quantity / l_discount ELSE 1.0 END, 6)))::DECIMAL(38, 5), 2)::DOUBLE AS div, round((sum(round(sqrt(abs(l_quantity)), 6)))::DECIMAL(38, 5), 2)::DOUBLE AS root,
  round((sum(round(ln(abs(l_discount) + 1e-10), 6)))::DECIMAL(38, 5), 2)::DOUBLE AS log, round((sum(round(power(abs(l_discount), 0.5), 6)))::DECIMAL(38, 5), 2)::DOUBLE AS power, count(*) FILTER (abs(l_discount - 0.05) < 1e-6)::BIGINT AS near
FROM lineitem GROUP BY l_returnflag, l_linestatus"""

# -- signals and rules

CROSS = [{"f": roll("avg", "close", 20), "g": roll("avg", "close", 50)}, {"signal": "CASE WHEN coalesce(f > g, false) THEN 1 ELSE -1 END"}]
ORACLES["ir_signal_ma_cross"] = staged(CROSS) + "SELECT symbol, ts, signal FROM last"
ORACLES["ir_signal_rsi"] = staged([*GAIN_LOSS, MEANS, {"rsi": RSI}, {"signal": "CASE WHEN rsi < 40 THEN 1 WHEN rsi > 60 THEN -1 ELSE 0 END"}]) + "SELECT symbol, ts, signal FROM last"
ORACLES["ir_signal_logic"] = staged([*GAIN_LOSS, MEANS | {"sma": roll("avg", "close", 10)}, {"rsi": RSI, "gap": "close - sma"}, {"signal": f"CASE WHEN NOT coalesce(rsi < 45, false) AND coalesce(gap > 0 AND {lag('gap')} <= 0, false) THEN 1 ELSE 0 END"}]) + "SELECT symbol, ts, signal FROM last"
BOARD = "CASE WHEN symbol IN ('1-URGENT', 'click') THEN 0.2 WHEN symbol IN ('2-HIGH', 'error') THEN 0.3 ELSE 0.1 END::DOUBLE"
RULED = [{"lim": BOARD, "off": "day(ts) = 13", "factor": "CASE WHEN day(ts) > 15 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END", "before": f"coalesce({lag('close')}, close)"}, {
    "no_buy_reason": "CASE WHEN before > 0 AND high >= before * (1 + lim) - 1e-6 THEN 'price limit' WHEN off THEN 'suspended' END", "no_sell_reason": "CASE WHEN before > 0 AND low <= before * (1 - lim) + 1e-6 THEN 'price limit' WHEN off THEN 'suspended' END"}]
PLAIN_RULES = [{"lim": "0.1::DOUBLE", "off": "false", "factor": "1.0::DOUBLE", "before": RULED[0]["before"]}, RULED[1]]
ORACLES["rule_flags"] = staged(RULED) + "SELECT symbol, ts, no_buy_reason IS NULL AS can_buy, no_sell_reason IS NULL AS can_sell, no_buy_reason, no_sell_reason FROM last"

ORACLES["ir_signal_named_outputs"] = (
    "SELECT symbol, ts, minus_di, plus_di, plus_dm, aroon_down AS aroon, aroonosc, linearreg, linearreg_angle, tsf, typprice, wclprice, upperband AS bbands FROM "
    + " JOIN ".join(f"({ORACLES[f'ind_{x}']})" + (" USING (symbol, ts)" if i else "") for i, x in enumerate(("directional", "aroon", "linearreg", "prices", "bbands")))
)
_CHANGE = "CASE WHEN {} THEN 1 ELSE -1 END"
ORACLES["ir_signal_arithmetic"] = staged([
    {"ma": roll("avg", "close", 5), "slow": roll("avg", "close", 20), "mom": f"close - {lag('close', 10)}"},
    {"ma2": lag("ma", 2), "ma3": lag("ma", 3), "mom1": lag("mom", 1), "under": f"coalesce(ma < slow AND {lag('ma')} - {lag('slow')} >= 0, false)"},
    {"gap": "(ma - ma2) - (-(mom / 4))", "chosen": "CASE WHEN under THEN ma ELSE mom1 END"},
    {"s0": _CHANGE.format("coalesce(ma + 0.5 * mom > ma3, false)"), "s1": _CHANGE.format(f"coalesce(gap > 0 AND {lag('gap')} <= 0, false)"), "s2": _CHANGE.format("coalesce(chosen <= 3, false) OR NOT coalesce(mom >= 0, false)"),
     "s3": _CHANGE.format("coalesce(sqrt(abs(mom)) < ln(abs(power(abs(mom), 2)) + 1e-10), false)"), "s4": "1"},
]) + "SELECT symbol, ts, s0, s1, s2, s3, s4 FROM last"

# -- execution

B_COLUMNS = "ts, open, close, signal, no_buy_reason IS NULL AS can_buy, no_sell_reason IS NULL AS can_sell, factor"


def execution(money: str = "cash * 0.95::DOUBLE", twice: bool = True, base: str = "close") -> str:
    """Tables b to st: the bar-by-bar step as a recursion over table ``b`` (key, rn, bar)."""
    extra = f"b.{base} * 0.001::DOUBLE" if twice else "0.0::DOUBLE"
    return f""",
st AS (
  SELECT key, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, 1000000.0::DOUBLE AS cash, 1000000.0::DOUBLE AS equity, 0.0::DOUBLE AS mv, 0.0::DOUBLE AS shares, 1.0::DOUBLE AS factor, NULL::DATE AS bday, 0 AS trades, NULL::INT AS side, NULL::DOUBLE AS price, NULL::DOUBLE AS fshares, NULL::DOUBLE AS commission, NULL::DOUBLE AS slip FROM b WHERE rn = 1
  UNION ALL
  SELECT key, rn, ts, cash2, cash2 + shares2 * close, shares2 * close, shares2, CASE WHEN buy AND sh1 = 0 THEN bf ELSE f1 END, CASE WHEN buy THEN ts::DATE WHEN sell THEN NULL ELSE bday END, trades + (buy OR sell)::INT,
    CASE WHEN buy THEN 1 WHEN sell THEN -1 END, CASE WHEN buy THEN px WHEN sell THEN spx END, CASE WHEN buy THEN n WHEN sell THEN sh1 END, CASE WHEN buy THEN n * px * 0.0003::DOUBLE WHEN sell THEN sh1 * spx * 0.0003::DOUBLE END, CASE WHEN buy THEN extra * n WHEN sell THEN extra * sh1 END
  FROM (
    SELECT *, CASE WHEN buy THEN cash - (n * px + n * px * 0.0003::DOUBLE + extra * n) WHEN sell THEN cash + sh1 * spx - (sh1 * spx * 0.0003::DOUBLE + sh1 * spx * 0.0005::DOUBLE + extra * sh1) ELSE cash END AS cash2, CASE WHEN buy THEN sh1 + n WHEN sell THEN 0 ELSE sh1 END AS shares2
    FROM (
      SELECT *, signal > 0 AND can_buy AND n > 0 AND cash >= n * px + n * px * 0.0003::DOUBLE + extra * n AS buy, signal < 0 AND sh1 > 0 AND can_sell AND bday <> ts::DATE AS sell
      FROM (
        SELECT *, trunc(({money}) / px / 100) * 100 AS n, CASE WHEN adj THEN trunc(shares / (bf / factor)) ELSE shares END AS sh1, CASE WHEN adj THEN bf ELSE factor END AS f1
        FROM (
          SELECT e.key, b.rn, b.ts, e.cash, e.equity, e.shares, e.factor, e.bday, e.trades, b.close, b.signal, b.can_buy, b.can_sell, b.factor AS bf, b.{base} * 1.001::DOUBLE AS px, b.{base} * 0.999::DOUBLE AS spx, {extra} AS extra,
            coalesce(e.shares > 0 AND b.factor > 0 AND e.factor > 0 AND b.factor <> e.factor AND trunc(e.shares / (b.factor / e.factor)) > 0, false) AS adj
          FROM st e JOIN b ON b.key = e.key AND b.rn = e.rn + 1)))))
"""


def cross_execution(source: str = DAILY, **kw) -> str:
    lagged = kw.pop("lagged", False)
    body = staged([*CROSS, *RULED], source)[:-1]
    columns = B_COLUMNS.replace("signal", f"coalesce({lag('signal')}, 0) AS signal") if lagged else B_COLUMNS
    return body + f",\nb AS (SELECT symbol AS key, row_number() OVER ({S}) AS rn, {columns} FROM last)" + execution(**kw)


EQUITY_COLUMNS = f"(rn - 1)::INT AS bar_seq, ts, {r('equity', digits=2)}, {r('cash', digits=2)}, {r('mv', 'market_value', 2)}"
TRADE_COLUMNS = f"ts, 'T' || lpad(trades::VARCHAR, 5, '0') AS trade_id, side AS signal, {r('price', digits=4)}, fshares::BIGINT AS shares, {r('commission', digits=4)}, {r('slip', 'slippage', 4)}, CASE side WHEN 1 THEN 'buy' ELSE 'sell' END AS reason, trades AS trade_seq"
ORACLES["backtest_ma_cross"] = cross_execution(HOURLY) + f"SELECT key AS symbol, {EQUITY_COLUMNS} FROM st WHERE rn > 0"
ORACLES["backtest_trades"] = cross_execution(HOURLY) + f"SELECT key AS symbol, {TRADE_COLUMNS} FROM st WHERE side IS NOT NULL"
ORACLES["result_sink"] = ORACLES["backtest_trades"]
ORACLES["backtest_percent"] = cross_execution(HOURLY, money="equity * 0.1::DOUBLE", twice=False) + f"SELECT key AS symbol, {EQUITY_COLUMNS} FROM st WHERE rn > 0"
ORACLES["backtest_next_open"] = cross_execution(HOURLY, base="open", lagged=True) + f"SELECT key AS symbol, {TRADE_COLUMNS} FROM st WHERE side IS NOT NULL"

ORACLES["excursions"] = cross_execution(HOURLY) + f""", h AS (SELECT *, mv > 0 AS held, mv > 0 AND NOT coalesce(lag(mv > 0) OVER (PARTITION BY key ORDER BY rn), false) AS begins FROM st WHERE rn > 0),
y AS (SELECT *, sum(begins::INT) OVER (PARTITION BY key ORDER BY rn ROWS UNBOUNDED PRECEDING)::INT AS stay FROM h)
SELECT key AS symbol, stay, min(ts) AS entry_ts, max(ts) AS last_ts, count(*) AS n_bars, {r('max(equity) / arg_min(equity, rn) - 1', 'mfe')}, {r('min(equity) / arg_min(equity, rn) - 1', 'mae')} FROM y WHERE held GROUP BY key, stay"""

# -- metrics


def metric_tables(curve: str, keys: str, order: str = "bar_seq") -> str:
    """Tables m0 to mx over a curve (keys, order, equity)."""
    p = f"PARTITION BY {keys} ORDER BY {order}"
    return f""",
m0 AS (SELECT *, row_number() OVER ({p}) - 1 AS sq, equity / nullif(lag(equity) OVER ({p}), 0) - 1 AS ret, max(equity) OVER ({p} ROWS UNBOUNDED PRECEDING) AS peak FROM {curve}),
m1 AS (SELECT *, (equity - peak) / peak AS drawdown, (equity - peak) / peak < -1e-12 AS under, lead(1) OVER ({p}) IS NULL AS fin FROM m0),
m2 AS (SELECT *, CASE WHEN under AND NOT coalesce(lag(under) OVER ({p}), false) THEN sq END AS st FROM m1),
m3 AS (SELECT *, CASE WHEN under THEN sq - last_value(st IGNORE NULLS) OVER ({p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + CASE WHEN fin THEN 0 ELSE 1 END ELSE 0 END AS under_bars FROM m2),
m4 AS (SELECT {keys}, count(*) AS n, arg_min(equity, {order}) AS fst, arg_max(equity, {order}) AS lst, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn, min(drawdown) AS mdd, max(under_bars) AS dur FROM m3 GROUP BY {keys}),
m5 AS (SELECT *, lst / fst - 1 AS total FROM m4),
m6 AS (SELECT *, CASE WHEN 1 + total > 0 THEN power(1 + total, 252.0::DOUBLE / n) - 1 ELSE total * 252.0 / n END AS annual, coalesce(sd * sqrt(252), 0.0) AS vol, coalesce(dn * sqrt(252), 0.0) AS dvol FROM m5),
mx AS (SELECT {keys}, n, lst - fst AS net_profit, total * 100 AS total_return_pct, annual * 100 AS annual_return_pct, annual AS cagr, vol AS volatility, CASE WHEN vol > 0 THEN (annual - 0.02) / vol ELSE 0.0 END AS sharpe_ratio, CASE WHEN dvol > 0 THEN (annual - 0.02) / dvol ELSE 0.0 END AS sortino_ratio,
  mdd * 100 AS max_drawdown_pct, dur::DOUBLE AS max_drawdown_duration, CASE WHEN mdd <> 0 THEN annual / abs(mdd) ELSE 0.0 END AS calmar_ratio, CASE WHEN mdd <> 0 THEN (lst - fst) / (abs(mdd) * fst) ELSE 0.0 END AS return_on_drawdown FROM m6)
"""


FIGURES = ("net_profit", "total_return_pct", "annual_return_pct", "cagr", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "max_drawdown_duration", "calmar_ratio", "return_on_drawdown")


def fifo_tables(trades: str, keys: str) -> str:
    """Tables t0 to trips and tp over trades (keys, symbol, trade_seq, signal, shares, price, commission, slippage).

    The edges of lots and sells cut the share counts into steps; each step looks up the lot and the sell it lies in.
    """
    both = f"{keys}, symbol" if keys else "symbol"
    p = f"PARTITION BY {both} ORDER BY trade_seq ROWS UNBOUNDED PRECEDING"
    same = lambda a: " AND ".join(f"c.{k} = {a}.{k}" for k in both.split(", "))
    return f""",
t0 AS (SELECT *, sum(CASE WHEN signal > 0 THEN shares ELSE 0 END) OVER ({p})::BIGINT AS b, sum(CASE WHEN signal < 0 THEN shares ELSE 0 END) OVER ({p})::BIGINT AS s, CASE WHEN signal > 0 THEN shares * price + commission + slippage ELSE shares * price - commission - slippage END AS money FROM {trades} WHERE shares > 0),
t1 AS (SELECT *, b - s - least(0, min(b - s) OVER ({p})) AS held FROM t0),
t2 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY {both} ORDER BY trade_seq), 0) AS had FROM t1),
buys AS (SELECT *, b - shares AS lo, b AS hi FROM t2 WHERE signal > 0),
sells AS (SELECT *, b - had AS lo, b - held AS hi FROM t2 WHERE signal < 0 AND held < had),
edges AS (SELECT {both}, lo AS e FROM buys UNION SELECT {both}, hi FROM buys UNION SELECT {both}, lo FROM sells UNION SELECT {both}, hi FROM sells),
c AS (SELECT *, lead(e) OVER (PARTITION BY {both} ORDER BY e) AS f FROM edges),
trips AS (SELECT {', '.join(f'c.{k}' for k in both.split(', '))}, y.trade_seq AS buy_trade_seq, z.trade_seq AS sell_trade_seq, (c.f - c.e)::BIGINT AS shares, y.money * (c.f - c.e) / y.shares AS cost, z.money * (c.f - c.e) / z.shares AS proceeds
  FROM c ASOF JOIN buys y ON {same('y')} AND c.e >= y.lo ASOF JOIN sells z ON {same('z')} AND c.e >= z.lo WHERE c.e < y.hi AND c.e < z.hi),
tp AS (SELECT *, proceeds - cost AS pnl FROM trips)
"""


def trade_figures(keys: str, trades: str) -> str:
    return f""",
tq AS (SELECT {keys}, avg((pnl > 0)::INT) AS wr, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0.0 END) AS won, sum(CASE WHEN pnl <= 0 THEN -pnl ELSE 0.0 END) AS lost, avg(pnl) FILTER (pnl > 0) AS aw, avg(-pnl) FILTER (pnl <= 0) AS al FROM tp GROUP BY {keys}),
tm AS (SELECT {keys}, coalesce(wr, 0.0) AS win_rate, CASE WHEN lost > 0 THEN won / lost ELSE 0.0 END AS profit_factor, coalesce(aw, 0.0) AS avg_win, coalesce(al, 0.0) AS avg_loss, coalesce(wr, 0.0) * coalesce(aw, 0.0) - (1 - coalesce(wr, 0.0)) * coalesce(al, 0.0) AS expectancy, total_trades FROM (SELECT {keys}, count(*)::DOUBLE AS total_trades FROM {trades} GROUP BY {keys}) LEFT JOIN tq USING ({keys}))
"""


TRADE_FIGURES = ("win_rate", "profit_factor", "avg_win", "avg_loss", "expectancy", "total_trades")
CURVE = f"WITH {DAILY}, curve AS (SELECT symbol, ts, row_number() OVER ({S}) - 1 AS bar_seq, close AS equity FROM bars)"
ORACLES["equity_metrics"] = CURVE + metric_tables("curve", "symbol") + f"SELECT symbol, {', '.join(map(r, FIGURES))} FROM mx"
ORACLES["drawdown_islands"] = CURVE + metric_tables("curve", "symbol") + f"SELECT symbol, bar_seq::INT AS bar_seq, {r('peak')}, {r('drawdown')}, under_bars::INT AS under_bars FROM m3"
ORACLES["flat_run"] = CURVE + f""", h AS (SELECT *, coalesce(equity > max(equity) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS high FROM curve),
g AS (SELECT *, bar_seq - last_value(CASE WHEN high THEN bar_seq END IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM h) SELECT symbol, max(since)::INT AS flat_run FROM g GROUP BY symbol"""
ORACLES["multi_oos"] = CURVE + f", c AS (SELECT *, ntile(3) OVER ({S}) AS part FROM curve) SELECT symbol, part::INT AS part, {r('arg_max(equity, bar_seq) / arg_min(equity, bar_seq) - 1', 'total_return')}, count(*) AS n FROM c GROUP BY symbol, part"
ORACLES["backtest_metrics"] = (
    cross_execution(HOURLY)
    + ", curve AS (SELECT key AS symbol, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0), fills AS (SELECT key AS symbol, trades AS trade_seq, side AS signal, fshares AS shares, price, commission, slip AS slippage FROM st WHERE side IS NOT NULL)"
    + metric_tables("curve", "symbol") + fifo_tables("fills", "") + trade_figures("symbol", "fills")
    + f"SELECT symbol, {', '.join(map(r, FIGURES))}, {', '.join(r(f'coalesce({c}, 0.0)', c) for c in TRADE_FIGURES)} FROM mx LEFT JOIN tm USING (symbol)"
)
FILLS = """WITH t AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS ts, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END AS signal, (l_quantity * 100)::BIGINT AS shares, round((l_extendedprice / l_quantity / 100)::DECIMAL(38, 7), 4)::DOUBLE AS price, l_tax AS commission, l_discount AS slippage FROM lineitem),
fills AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, price) AS trade_seq, symbol AS run_id FROM t)"""
ORACLES["fifo_round_trips"] = FILLS + fifo_tables("fills", "") + f"SELECT symbol, buy_trade_seq::INT AS buy_trade_seq, sell_trade_seq::INT AS sell_trade_seq, shares, {r('cost', digits=4)}, {r('proceeds', digits=4)}, {r('pnl', digits=4)} FROM tp"
ORACLES["trade_metrics"] = FILLS + fifo_tables("fills", "run_id") + trade_figures("run_id", "fills") + f"SELECT run_id, {', '.join(r(c, digits=4) for c in TRADE_FIGURES)} FROM tm"
ORACLES["pnl_histogram"] = FILLS + fifo_tables("fills", "") + f""", p AS (SELECT symbol, round((pnl)::DECIMAL(38, 7), 4)::DOUBLE AS pnl FROM tp), e AS (SELECT symbol, min(pnl) AS lo, max(pnl) AS hi FROM p GROUP BY symbol)
SELECT symbol, coalesce(least(floor((pnl - lo) / nullif((hi - lo) / 20, 0)), 19), 0)::INT AS bin, count(*) AS n, {r('sum(pnl)', 'pnl', 2)} FROM p JOIN e USING (symbol) GROUP BY ALL"""

# -- Monte Carlo


def u(*keys: str) -> str:
    return f"(concat('0x', substr(md5(concat_ws(':', '42', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def drawn(method: str, *rates: float) -> str:
    return f"([{', '.join(map(str, rates))}]::DOUBLE[])[(floor({u(chr(39) + 'rate' + chr(39), chr(39) + method + chr(39), 'sim_id')} * {len(rates)}) + 1)::INT]"


def outcomes(source: str, n: int) -> str:
    """Tables bars, outcomes and rows: the change of each bar as a trade, once for each of n simulations."""
    return f"{source}, outcomes AS (SELECT symbol AS run_id, row_number() OVER ({S}) AS trade_seq, round(((close - open) * 100)::DECIMAL(38, 7), 4)::DOUBLE AS pnl FROM bars), rows AS (SELECT *, i::INT AS sim_id FROM outcomes, range({n}) g(i))"


def simulated(method: str) -> str:
    x = u(f"'{method}'", "sim_id", "trade_seq")
    match method:
        case "shuffle_trades":
            return f"SELECT *, {x} AS place FROM rows"
        case "skip_trades":
            return f"SELECT *, trade_seq::DOUBLE AS place FROM rows WHERE {x} > {drawn(method, 0.1, 0.2, 0.3)}"
        case "randomize_trades_order":
            return f"SELECT * REPLACE (CASE WHEN {u(chr(39) + 'flip' + chr(39), 'sim_id', 'trade_seq')} < 0.5 THEN -pnl ELSE pnl END AS pnl), {x} AS place FROM rows"
        case "position_size":
            return f"SELECT * REPLACE (pnl * (0.8::DOUBLE + 0.4::DOUBLE * {x}) AS pnl), trade_seq::DOUBLE AS place FROM rows"
    return f"SELECT *, trade_seq::DOUBLE AS place FROM rows QUALIFY row_number() OVER (PARTITION BY run_id, sim_id ORDER BY {x}, trade_seq) > floor(count(*) OVER (PARTITION BY run_id, sim_id) * {drawn(method, 0.1, 0.2)})"


METHODS = ("shuffle_trades", "skip_trades", "randomize_trades_order", "position_size", "delete_trades")
for _m in METHODS:
    ORACLES[f"mc_{_m}"] = f"WITH {outcomes(DAILY, 20)}, sim AS ({simulated(_m)}) SELECT run_id, sim_id, trade_seq::INT AS trade_seq, {r('pnl')}, row_number() OVER (PARTITION BY run_id, sim_id ORDER BY place, trade_seq)::INT AS at FROM sim".replace(" AS at", ' AS "at"')


def mc_summary(figures: str) -> str:
    """Summary over (run_id, method, total_return_pct, sharpe_ratio, max_drawdown_pct)."""
    return f"""SELECT run_id, method, count(*) AS n_simulations, {r("avg((total_return_pct > 0)::INT)", "profitable_pct", 4)}, {r("quantile_cont(total_return_pct / 100, 0.5)", "profit_median", 4)}, {r("quantile_cont(total_return_pct / 100, 0.05)", "profit_pct5", 4)}, {r("quantile_cont(total_return_pct / 100, 0.95)", "profit_pct95", 4)}, {r("stddev_samp(total_return_pct / 100)", "profit_std", 4)},
  {r("quantile_cont(sharpe_ratio, 0.5)", "sharpe_median", 4)}, {r("stddev_samp(sharpe_ratio)", "sharpe_std", 4)}, {r("min(max_drawdown_pct / 100)", "worst_drawdown", 4)}, avg((total_return_pct > 0)::INT) >= 0.8 AS pass_status FROM {figures} GROUP BY run_id, method"""


def trade_methods(source: str, n: int) -> str:
    """Tables to mx: figures of all simulations of the trade methods."""
    return outcomes(source, n) + ", sim AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, run_id, sim_id, trade_seq, pnl, place FROM ({simulated(m)})" for m in METHODS) + """),
curve AS (SELECT method, run_id, sim_id, row_number() OVER p AS bar_seq, 1000000.0::DOUBLE + sum(pnl) OVER (p ROWS UNBOUNDED PRECEDING) AS equity FROM sim WINDOW p AS (PARTITION BY method, run_id, sim_id ORDER BY place, trade_seq) UNION ALL SELECT DISTINCT method, run_id, sim_id, 0, 1000000.0::DOUBLE FROM sim)""" + metric_tables("curve", "method, run_id, sim_id")


def overall(summary: str) -> str:
    return f"SELECT run_id, bool_and(pass_status) AS pass_status, min(profitable_pct) AS least_profitable, min(worst_drawdown) AS worst_drawdown, count(*) AS n_methods FROM ({summary}) GROUP BY run_id"


ORACLES["mc_summary"] = f"WITH {trade_methods(DAILY, 20)} {mc_summary('mx')}"
ORACLES["mc_overall"] = overall(ORACLES["mc_summary"])
ORACLES["mc_block_shuffle"] = f"""WITH {DAILY}, n AS (SELECT symbol, close, row_number() OVER ({S}) AS n, ln({div('close', lag('close'))}) AS step FROM bars), rows AS (SELECT *, i::INT AS sim_id, floor((n - 2) / 20)::BIGINT AS block FROM n, range(3) g(i)),
u AS (SELECT *, {u("'block'", "sim_id", "symbol", "block")} AS x FROM rows), p AS (SELECT symbol, sim_id, row_number() OVER o AS place, ln(first_value(close) OVER o) + sum(coalesce(step, 0.0)) OVER (o ROWS UNBOUNDED PRECEDING) AS c FROM u WINDOW o AS (PARTITION BY symbol, sim_id ORDER BY n > 1, x, block, n))
SELECT symbol, sim_id, place::INT AS place, {r('c', 'log_close')} FROM p"""
ORACLES["regime_returns"] = staged([{"change": f"{div('close', lag('close', 20))} - 1"}, {"rg": "CASE WHEN change > 0.1 THEN 'rising' WHEN change < -0.1 THEN 'falling' ELSE 'flat' END"}, {"regime": lag("rg"), "ret": f"{div('close', lag('close'))} - 1"}]) + f"SELECT symbol, regime, {r('avg(ret)', 'mean_ret')}, count(*) AS n FROM last WHERE regime IS NOT NULL GROUP BY symbol, regime"


def normal(column: str) -> str:
    key = (f"'{column}'", "sim_id", "symbol", "epoch_us(ts)")
    return f"(sqrt(-2 * ln({u(*key, chr(39) + 'u' + chr(39))} + 1e-12)) * cos(2 * pi() * {u(*key, chr(39) + 'v' + chr(39))}))"


_WALK = lambda what: u(f"'{what}'", "symbol", "n")
_STEP = f"(sqrt(-2 * ln({u(chr(39) + 'step' + chr(39), 'symbol', 'n', chr(39) + 'u' + chr(39))} + 1e-12)) * cos(2 * pi() * {u(chr(39) + 'step' + chr(39), 'symbol', 'n', chr(39) + 'v' + chr(39))}))"
ORACLES["random_walk_bars"] = f"""
WITH days AS (SELECT 'S' || lpad(i::VARCHAR, 3, '0') AS symbol, d::TIMESTAMP AS ts FROM range(4) x(i), generate_series(DATE '2020-01-01', DATE '2020-01-01' + INTERVAL 147 DAY, INTERVAL 1 DAY) g(d) WHERE isodow(d) <= 5),
n AS (SELECT *, row_number() OVER ({S}) AS n FROM days QUALIFY n <= 100),
c AS (SELECT *, 100 * exp(sum(CASE WHEN n = 1 THEN 0.0 ELSE 0.02::DOUBLE * {_STEP} END) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS close FROM n),
o AS (SELECT *, close * (1 + 0.01::DOUBLE * ({_WALK('open')} - 0.5)) AS open FROM c),
h AS (SELECT *, greatest(open, close) * (1 + 0.01::DOUBLE * {_WALK('high')}) AS high, least(open, close) * (1 - 0.01::DOUBLE * {_WALK('low')}) AS low, 1e6 + floor({_WALK('volume')} * 49e6) AS volume, {div('close', lag('close'))} - 1 AS ch FROM o)
SELECT symbol, ts, {', '.join(r(x, digits=4) for x in ALL[:5])}, coalesce(ch >= 0.095, false) AS limit_up, coalesce(ch <= -0.095, false) AS limit_down, {_WALK('suspended')} < 0.01 AS is_suspended, 1.0::DOUBLE AS adjustment_factor FROM h"""
_SPREAD = ", ".join(f"coalesce(stddev_samp({c}) OVER (PARTITION BY symbol), 0.0) AS s_{c}" for c in ALL[:4])


def noisy(source: str, n: int) -> str:
    """Tables to noisy: the bars of every simulation."""
    return f"""{source}, s AS (SELECT *, {_SPREAD} FROM bars), noise AS (SELECT *, i::INT AS sim_id FROM s, range({n}) g(i)),
moved AS (SELECT symbol, ts, sim_id, {', '.join(f"{c} + {drawn('data_noise', 0.01, 0.02, 0.05)} * s_{c} * {normal(c)} AS {c}" for c in ALL[:4])} FROM noise),
noisy AS (SELECT symbol, ts, sim_id, open, greatest(high, open, close, low) AS high, least(low, open, close, high) AS low, close FROM moved)"""


def offset(source: str, n: int) -> str:
    """Tables to later: the bars of every simulation after its offset."""
    return f"""{source}, k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n_bars, row_number() OVER ({S}) AS k FROM bars), ks AS (SELECT *, i::INT AS sim_id FROM k, range({n}) g(i)), most AS (SELECT *, floor(n_bars * {drawn('start_offset', 0.1, 0.2, 0.3)}) AS most FROM ks),
later AS (SELECT * FROM most WHERE k > CASE WHEN most > 0 THEN floor({u("'offset'", "sim_id", "symbol")} * most) + 1 ELSE 0 END)"""


ORACLES["mc_data_noise"] = f"WITH {noisy(DAILY, 3)} SELECT symbol, ts, sim_id, {', '.join(r(c, digits=4) for c in ALL[:4])} FROM noisy"
ORACLES["mc_atr_noise"] = staged([{"tr": TR}, {"atr": roll("avg", "tr", 14)}])[:-1] + f""", rows AS (SELECT *, i::INT AS sim_id FROM last, range(3) g(i)), m AS (SELECT *, 0.5::DOUBLE * coalesce(atr, 0.0) * {normal('atr')} AS move FROM rows)
SELECT symbol, ts, sim_id, {', '.join(r(f'{c} + move', c, 4) for c in ALL[:4])} FROM m"""
ORACLES["mc_against_original"] = f"""WITH own AS (WITH {outcomes(DAILY, 1)}, curve AS (SELECT run_id, trade_seq AS bar_seq, 1000000.0::DOUBLE + sum(pnl) OVER (PARTITION BY run_id ORDER BY trade_seq) AS equity FROM outcomes){metric_tables('curve', 'run_id')} SELECT * FROM mx),
sims AS (WITH {trade_methods(DAILY, 10)} SELECT run_id, method, quantile_cont(total_return_pct / 100, 0.5) AS profit, min(max_drawdown_pct / 100) AS fall FROM mx WHERE method IN ('skip_trades', 'delete_trades') GROUP BY ALL)
SELECT run_id, method, {r('total_return_pct / 100', 'original_return', 4)}, {r('max_drawdown_pct / 100', 'original_drawdown', 4)}, {r('profit / nullif(total_return_pct / 100, 0)', 'profit_kept', 4)}, {r('fall / nullif(max_drawdown_pct / 100, 0)', 'drawdown_grown', 4)} FROM sims JOIN own USING (run_id)"""
ORACLES["mc_start_offset"] = f"WITH {offset(DAILY, 5)} SELECT symbol, sim_id, count(*) AS n, min(ts) AS first_ts FROM later GROUP BY symbol, sim_id"
# Periods of 10 and 30 as the four simulations perturb them, worked out by hand from the hashes.
PERTURBED = [(8, 28), (11, 25), (9, 30), (9, 38)]


def anew(method: str) -> str:
    """Tables to mx over the simulations of a method that are executed anew, symbols being <symbol>#<simulation>."""
    tables, rows = {"data_noise": (noisy(HOURLY, 4), "noisy"), "comprehensive": (noisy(HOURLY, 4), "noisy"), "start_offset": (offset(HOURLY, 4), "later"), "param_perturb": (f"{HOURLY}, every AS (SELECT *, i::INT AS sim_id FROM bars, range(4) g(i))", "every")}[method]
    pairs = PERTURBED if method in ("comprehensive", "param_perturb") else [(10, 30)] * 4
    mean = lambda side: "CASE sim_id " + " ".join(f"WHEN {i} THEN {roll('avg', 'close', p[side])}" for i, p in enumerate(pairs)) + " END"
    steps = [{"f": mean(0), "g": mean(1)}, CROSS[1], *PLAIN_RULES]
    body = staged(steps, f"{tables}, named AS (SELECT ts, open, high, low, close, sim_id, symbol || '#' || sim_id AS symbol FROM {rows})", "named")[:-1]
    return body + f",\nb AS (SELECT symbol AS key, row_number() OVER ({S}) AS rn, {B_COLUMNS} FROM last)" + execution() + ", curve AS (SELECT key AS symbol, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "symbol")


RUN = "split_part(symbol, '#', 1) AS run_id, split_part(symbol, '#', 2)::INT AS sim_id"
for _m in ("param_perturb", "data_noise", "start_offset", "comprehensive"):
    ORACLES[f"mc_anew_{_m}"] = anew(_m) + f"SELECT {RUN}, {', '.join(r(c, digits=4) for c in ('net_profit', 'total_return_pct', 'sharpe_ratio', 'max_drawdown_pct'))} FROM mx"
ORACLES["mc_all_methods"] = overall(
    " UNION ALL ".join([f"SELECT * FROM (WITH {trade_methods(HOURLY, 4)} {mc_summary('mx')})"] + [f"SELECT * FROM ({anew(_m)}, named_mx AS (SELECT *, {RUN}, '{_m}' AS method FROM mx) {mc_summary('named_mx')})" for _m in ("param_perturb", "data_noise", "start_offset", "comprehensive")])
)


# -- search

PAIRS = [(5, 20), (5, 40), (10, 20), (10, 40), (20, 40)]


def runs(pairs: list[tuple[int, int]]) -> str:
    """Tables up to ``runs``: a row for each bar and pair."""
    periods = sorted({p for pair in pairs for p in pair})
    head = staged([{f"sma{p}": roll("avg", "close", p) for p in periods}, *PLAIN_RULES], HOURLY)[:-1]
    parts = " UNION ALL ".join(f"SELECT {i}::INT AS combo_idx, {f}::INT AS fast, {s}::INT AS slow, symbol, {B_COLUMNS.replace('signal', f'CASE WHEN coalesce(sma{f} > sma{s}, false) THEN 1 ELSE -1 END AS signal')} FROM last" for i, (f, s) in enumerate(pairs))
    return f"{head},\nruns AS ({parts})"


_GRID = runs(PAIRS) + ", b AS (SELECT combo_idx || '|' || symbol AS key, row_number() OVER (PARTITION BY combo_idx, symbol ORDER BY ts) AS rn, * EXCLUDE (symbol, combo_idx, fast, slow) FROM runs)" + execution() + ", curve AS (SELECT key, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "key") + ", named AS (SELECT DISTINCT combo_idx || '|' || symbol AS key, combo_idx, fast, slow, symbol FROM runs), ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe_ratio, 10) DESC, combo_idx)::INT AS rank FROM mx JOIN named USING (key))"
ORACLES["grid_search"] = _GRID + f" SELECT symbol, combo_idx, fast, slow, rank, {r('total_return_pct', digits=4)}, {r('sharpe_ratio', digits=4)}, {r('max_drawdown_pct', digits=4)} FROM ranked"
ORACLES["grid_best"] = _GRID + f" SELECT symbol, fast, slow, {r('total_return_pct', digits=4)}, {r('sharpe_ratio', digits=4)} FROM ranked WHERE rank = 1"
ORACLES["gp_nsga2_ranks"] = _GRID + ", fl AS (SELECT key, key AS symbol, trades AS trade_seq, side AS signal, fshares AS shares, price, commission, slip AS slippage FROM st WHERE side IS NOT NULL)" + fifo_tables("fl", "key") + ", won AS (SELECT key, coalesce(wr, 0.0) AS win_rate FROM mx LEFT JOIN (SELECT key, avg((pnl > 0)::INT) AS wr FROM tp GROUP BY key) USING (key))" + f""", g AS (SELECT symbol, combo_idx, round(sharpe_ratio - 0.001::DOUBLE * (fast + slow), 6) AS sharpe, round(-max_drawdown_pct / 100 - 0.001::DOUBLE * (fast + slow), 6) AS drawdown, round(win_rate - 0.001::DOUBLE * (fast + slow), 6) AS win FROM ranked JOIN won USING (key)),
beats AS (SELECT y.symbol, y.combo_idx AS beaten, x.combo_idx AS by FROM g x JOIN g y ON x.symbol = y.symbol AND x.sharpe >= y.sharpe AND x.drawdown >= y.drawdown AND x.win >= y.win AND (x.sharpe > y.sharpe OR x.drawdown > y.drawdown OR x.win > y.win)),
chain AS (SELECT symbol, combo_idx, 1 AS front FROM g UNION SELECT b.symbol, b.beaten, c.front + 1 FROM chain c JOIN beats b ON b.symbol = c.symbol AND b.by = c.combo_idx),
f AS (SELECT g.*, front FROM g JOIN (SELECT symbol, combo_idx, max(front)::BIGINT AS front FROM chain GROUP BY ALL) USING (symbol, combo_idx)),
parts AS (SELECT symbol, combo_idx, front, v, lead(v) OVER o - lag(v) OVER o AS gap, max(v) OVER p AS hi, min(v) OVER p AS lo FROM (UNPIVOT f ON sharpe, drawdown, win INTO NAME objective VALUE v) WINDOW p AS (PARTITION BY symbol, front, objective), o AS (PARTITION BY symbol, front, objective ORDER BY v, combo_idx)),
crowd AS (SELECT symbol, combo_idx, CASE WHEN bool_or(v = hi OR v = lo) THEN NULL ELSE sum(gap / (hi - lo)) END AS crowding FROM parts GROUP BY ALL)
SELECT symbol, combo_idx, {r('sharpe', digits=4)}, {r('drawdown', digits=4)}, {r('win', digits=4)}, front, {r('crowding', digits=4)} FROM f JOIN crowd USING (symbol, combo_idx)"""
_UP, _DOWN, _MOM = "f10 > s30", "mom10 < {}", "mom10 < -0.4"
_CLAUSES = [(_UP + x, _MOM) for x in (" OR rsi < 30", " OR cci < -100", " OR mom14 > 0")] + [(_UP, _MOM + x) for x in (" OR rsi > 70", " OR cci > 100", " OR mom14 < 0")] + [(f"({_UP}) AND {x}", _MOM) for x in ("rsi < 30", "cci < -100", "mom14 > 0")]
_LEVELS = [(_UP, _DOWN.format(f"-0.4::DOUBLE * {x}::DOUBLE")) for x in (0.8, 1.2, 1.5)]
_SHIFTED = [(f"f{n} > s30", _MOM) for n in (5, 8, 12, 15)] + [(f"f10 > s{n}", _MOM) for n in (25, 28, 32, 35)] + [(_UP, f"mom{n} < -0.4") for n in (5, 8, 12, 15)]
_TRIALS = [(_UP, _MOM), *_CLAUSES, *_LEVELS, *_SHIFTED]
_SIGNALS = ", ".join(f"CASE WHEN coalesce({a}, false) THEN 1 WHEN coalesce({b}, false) THEN -1 ELSE 0 END" for a, b in _TRIALS)
ORACLES["improver_candidates"] = staged([
    *GAIN_LOSS, MEANS | {f"{x}{n}": roll("avg", "close", n) for x, ns in (("f", (5, 8, 10, 12, 15)), ("s", (25, 28, 30, 32, 35))) for n in ns} | {f"mom{n}": f"close - {lag('close', n)}" for n in (5, 8, 10, 12, 14, 15)} | {"tp": TP},
    {"rsi": RSI, "mean": roll("avg", "tp", N), "near": f"list(tp) OVER {w(N)}"}, {"mad": f"list_sum(list_transform(near, lambda x: abs(x - mean))) / {N}"}, {"cci": f"CASE WHEN mean IS NOT NULL THEN {div('tp - mean', '0.015 * mad')} END"}, *PLAIN_RULES,
], HOURLY)[:-1] + f""", trials AS (SELECT * EXCLUDE (near), unnest([{_SIGNALS}]) AS signal, unnest(range({len(_TRIALS)}))::INT AS run_id FROM last),
b AS (SELECT run_id || '|' || symbol AS key, row_number() OVER (PARTITION BY run_id, symbol ORDER BY ts) AS rn, {B_COLUMNS} FROM trials)""" + execution() + ", curve AS (SELECT key, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "key") + f"""
SELECT split_part(key, '|', 1)::INT AS run_id, split_part(key, '|', 2) AS symbol, {', '.join(r(c, digits=4) for c in ('net_profit', 'total_return_pct', 'sharpe_ratio', 'max_drawdown_pct'))} FROM mx"""  # fmt: skip
_LEVELS_GRID = [(n, lo, hi) for n in (7, 14) for lo in (35, 45) for hi in (55, 65)]
ORACLES["grid_search_levels"] = staged([
    *GAIN_LOSS, {f"{x}{n}": roll("avg", y, n) for n in (7, 14) for x, y in (("gain", "up"), ("loss", "down"))}, {f"rsi{n}": RSI.replace("loss", f"loss{n}").replace("gain", f"gain{n}") for n in (7, 14)}, *PLAIN_RULES,
], HOURLY)[:-1] + f""", trials AS (SELECT *, unnest([{', '.join(f'CASE WHEN coalesce(rsi{n} < {lo}, false) THEN 1 WHEN coalesce(rsi{n} > {hi}, false) THEN -1 ELSE 0 END' for n, lo, hi in _LEVELS_GRID)}]) AS signal, unnest(range({len(_LEVELS_GRID)}))::INT AS combo_idx FROM last),
b AS (SELECT combo_idx || '|' || symbol AS key, row_number() OVER (PARTITION BY combo_idx, symbol ORDER BY ts) AS rn, {B_COLUMNS} FROM trials)""" + execution() + ", curve AS (SELECT key, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "key") + f""",
n AS (SELECT split_part(key, '|', 1)::INT AS combo_idx, split_part(key, '|', 2) AS symbol, * FROM mx)
SELECT symbol, combo_idx, {r('CASE WHEN combo_idx < 4 THEN 7 ELSE 14 END', 'period', 4)}, {r('CASE WHEN combo_idx % 4 < 2 THEN 35 ELSE 45 END', 'low_value', 4)}, {r('CASE WHEN combo_idx % 2 = 0 THEN 55 ELSE 65 END', 'high_value', 4)}, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe_ratio, 10) DESC, combo_idx)::INT AS rank, {r('total_return_pct', digits=4)}, {r('sharpe_ratio', digits=4)} FROM n"""  # fmt: skip
ORACLES["pareto_front"] = _GRID + f""", g AS (SELECT symbol, combo_idx, round(total_return_pct, 6) AS a, round(max_drawdown_pct, 6) AS d FROM ranked)
SELECT symbol, combo_idx, {r('a', 'total_return_pct', 4)}, {r('d', 'max_drawdown_pct', 4)} FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.symbol = g.symbol AND o.a >= g.a AND o.d >= g.d AND (o.a > g.a OR o.d > g.d))"""
_RATED = _GRID + ", rated AS (SELECT *, sharpe_ratio - 0.001::DOUBLE * (fast + slow) AS fitness, combo_idx % 2 AS generation FROM ranked)"
ORACLES["gp_fitness"] = _RATED + f" SELECT symbol, combo_idx, {r('fitness', digits=4)} FROM rated"
ORACLES["gp_generation_stats"] = _RATED + f" SELECT generation, count(*) AS n, {r('avg(fitness)', 'avg', 4)}, {r('stddev_pop(fitness)', 'std', 4)}, {r('min(fitness)', 'min', 4)}, {r('max(fitness)', 'max', 4)} FROM rated GROUP BY generation"
ORACLES["hall_of_fame"] = _RATED + f", best AS (SELECT printf('SMA%d>SMA%d', fast, slow) AS expression, max(round(fitness, 6)) AS fitness FROM rated GROUP BY fast, slow) SELECT expression, {r('fitness', digits=4)} FROM best ORDER BY best.fitness DESC, expression LIMIT 3"
ORACLES["wfo_windows"] = f"WITH {HOURLY}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) SELECT symbol, i::INT AS window_idx, i * 100 AS is_start, i * 100 + 200 AS oos_start, i * 100 + 300 AS oos_end FROM n, range(1000) g(i) WHERE i * 100 + 300 <= n"


def windows(pairs: list[tuple[int, int]], sizes: list[tuple[int, int, int]]) -> str:
    """Tables up to ``wf``: the chosen pair of each size, symbol and window."""
    parts = " UNION ALL ".join(f"SELECT {c}::INT AS config_id, {a}::INT AS in_sample, {o}::INT AS out_sample, {s}::INT AS step, i::INT AS window_idx, CASE WHEN k - i * {s} < {a} THEN 'is' ELSE 'oos' END AS part, placed.* FROM placed, range(1000) g(i) WHERE i * {s} <= k AND k < i * {s} + {a + o} AND i * {s} + {a + o} <= n" for c, (a, o, s) in enumerate(sizes))
    key = "concat_ws('|', config_id, symbol, window_idx, part, combo_idx)"
    return runs(pairs) + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, combo_idx ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol, combo_idx) AS n FROM runs),
parts AS ({parts}), b AS (SELECT {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS rn, ts, open, close, signal, can_buy, can_sell, factor FROM parts)""" + execution() + ", curve AS (SELECT key, rn - 1 AS bar_seq, equity FROM st WHERE rn > 0)" + metric_tables("curve", "key") + f""",
named AS (SELECT DISTINCT {key} AS key, config_id, in_sample, out_sample, step, symbol, window_idx, part, combo_idx, fast, slow FROM parts),
wide AS (SELECT config_id, in_sample, out_sample, step, symbol, window_idx, combo_idx, fast, slow, max(total_return_pct) FILTER (part = 'is') AS is_return, max(total_return_pct) FILTER (part = 'oos') AS oos_return FROM mx JOIN named USING (key) GROUP BY ALL),
chosen AS (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY config_id, symbol, window_idx ORDER BY round(is_return, 10) DESC, combo_idx) = 1),
wf AS (SELECT *, CASE WHEN is_return <= 0 OR oos_return <= 0 THEN 0.0 ELSE least(oos_return / is_return, 1.0) END AS wfer FROM chosen)"""


SUMMARY = "count(*) AS n_windows, avg(wfer) AS avg_wfer, coalesce(stddev_samp(wfer), 0.0) AS std_wfer, max(wfer) AS best_wfer, avg((wfer > 0.8)::INT) AS good_share"
SUMMED = "SELECT *, avg_wfer > 0.5 AND good_share >= 0.5 AS pass_status, avg_wfer - 0.5 * std_wfer + 0.2 * (avg_wfer > 0.5 AND good_share >= 0.5)::INT AS score FROM"
SUMMARY_OUT = f"n_windows, {', '.join(r(c, digits=4) for c in ('avg_wfer', 'std_wfer', 'best_wfer', 'good_share'))}, pass_status, {r('score', digits=4)}"
ORACLES["walk_forward"] = windows(PAIRS, [(60, 40, 40)]) + f" SELECT symbol, window_idx, combo_idx, fast, slow, {r('is_return', digits=4)}, {r('oos_return', digits=4)}, {r('wfer', digits=4)} FROM wf"
ORACLES["wfo_summary"] = windows(PAIRS, [(60, 40, 40)]) + f", one AS (SELECT symbol, {SUMMARY} FROM wf GROUP BY symbol), summed AS ({SUMMED} one) SELECT symbol, {SUMMARY_OUT} FROM summed"
ORACLES["wfo_matrix"] = windows(PAIRS[:3], [(60, 40, 40), (80, 40, 40)]) + f", one AS (SELECT symbol, config_id, in_sample, out_sample, step, {SUMMARY} FROM wf GROUP BY ALL), summed AS ({SUMMED} one) SELECT symbol, config_id, in_sample, out_sample, step, {SUMMARY_OUT}, row_number() OVER (PARTITION BY symbol ORDER BY round(score, 10) DESC, config_id)::INT AS rank FROM summed"

# -- overfitting

RETS = """WITH p AS (SELECT user_id % 8 AS strategy_id, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL),
q AS (SELECT strategy_id, row_number() OVER s AS period_idx, round((v - lag(v) OVER s) / nullif(v + lag(v) OVER s, 0), 8) AS ret FROM p WINDOW s AS (PARTITION BY strategy_id ORDER BY h)), rets AS (SELECT * FROM q WHERE ret IS NOT NULL)"""
PBO = """, sized AS (SELECT *, count(*) OVER (PARTITION BY strategy_id) AS n, row_number() OVER (PARTITION BY strategy_id ORDER BY period_idx) - 1 AS k FROM rets),
grp AS (SELECT strategy_id, least(floor(k / nullif(floor(n / 8), 0)), 7)::INT AS g, sum(ret) AS ret FROM sized GROUP BY ALL),
masks AS (SELECT i FROM range(256) x(i) WHERE bit_count(i) = 4),
sides AS (SELECT i, strategy_id, round(sum(CASE WHEN (i >> g) & 1 = 1 THEN ret ELSE 0.0 END), 10) AS a, round(sum(CASE WHEN (i >> g) & 1 = 1 THEN 0.0 ELSE ret END), 10) AS o FROM grp, masks GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY o DESC) + (count(*) OVER (PARTITION BY i, o) - 1) / 2 AS rk, row_number() OVER (PARTITION BY i ORDER BY a DESC, strategy_id) AS best, count(*) OVER (PARTITION BY i) AS m FROM sides),
pb AS (SELECT count(*) AS n_splits, avg((rk > (m + 1) / 2)::INT) AS pbo FROM ranked WHERE best = 1)"""
MOMENTS = """, mo AS (SELECT count(ret)::DOUBLE AS t, count(DISTINCT strategy_id)::DOUBLE AS n, stddev_samp(ret) AS sd, skewness(ret) * (count(ret) - 2) / sqrt(count(ret)::DOUBLE * (count(ret) - 1)) AS skew, kurtosis_pop(ret) AS kurt FROM rets)"""


def cdf(z: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = f"{t} * (0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    tail = f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002::DOUBLE * {poly})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def chance(sharpe: float, benchmark: str) -> str:
    inside = f"((1 - skew * {sharpe} + (kurt + 3) / 4 * {sharpe} * {sharpe}) / (t - 1))"
    return f"CASE WHEN {sharpe} <= {benchmark} THEN 0.0 WHEN sd = 0 OR {inside} <= 0 THEN 1.0 ELSE {cdf(f'(({sharpe} - {benchmark}) / sqrt({inside}))')} END"


RAISED = "(sqrt(2 * ln(n)) / sqrt(t - 1))"
LOGIT = "CASE WHEN pbo > 0 AND pbo < 1 THEN ln(pbo / (1 - pbo)) ELSE 0.0 END"
ORACLES["pbo"] = RETS + PBO + f" SELECT n_splits, {r('pbo')}, {r(LOGIT, 'logit_pbo')} FROM pb"
ORACLES["psr"] = RETS + MOMENTS + f" SELECT 0.02::DOUBLE AS sharpe, {r('skew', digits=4)}, {r('kurt', digits=4)}, {r(chance(0.02, '0.0'), 'psr', 4)} FROM mo"
ORACLES["dsr"] = RETS + MOMENTS + f" SELECT 0.05::DOUBLE AS sharpe, {r(RAISED, 'benchmark', 4)}, {r(chance(0.05, RAISED), 'dsr', 4)} FROM mo"
ORACLES["overfitting_report"] = RETS + PBO + MOMENTS + f", x AS (SELECT pbo, {LOGIT} AS logit_pbo, {chance(0.05, '0.0')} AS psr, {chance(0.05, RAISED)} AS dsr FROM pb, mo) SELECT {r('pbo', digits=4)}, {r('logit_pbo', digits=4)}, {r('psr', digits=4)}, {r('dsr', digits=4)}, pbo > 0.5 OR dsr < 0.05 OR psr < 0.95 AS is_overfitted, {r('(1 - pbo + dsr + psr) / 3', 'confidence', 4)} FROM x"

# -- reports, portfolios, fuzzy rules

CHANGES = f"WITH {DAILY}, x AS (SELECT symbol, ts, close / nullif(lag(close) OVER ({S}), 0) - 1 AS ret FROM bars), rets AS (SELECT * FROM x WHERE ret IS NOT NULL)"
ORACLES["corr_matrix"] = CHANGES + f" SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, {r('corr(a.ret, b.ret)', 'corr')}, {r('covar_samp(a.ret, b.ret)', 'covar')}, count(*) AS n FROM rets a JOIN rets b USING (ts) WHERE a.symbol <= b.symbol GROUP BY ALL"
ORACLES["risk_parity"] = CHANGES + f", v AS (SELECT symbol, stddev_samp(ret) AS vol FROM rets GROUP BY symbol) SELECT symbol, {r('vol')}, {r('1 / vol / sum(1 / vol) OVER ()', 'weight')} FROM v"
ORACLES["calmar_weights"] = CHANGES + f""", d AS (SELECT symbol, i::INT AS trial FROM (SELECT DISTINCT symbol FROM rets), range(41) g(i)),
k AS (SELECT *, CASE WHEN trial = 0 THEN 1.0 ELSE -ln(1e-12 + {u("'weight'", "trial", "symbol")}) END AS raw FROM d), wt AS (SELECT symbol, trial, raw / sum(raw) OVER (PARTITION BY trial) AS weight FROM k),
m AS (SELECT trial, ts, sum(ret * weight) AS ret FROM rets JOIN wt USING (symbol) GROUP BY ALL), e AS (SELECT *, sum(ln(1 + ret)) OVER o AS growth FROM m WINDOW o AS (PARTITION BY trial ORDER BY ts ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, 1 - exp(growth - greatest(max(growth) OVER (PARTITION BY trial ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0)) AS fall FROM e), c AS (SELECT trial, arg_max(growth, ts) AS g, max(fall) AS fall FROM f GROUP BY trial),
l AS (SELECT trial, g, fall, CASE WHEN g > 0 AND fall > 0 THEN g + ln(1 - exp(-g)) - ln(fall) END AS log_calmar FROM c),
best AS (SELECT * FROM l ORDER BY round(log_calmar, 9) DESC NULLS LAST, CASE WHEN g <= 0 THEN round((exp(g) - 1) / nullif(fall, 0), 9) END DESC NULLS LAST, trial LIMIT 1) SELECT trial, symbol, {r('weight')}, {r('log_calmar')} FROM wt JOIN best USING (trial)"""
ORACLES["portfolio_curve"] = CHANGES + f", m AS (SELECT ts, sum(ret * 0.2::DOUBLE) AS ret FROM rets GROUP BY ts) SELECT ts, {r('ret', digits=4)}, {r('sum(ln(1 + ret)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'log_equity', 4)} FROM m"
ORACLES["corrected_p_values"] = """WITH t AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101) / 5000.0::DOUBLE AS p_value FROM supplier), k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, id) AS rk FROM t),
h AS (SELECT *, p_value * m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)) / rk AS raw FROM k)
SELECT id, round((p_value)::DECIMAL(38, 9), 6)::DOUBLE AS p_value, round((least(1.0, p_value * m))::DECIMAL(38, 9), 6)::DOUBLE AS bonferroni, round((least(1.0, min(raw) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))::DECIMAL(38, 9), 6)::DOUBLE AS bhy FROM h"""
_HORIZONS = " UNION ALL ".join(f"SELECT symbol, {i}::INT AS combo_idx, close / lag(close, {n}) OVER ({S}) - 1 AS change FROM bars" for i, n in enumerate((1, 2, 3, 5, 8, 13, 21)))
CURVE_GRID = f"WITH {DAILY}, c AS ({_HORIZONS}), grid AS (SELECT symbol, combo_idx, round(avg(change) - 0.3, 8) AS ret FROM c GROUP BY ALL)"
ORACLES["spp_summary"] = CURVE_GRID + f" SELECT symbol, count(*) AS n, {r('quantile_cont(ret, 0.5)', 'median')}, {r('quantile_cont(ret, 0.25)', 'q25')}, {r('quantile_cont(ret, 0.75)', 'q75')}, {r('avg((ret > 0)::INT)', 'positive_share')}, {r('max(ret)', 'best')}, {r('max(ret) - quantile_cont(ret, 0.5)', 'best_to_median')} FROM grid GROUP BY symbol"
ORACLES["opt_profile"] = CURVE_GRID + f", t AS (SELECT *, (sign(ret) <> lag(sign(ret)) OVER (PARTITION BY symbol ORDER BY combo_idx))::INT AS turn FROM grid) SELECT symbol, count(*) AS n, {r('avg(ret)', 'mean')}, {r('coalesce(stddev_samp(ret), 0.0)', 'std')}, {r('avg((ret > 0)::INT)', 'positive_share')}, {r('coalesce(avg(turn), 0.0)', 'turn_share')} FROM t GROUP BY symbol"
MEMBERS = {
    "trend_strength": {"weak": (0, 0, 15, 25), "medium": (18, 30, 30, 42), "strong": (35, 45, 60, 60)}, "volume_pressure": {"low": (0, 0, 0.7, 1.0), "normal": (0.8, 1.1, 1.1, 1.6), "high": (1.4, 2.0, 4.0, 4.0)},
    "risk_heat": {"calm": (0, 0, 0.018, 0.035), "normal": (0.025, 0.05, 0.05, 0.075), "hot": (0.065, 0.09, 0.12, 0.12)}, "reversal_pressure": {"oversold": (0, 0, 25, 35), "neutral": (30, 50, 50, 70), "overbought": (65, 75, 100, 100)},
}


def degree(x: str, points: tuple[float, ...]) -> str:
    a, b, c, d = points
    rise = f"WHEN {x} < {b} THEN ({x} - {a}) / ({b} - {a})::DOUBLE " if b > a else ""
    fall = f"({d} - {x}) / ({d} - {c})::DOUBLE" if d > c else "1.0"
    return f"CASE WHEN {x} IS NULL OR {x} <= {a} OR {x} >= {d} THEN 0.0 {rise}WHEN {x} <= {c} THEN 1.0 ELSE {fall} END"


FUZZY = [*DIRECTION, {"dx": DX}, {"trend_strength": roll("avg", "dx", N), "volume_pressure": div("volume", roll("avg", "volume", 20)), "risk_heat": div(roll("avg", "tr", N), "close")}, *GAIN_LOSS, MEANS, {"reversal_pressure": RSI}, {f"{v}_{m}": degree(v, p) for v, ms in MEMBERS.items() for m, p in ms.items()}]
put("fuzzy_degrees", FUZZY, [f"{v}_{m}" for v, ms in MEMBERS.items() for m in ms], digits=4)
_RULES = {
    "fuzzy_signal": (("trend_strength_strong * 0.40 + volume_pressure_high * 0.25 + risk_heat_calm * 0.20 + reversal_pressure_neutral * 0.15", 1), ("reversal_pressure_oversold * 0.45 + risk_heat_calm * 0.35 + volume_pressure_normal * 0.20", 1), ("reversal_pressure_overbought * 0.45 + risk_heat_hot * 0.35 + trend_strength_weak * 0.20", -1)),
    "fuzzy_momentum": (("trend_strength_strong * 0.45 + volume_pressure_high * 0.30 + risk_heat_calm * 0.25", 1), ("trend_strength_weak * 0.55 + risk_heat_hot * 0.45", -1)),
    "fuzzy_reversal": (("reversal_pressure_oversold * 0.45 + volume_pressure_normal * 0.25 + risk_heat_calm * 0.30", 1), ("reversal_pressure_overbought * 0.60 + risk_heat_hot * 0.40", -1)),
}
for _name, _rules in _RULES.items():
    _fired = " ".join(f"WHEN fuzzy_score_{i} >= {'0.35' if side > 0 else '0.3'} THEN {side}" for i, (_, side) in enumerate(_rules))
    put(_name, [*FUZZY, {f"fuzzy_score_{i}": x for i, (x, _) in enumerate(_rules)}, {"signal": f"CASE {_fired} ELSE 0 END"}], [f"fuzzy_score_{i}" for i in range(len(_rules))], plain=("signal",), digits=4)
ORACLES["fuzzy_graph"] = f"SELECT symbol, ts, signal FROM ({ORACLES['fuzzy_signal']})"
ORACLES["results_scores"] = """
WITH f AS (SELECT c_custkey AS run_id, (-(c_custkey % 31))::DOUBLE AS mdd, (c_custkey % 53 - 20)::DOUBLE AS tot, (c_custkey % 41) / 10.0::DOUBLE - 1 AS sharpe, (c_custkey % 7) / 10.0::DOUBLE AS wr, (c_custkey % 23) / 10.0::DOUBLE AS pf, (c_custkey % 90)::DOUBLE AS n, (c_custkey % 19) / 10.0::DOUBLE AS calmar, (c_custkey % 60)::INT AS flat FROM customer),
i AS (SELECT *, abs(mdd) AS dd, abs(mdd) >= 20 AS i1, abs(mdd) >= 12 AND abs(mdd) < 20 AS i2, sharpe < 0.8 AS i3, sharpe >= 1.5 AS i4, pf <> 0 AND pf < 1.2 AS i5, wr < 0.42 AND n >= 20 AS i6, n < 20 AS i7, flat >= 30 AS i8 FROM f),
k AS (SELECT *, i1::INT + i3::INT + i7::INT AS hi, i2::INT + i5::INT + i6::INT + i8::INT AS me, i1::INT + i2::INT + i3::INT + i4::INT + i5::INT + i6::INT + i7::INT + i8::INT AS cnt FROM i),
s AS (SELECT *, greatest(0.0, least(100.0, 50 + greatest(-25.0, least(25.0, sharpe * 12)) + greatest(-15.0, least(15.0, (pf - 1) * 20)) + least(10.0, calmar * 5) - 12 * hi - 6 * me)) AS q, greatest(0.0, least(100.0, least(70.0, dd * 2.4) + greatest(0.0, 15 - sharpe * 6) + CASE WHEN n < 20 THEN 10.0 ELSE 0.0 END + 8 * hi + 4 * me)) AS rk FROM k)
SELECT run_id, CASE WHEN sharpe >= 1.5 AND dd < 12 AND tot > 0 THEN 'steady' WHEN sharpe >= 0.8 AND dd < 20 THEN 'promising' WHEN tot > 0 AND dd >= 20 THEN 'profitable but rough' ELSE 'unconvincing' END AS regime,
  round((q)::DECIMAL(38, 9), 6)::DOUBLE AS quality_score, round((rk)::DECIMAL(38, 9), 6)::DOUBLE AS risk_score, round((greatest(0.0, least(100.0, 100 - q + rk * 0.25)))::DECIMAL(38, 9), 6)::DOUBLE AS opportunity_score, greatest(cnt, 1)::INT AS n_insights, least(6, greatest(cnt, 1) + (dd >= 12)::INT + (sharpe < 1)::INT + 1)::INT AS n_actions,
  CASE WHEN i1 THEN 'losses from the peak exceed a fifth: lower exposure before anything else' WHEN i2 THEN 'simulate reordered trades to see how deep a fall could have been' WHEN i3 THEN 'return does not pay for its swings: compare entries that gain with those that do not' WHEN i4 THEN 'return pays for its swings: see whether that holds out of sample' WHEN i5 THEN 'gains barely exceed losses: find what the largest losses share' WHEN i6 THEN 'most trades lose: ask more of a signal before it trades' WHEN i7 THEN 'under twenty trades prove little: add years or symbols' WHEN i8 THEN 'no new high for thirty bars: compare figures by regime' ELSE 'no figure stands out: try larger sizes and higher costs' END AS first_action
FROM s"""
