"""Parameter grids, walk-forward windows and their evaluation: all combinations are runs of one job."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import roll
from quantloom.operators import parzen
from quantloom.operators.backtest import BacktestConfig, evaluate
from quantloom.operators.generate import evaluate_all
from quantloom.operators.rules import RuleChain
from quantloom.plans.ir import StrategyIR

Space = dict[str, tuple]


def grid_values(space: Space) -> dict[str, list]:
    """("int", lo, hi) gives up to five whole numbers, ("float", lo, hi) five numbers, ("categorical", values) all."""
    out = {}
    for name, (kind, *ends) in space.items():
        if kind == "categorical":
            out[name] = list(ends[0])
        else:
            lo, hi = ends
            k = min(5, hi - lo + 1) if kind == "int" else 5
            points = [lo + (hi - lo) * i / max(1, k - 1) for i in range(k)]
            out[name] = [int(p) for p in points] if kind == "int" else points
    return out


def grid(spark: SparkSession, values: dict[str, list], most: int | None = None) -> DataFrame:
    """The table of combinations with their number; ``most`` keeps so many of them by a hash, which is a sample on purpose."""
    rows = [(i, *map(float, c)) for i, c in enumerate(product(*values.values()))]
    table = spark.createDataFrame(rows, "combo_idx int, " + ", ".join(f"`{n}` double" for n in values))
    return table if most is None or len(rows) <= most else table.orderBy(F.md5(F.col("combo_idx").cast("string").cast("binary"))).limit(most)


def _points(whole: bool, lo: Column, hi: Column) -> Column:
    """Up to five numbers from lo to hi, as an array."""
    k = F.least(F.lit(5.0), hi - lo + 1).cast("int") if whole else F.when(lo.isNotNull() & hi.isNotNull(), 5)
    points = F.transform(F.sequence(F.lit(0), k - 1), lambda i: lo + (hi - lo) * i / F.greatest(F.lit(1), k - 1))
    return F.when(k > 0, F.transform(points, lambda x: x.cast("long").cast("double")) if whole else points)


def grid_over(ranges: DataFrame, keys: list[str], space: Space, most: int | None = None) -> DataFrame:
    """As ``grid``, with a grid for each row of ``ranges`` (one row a key), whose columns the space may name as ends: ("float", "lowest", "highest").

    combo_idx counts from 0 in the order of the space, the last name fastest. A row with a null end, or whole numbers
    that end before they begin, has no combinations. ``most`` keeps so many of each row's by a hash, a sample on purpose.
    """
    dims = []
    for kind, *ends in space.values():
        if kind == "categorical":
            dims.append(F.array(*(F.lit(float(v)) for v in ends[0])))
        else:
            dims.append(_points(kind == "int", *(F.col(e).cast("double") if isinstance(e, str) else F.lit(float(e)) for e in ends)))
    out = ranges.select(*keys, *(x.alias(f"_dim{i}") for i, x in enumerate(dims)), F.lit(0).alias("combo_idx"))
    for i, name in enumerate(space):
        out = out.select("*", F.posexplode(f"_dim{i}").alias("_at", name)).withColumn("combo_idx", F.col("combo_idx") * F.size(f"_dim{i}") + F.col("_at")).drop("_at", f"_dim{i}")
    if most is None:
        return out
    w = Window.partitionBy(*keys).orderBy(F.md5(F.col("combo_idx").cast("string").cast("binary")))
    return out.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def detect_space(params: dict[str, float]) -> Space:
    """From half to twice and one more of every number."""
    return {k: ("int", max(1, v // 2), 2 * v + 1) if isinstance(v, int) else ("float", v * 0.5, v * 2 + 1) for k, v in params.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def cross_signals(bars: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Bars with rule flags and ``signals``, an entry for each moving-average pair; each distinct average is computed once."""
    checked = RuleChain().apply(bars)
    periods = sorted({p for pair in pairs for p in pair})
    averaged = checked.withColumns({f"_sma{p}": roll(F.avg, F.col("close"), p) for p in periods})
    signals = F.array(*(F.when(F.coalesce(F.col(f"_sma{f}") > F.col(f"_sma{s}"), F.lit(False)), 1).otherwise(-1) for f, s in pairs))
    return averaged.withColumn("signals", signals).drop(*(f"_sma{p}" for p in periods))


def cross_runs(bars: DataFrame, runs: DataFrame, periods: range) -> DataFrame:
    """Bars with rule flags and ``signals``, an entry for each row of ``runs`` (sample_id from 0, fast, slow: whole numbers in ``periods``).

    Runs are data: every average is computed once, and the plan is the same for any number of them.
    """
    checked = RuleChain().apply(bars)
    means = F.array(*(roll(F.avg, F.col("close"), p) for p in periods))
    listed = runs.agg(F.array_sort(F.collect_list(F.struct("sample_id", F.col("fast").cast("int").alias("fast"), F.col("slow").cast("int").alias("slow")))).alias("_runs"))  # one row; each bar gets as many signals
    mean = lambda n: F.get("_means", n - periods.start)
    above = lambda run: F.when(F.coalesce(mean(run["fast"]) > mean(run["slow"]), F.lit(False)), 1).otherwise(-1)
    return checked.withColumn("_means", means).crossJoin(F.broadcast(listed)).withColumn("signals", F.transform("_runs", above)).drop("_means", "_runs")


def permuted(bars: DataFrame, space: Space, n: int, seed: int = 42, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Figures of moving-average strategies with n pairs of periods from a Latin hypercube over the space of ``fast`` and ``slow``."""
    runs = parzen.latin_hypercube(bars.sparkSession, space, n, seed)
    ends = [e for kind, *ends in (space["fast"], space["slow"]) for e in ends]
    return evaluate(cross_runs(bars, runs, range(min(ends), max(ends) + 1)), config)


def _named(figures: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    fast, slow = (F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), F.col("combo_idx") + 1) for i in (0, 1))
    return figures.withColumns({"fast": fast, "slow": slow})


def grid_search(bars: DataFrame, pairs: list[tuple[int, int]], metric: str = "sharpe_ratio", config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Every pair's figures per symbol, with its rank; of equals the first combination wins."""
    best = Window.partitionBy("symbol").orderBy(F.desc(F.round(metric, 10)), "combo_idx")
    return _named(evaluate(cross_signals(bars, pairs), config), pairs).withColumn("rank", F.row_number().over(best))


def strategy_grid(ir: StrategyIR, values: dict[str, list], bars: DataFrame, metric: str = "sharpe_ratio", config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Figures of any strategy for every combination of parameters (named as in ``StrategyIR.with_params``), with the combination and its rank per symbol."""
    combos = [dict(zip(values, c)) for c in product(*values.values())]
    figures = evaluate_all([ir.with_params(c) for c in combos], bars, config).withColumnRenamed("run_id", "combo_idx")
    named = figures.withColumns({n.replace(".", "_"): F.element_at(F.array(*(F.lit(float(c[n])) for c in combos)), F.col("combo_idx") + 1) for n in values})
    best = Window.partitionBy("symbol").orderBy(F.desc(F.round(metric, 10)), "combo_idx")
    return named.withColumn("rank", F.row_number().over(best))


def wfo_windows(bars: DataFrame, in_sample: int, out_sample: int, step: int) -> DataFrame:
    """Windows while they fit, by position: symbol, window_idx, and first and last bar of either part."""
    n = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - in_sample - out_sample) / step).cast("int")
    rows = n.where(F.col("n") >= in_sample + out_sample).select("symbol", F.explode(F.sequence(F.lit(0), last)).alias("window_idx"))
    start = F.col("window_idx") * step
    return rows.select("symbol", "window_idx", start.alias("is_start"), (start + in_sample).alias("oos_start"), (start + in_sample + out_sample).alias("oos_end"))


def walk_forward(bars: DataFrame, pairs: list[tuple[int, int]], in_sample: int, out_sample: int, step: int, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Per symbol and window: the pair that was best in sample, both total returns and their efficiency.

    Bars know their windows by arithmetic on their position (no range join); in-sample and
    out-of-sample parts are groups in which all pairs are executed.
    """
    w = Window.partitionBy("symbol")
    placed = cross_signals(bars, pairs).withColumns({"_at": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count("*").over(w)})
    size = in_sample + out_sample
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / step)).cast("int")
    final = F.least(F.floor(F.col("_at") / step), F.floor((F.col("_n") - size) / step)).cast("int")
    windowed = placed.where((F.col("_n") >= size) & (first <= final)).withColumn("window_idx", F.explode(F.sequence(first, final)))
    parts = windowed.withColumn("part", F.when(F.col("_at") - F.col("window_idx") * step < in_sample, "is").otherwise("oos")).drop("_at", "_n")
    figures = _named(evaluate(parts, config, ("symbol", "window_idx", "part"), chunk=len(pairs)), pairs)
    wide = figures.groupBy("symbol", "window_idx", "combo_idx", "fast", "slow").agg(F.max(F.when(F.col("part") == "is", F.col("total_return_pct"))).alias("is_return"), F.max(F.when(F.col("part") == "oos", F.col("total_return_pct"))).alias("oos_return"))
    best = Window.partitionBy("symbol", "window_idx").orderBy(F.desc(F.round("is_return", 10)), "combo_idx")
    chosen = wide.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    return chosen.withColumn("wfer", efficiency(F.col("is_return"), F.col("oos_return")))


def efficiency(in_sample, out_sample):
    """Out-of-sample return over in-sample return within 0 and 1; zero unless both are gains."""
    return F.when((in_sample <= 0) | (out_sample <= 0), 0.0).otherwise(F.least(F.try_divide(out_sample, in_sample), F.lit(1.0)))


def wfo_summary(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Average, deviation and best efficiency, whether it passes, and the matrix score."""
    one = windows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg("wfer").alias("avg_wfer"), F.coalesce(F.stddev_samp("wfer"), F.lit(0.0)).alias("std_wfer"), F.max("wfer").alias("best_wfer"), F.avg(F.when(F.col("wfer") > 0.8, 1.0).otherwise(0.0)).alias("good_share"))
    passed = one.withColumn("pass_status", (F.col("avg_wfer") > 0.5) & (F.col("good_share") >= 0.5))
    return passed.withColumn("score", F.col("avg_wfer") - 0.5 * F.col("std_wfer") + 0.2 * F.col("pass_status").cast("double"))


def wfo_matrix(bars: DataFrame, pairs: list[tuple[int, int]], sizes: list[tuple[int, int, int]], config: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Summaries of several window sizes, ranked per symbol by score."""
    out = None
    for i, (a, b, step) in enumerate(sizes):
        one = walk_forward(bars, pairs, a, b, step, config).withColumns({"config_id": F.lit(i), "in_sample": F.lit(a), "out_sample": F.lit(b), "step": F.lit(step)})
        out = one if out is None else out.unionByName(one)
    summed = wfo_summary(out, ["symbol", "config_id", "in_sample", "out_sample", "step"])
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round("score", 10)), "config_id")))
