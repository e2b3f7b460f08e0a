"""A reading of results by rules: insights, regime, scores and actions, for any number of runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Other names of the figures.
ALIASES = {
    "max_drawdown_pct": ("max_drawdown", "drawdown"), "total_return_pct": ("return_pct", "total_return"), "sharpe_ratio": ("sharpe",), "sortino_ratio": ("sortino",),
    "win_rate": (), "profit_factor": (), "total_trades": ("trades",), "expectancy": (), "calmar_ratio": ("calmar",),
}


@dataclass(frozen=True)
class Insight:
    title: str
    severity: str
    when: Column
    action: str


def normalize(figures: DataFrame) -> DataFrame:
    """All figures under their own names; what is missing or null is zero."""
    out = {}
    for name, others in ALIASES.items():
        have = [F.col(c).cast("double") for c in (name, *others) if c in figures.columns]
        out[name] = F.coalesce(*have, F.lit(0.0))
    return figures.withColumns(out)


def insights() -> list[Insight]:
    # The thresholds and severities below; the words are this library's.
    dd, sharpe, factor, trades = F.abs("max_drawdown_pct"), F.col("sharpe_ratio"), F.col("profit_factor"), F.col("total_trades").cast("int")
    rate = F.when(F.col("win_rate") > 1, F.col("win_rate") / 100).otherwise(F.col("win_rate"))
    return [
        Insight("drawdown of 20 % or more", "high", dd >= 20, "losses from the peak exceed a fifth: lower exposure before anything else"),
        Insight("drawdown of 12 % or more", "medium", (dd >= 12) & (dd < 20), "simulate reordered trades to see how deep a fall could have been"),
        Insight("Sharpe ratio under 0.8", "high", sharpe < 0.8, "return does not pay for its swings: compare entries that gain with those that do not"),
        Insight("Sharpe ratio of 1.5 or more", "low", sharpe >= 1.5, "return pays for its swings: see whether that holds out of sample"),
        Insight("profit factor under 1.2", "medium", (factor != 0) & (factor < 1.2), "gains barely exceed losses: find what the largest losses share"),
        Insight("win rate under 42 %", "medium", (rate < 0.42) & (trades >= 20), "most trades lose: ask more of a signal before it trades"),
        Insight("under 20 trades", "high", trades < 20, "under twenty trades prove little: add years or symbols"),
        Insight("30 bars without a new high", "medium", F.col("flat_run") >= 30, "no new high for thirty bars: compare figures by regime"),
    ]


def longest_flat_run(equity: DataFrame, keys: list[str], order: str = "bar_seq") -> DataFrame:
    """Most bars in a row without a new high."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, -1))
    highs = equity.withColumns({"_high": F.coalesce(F.col("equity") > before, F.lit(True)), "_at": F.row_number().over(w)})
    since = F.col("_at") - F.last(F.when(F.col("_high"), F.col("_at")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return highs.withColumn("_since", since).groupBy(*keys).agg(F.max("_since").alias("flat_run"))


def analyze(figures: DataFrame) -> DataFrame:
    """Figures (one row per run, with flat_run if known) and regime, scores, insights, suggested_actions."""
    rows = normalize(figures)
    if "flat_run" not in rows.columns:
        rows = rows.withColumn("flat_run", F.lit(0))
    all_ = insights()
    hits = [F.coalesce(i.when, F.lit(False)) for i in all_]
    number = lambda severity: sum((h.cast("int") for h, i in zip(hits, all_) if i.severity == severity), F.lit(0))
    found = F.filter(F.array(*(F.when(h, F.struct(F.lit(i.title).alias("title"), F.lit(i.severity).alias("severity"), F.lit(i.action).alias("action"))) for h, i in zip(hits, all_))), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("nothing found").alias("title"), F.lit("low").alias("severity"), F.lit("no figure stands out: try larger sizes and higher costs").alias("action")))
    dd, sharpe, total = F.abs("max_drawdown_pct"), F.col("sharpe_ratio"), F.col("total_return_pct")
    regime = F.when((sharpe >= 1.5) & (dd < 12) & (total > 0), "steady").when((sharpe >= 0.8) & (dd < 20), "promising").when((total > 0) & (dd >= 20), "profitable but rough").otherwise("unconvincing")
    # The thresholds of regimes and the weights of scores.
    inside = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    quality = 50 + inside(sharpe * 12, -25.0, 25.0) + inside((F.col("profit_factor") - 1) * 20, -15.0, 15.0) + F.least(F.lit(10.0), F.col("calmar_ratio") * 5) - 12 * F.col("_high") - 6 * F.col("_medium")
    risk = F.least(F.lit(70.0), dd * 2.4) + F.greatest(F.lit(0.0), 15 - sharpe * 6) + F.when(F.col("total_trades") < 20, 10.0).otherwise(0.0) + 8 * F.col("_high") + 4 * F.col("_medium")
    staged = rows.withColumns({"regime": regime, "insights": F.when(F.size(found) > 0, found).otherwise(none), "_high": number("high"), "_medium": number("medium")})
    staged = staged.withColumns({"quality_score": inside(quality, 0.0, 100.0), "risk_score": inside(risk, 0.0, 100.0)})
    more = F.filter(F.array(F.when(dd >= 12, "rank a grid of sizes by return over drawdown"), F.when(sharpe < 1, "compare the strategy with each of its conditions left out"), F.lit("record the figures for the next comparison")), lambda x: x.isNotNull())
    actions = F.slice(F.array_distinct(F.concat(F.transform("insights", lambda x: x["action"]), more)), 1, 6)
    return staged.withColumns({"opportunity_score": inside(100 - F.col("quality_score") + F.col("risk_score") * 0.25, 0.0, 100.0), "suggested_actions": actions}).drop("_high", "_medium")
