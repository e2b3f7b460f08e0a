"""Preparation of bars: price adjustment, flags, gaps, cleaning, returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import lag, ratio, roll, series

PRICES = ("open", "high", "low", "close")
# Daily price limits by market.
LIMITS = {"main": 0.10, "st": 0.05, "kcb": 0.20, "cyb": 0.20, "bse": 0.30}


def join_factors(bars: DataFrame, factors: DataFrame, default: float = 1.0) -> DataFrame:
    """Bars with the factor of their symbol and time; Spark broadcasts the factors if they are small."""
    return bars.join(factors, ["symbol", "ts"], "left").withColumn("factor", F.coalesce("factor", F.lit(default)))


def forward_adjust(bars: DataFrame, factor: str = "factor") -> DataFrame:
    """Prices times the factor over the symbol's last factor."""
    last = F.last(factor).over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumn("_last", last).withColumns({c: F.col(c) * F.col(factor) / F.col("_last") for c in PRICES}).drop("_last")


def backward_adjust(bars: DataFrame, factor: str = "factor") -> DataFrame:
    return bars.withColumns({c: F.col(c) * F.col(factor) for c in PRICES})


def mark_suspension(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Flags bars whose time stands in ``days`` (column ts)."""
    flagged = days.select("ts").distinct().withColumn("_off", F.lit(True))
    return bars.join(flagged, "ts", "left").withColumn("is_suspended", F.coalesce("_off", F.lit(False))).drop("_off")


def limit_of(market: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(market)), F.lit(0.10))


def mark_limits(bars: DataFrame, market: Column | None = None) -> DataFrame:
    """change_pct against the previous close, and whether it reaches the market's limit."""
    limit = limit_of(market if market is not None else F.lit("main"))
    changed = bars.withColumn("change_pct", ratio(F.col("close"), lag(F.col("close"))) - 1)
    reached = F.coalesce(F.col("change_pct") >= limit, F.lit(False)), F.coalesce(F.col("change_pct") <= -limit, F.lit(False))
    return changed.withColumns({"limit_up": reached[0], "limit_down": reached[1]})


def fill_missing(bars: DataFrame, columns: tuple[str, ...], method: str = "ffill", limit: int | None = None) -> DataFrame:
    """Fill nulls from before (ffill), from after (bfill) or in between (linear), at most ``limit`` in a row; other methods change nothing."""
    if method not in ("ffill", "bfill", "linear"):
        return bars
    w = series()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = bars.withColumn("_n", F.row_number().over(w))
    for c in columns:
        x = F.col(c)
        at = F.when(x.isNotNull(), F.col("_n"))
        out = out.withColumns({"_p": F.last(x, True).over(before), "_pn": F.last(at, True).over(before), "_q": F.first(x, True).over(after), "_qn": F.first(at, True).over(after)})
        gap_before, gap_after = F.col("_n") - F.col("_pn"), F.col("_qn") - F.col("_n")
        near = F.lit(True) if limit is None else (gap_after if method == "bfill" else gap_before) <= limit
        if method == "linear":  # behind the last known value it goes on as it is
            value = F.when(F.col("_q").isNull(), F.col("_p")).when(F.col("_p").isNotNull(), F.col("_p") + (F.col("_q") - F.col("_p")) * ratio(gap_before, F.col("_qn") - F.col("_pn")))
        else:
            value = F.col("_q") if method == "bfill" else F.col("_p")
        out = out.withColumn(c, F.when(x.isNotNull(), x).when(near, value)).drop("_p", "_pn", "_q", "_qn")
    return out.drop("_n")


def clean_ohlcv(bars: DataFrame) -> DataFrame:
    """Drops bars without volume, lifts prices to 0.01, and makes high and low hold the others."""
    lifted = bars.where("volume > 0").withColumns({c: F.greatest(F.col(c), F.lit(0.01)) for c in PRICES})
    ranged = lifted.withColumns({"high": F.greatest("high", "open", "low", "close"), "low": F.least("low", "open", "high", "close")})
    return ranged.withColumns({c: F.greatest("low", F.least("high", c)) for c in ("open", "close")})


def add_returns(bars: DataFrame) -> DataFrame:
    before = lag(F.col("close"))
    return bars.withColumns({"returns": ratio(F.col("close"), before) - 1, "log_returns": F.ln(ratio(F.col("close"), before))})


def add_technical_features(bars: DataFrame) -> DataFrame:
    """Moving averages of 5, 10 and 20 bars, and the volatility of 20 returns."""
    x = bars if "returns" in bars.columns else add_returns(bars)
    return x.withColumns({f"ma_{n}": roll(F.avg, F.col("close"), n) for n in (5, 10, 20)} | {"volatility_20": roll(F.stddev_samp, F.col("returns"), 20)})
