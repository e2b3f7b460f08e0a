"""Streaming counterparts; additions for live data, not part of the batch engine.

Bars from ticks come by event-time windows with a watermark; an exponential average per symbol
keeps its state between triggers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ticks (symbol, ts timestamp, price, size) to bars, each given out once no tick of it can come any more."""
    window = F.window("ts", width)
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", window.alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of ticks: a session ends where none came for the gap."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("volume")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")


def stream_ema(bars: DataFrame, span: int = 14) -> DataFrame:
    """The exponential average of closes, carried on from trigger to trigger."""
    alpha = 2 / (span + 1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values("ts")
        out = []
        for close in rows.close:
            value = close if value is None else alpha * close + (1 - alpha) * value
            out.append(value)
        state.update((value,))
        yield rows.assign(ema=out)[["symbol", "ts", "close", "ema"]]

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", "value double", "append", "NoTimeout")
