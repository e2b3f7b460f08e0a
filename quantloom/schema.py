"""Schemas of the engine's tables, and the one projection that brings bars into shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp_ntz": T.TimestampNTZType()}


def _table(**columns: str) -> T.StructType:
    """Columns by type, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for kind, names in columns.items() for name in names.split()])


def _ordered(schema: T.StructType, names: str) -> T.StructType:
    return T.StructType([schema[name] for name in names.split()])


BARS = _ordered(
    _table(string="symbol board", timestamp_ntz="ts", double="open high low close volume amount turnover_rate prev_close adjustment_factor", boolean="limit_up limit_down is_suspended"),
    "symbol ts open high low close volume amount turnover_rate board prev_close limit_up limit_down is_suspended adjustment_factor",
)
TRADES = _ordered(
    _table(string="run_id trade_id symbol reason", int="trade_seq signal", timestamp_ntz="ts", double="price commission slippage pnl", long="shares"),
    "run_id trade_seq trade_id ts symbol signal price shares commission slippage reason pnl",
)
EQUITY = _ordered(_table(string="run_id symbol", int="bar_seq", timestamp_ntz="ts", double="equity cash market_value"), "run_id symbol bar_seq ts equity cash market_value")

# Other names under which a column may come.
ALIASES = {
    "ts": ("timestamp", "time", "trade_date", "trade_time"),
    "volume": ("vol",),
    "limit_up": ("is_limit_up",),
    "limit_down": ("is_limit_down",),
    "is_suspended": ("suspended",),
    "adjustment_factor": ("adj_factor",),
}
DEFAULTS = {"volume": 1.0, "limit_up": False, "limit_down": False, "is_suspended": False, "adjustment_factor": 1.0}


def normalize_bars(bars: DataFrame) -> DataFrame:
    """Bars with exactly the columns of BARS: aliases renamed, defaults filled in, NaN turned into null.

    high and low default to close; all other columns that are missing become null.
    """
    have = set(bars.columns)
    out = []
    for field in BARS:
        name = next((c for c in (field.name, *ALIASES.get(field.name, ())) if c in have), None)
        if name is None and field.name in ("open", "high", "low"):
            name = "close"
        value = F.col(name).cast(field.dataType) if name else F.lit(None).cast(field.dataType)
        if name and isinstance(field.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]))
        out.append(value.alias(field.name))
    return bars.select(*out)
