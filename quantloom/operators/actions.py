"""Corporate actions: splits, dividends and rights issues turned into adjustment factors for bars.

An event has symbol, ts (the ex-date), action_type, ratio and amount. ``split``: ratio new shares for
one; ``dividend``: amount a share; ``rights``: ratio new shares for one, each at the price amount.
Other types change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.align import asof_join


def _of(kind: str, value: Column) -> Column:
    return F.when(F.lower("action_type") == kind, value)


def multipliers(events: DataFrame, bars: DataFrame, span: str = "month") -> DataFrame:
    """symbol, ts, multiplier: the theoretical price behind all events of a day over the last close before it.

    A day without a close before it has nothing to adjust; one whose price would not be positive is
    no valid event. Both are left out.
    """
    days = events.groupBy("symbol", "ts").agg(
        F.coalesce(F.product(_of("split", F.col("ratio"))), F.lit(1.0)).alias("split"),
        F.coalesce(F.sum(_of("dividend", F.col("amount"))), F.lit(0.0)).alias("paid"),
        F.coalesce(F.sum(_of("rights", F.col("ratio"))), F.lit(0.0)).alias("issued"),
        F.coalesce(F.sum(_of("rights", F.col("ratio") * F.col("amount"))), F.lit(0.0)).alias("raised"),
    )
    priced = asof_join(days, bars.select("symbol", "ts", "close"), ["symbol"], ["close"], span=span, strict=True)
    behind = (F.col("close") - F.col("paid") + F.col("raised")) / (F.col("split") * (1 + F.col("issued")))
    return priced.where("close > 0 AND split > 0 AND issued >= 0").select("symbol", "ts", (behind / F.col("close")).alias("multiplier")).where("multiplier > 0")


def periods(found: DataFrame) -> DataFrame:
    """symbol, begin, end, factor: from each event to the next; begin belongs to a period, end doesn't, and null is open.

    The factor is the product of all multipliers from ``end`` on, a running product from the right.
    """
    later = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    up_to = found.select("symbol", before.alias("begin"), F.col("ts").alias("end"), F.exp(F.sum(F.ln("multiplier")).over(later)).alias("factor"))
    last = found.groupBy("symbol").agg(F.max("ts").alias("begin")).select("symbol", "begin", F.lit(None).cast(found.schema["ts"].dataType).alias("end"), F.lit(1.0).alias("factor"))
    return up_to.unionByName(last)


def with_factors(bars: DataFrame, held: DataFrame, span: str = "year") -> DataFrame:
    """Bars with the factor of the period they lie in; 1 for symbols without events.

    Periods are cut into ranges of one ``span``, so bars meet them by an equi-join on symbol and range.
    """
    within = lambda c: F.date_trunc(span, c).cast("timestamp_ntz")
    reach = bars.agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))  # one row
    clipped = held.crossJoin(F.broadcast(reach)).withColumns({"_from": F.greatest("begin", "_low"), "_to": F.least("end", "_high")}).where("_from <= _to")
    cut = clipped.withColumn("_range", F.explode(F.sequence(within("_from"), within("_to"), F.expr(f"INTERVAL 1 {span}")))).select("symbol", "_range", "begin", "end", "factor")
    b, p = bars.withColumn("_range", within("ts")).alias("b"), cut.alias("p")
    same = (F.col("b.symbol") == F.col("p.symbol")) & (F.col("b._range") == F.col("p._range"))
    inside = F.coalesce(F.col("b.ts") >= F.col("p.begin"), F.lit(True)) & F.coalesce(F.col("b.ts") < F.col("p.end"), F.lit(True))
    return b.join(p, same & inside, "left").select(*(f"b.{c}" for c in bars.columns if c != "factor"), F.coalesce("p.factor", F.lit(1.0)).alias("factor"))


def factors(bars: DataFrame, events: DataFrame, span: str = "month") -> DataFrame:
    """Bars with ``factor``, for ``prep.forward_adjust``."""
    return with_factors(bars, periods(multipliers(events, bars, span)))
