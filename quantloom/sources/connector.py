"""A Spark data source over any function that delivers bars of one symbol between two days.

``register(spark)``, then
``spark.read.format("bar_feed").options(fetch="package.module:function", symbols="A,B", start=..., end=...).load()``.
Symbols are dealt out over tasks, so many downloads run at once; one that fails gives no bars, or
the job's failure with ``errors="fail"``. Filters on symbol and time reach the feed: only the symbols and days that a
query asks for are fetched. With ``readStream`` every batch fetches the days since the last one.

A feed is called with symbol, first day and last day, and with ``path`` where that option is given.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

COLUMNS = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
DAY = dt.timedelta(days=1)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarFeed)


class Symbols(InputPartition):
    def __init__(self, names: list[str], start: dt.date, end: dt.date):
        self.names, self.start, self.end = names, start, end


class BarFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_feed"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> "FeedReader":
        return FeedReader(self.options)

    def streamReader(self, schema) -> "FeedStreamReader":  # noqa: N802
        return FeedStreamReader(self.options)


class _Feed:
    """What both readers share."""

    def __init__(self, options):
        self.fetch, self.path = options["fetch"], options.get("path")
        self.start, self.end = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.tasks = int(options.get("tasks", "8"))
        self.fail = options.get("errors", "skip") == "fail"

    def dealt(self, start: dt.date, end: dt.date) -> list[Symbols]:
        n = max(1, min(self.tasks, len(self.symbols)))
        return [Symbols(self.symbols[i::n], start, end) for i in range(n)]

    def fetched(self, part: Symbols) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        fetch, more = getattr(importlib.import_module(module), name), {"path": self.path} if self.path else {}
        for symbol in part.names if part.start <= part.end else ():
            try:
                rows = list(fetch(symbol, part.start, part.end, **more))
            except Exception:
                if self.fail:
                    raise
                continue
            yield from ((symbol, *r) for r in rows)


class FeedReader(_Feed, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Symbols and days are narrowed down; days a little wider than asked for, as times hang on the session's zone, so Spark keeps the filters on time."""
        for f in filters:
            match f:
                case EqualTo(attribute=("symbol",), value=x):
                    self.symbols = [s for s in self.symbols if s == x]
                case In(attribute=("symbol",), value=xs):
                    self.symbols = [s for s in self.symbols if s in xs]
                case IsNotNull(attribute=("symbol",) | ("ts",)):
                    pass
                case EqualTo(attribute=("ts",), value=x) | GreaterThan(attribute=("ts",), value=x) | GreaterThanOrEqual(attribute=("ts",), value=x) | LessThan(attribute=("ts",), value=x) | LessThanOrEqual(attribute=("ts",), value=x):
                    if not isinstance(f, LessThan | LessThanOrEqual):
                        self.start = max(self.start, x.date() - DAY)
                    if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                        self.end = min(self.end, x.date() + DAY)
                    yield f
                case _:
                    yield f

    def partitions(self) -> list[Symbols]:
        return self.dealt(self.start, self.end)

    def read(self, partition: Symbols) -> Iterator[tuple]:
        return self.fetched(partition)


class FeedStreamReader(_Feed, DataSourceStreamReader):
    """Offsets are days: a batch holds the days behind the last one, up to ``end`` or today."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": str(self.start - DAY)}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": str(max(self.start - DAY, min(self.end, dt.date.today())))}

    def partitions(self, start: dict, end: dict) -> list[Symbols]:
        return self.dealt(dt.date.fromisoformat(start["day"]) + DAY, dt.date.fromisoformat(end["day"]))

    def read(self, partition: Symbols) -> Iterator[tuple]:
        return self.fetched(partition)


def stored_bars(symbol: str, start: dt.date, end: dt.date, path: str) -> Iterator[tuple]:
    """A feed over Parquet files in folders ``symbol=...``: both bounds reach the files' row groups."""
    import pyarrow.dataset as ds

    ts = ds.field("ts")
    wanted = (ds.field("symbol") == symbol) & (ts >= dt.datetime.combine(start, dt.time())) & (ts < dt.datetime.combine(end + DAY, dt.time()))
    columns = [c.split(" ")[0] for c in COLUMNS.split(", ")][1:]
    rows = ds.dataset(path, format="parquet", partitioning=ds.partitioning(flavor="hive", schema=None)).scanner(columns=columns, filter=wanted)
    for batch in rows.to_batches():
        yield from zip(*(c.to_pylist() for c in batch.columns))


def ramp(symbol: str, start: dt.date, end: dt.date) -> Iterator[tuple]:
    """A feed for tests: prices rise with the days, on business days."""
    base = 10.0 + int(symbol[1:])
    for n in range((end - start).days + 1):
        day = start + dt.timedelta(days=n)
        if day.weekday() < 5:
            p = base + n * 0.05
            yield dt.datetime(day.year, day.month, day.day), p, p + 0.5, p - 0.5, p + 0.1, 1000.0 + n * 10
