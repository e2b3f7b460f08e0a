"""The data source, reference tables and result files."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from quantloom import queries
from quantloom.operators import align
from quantloom.operators.backtest import execute
from quantloom.operators.metrics import performance
from quantloom.plans.ir import cross_strategy
from quantloom.plans.signals import with_signal
from quantloom.sources import connector, reference
from quantloom.sources.bars import bars_hourly

SF = "/root/testdata/sf0.001"


def feed(spark, **options):
    connector.register(spark)
    return spark.read.format("bar_feed").options(**{"fetch": "quantloom.sources.connector:ramp", "start": "2020-01-01", "end": "2020-01-10", **options}).load()


def test_feed_spreads_symbols_and_skips_failures(spark):
    assert feed(spark, symbols="S1,S2,x,S3", tasks="2").rdd.getNumPartitions() == 2
    assert {r.symbol: r.n for r in feed(spark, symbols="S1,x,S3").groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"S1": 8, "S3": 8}
    assert feed(spark, symbols="").count() == 0
    with pytest.raises(Exception):
        feed(spark, symbols="x", errors="fail").count()


def noted(symbol, start, end, path):
    """A feed that notes what it is asked for."""
    with open(f"{path}/{symbol}_{start}_{end}", "w"):
        pass
    return [(day, *[10.0 + int(symbol[1:])] * 4, 2000.0) for day, *_ in connector.ramp(symbol, start, end)]


def noted_feed(tmp_path, **options):
    return {"fetch": "tests.test_sources:noted", "path": str(tmp_path), "symbols": "S1,S2,S3", "start": "2020-01-01", "end": "2020-12-31", "errors": "fail", **options}


def test_feed_is_asked_only_for_what_the_query_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", str(pathlib.Path(__file__).parent.parent))
    connector.register(spark)
    rows = spark.read.format("bar_feed").options(**noted_feed(tmp_path)).load()
    found = rows.where("symbol IN ('S2', 'S3', 'S9') AND ts >= TIMESTAMP'2020-03-02 00:00:00' AND ts < TIMESTAMP'2020-03-07 00:00:00' AND close > 11.5").collect()
    assert {(r.symbol, r.ts.day) for r in found} == {(s, d) for s in ("S2", "S3") for d in range(2, 7)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["S2_2020-03-01_2020-03-08", "S3_2020-03-01_2020-03-08"]
    assert rows.where("symbol = 'S1' AND ts = TIMESTAMP'2020-05-04 00:00:00'").count() == 1
    assert "S1_2020-05-03_2020-05-05" in {p.name for p in tmp_path.iterdir()}
    assert rows.where("symbol = 'none'").count() == 0 and rows.where("symbol = 'S1' AND ts > TIMESTAMP'2021-06-01 00:00:00'").count() == 0
    assert rows.where("volume > 1000 AND (symbol = 'S1' OR close > 12)").count() == 262 * 2


def test_feed_streams_the_days_since_the_last_batch(spark, tmp_path):
    connector.register(spark)
    (tmp_path / "asked").mkdir()

    def run(end):
        rows = spark.readStream.format("bar_feed").options(**noted_feed(tmp_path / "asked", end=end, symbols="S1,S2")).load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").option("path", f"file://{tmp_path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return spark.read.parquet(f"file://{tmp_path}/out").groupBy("symbol").count().collect()

    assert {r.symbol: r["count"] for r in run("2020-01-10")} == {"S1": 8, "S2": 8}
    assert {r.symbol: r["count"] for r in run("2020-01-20")} == {"S1": 14, "S2": 14}
    assert {r.symbol: r["count"] for r in run("2020-01-20")} == {"S1": 14, "S2": 14}
    assert sorted(p.name for p in (tmp_path / "asked").iterdir()) == [f"{s}_{days}" for s in ("S1", "S2") for days in ("2020-01-01_2020-01-10", "2020-01-11_2020-01-20")]


def test_calendar(spark):
    holidays = spark.createDataFrame([(dt.date(2020, 1, 2),)], "day date")
    days = {r.day.day: (r.is_open, r.open_before and r.open_before.day) for r in reference.trade_calendar(spark, "2020-01-01", "2020-01-07", holidays).collect()}
    assert days == {1: (True, None), 2: (False, 1), 3: (True, 1), 4: (False, 3), 5: (False, 3), 6: (True, 3), 7: (True, 6)}


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("b", 5)], "k string, t int").withColumn("ts", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("a", 5, 3.0), ("c", 1, 9.0)], "k string, t int, v double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    assert sorted((r.k, r.t, r.v) for r in align.asof_join(left, right, ["k"], ["v"]).collect() if r.v) == [("a", 5, 3.0), ("a", 5, 3.0)]


def test_results_are_written(spark, tmp_path):
    steps = execute(with_signal(cross_strategy(5, 20), bars_hourly(spark, SF)))
    reference.write_results(steps, performance(steps, ["symbol"]), f"file://{tmp_path}/run")
    read = {n: spark.read.parquet(f"file://{tmp_path}/run/{n}") for n in ("equity", "trades", "metrics")}
    assert read["equity"].count() == steps.count() and read["metrics"].count() == 5 and read["trades"].where("trade_id = 'T00001'").count() == 5


def test_registration():
    assert set(queries.oracle_sql()) <= set(queries.queries())
