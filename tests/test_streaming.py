"""Streams against the same computation on the whole table."""

from pyspark.sql import functions as F

from quantloom.streaming.bars import stream_bars, stream_ema, stream_sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def ticks(rows):
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 100).alias("price"), F.lit(1.0).alias("size"))


def run(frame, name):
    q = frame.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name)


def source(spark, tmp_path):
    """The events in time order, a file for each stretch of time."""
    rows = spark.read.parquet(EVENTS)
    for i in range(4):
        rows.where(F.dayofmonth("ts").between(i * 8, i * 8 + 7)).coalesce(1).write.parquet(f"file://{tmp_path}/ticks/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/ticks")


def test_bars_from_a_stream(spark, tmp_path):
    got = run(stream_bars(ticks(source(spark, tmp_path)), "6 hours"), "stream_bars")
    want = ticks(spark.read.parquet(EVENTS)).groupBy("symbol", F.window("ts", "6 hours").alias("w")).agg(F.min_by("price", "ts").alias("open"), F.sum("size").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "volume")
    last = got.agg(F.max("ts")).first()[0]
    assert got.count() > 50 and got.select("symbol", "ts", "open", "volume").exceptAll(want).count() == 0
    assert want.where(F.col("ts") < F.lit(last)).exceptAll(got.select("symbol", "ts", "open", "volume")).count() == 0


def test_sessions_from_a_stream(spark, tmp_path):
    got = run(stream_sessions(ticks(source(spark, tmp_path)), "3 hours"), "stream_sessions")
    assert got.count() > 10 and got.where("end <= start OR n < 1").count() == 0


def test_average_is_carried_on(spark, tmp_path):
    for i, part in enumerate(([1.0, 2.0], [4.0], [8.0, 8.0])):
        spark.createDataFrame([("A", i * 10 + k, v) for k, v in enumerate(part)], "symbol string, t int, close double").coalesce(1).write.parquet(f"file://{tmp_path}/bars/{i}")
    stream = spark.readStream.schema("symbol string, t int, close double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/bars").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.ema for r in run(stream_ema(stream, 3), "stream_ema").orderBy("ts").collect()]
    assert got == [1.0, 1.5, 2.75, 5.375, 6.6875]
