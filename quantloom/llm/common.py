"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named a temporary one serves on a local master; on a cluster it would be a different disk for every executor, so that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the folder all executors share."""
    _checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder all executors share."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


BATCH_BYTES = 8 << 20


def small_batches(frame: DataFrame) -> None:
    """Have Spark hand texts to Python in batches of a few megabytes, however long they are, so that a worker's memory doesn't hang on their lengths."""
    conf = frame.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def fresh(taken: list[str], wanted: str) -> str:
    """A column name that isn't taken, whatever its case."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
