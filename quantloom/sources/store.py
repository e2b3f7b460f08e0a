"""A market-data store on Parquet with a key, snapshots and tiers.

A bar is known by (symbol, timeframe, time): inserting it again replaces it. Files are never changed. A
manifest lists the files of a version with the range of symbols and times of each, and a change writes new files, then
a manifest with the next number by one rename that fails if that number is taken. So readers see one
version all the time, and of two changes at once the later one is made anew on what the other left.
Scans open only the files whose ranges they meet; Spark prunes row groups in them.

Old months move to colder tiers, where each year's bars of many symbols lie sorted in few files.
"""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.schema import ALIASES


def scratch(spark: SparkSession) -> str:
    """A new folder: in ``spark.checkpoint.dir``, which all executors share; on a local master without one, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or 'file://' + tempfile.mkdtemp(prefix='bars-')}/{uuid.uuid4().hex}"


KEY = ["symbol", "timeframe", "ts"]
_BY = ["_tier", "_part"]
_CODECS = {"hot": "snappy", "warm": "zstd", "cold": "gzip"}
TIERS = tuple(_CODECS)  # from hot to cold


def _stamp(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def _meets(f: dict, symbols: Iterable[str], timeframe: str, start: str | None, end: str | None) -> bool:
    """Whether a file may hold bars of some symbols between two times."""
    after = not start or f["end"] >= str(dt.datetime.fromisoformat(start))
    return after and (not end or f["begin"] <= str(dt.datetime.fromisoformat(end))) and f["timeframe"] == timeframe and any(f["first"] <= s <= f["last"] for s in symbols)


class BarStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.Path(self.path).getFileSystem(self._conf)

    # -- versions

    def versions(self) -> list[int]:
        """The numbers of all versions, rising."""
        folder = self._jvm.Path(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[0] != "_" and n.endswith(".json"))

    def files(self, version: int | None = None) -> list[dict]:
        """The files of a version (the last one), with tier, timeframe, rows and ranges."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return []
        stream = self._fs.open(self._jvm.Path(f"{self.path}/_manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, files: list[dict]) -> bool:
        """Make these files the next version after ``version``; False if there is one already."""
        folder = f"{self.path}/_manifests"
        waiting, final = self._jvm.Path(f"{folder}/_{uuid.uuid4().hex}"), self._jvm.Path(f"{folder}/{version + 1:012d}.json")
        stream = self._fs.create(waiting, False)
        stream.write(bytearray(json.dumps(files), "utf-8"))
        stream.close()
        if not self._fs.exists(final):
            options = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 0)
            try:
                self._jvm.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(waiting), self._fs.makeQualified(final), options)
                return True
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
        self._fs.delete(waiting, False)
        return False

    def _change(self, concerns: Callable[[dict], bool], made: Callable[[list[dict]], list[dict]]) -> int:
        """Put ``made(files)`` in place of the files it concerns; the number of the new version.

        Where another change came first, files are made anew only if it touched the same ones.
        """
        before: list[dict] | None = None
        new: list[dict] = []
        while True:
            version = (self.versions() or [0])[-1]
            every = self.files(version)
            own = [f for f in every if concerns(f)]
            if own != before:
                self._drop(new)
                before, new = own, made(own)
            if self._commit(version, [f for f in every if f not in own] + new):
                return version + 1

    def _drop(self, files: list[dict]) -> None:
        for f in files:
            self._fs.delete(self._jvm.Path(f"{self.path}/{f['file']}"), False)

    # -- files

    def _write(self, placed: DataFrame, deal: Column, tiers: Iterable[str]) -> list[dict]:
        """Write bars with ``_tier`` and ``_part`` into new files, a task for each part and value of ``deal``, and give their ranges."""
        folder, found = f"data/{uuid.uuid4().hex}", []
        dealt = placed.repartition(*_BY, deal).sortWithinPartitions(*_BY, *KEY)
        for tier in tiers:
            dealt.where(F.col("_tier") == tier).write.partitionBy(*_BY).option("compression", _CODECS[tier]).mode("append").parquet(f"{self.path}/{folder}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.drop(*_BY).schema)
        written = self.spark.read.schema(f"{schema}, _tier string, _part string").parquet(f"{self.path}/{folder}")
        ranges = written.groupBy(F.col("_metadata.file_path").alias("file"), "_tier", "timeframe").agg(F.count("*").alias("rows"), F.min("symbol").alias("first"), F.max("symbol").alias("last"), F.min("ts").cast("string").alias("begin"), F.max("ts").cast("string").alias("end"))
        for r in ranges.collect():  # a row a file
            found.append({"file": folder + r["file"].split(folder, 1)[1], "tier": r["_tier"], "timeframe": r["timeframe"], "rows": r["rows"], "first": r["first"], "last": r["last"], "begin": r["begin"], "end": r["end"], "schema": schema})
        return sorted(found, key=lambda f: f["file"])

    def _read(self, files: list[dict]) -> DataFrame | None:
        """The bars of some files and their tier; columns that a file lacks are null."""
        frames = []
        for kind in sorted({(f["schema"], f["tier"]) for f in files}):
            paths = [f"{self.path}/{f['file']}" for f in files if (f["schema"], f["tier"]) == kind]
            frames.append(self.spark.read.schema(kind[0]).parquet(*paths).withColumn("tier", F.lit(kind[1])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None

    def _months(self) -> Column:
        return F.date_format("ts", "yyyy-MM")

    # -- changes

    def insert(self, bars: DataFrame, timeframe: str, symbol: str | None = None, files: int = 8) -> int:
        """Merge bars into the store by their key; the number of the new version.

        A time column of another name is renamed, a missing symbol is filled in. Bars whose key the store has replace the
        old ones; of bars that share a key the greatest, column by column, is taken. Only the months that hold new
        bars are written, and are hot from then on, by ``files`` tasks each at most. Rows without symbol or time are left out.
        """
        for name in ("ts", "adjustment_factor"):
            for other in ALIASES[name]:
                if other in bars.columns and name not in bars.columns:
                    bars = bars.withColumnRenamed(other, name)
        if "symbol" not in bars.columns:
            bars = bars.withColumn("symbol", F.lit(symbol))
        rest = [c for c in bars.columns if c not in KEY]
        keyed = bars.where("symbol IS NOT NULL AND ts IS NOT NULL").withColumn("timeframe", F.lit(timeframe))
        new = keyed.groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("_b")).select(*KEY[:1], "ts", *(f"_b.{c}" for c in rest), "timeframe")
        months = {r["m"] for r in new.select(self._months().alias("m")).distinct().collect()}  # a row a month

        def made(own: list[dict]) -> list[dict]:
            old = self._read(own)
            whole = new if old is None else old.drop("tier").join(new.select(*KEY), KEY, "left_anti").unionByName(new, allowMissingColumns=True)
            return self._write(whole.withColumns({"_tier": F.lit("hot"), "_part": self._months()}), F.pmod(F.xxhash64("symbol"), F.lit(files)), ["hot"])

        return self._change(lambda f: f["timeframe"] == timeframe and any(f["begin"][:7] <= m <= f["end"][:7] for m in months), made)

    def delete(self, symbol: str, timeframe: str, start: str | None = None, end: str | None = None, files: int = 8) -> int | None:
        """Remove a symbol's bars in a range, both ends included; only files that may hold some of them are written anew."""
        gone = (F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)
        if start:
            gone &= F.col("ts") >= _stamp(start)
        if end:
            gone &= F.col("ts") <= _stamp(end)
        meets = lambda f: _meets(f, [symbol], timeframe, start, end)
        if not any(map(meets, self.files())):
            return None

        def made(own: list[dict]) -> list[dict]:
            if not own:
                return []
            kept = self._read(own).where(~F.coalesce(gone, F.lit(False)))
            return self._write(kept.withColumnRenamed("tier", "_tier").withColumn("_part", self._months()), F.pmod(F.xxhash64("symbol"), F.lit(files)), sorted({f["tier"] for f in own}))

        return self._change(meets, made)

    def retier(self, now: str, warm_years: int = 2, cold_years: int = 5, files: int = 4) -> int | None:
        """Move months that ended so many years before ``now`` to the warm and the cold tier.

        There a year's bars are sorted by symbol and time and written by ``files`` tasks with ranges of symbols of their own.
        Files that hold no month to move stay as they are.
        """
        limit = {t: (str(int(now[:4]) - y) + now[4:7]) for t, y in (("warm", warm_years), ("cold", cold_years))}
        wanted = lambda month: "cold" if month < limit["cold"] else "warm" if month < limit["warm"] else "hot"
        moves = lambda f: TIERS.index(wanted(f["begin"][:7])) > TIERS.index(f["tier"])  # noqa: E731  of its months the first goes first
        if not any(map(moves, self.files())):
            return None
        month, rank = self._months(), lambda t: F.when(t == "cold", 2).when(t == "warm", 1).otherwise(0)
        aim = F.when(month < limit["cold"], "cold").when(month < limit["warm"], "warm").otherwise("hot")

        def made(own: list[dict]) -> list[dict]:
            bars = self._read(own)
            moved = bars.withColumn("_tier", F.when(rank(aim) > rank(F.col("tier")), aim).otherwise(F.col("tier"))).drop("tier")
            ranges = bars.select("symbol").distinct().select("symbol", F.ntile(files).over(Window.orderBy("symbol")).alias("_range"))  # a row a symbol
            ranged = moved.join(ranges, "symbol").withColumn("_part", F.concat_ws("_", F.when(F.col("_tier") == "hot", month).otherwise(F.date_format("ts", "yyyy")), "timeframe", "_range"))
            return self._write(ranged.drop("_range"), F.col("_part"), TIERS)

        return self._change(moves, made)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions and the files that only they have; how many files went."""
        numbers = self.versions()
        stay = {f["file"] for v in numbers[-keep:] for f in self.files(v)}
        gone = {f["file"]: f for v in numbers[:-keep] for f in self.files(v) if f["file"] not in stay}
        for v in numbers[:-keep]:
            self._fs.delete(self._jvm.Path(f"{self.path}/_manifests/{v:012d}.json"), False)
        self._drop(list(gone.values()))
        return len(gone)

    # -- scans

    def rows(self, version: int | None = None) -> DataFrame | None:
        """All bars of a version, with their tier."""
        return self._read(self.files(version))

    def scanned(self, symbols: Iterable[str], timeframe: str, start: str, end: str, version: int | None = None) -> list[dict]:
        """The files that may hold bars of some symbols between two times."""
        symbols = list(symbols)
        return [f for f in self.files(version) if _meets(f, symbols, timeframe, start, end)]

    def query(self, symbols: str | Iterable[str], timeframe: str, start: str, end: str, version: int | None = None) -> DataFrame:
        """Bars of some symbols between two times, both included, ordered by symbol and time: one scan for all of them."""
        wanted = [symbols] if isinstance(symbols, str) else list(symbols)
        found = self._read(self.scanned(wanted, timeframe, start, end, version))
        if found is None:
            found = self._read(self.files(version)).limit(0)
        return range_scan(found.where(F.col("timeframe") == timeframe), wanted, start, end).drop("tier")

    def _rows(self) -> DataFrame:
        return self.rows().drop("tier")

    def coverage(self) -> DataFrame:
        return coverage(self._rows())

    def last(self, symbol: str, timeframe: str, n: int) -> DataFrame:
        """The n latest bars."""
        return self._rows().where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)).orderBy(F.desc("ts")).limit(n)


def range_scan(bars: DataFrame, symbols: list[str], start: str, end: str) -> DataFrame:
    return bars.where(F.col("symbol").isin(symbols) & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy("symbol", "ts")


def coverage(bars: DataFrame) -> DataFrame:
    keys = [c for c in ("symbol", "timeframe") if c in bars.columns]
    return bars.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"))
