"""Secret scanning over an incremental ledger of blobs.

Every version of a document is content-addressed by the SHA-256 of its text. The ledger, a table
in a shared folder, records which (blob, rule version) pairs were scanned and what was found; a
rule version is a hash of the patterns. Only pairs the ledger doesn't have are scanned, once
however many paths share the blob, and findings are joined back to all paths. ``scan`` and
``redact`` bring the ledger up to date first, so it never lacks a blob of the input. Copies are
put together map-side before the shuffle, so a blob that a third of all rows share costs one row
per task; the join back is a plain sort-merge join that Spark can split.

Spans are whole matches ``kind:start:end`` in code points, end exclusive, ordered by start and
then by kind as listed; within a kind they are leftmost and don't overlap.

Defined cases: null text is the empty blob, without findings; repeated rows get the same findings
each; an empty table gives no rows; other columns of the input are kept by ``redact`` and ignored
by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import fresh, shared_folder, small_batches

KINDS = ("assign", "access", "hex")
MASK = "[secret]"
FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, spans string"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as with + and a length test after
_KEYWORDS = ("passw", "secret", "token", "api")  # one stands in every assignment
_LEAST = {"assign": 6, "access": 20}  # characters of a match


def rule_version(patterns: tuple[re.Pattern, ...] = (_ASSIGN, _ACCESS, _HEX)) -> str:
    """A hash of the patterns, their flags and the least lengths."""
    said = repr([(p.pattern, p.flags) for p in patterns] + sorted(_LEAST.items()))
    return hashlib.sha256(said.encode()).hexdigest()[:16]


RULES = rule_version()


def secrets(text: str) -> list[tuple[str, int, int]]:
    """The (kind, start, end) of a text, ordered."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def _scan_blobs(batches: Iterator[pa.RecordBatch], rules: str) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in FINDINGS.split(", ")]
    for batch in batches:
        counts, spans = {k: [] for k in KINDS}, []
        for text in batch.column("text"):
            found = secrets(text.as_py())
            for k in KINDS:
                counts[k].append(sum(kind == k for kind, _, _ in found))
            spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([rules] * len(spans), pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(spans, pa.string())], names)


def _addressed(docs: DataFrame, text: str, key: str = "_blob") -> DataFrame:
    return docs.withColumn(key, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def blob_findings(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Findings of the blobs in ``docs`` that the ledger lacks under the current rules."""
    small_batches(docs)
    rows = _addressed(docs.select(F.col(text).alias("text")), "text")
    blobs = rows.groupBy(F.col("_blob").alias("blob")).agg(F.first(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == RULES).select("blob"), "blob", "left_anti")
    rules = RULES
    return blobs.mapInArrow(lambda batches: _scan_blobs(batches, rules), FINDINGS)


def update_ledger(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks, add it there, and give the whole ledger.

    A run that is lost before its files are committed leaves the ledger as it was; pairs written
    twice by concurrent runs hold equal findings and count once.
    """
    spark = docs.sparkSession
    schema = blob_findings(docs.limit(0), None, text).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema(schema).parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None
    blob_findings(docs, known, text).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).dropDuplicates(["blob", "rules"])


def scan(docs: DataFrame, ledger: str | None = None, text: str = "text", path: str = "doc_id") -> DataFrame:
    """Per path: counts by kind and all spans. ``ledger``: the path of one to use and extend, else a new one in the shared folder."""
    known = update_ledger(docs, ledger or shared_folder(docs.sparkSession), text)
    findings = known.where(F.col("rules") == RULES).withColumnRenamed("blob", "_blob")
    paths = _addressed(docs.select(F.col(path), F.col(text)), text).select(path, "_blob")
    return paths.join(findings, "_blob").drop("_blob", "rules")


def redact(docs: DataFrame, ledger: str | None = None, text: str = "text") -> DataFrame:
    """The same rows and columns with every secret in the text masked."""
    names = docs.columns
    key, marks = fresh(names, "_blob"), fresh(names, "_spans")
    known = update_ledger(docs, ledger or shared_folder(docs.sparkSession), text)
    found = known.where((F.col("rules") == RULES) & (F.col("spans") != "")).select(F.col("blob").alias(key), F.col("spans").alias(marks))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for whole, spans in zip(batch.column(text).to_pylist(), batch.column(marks).to_pylist()):
                if spans:
                    out, at = [], 0
                    for start, end in ((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(","))):
                        if start >= at:
                            out += [whole[at:start], MASK]
                        at = max(at, end)
                    whole = "".join(out) + whole[at:]
                texts.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)

    joined = _addressed(docs, text, key).join(found, key, "left").drop(key)
    return joined.mapInArrow(mask, docs.schema)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans; the method adds no spans to the base ones."""
    return scanned.select(F.col("doc_id").cast("long"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")
