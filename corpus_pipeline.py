"""A training corpus in five stages: identified, near-deduplicated, without long repeats, without
secrets, packed.

Every stage takes what its predecessor kept, as Parquet, and all but the last give the columns of
``documents`` back, further columns among them, whatever they are called.

Defined cases: texts that are null, empty or without a letter go in the first stage. Rows with a
null doc_id pass near-dedup and repeat removal whole. Repeated rows, and rows that share a doc_id,
go in near-dedup if all texts of that doc_id have a smaller similar one; otherwise they all stay.
Long texts are worked off whole. Nulls in other columns stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import best_fit_packing, language_id, secret_scan, simhash_dedup, suffix_dedup
from quantloom.llm.common import remove, shared_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text has no letter or stands between two languages."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five-word shingles, that with the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes go that a string of 50 bytes covers which a smaller doc_id has too; the row stays."""
    return suffix_dedup.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars is the new length."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # fingerprints, alignment and packing are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted once the next is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = shared_folder(spark), None
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = f"{folder}/stage-{number}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
