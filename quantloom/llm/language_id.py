"""Language identification with error-correcting output codes.

Every learned language has a codeword. One binary classifier per bit, a log-odds table over
hashed byte trigrams of the lower-cased text, says how strongly a text has that bit. Decoding
adds up, for each codeword, the logistic losses of its bits, so weak bits count little, and takes
the codeword with the least; where the runner-up is about as near, the answer is flagged as
ambiguous. Whole texts are counted in training and in prediction.

The classifiers are fitted on a bounded sample: about ``per_language`` labelled rows of each
language, chosen by a hash of doc_id, for the ``languages`` with the most labelled rows (ties by
name). What comes to the driver is trigram counts by language, which don't grow with the input.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled
row all are ``und``; with one language all other texts are that language; of languages whose
codewords are equally near the first by name is taken, flagged as ambiguous; a row with a null
doc_id is neither learned from nor held out; repeated rows get equal answers; an empty table
gives no rows; other columns are kept by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import small_batches

UNKNOWN = "und"
BUCKETS = 1 << 16
PER_LANGUAGE, LANGUAGES = 20_000, 200
_WEIGHT, _ENOUGH = 0.2, 100  # of a trigram, as those of one text aren't independent; trigrams from which more don't make it surer
_SLICE = 1 << 20


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1, well apart: all different splits for up to 7 languages, else the best of some random codes."""
    if languages <= 7:
        splits = [s for s in product((1, -1), repeat=languages) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T.reshape(languages, -1)
    rng, bits, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None, -1
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (languages, bits))
        code = code[:, np.abs(code.sum(0)) < languages]
        least = int(((code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(languages, dtype=int) * bits).min())
        if least > apart:
            best, apart = code, least
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # language, bit
    weights: np.ndarray  # bucket, bit


def _grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the byte trigrams, slice by slice."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for a in range(0, len(data) - 2, _SLICE):
        b = data[a : a + _SLICE + 2].astype(np.uint32)
        yield ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for grams in _grams(text.as_py()):
                own += np.bincount(grams, minlength=BUCKETS)
    for lang, own in counts.items():
        met = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(own[met])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, may_learn, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learn from rows with doc_id, text and lang for which the condition ``may_learn`` holds."""
    labelled = docs.where(may_learn).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    rows = {r["lang"]: r["n"] for r in most.collect()}
    if not rows:
        return Model((), np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*(F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, per_language / n))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(place < share[F.col("lang")])
    found = sample.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    learned = tuple(sorted(rows))
    counts = np.zeros((len(learned), BUCKETS))
    at = {lang: i for i, lang in enumerate(learned)}
    counts[[at[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Model(learned, code := codewords(len(learned)), bit_weights(counts, code))


def bit_weights(counts: np.ndarray, code: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Log-odds of each bucket for each bit; languages count alike, whatever their number of texts."""
    shares = (counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * BUCKETS)
    out = np.empty((BUCKETS, code.shape[1]), np.float32)
    for bit, side in enumerate(code.T):
        out[:, bit] = np.log(shares[side > 0].mean(0)) - np.log(shares[side < 0].mean(0))
    return out


def predict(model: Model, text: str | None) -> tuple[str, float, float]:
    """Language, score, and how much nearer its codeword is than the next (in loss)."""
    if not model.languages or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0
    total, n = np.zeros(model.code.shape[1]), 0
    for grams in _grams(text):
        total += model.weights[grams].sum(0, dtype=np.float64)
        n += len(grams)
    margins = model.code * (total / n * min(n, _ENOUGH) * _WEIGHT)
    loss = np.logaddexp(0, -margins).sum(1)
    likely = np.exp(loss.min() - loss)
    order = np.argsort(loss, kind="stable")
    return model.languages[order[0]], float(likely[order[0]] / likely.sum()), float(loss[order[1]] - loss[order[0]]) if len(loss) > 1 else float(_ENOUGH)


def identify(docs: DataFrame, model: Model, ambiguity: float = 0.1, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and ambiguous (the next codeword is within ``ambiguity``), in place of columns so named."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(shared.value, t.as_py()) for t in batch.column(text)]
            lang, score, gap = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([g < ambiguity for g in gap], pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def held_out():
    """Whether a row is kept from learning: a fifth, by the CRC-32 of doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, learned from the rows not held out."""
    model = fit(docs, ~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is known beyond doubt, columns as they are."""
    model = fit(docs, ~held_out())
    names = docs.columns
    found = identify(docs.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(names) if c != "text"}), model)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*(F.col(c if c == "text" else f"_{i}").alias(c) for i, c in enumerate(names)))
