"""Quality selection by importance resampling.

Two bag-of-n-gram models over hashed buckets are counted: one of texts like the target, one of the
raw corpus. A document's weight is the logarithm of the ratio of its probabilities under the two,
and documents are drawn without replacement in proportion to their weights by the Gumbel top-k
trick: add Gumbel noise to the logarithm and keep the k largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import SPACED, Chunk, chunks

#: Buckets of word n-grams (one and two words).
BUCKETS = 10_000
#: The target model learns from so many labelled documents in expectation, chosen by a hash of their ids.
TARGET_DOCS = 20_000


def _grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the text of each n-gram of a chunk."""
    text = np.repeat(np.arange(len(c)), c.counts())
    pairs, inside = c.windows(2)
    bucket = np.concatenate([c.hashes, pairs[inside]]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([text, text[: len(inside)][inside]])


def _counts(docs: DataFrame) -> DataFrame:
    """bucket, raw, target: n-grams of all documents and of those with ``is_target``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            flags = np.array(b.column(1).to_pylist(), bool)
            for c in chunks(b.column(0), SPACED, lower=True):
                bucket, text = _grams(c)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[flags[c.at + text]], minlength=BUCKETS)
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (there, raw[there], target[there])], names=["bucket", "raw", "target"])

    rows = docs.select("text", "is_target").mapInArrow(count, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weigh(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_docs: int = TARGET_DOCS, per_grams: float | None = None) -> DataFrame:
    """doc_id and log_weight of every row.

    ``targets`` has ids of documents like those that are wanted, in its column ``doc_id``; null and
    repeated ids count once or not at all. At most about ``target_docs`` of them, chosen by a hash,
    make the target model; the raw model counts every document. Null texts and texts without words
    have a null weight. Without any target all weights are 0.

    The weight is the logarithm of the ratio of the document's probabilities under both models. With
    ``per_grams`` it is the mean of an n-gram times that number instead, so that length alone neither
    helps nor harms; such weights are no importance weights any more.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = targets.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct()
    n = ids.count()
    place = F.pmod(F.xxhash64(F.col("target_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    # about target_docs ids, so the broadcast has a bound
    ids = F.broadcast(ids.where(place < F.lit(min(1.0, target_docs / max(n, 1)))))
    flagged = docs.join(ids, F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("is_target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in _counts(flagged).collect():  # BUCKETS rows at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if n else np.zeros(BUCKETS)
    sent = spark.sparkContext.broadcast(ratio)
    kind = docs.schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(1), SPACED, lower=True):
                bucket, text = _grams(c)
                total = np.bincount(text, sent.value[bucket], len(c))
                size = np.bincount(text, minlength=len(c))
                weight = total if per_grams is None else per_grams * total / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.at, len(c)), pa.array(weight, mask=size == 0)], names=["doc_id", "log_weight"])

    return docs.mapInArrow(score, f"doc_id {kind}, log_weight double")


def _kth_largest(keys: DataFrame, k: int) -> float | None:
    """The exact k-th largest of column ``key``, by narrowing a range with histograms of 4096 bins."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if n == 0 or k <= 0:
        return None
    if k >= n:
        return lo
    left = k  # the answer is the left-th largest key in [lo, hi]
    while lo < hi:
        width = (hi - lo) / 4096
        bins = F.least(F.floor((F.col("key") - lo) / width), F.lit(4095)).alias("bin")
        own = keys.where(F.col("key").between(lo, hi))
        found = own.groupBy(bins).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for r in found.orderBy(F.desc("bin")).collect():
            if r["n"] >= left:
                break
            left -= r["n"]
        lo, hi = r["lo"], r["hi"]
    return lo


def select(docs: DataFrame, targets: DataFrame, keep: float = 0.85, seed: int = 11, **columns) -> DataFrame:
    """doc_id, log_weight, key (weight plus Gumbel noise) and selected for every row.

    Selected are the ``round(keep * rows)`` largest keys; equal keys at the border are all selected
    (repeated rows have equal noise, as it comes from the id and the seed). Rows without a weight
    have no key and are not selected, nor are rows without an id. ``columns`` as in ``weigh``.
    """
    tables = Scratch(docs.sparkSession, "resample")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.when(F.col("doc_id").isNotNull(), F.col("log_weight") - F.log(-F.log(u)))
    keys = tables.put(weigh(docs, targets, **columns).withColumn("key", key), "keys")
    border = _kth_largest(keys, round(keep * keys.count()))
    return keys.withColumn("selected", F.coalesce(F.col("key") >= F.lit(border), F.lit(False)))
