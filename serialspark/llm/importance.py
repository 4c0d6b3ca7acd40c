"""Importance resampling towards a target distribution, with exact weights by bit-sliced sums.

Features are runs of 1 to ``longest`` consecutive words (A-Z lower-cased; runs of digits, letters and bytes outside
ASCII), joined by one space, each hashed to a bucket by its CRC-32. A bucket's gain is the logarithm, in thousandths
and rounded down, of how much likelier the target texts make it than all documents do. A document's weight is the
mean gain of its features, rounded down; a Gumbel variable drawn from its id by SHA-256 is added, and the highest
scores are drawn, which samples without replacement in proportion to the exponential weights.

The sums are bit-sliced: a document's counts of the buckets are binary planes of one bit a bucket, as are the gains
in two's complement. Each plane of counts meets each plane of gains by AND and a population count, which counts for the
power of two that belongs to both. Planes are made for some hundreds of documents at a time.

What tasks receive is one gain a bucket. Scores are integers of bounded range (so are gains and the variable), so their
histogram is small whatever the number of documents: it gives the score of the last one drawn and each score's first
rank, and only rows of equal scores are sorted.

Null and empty texts have no features, weight 0 and no rank. A row without an id draws as one with an empty id and
comes after others of its score. Rows that repeat an id are documents of their own; ties between them go to the one of
fewer features. Empty documents give an empty table, empty targets leave every count of the target at zero.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .flat import Words, crc32_of, joined, texts_of, words_of

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
PLANE_ROWS = 512
_IS_WORD = np.array([48 <= b < 58 or 97 <= b < 123 or b > 127 for b in range(256)])


def features_of(words: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row of the text) of every feature."""
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if longest > 1:
        words = joined(words)
    found, rows = [], []
    for n in range(longest):
        first = np.flatnonzero(of[: len(of) - n] == of[n:])
        found.append(crc32_of(words.data, words.start[first], words.end[first + n]) % np.uint32(buckets))
        rows.append(of[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows)


def bucket_counts(texts: DataFrame, text: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in texts_of(batch.column(0)):
                total += np.bincount(features_of(words_of(data, offsets, _IS_WORD), longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts.select(text.cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from its counts in all documents and in the target."""
    more, less = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * more / ((s + 1) * less))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def planes(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """The gains' bits, lowest first; the last plane is the sign and counts below zero."""
    n = int(max(gains.max(initial=0), -gains.min(initial=0) - 1)).bit_length() + 1
    return planes((gains[None, :] >> np.arange(n)[:, None] & 1).astype(bool))


def sums_of(bucket: np.ndarray, row: np.ndarray, n_rows: int, gains: np.ndarray, buckets: int) -> np.ndarray:
    """The exact sum of gains of each row's features; gains are planes, row doesn't fall."""
    out = np.zeros(n_rows, np.int64)
    value = [1 << j for j in range(len(gains))]
    value[-1] = -value[-1]
    for lo in range(0, n_rows, PLANE_ROWS):
        a, b = np.searchsorted(row, [lo, lo + PLANE_ROWS])
        cells, count = np.unique((row[a:b] - lo) * buckets + bucket[a:b], return_counts=True)
        for k in range(int(count.max(initial=0)).bit_length()):
            own = cells[count >> k & 1 == 1]
            rows, place = np.unique(own // buckets, return_inverse=True)
            bits = np.zeros((len(rows), buckets), bool)
            bits[place, own % buckets] = True
            bits = planes(bits)
            for plane, v in zip(gains, value, strict=True):
                out[lo + rows] += (v << k) * np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64)
    return out


def gumbel_of(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel variable in thousandths, rounded down, from the first 32 bits of the id's SHA-256."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain_planes(gains))
    buckets = len(gains)
    schema = "doc_id long, n_words long, n_features long, weight long, score long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in texts_of(batch.column(1)):
                words = words_of(data, offsets, _IS_WORD)
                bucket, row = features_of(words, longest, buckets)
                order = np.argsort(row, kind="stable") if longest > 1 else slice(None)
                n = np.bincount(row, minlength=hi - lo)
                weight = sums_of(bucket[order], row[order], hi - lo, shared.value, buckets) // np.maximum(n, 1)
                out = [np.diff(words.first), n, weight, weight + np.array([gumbel_of(i, seed) for i in ids[lo:hi]], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), *(pa.array(x.astype(np.int64)) for x in out)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(score, schema)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank to (doc_id, n_words, n_features, weight, score): 1, 2, 3 ... for the drawn share of the documents with enough words, else null."""
    spark = rows.sparkSession
    fit = F.col("n_words") >= least_words
    heights = rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    before = heights["n"].cumsum() - heights["n"]
    draws = int(heights["n"].sum()) * percent // 100
    starts = [(int(s), int(b)) for s, b in zip(heights["score"], before, strict=True) if b < draws]
    if not starts:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    drawn = fit & (F.col("score") >= starts[-1][0])
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(starts, columns=["score", "before"]), "score long, before long"))
    equal = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    top = rows.where(drawn).join(table, "score").withColumn("rank", F.col("before") + F.row_number().over(equal))
    top = top.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).select(*rows.columns, "rank")
    return top.unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, drawn towards the target's texts."""
    gains = gains_of(bucket_counts(docs, F.col(f"`{text_col}`"), longest, buckets), bucket_counts(target, F.col(f"`{target_col}`"), longest, buckets))
    return ranked(written(scored(docs, gains, id_col, text_col, longest, seed), "importance"), percent, least_words)
