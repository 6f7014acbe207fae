"""Importance resampling towards a target by hashed n-gram features and Gumbel noise.

Two counting passes give each bucket of features its gain, the log ratio of its
share of the target to its share of the documents.  A third pass scores the
documents: the buckets of a step of documents are one array, their gains another,
and the weights differences of its running sum.  With Gumbel noise from a digest
of the id, the highest scores are a draw without replacement.

The draw needs no sort of all documents.  Score and id make one key of bytes, in
falling order of scores, and the k-th key is found digit by digit: a grouped count
of the next two bytes, at most 65,536 rows, tells in which digit it lies, and
only the keys with that digit stay for the next step.  A score that a third of all
documents share costs steps, not skew, since counts combine before their shuffle.
Only what is drawn is range-sorted; its ranks are places within a range, plus the sizes of the ranges before.

Defined results
  * null text: no features, weight 0.  Very long texts: whole.
  * null id: digests as the empty text, and comes after all others of its score.
  * repeated rows: each is scored; of rows with one id and score it is open which is drawn first.
  * fewer documents with ``min_words`` words than make one draw, or none: no ranks.
  * empty target: all gains come from the documents alone.  Empty table: an empty result.
  * extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, small_batches
from .text import CodedWords, coded_words

BUCKETS = 10_000
#: Bytes of one digit of the radix selection.
DIGIT = 2

KIND = np.ones(256, np.uint8)
KIND[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 0


def _buckets(words: CodedWords, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the features of each length."""
    for n in range(1, longest + 1):
        at = np.arange(len(words.codes) - n + 1) if n == 1 else np.flatnonzero(words.piece[: 1 - n] == words.piece[n - 1 :])
        if len(at):
            if n == 1:
                spelled, which = words.distinct.to_pylist(), words.codes
            else:
                first, which, _ = words.distinct_phrases(at, n)
                spelled = words.spelled(first, n).cast(pa.binary()).to_pylist()
            own = np.fromiter((zlib.crc32(x) % buckets for x in spelled), np.int64, len(spelled))
            yield words.doc[at], own[which]


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in coded_words(batch.column(0), KIND):
                for _, own in _buckets(words, longest, buckets):
                    total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of the shares of each bucket."""
    n, s, t = len(documents), int(documents.sum()), int(target.sum())
    ratios = ((target + 1).astype(float) * float(s + n)) / ((documents + 1).astype(float) * float(t + n))
    # math.log, as vectorised logarithms may differ in the last bit.
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def noise(name: str, seed: int) -> int:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a digest of ``seed:name``."""
    import hashlib

    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for words in coded_words(batch.column(2), KIND):
                a, b = words.first, words.last
                n_words[a:b] = words.counts
                for doc, own in _buckets(words, longest, len(gain)):
                    edges = np.searchsorted(doc, np.arange(b - a + 1))
                    sums = np.concatenate(([0], np.cumsum(gain[own])))
                    weight[a:b] += sums[edges[1:]] - sums[edges[:-1]]
                    n_features[a:b] += np.diff(edges)
            weight //= np.maximum(1, n_features)
            score = weight + np.array([noise(x or "", seed) for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_i"), F.col(id_col).cast("string").alias("_s"), text_col).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _big_endian(number: Column) -> Column:
    """Eight bytes whose order is that of the numbers."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def draw_key(score: Column, name: Column, row: Column, integral: bool) -> Column:
    """Bytes in the order of the draw: falling scores, rising ids, nulls last, rows."""
    own = _big_endian(name.cast("long")) if integral else F.concat(name.cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.concat(_big_endian(F.bitwise_not(score)), F.when(name.isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), own)), _big_endian(row))


def kth_key(keys: DataFrame, k: int) -> bytes | None:
    """The k-th smallest of ``key``, by the counts of one digit after another; None if there are fewer.

    Keys must differ, and none may be the beginning of another.
    """
    if k < 1:
        return None
    ends = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if ends[2] < k:
        return None
    left, n, wanted, at = keys.select("key"), ends[2], k, 0
    low, high = bytes(ends[0]), bytes(ends[1])
    while n > 1 and wanted < n:
        # The digits that all keys share need no counting.
        while low[at : at + DIGIT] == high[at : at + DIGIT]:
            if at >= len(low):
                raise ValueError("keys are not distinct")
            at += DIGIT
        digit = F.substring("key", at + 1, DIGIT)
        per = left.groupBy(digit.alias("d")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for row in sorted(per, key=lambda r: bytes(r.d)):
            if wanted <= row.n:
                break
            wanted -= row.n
        left, n, low, high = materialize(left.where(digit == F.lit(bytes(row.d))), "keys"), row.n, bytes(row.low), bytes(row.high)
        at += DIGIT
    return high


def ranked(drawn: DataFrame) -> DataFrame:
    """``drawn`` in ranges of ``key``, with ``rank`` from 1."""
    cut = materialize(drawn.repartitionByRange("key").withColumn("_slice", F.spark_partition_id()), "drawn")
    sizes = cut.groupBy(F.col("_slice").alias("_s")).agg(F.count("*").alias("_c"))
    # One row for each range.
    before = materialize(sizes.select("_s", (F.sum("_c").over(Window.orderBy("_s")) - F.col("_c")).alias("_before")), "ranges")
    own = F.row_number().over(Window.partitionBy("_slice").orderBy("key"))
    return cut.withColumn("_own", own).join(before, F.col("_slice") == F.col("_s")).withColumn("rank", F.col("_own") + F.col("_before")).drop("_slice", "_own", "_s", "_before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; rank is null if it isn't drawn.

    ``percent`` of the documents with at least ``min_words`` words are drawn.
    """
    small_batches(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    row, integral = F.monotonically_increasing_id(), docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rows = materialize(scored(docs, gain, id_col, text_col, longest, seed).withColumn("key", draw_key(F.col("score"), F.col("doc_id"), row, integral)), "weights")
    able = rows.where(F.col("n_words") >= min_words)
    last = kth_key(able, percent * able.count() // 100)
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*out, none)
    taken = (F.col("n_words") >= min_words) & (F.col("key") <= F.lit(last))
    return rows.where(~taken).select(*out, none).unionByName(ranked(rows.where(taken)).select(*out, F.col("rank").cast("long")))
