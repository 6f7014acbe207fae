"""Phrase collocations by passes with hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k counts the phrases of k words exactly and, on the way, the phrases of
k + 1 words in hashed buckets.  A phrase can only be frequent if both phrases
within it that are one word shorter are, and if its bucket is; both tests are
bitmaps of a fixed number of bits, broadcast to the next pass, and both err on
one side only.  So what they leave is a superset of the frequent phrases, the
exact counts decide, and the size of the bitmaps changes the work, not the rows.

Inside a task no hash decides what is the same phrase: words are places in a
dictionary of their step, phrases pairs of places.  A task hands over its counts
combined, Spark adds them up, and a phrase that a third of all rows hold is one
row a task.  Bucket counts are bytes that stop at 255; they travel in chunks and are added
up as a stream, so that no task holds more than one array of buckets.

Everything is per language.  The best ``top`` phrases of a language are found among
the best ``top`` of each of its salted parts.

Defined results
  * null text: empty.  Null language: ``und``, together with rows that say so.
  * very long texts: whole, each a step of its own.  Repeated rows: each counts.
  * ties: by count, then by the phrase in the order of its bytes.
  * empty table, or no frequent phrase: an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialize, small_batches
from .text import U64, CodedWords, buffer_of, coded_words, mix, span_hashes

#: Bits of a bitmap at least and at most (8 MB); they decide speed, not results.
MIN_BITS, MAX_BITS = 16, 26
CHUNK_BITS = 16
#: Distinct phrases that a task holds before it hands them over.
HELD = 1_000_000
SALTS = 64
ROW = "lang string, phrase string, n bigint, chunk int, cells binary"

KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FACTORS = mix(np.arange(101, 117, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _phrase_hashes(one: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 mean nothing."""
    if k == 1:
        return one
    out = np.zeros(len(one), U64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(one))):
            out[: len(one) - j] += one[j:] * _FACTORS[j]
    return mix(out)


def _has(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> U64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place of each row, distinct languages, their hashes)."""
    coded = column.fill_null("und").dictionary_encode()
    data, offsets = buffer_of(coded.dictionary)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, span_hashes(data, offsets[:-1], offsets[1:])


class _Buckets:
    """Counts of one byte, which stop at 255."""

    def __init__(self, bits: int):
        self.bits, self.cells = bits, np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        place, n = np.unique((hashes >> U64(64 - self.bits)).astype(np.uint32), return_counts=True)
        self.cells[place] = np.minimum(255, self.cells[place] + n)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """The chunks that are not empty, as (place, count) lists where these are shorter."""
        size = min(1 << CHUNK_BITS, len(self.cells))
        for c, part in enumerate(self.cells.reshape(-1, size)):
            at = np.flatnonzero(part)
            if len(at):
                yield c, b"s" + at.astype("<u2").tobytes() + part[at].tobytes() if 3 * len(at) < size else b"d" + part.tobytes()


def _cells(data: bytes, size: int) -> tuple[np.ndarray | slice, np.ndarray]:
    if data[:1] == b"d":
        return slice(None), np.frombuffer(data, np.uint8, offset=1)
    n = (len(data) - 1) // 3
    return np.frombuffer(data, "<u2", n, 1).astype(np.int64), np.frombuffer(data, np.uint8, n, 1 + 2 * n)


def _bitmap(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """The buckets with ``least`` counts or more: 2**bits bits, which is all that reaches the driver."""
    size = 1 << min(bits, CHUNK_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = _cells(data.as_py(), size)
                sums = total.setdefault(c, np.zeros(size, np.uint8))
                sums[at] = np.minimum(255, sums[at].astype(np.uint16) + n)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()], pa.binary())], ["chunk", "cells"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for c, data in rows.where("chunk is not null").select("chunk", "cells").repartition("chunk").mapInArrow(add, "chunk int, cells binary").toLocalIterator():
        out[c * size // 8 : (c + 1) * size // 8] = np.frombuffer(data, np.uint8)
    return out


def _marked(phrases: DataFrame, bits: int, k: int) -> np.ndarray:
    """The bitmap of a table of phrases of k words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits)
        for batch in batches:
            place, _, of = _languages(batch.column(0))
            for words in coded_words(batch.column(1), KIND):
                one = mix(words.hashes() ^ of[place[words.first + words.doc]])
                buckets.add(_phrase_hashes(one, k)[np.cumsum(words.counts) - words.counts])
        yield from _chunk_rows(buckets)

    return _bitmap(phrases.select("lang", "phrase").mapInArrow(mark, ROW), bits, 1)


def _chunk_rows(buckets: _Buckets) -> Iterator[pa.RecordBatch]:
    for c, data in buckets.chunks():
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([data], pa.binary())], ["lang", "phrase", "n", "chunk", "cells"])


def _count_rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.select(["lang", "phrase", "n_sum"]).to_batches(max_chunksize=50_000):
        nothing = [pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *nothing], ["lang", "phrase", "n", "chunk", "cells"])


def _counted(texts: DataFrame, k: int, longest: int, bits: int, shorter: np.ndarray | None, bucket: np.ndarray | None) -> DataFrame:
    """Counts of the phrases of k words that may be frequent, and the buckets of the next length."""
    tests = None if k == 1 else texts.sparkSession.sparkContext.broadcast((shorter, bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits) if k < longest else None
        held: list[pa.Table] = []
        for batch in batches:
            place, names, of = _languages(batch.column(0))
            for words in coded_words(batch.column(1), KIND):
                found = _step(words, place, names, of, buckets)
                if found is not None:
                    held.append(found)
            if sum(len(t) for t in held) > HELD:
                one = _combined(held)
                held = [one.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])]
                if len(one) > HELD // 2:
                    yield from _count_rows(one)
                    held = []
        if held:
            yield from _count_rows(_combined(held))
        if buckets is not None:
            yield from _chunk_rows(buckets)

    def _step(words: CodedWords, place: np.ndarray, names: pa.Array, of: np.ndarray, buckets: _Buckets | None) -> pa.Table | None:
        n = len(words.codes) - k + 1
        if n <= 0:
            return None
        language = place[words.first + words.doc]
        one = mix(words.hashes() ^ of[language])
        ok = words.piece[:n] == words.piece[k - 1 :]
        if tests is not None:
            shorter, bucket = tests.value
            known = _has(shorter, bits, _phrase_hashes(one, k - 1))
            ok &= known[:n] & known[1 : n + 1] & _has(bucket, bits, _phrase_hashes(one, k)[:n])
        if buckets is not None and n > 1:
            longer = np.flatnonzero(ok[:-1] & ok[1:] & (words.piece[: n - 1] == words.piece[k:]))
            buckets.add(_phrase_hashes(one, k + 1)[longer])
        at, _, count = words.distinct_phrases(np.flatnonzero(ok), k, language)
        return pa.table({"lang": names.take(pa.array(language[at])), "phrase": words.spelled(at, k), "n": pa.array(count, pa.int64())})

    def _combined(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")])

    return texts.mapInArrow(run, ROW)


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang", bits: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """([``lang, phrase, n`` of the phrases of 1, 2, ... words found ``least`` times or more], ``lang, n`` of all words)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    if bits is None:
        octets = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(octets / 4 + 1))))
    out, totals, shorter, bucket = [], None, None, None
    for k in range(1, longest + 1):
        raw = materialize(_counted(texts, k, longest, bits, shorter, bucket), f"phrases{k}")
        counts = raw.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found = materialize(counts.where(F.col("n") >= least), f"frequent{k}")
        if k == 1:
            totals = materialize(raw.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        if k < longest:
            bucket = _bitmap(raw, bits, min(least, 255))
            shorter = _marked(found, bits, k)
        discard(raw)
        out.append(found)
    return out, totals


def _part(first, n):
    return F.array_join(F.slice("_w", first, n), " ")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang", bits: int | None = None
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of 2 to ``longest`` words of each language.

    A phrase is found ``a`` times; of its cuts in two, found ``l`` and ``r`` times, the lowest
    floor(1000000 a a / (l r)) counts.  A phrase goes if a longer frequent one around it has
    ``covered`` per cent of its count.  ``top`` None returns every phrase that is left.
    """
    found, totals = frequent_phrases(docs, longest, least, text_col, lang_col, bits)
    parts = reduce(DataFrame.unionByName, found[:-1]).select(F.col("lang").alias("_pl"), F.col("phrase").alias("_pp"), F.col("n").alias("_pn"))
    whole = reduce(DataFrame.unionByName, found[1:]).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = whole.select("lang", "phrase", "a", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("_left"), _part(F.col("k") + 1, F.size("_w") - F.col("k")).alias("_right"))
    for side, name in (("_left", "l"), ("_right", "r")):
        cuts = cuts.join(parts.hint("merge"), (F.col("lang") == F.col("_pl")) & (F.col(side) == F.col("_pp"))).withColumnRenamed("_pn", name).drop("_pl", "_pp", side)
    # Products may pass 64 bits: counts are decimals of 15 digits, products of 38.
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    cuts = cuts.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("cast((_a * _a * cast(1000000 as decimal(7,0))) div (_l * _r) as bigint)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_c"))
    if longest > 2:
        # All runs of 2 to m - 1 words of a phrase of m.
        inner = "flatten(transform(sequence(2, size(_w) - 1), n -> transform(sequence(1, size(_w) - n + 1), i -> array_join(slice(_w, i, n), ' '))))"
        around = whole.where(F.size("_w") > 2).select(F.col("lang").alias("_il"), F.explode(F.expr(inner)).alias("_ip"), "a").groupBy("_il", "_ip").agg(F.max("a").alias("_ia"))
        scored = scored.join(around.hint("merge"), (F.col("lang") == F.col("_il")) & (F.col("phrase") == F.col("_ip")), "left").where(F.col("_ia").isNull() | (F.col("_ia") * 100 < F.col("a") * covered))
    scored = materialize(scored.select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        scored = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top).drop("_r", "_salt")
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    else:
        scored = scored.withColumn("rank", F.lit(None).cast("long"))
    return scored.join(totals.select(F.col("lang").alias("_tl"), F.col("n")), F.col("lang") == F.col("_tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
