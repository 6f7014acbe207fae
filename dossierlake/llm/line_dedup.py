"""Substring deduplication by hashing units of text: lines, paragraphs, or units that the words themselves delimit.

The normal form of a unit is its words, A-Z lower-cased, however they are
spaced.  Digests of units are grouped over the whole corpus, the occurrence with
the smallest (id, offset) stays, and every other one is removed.  Removed spans
keep their offsets in the original text, in code points.

``unit`` says what a unit is:

* ``line`` and ``paragraph`` (lines between blank lines): those with at least
  ``min_words`` words.  A passage that is no line of its own is not found so.
* ``words`` (the default): every run of ``min_words`` words, wherever it begins.
  A run is removed if an earlier place has the same words.  It is the least unit that
  holds all repeated lines, paragraphs and passages of that length.

Runs overlap, one for each word, so they are not listed singly.  The *anchor* of
a run is the least hash of a gram of half as many words in it.  Neighbours with
one anchor form a *stretch*, some 13 runs with all their words, and stretches are
what is hashed and grouped: equal stretches hold equal runs.  Runs that are equal
in unequal stretches, as at the edge of a passage, still share their anchor.  So of
an anchor with stretches of more than one kind the first of each kind is
taken apart into its runs, which are grouped in turn.  The result is that of
comparing all runs with all others.

Counts are combined before the shuffle, and the small side of a join is written
first, so that a very common line or passage is split by the adaptive skew join.
A document is told by its id and a hash of its text.

Defined results
  * null or empty text: no units.  Very long texts: whole.
  * repeats inside one document count like those across documents, if the two
    places do not overlap.
  * repeated rows: rows with the same id and text are one document.  A null id ranks last.
  * texts that repeat a few words over and over: equal neighbouring stretches are one row.
  * empty table: an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .store import discard, materialize, small_batches

MIN_WORDS = 50


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text); the tag tells texts with the same or no id apart."""
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("tag"), docs[text_col].alias("text"))


def _rank(place: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag", place)


def _own(first: str = "first") -> Column:
    """Whether ``first`` lies in the same document."""
    return F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id")) & (F.col("tag") == F.col(f"{first}.tag"))


def _firsts(units: DataFrame, keys: tuple[str, str], place: str, tag: str) -> DataFrame:
    """``units`` whose two keys repeat, with the struct ``first``: the earliest place that has them."""
    names = [f"_{k}" for k in keys]
    first = units.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(_rank(place)).alias("first"), F.count("*").alias("_c"))
    first = materialize(first.where("_c > 1").drop("_c"), tag)
    on = (F.col(keys[0]) == F.col(names[0])) & (F.col(keys[1]) == F.col(names[1]))
    return units.join(first.hint("merge"), on).drop(*names)


# -- lines and paragraphs -----------------------------------------------------


def _lines(part: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) byte spans of the units, without the line breaks."""
    breaks = np.flatnonzero(part == 10)
    if kind == "paragraph" and len(breaks):
        # A break counts if nothing but white space lies between it and the next one.
        solid = np.concatenate(([0], np.cumsum(~X.SPACE[part])))
        blank = solid[breaks[1:]] == solid[breaks[:-1]]
        breaks = breaks[np.concatenate((blank, [False])) | np.concatenate(([False], blank))]
    starts, ends = np.concatenate((at[:-1], breaks + 1)), np.concatenate((at[1:], breaks))
    starts.sort()
    ends.sort()
    doc = np.searchsorted(at, starts, side="right") - 1
    # Empty documents share their start with the next one and have no units.
    keep = ends > starts
    return starts[keep], ends[keep], doc[keep]


def unit_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tag, start, end, n_words, d1, d2) of every line or paragraph with enough words."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.buffer_of(batch.column(2))
            docs_at, out = [], ([], [], [], [], [])
            for a, b in X.steps(offsets):
                raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                u0, u1, doc = _lines(raw, at, kind)
                part = X.LOWER[raw]
                starts, ends, _ = X.word_spans(part, at)
                words = X.span_hashes(part, starts, ends)
                first, last = np.searchsorted(starts, u0), np.searchsorted(starts, u1)
                keep = last - first >= max(1, min_words)
                u0, u1, doc, first, last = u0[keep], u1[keep], doc[keep], first[keep], last[keep]
                if not len(u0):
                    continue
                n = last - first
                cuts = np.cumsum(n) - n
                place = np.arange(n.sum()) - np.repeat(cuts, n)
                index, place = np.repeat(first, n) + place, place.astype(np.uint64)
                with np.errstate(over="ignore"):
                    d1 = np.add.reduceat(X.mix(words[index] + place * np.uint64(0x9E6C63D0676A9A99)), cuts)
                    d2 = np.add.reduceat(X.mix((words[index] ^ np.uint64(0x71D67FFFEDA60000)) + place * np.uint64(0xD1342543DE82EF95)), cuts)
                points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                base = points[at[doc]]
                docs_at.append(a + doc)
                for column, x in zip(out, (points[u0] - base, points[u1] - base, n, d1.view(np.int64), d2.view(np.int64)), strict=True):
                    column.append(x)
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            at = pa.array(join(docs_at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(join(x)) for x in out)], ["doc_id", "tag", "start", "end", "n_words", "d1", "d2"])

    of = docs.schema[id_col].dataType.simpleString()
    return _documents(docs, id_col, text_col).mapInArrow(make, f"doc_id {of}, tag long, start long, end long, n_words long, d1 long, d2 long")


def _unit_spans(docs: DataFrame, id_col: str, text_col: str, kind: str, min_words: int) -> DataFrame:
    units = materialize(unit_digests(docs, id_col, text_col, kind, min_words), "units")
    found = _firsts(units, ("d1", "d2"), "start", "first").where(~(_own() & (F.col("start") == F.col("first.start"))))
    return found.select("doc_id", "tag", "start", "end", "n_words", F.col("first.doc_id").alias("keep_doc_id")).distinct()


# -- runs of words ------------------------------------------------------------


def _steps(column: pa.Array, size: int) -> Iterator[tuple]:
    """(first document, bytes, offsets, word starts, word ends, words per document, hash of n words from i) of each step."""
    data, offsets = X.buffer_of(column)
    for a, b in X.steps(offsets):
        raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        part = X.LOWER[raw]
        starts, ends, counts = X.word_spans(part, at)
        if len(starts) < size:
            continue
        words, (up, down) = X.span_hashes(part, starts, ends), X._powers(len(starts) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))

        def hashed(i, n, total=total, down=down):
            with np.errstate(over="ignore"):
                return X.mix((total[i + n] - total[i]) * down[i] + np.asarray(n).astype(np.uint64))

        yield a, raw, at, starts, ends, counts, hashed


def _stretches(docs: DataFrame, size: int) -> DataFrame:
    """(k, d, doc_id, tag, nth, n, r) of every stretch: anchor, digest, first run, runs, and how often it follows itself.

    docs: doc_id, tag, text.
    """
    gram = (size + 1) // 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, _, starts, _, counts, hashed in _steps(batch.column(2), size):
                doc = np.repeat(np.arange(len(counts)), counts)
                i = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
                if not len(i):
                    continue
                grams = hashed(np.arange(len(starts) - gram + 1), gram)
                least = i + np.lib.stride_tricks.sliding_window_view(grams, size - gram + 1).argmin(1)[i]
                new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[i[1:]] != doc[i[:-1]]))))
                n = np.diff(np.append(new, len(i)))
                key, digest, of, at = grams[least[new]], hashed(i[new], n + size - 1), doc[i[new]], i[new]
                fresh = np.flatnonzero(np.concatenate(([True], (digest[1:] != digest[:-1]) | (key[1:] != key[:-1]) | (of[1:] != of[:-1]))))
                times = np.diff(np.append(fresh, len(n)))
                key, digest, of, at, n = key[fresh], digest[fresh], of[fresh], at[fresh], n[fresh]
                rows, nth = pa.array(a + of), at - (np.cumsum(counts) - counts)[of]
                small = (pa.array(x.astype(np.int32)) for x in (nth, n, times))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), *small], ["k", "d", "doc_id", "tag", "nth", "n", "r"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(make, f"k long, d long, doc_id {of}, tag long, nth int, n int, r int")


def _taken_apart(met: DataFrame, size: int) -> DataFrame:
    """Places of runs from documents with their repeated stretches; met: doc_id, tag, text, found.

    Rows without ``h`` are ``many`` runs that an earlier place has; with it, a
    run that is still to be compared.  Offsets are those of the words of all.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            per, found = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            field = {found.type.field(j).name: found.field(j) for j in range(found.type.num_fields)}
            first_of = np.cumsum(per) - per
            for a, raw, at, starts, ends, counts, hashed in _steps(batch.column(2), size):
                here = slice(int(first_of[a]), int(first_of[a] + per[a : a + len(counts)].sum()))
                doc = np.repeat(np.arange(len(counts)), per[a : a + len(counts)])
                k, nth, n, r, f = (field[c][here].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "nth", "n", "r", "f"))
                several, own = (field[c][here].to_numpy(zero_copy_only=False).astype(bool) for c in ("several", "own"))
                base, points = np.cumsum(counts) - counts, np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                # Places in the first one's document that would overlap it are not removed for it.
                stay = np.where(own, np.clip(-((nth - f - size) // n), 0, r), 0)
                low, high = nth + stay * n, nth + r * n
                cut = np.flatnonzero(high > low)
                cut = cut[np.lexsort((low[cut], doc[cut]))]
                reach = np.maximum.accumulate(high[cut] + doc[cut] * (1 << 40)) if len(cut) else np.zeros(0, np.int64)
                new = np.concatenate(([True], low[cut[1:]] + doc[cut[1:]] * (1 << 40) >= reach[:-1] + size)) if len(cut) else np.zeros(0, bool)
                lead = np.flatnonzero(new)
                last = np.append(lead, len(cut))[1:] - 1
                lead_at, upto = cut[lead], reach[last] & ((1 << 40) - 1)
                # Of an anchor with several kinds of stretches, what stays is compared run by run.
                apart = np.flatnonzero(several & (stay > 0))
                times = stay[apart] * n[apart]
                runs = np.repeat(nth[apart], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                every = np.concatenate((lead_at, np.repeat(apart, times)))
                docs_at = doc[every]
                place = np.concatenate((low[lead_at], runs))
                many = np.concatenate((upto - low[lead_at], np.ones(len(runs), np.int64)))
                word = base[docs_at] + place
                whole = hashed(word[len(lead) :], size).view(np.int64)
                none = np.arange(len(every)) < len(lead)
                start, stop = points[starts[word]] - points[at[docs_at]], points[ends[word + many + size - 2]] - points[at[docs_at]]
                rows = pa.array(a + docs_at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        *(pa.array(x.astype(np.int32)) for x in (place, many, start, stop)),
                        field["keep"][here].take(pa.array(every)),
                        pa.array(np.where(none, 0, k[every]), mask=none),
                        pa.array(np.concatenate((np.zeros(len(lead), np.int64), whole)), mask=none),
                    ],
                    ["doc_id", "tag", "nth", "many", "start", "end", "keep", "k", "h"],
                )

    of = met.schema["doc_id"].dataType.simpleString()
    return met.select("doc_id", "tag", "text", "found").mapInArrow(make, f"doc_id {of}, tag long, nth int, many int, start int, end int, keep {of}, k long, h long")


def _run_spans(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = _documents(docs, id_col, text_col)
    units = _stretches(docs, size)
    # Anchors met more than once, and whether their stretches are of several kinds.
    anchors = units.select("k", "d", "r").groupBy(F.col("k").alias("_k")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("r").alias("c"))
    anchors = materialize(anchors.where("c > 1").select("_k", (F.col("lo") != F.col("hi")).alias("several")), "anchors")
    known = materialize(units.join(anchors.hint("merge"), F.col("k") == F.col("_k")).drop("_k"), "stretches")
    # A stretch met once matters if its anchor has others, so the first of all is kept.
    first = materialize(known.groupBy(F.col("k").alias("_k"), F.col("d").alias("_d")).agg(F.min(_rank("nth")).alias("first")), "first")
    each = known.join(first.hint("merge"), (F.col("k") == F.col("_k")) & (F.col("d") == F.col("_d")))
    each = each.select("doc_id", "tag", F.struct("k", "nth", "n", "r", "several", _own().alias("own"), F.col("first.nth").alias("f"), F.col("first.doc_id").alias("keep")).alias("one"))
    found = each.groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set("one").alias("found"))
    met = docs.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    places = materialize(_taken_apart(met, size), "places")
    for table in (anchors, known, first):
        discard(table)
    runs = _firsts(places.where("h is not null"), ("k", "h"), "nth", "runs")
    runs = runs.where(~_own() | (F.col("nth") - F.col("first.nth") >= size)).withColumn("keep", F.col("first.doc_id"))
    cut = places.where("h is null").select("doc_id", "tag", "nth", "many", "start", "end", "keep").unionByName(runs.select("doc_id", "tag", "nth", "many", "start", "end", "keep"))
    # Runs that overlap or touch are one span.
    upto = F.col("nth") + F.col("many") + (size - 1)
    by = Window.partitionBy("doc_id", "tag").orderBy("nth")
    cut = cut.withColumn("upto", upto).withColumn("reach", F.max("upto").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    cut = cut.withColumn("span", F.sum((F.col("reach").isNull() | (F.col("nth") > F.col("reach"))).cast("int")).over(by))
    out = cut.groupBy("doc_id", "tag", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("upto") - F.min("nth")).alias("n_words"), F.min_by("keep", F.struct("nth", "many")).alias("keep_doc_id"))
    return out.select("doc_id", "tag", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words")), "keep_doc_id")


def _spans(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    if unit not in ("words", "line", "paragraph"):
        raise ValueError(f"no unit {unit}")
    return _run_spans(docs, id_col, text_col, min_words) if unit == "words" else _unit_spans(docs, id_col, text_col, unit, min_words)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "words", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed span: ``doc_id, start, end, n_words, keep_doc_id``.

    ``keep_doc_id`` has an earlier place of the span's first unit; parts of a long
    span may be kept in several documents.
    """
    return _spans(docs, id_col, text_col, unit, min_words).drop("tag")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "words", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text, kept``: the text without its removed spans, and the kept (start, end) spans of the original."""
    place = F.struct(F.col("start"), F.col("end"))
    spans = _spans(docs, id_col, text_col, unit, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.array_sort(F.collect_set(place)).alias("cut"))
    own = _documents(docs, id_col, text_col).select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("t"))
    joined = own.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    joined = joined.select("doc_id", "t", F.coalesce("cut", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("cut"))
    edge = lambda at: F.array(F.struct(at.cast("long").alias("start"), at.cast("long").alias("end")))
    edges = F.concat(edge(F.lit(0)), F.col("cut"), edge(F.length("t")))
    # What lies between two cuts stays.
    kept = F.filter(F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end"))), lambda s: s["end"] > s["start"])
    part = lambda s: F.substring(F.col("t"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return joined.withColumn("kept", kept).select("doc_id", F.array_join(F.transform("kept", part), "").alias("text"), "kept")
