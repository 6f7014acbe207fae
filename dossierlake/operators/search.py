"""A stored inverted index: posting lists in Parquet, read by the buckets of the words asked for.

A segment is what one batch adds: ``segment=<n>/bucket=<b>`` holds one row for each word
and block of ids, with the ids, how often and where the word occurs, as gaps in
bytes.  A word's bucket is a hash of it, so a search names its buckets as literals and
the scan opens no others; within them the word is a pushed filter.  A word that every
document has is as many rows as there are blocks, so no row grows with the corpus.

All words of a query are met block by block: blocks that lack one of them are dropped
by a grouped count before anything is decoded, and a block's lists are intersected
as arrays.  A document that a later segment holds again is answered from there alone.

A document id is an integer.  Null texts have no words, and null ids are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Ids of one block.
BLOCK = 8192
#: Hits that a task turns into posting lists at a time, and of those the hits that are encoded at a time.
HELD = 1 << 20
ENCODED = 1 << 18
POSTINGS = "token string, block bigint, n_docs bigint, n_hits bigint, postings binary"
LAYOUT = f"{POSTINGS}, segment bigint, bucket int"
#: What is shuffled: the lists of all words of a bucket and block that a task had at a time.  ``numbers`` are five of each list.
PARTIAL = "bucket int, block bigint, tokens string, n_hits bigint, numbers binary, postings binary"
#: Bytes of lower-cased words (1): letters and digits of ASCII, and all beyond it.
INSIDE = bytes(b > 127 or chr(b).isalnum() for b in range(256))
OUTSIDE = bytes(b for b in range(256) if not INSIDE[b])


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token), F.lit(buckets)).cast("int")


def plain(text: Column) -> Column:
    """Lower-cased text in which the words of ``functions.text.tokens`` are the runs of ``INSIDE``; texts of ASCII alone meet no pattern."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.regexp_replace(low, r"[^\x00-\x7F\p{L}\p{N}]+", " "))


def to_bytes(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, end of each): non-negative integers, seven bits a byte, the last byte of each without its high bit."""
    numbers = np.asarray(numbers)
    numbers = numbers.astype(np.uint64 if int(numbers.max(initial=0)) >> 32 else np.uint32, copy=False)
    more = np.flatnonzero(numbers > 127)
    long = numbers[more]
    size = np.ones(len(more), np.int64)
    for k in range(1, -(-int(long.max(initial=0)).bit_length() // 7)):
        size += long >> (7 * k) != 0
    step = np.ones(len(numbers), np.uint8)
    step[more] = size
    ends = np.cumsum(step, dtype=np.int64)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = numbers.astype(np.uint8)
    # Most numbers are a byte; the others are written over theirs.
    starts = ends[more] - size
    k = 0
    while len(long):
        out[starts + k] = (long >> (7 * k) & 127).astype(np.uint8) | ((size > k + 1).astype(np.uint8) << 7)
        k += 1
        has = size > k
        long, starts, size = long[has], starts[has], size[has]
    return out.tobytes(), ends


def from_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = (raw[starts] & 127).astype(np.int64)
    more, k = np.flatnonzero(ends > starts), 1
    while len(more):
        out[more] |= (raw[starts[more] + k] & 127).astype(np.int64) << 7 * k
        more, k = more[ends[more] - starts[more] > k], k + 1
    return out


def _taken(source: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of each): pieces of ``source`` behind each other."""
    ends = np.cumsum(size)
    at = ends - size
    return source[np.repeat(starts - at, size) + np.arange(ends[-1] if len(ends) else 0)], at


def _encoded(heads: np.ndarray, ids: np.ndarray, places: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(posting lists behind each other, where they are cut, documents in each) of hits sorted by (list, id, place); ``heads`` are the first hits of the lists, ids count from ``first``.

    A list: number of documents, gaps of ids, counts, gaps of places within a document.
    """
    hits = np.diff(np.append(heads, len(ids)))
    new = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    new[heads] = True
    docs = np.flatnonzero(new)
    n = np.add.reduceat(new, heads, dtype=np.int64)
    of, first_doc = np.repeat(np.arange(len(heads)), n), np.cumsum(n) - n
    gaps = np.diff(ids[docs], prepend=0)
    gaps[first_doc] = ids[docs][first_doc] - first
    steps = places.copy()
    steps[1:] -= places[:-1]
    steps[docs] = places[docs]
    size = 1 + 2 * n + hits
    base = np.cumsum(size) - size
    out = np.empty(size.sum(), np.int64 if int(gaps.max(initial=0)) >> 31 else np.int32)
    out[base] = n
    at = (base + 1 - first_doc)[of] + np.arange(len(docs))
    out[at] = gaps
    at += n[of]
    out[at] = np.diff(np.append(docs, len(ids)))
    out[np.repeat(base + 1 + 2 * n - heads, hits) + np.arange(len(ids))] = steps
    data, ends = to_bytes(out)
    return data, np.concatenate(([0], ends[base + size - 1])), n


def encoded(heads: np.ndarray, ids: np.ndarray, places: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The same with the lists apart."""
    data, cuts, n = _encoded(heads, ids, places, first)
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], n


def decoded(data: bytes, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, counts, places): the documents, how often each has the word, and where."""
    numbers = from_bytes(data)
    n = int(numbers[0])
    docs, counts, gaps = np.cumsum(numbers[1 : 1 + n]) + first, numbers[1 + n : 1 + 2 * n], numbers[1 + 2 * n :]
    total = np.cumsum(gaps)
    heads = np.cumsum(counts) - counts
    return docs, counts, total - np.repeat(total[heads] - gaps[heads], counts)


def decoded_all(lists: pa.Array, n_docs: np.ndarray, n_hits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, id, place) of every hit of many lists at once."""
    numbers = from_bytes(b"".join(lists.to_pylist()))
    size = 1 + 2 * n_docs + n_hits
    base = np.cumsum(size) - size
    of, first_doc = np.repeat(np.arange(len(size)), n_docs), np.cumsum(n_docs) - n_docs
    at = base[of] + 1 + np.arange(len(of)) - first_doc[of]
    run = np.cumsum(numbers[at])
    ids = run - (run[first_doc] - numbers[at][first_doc])[of] + first[of]
    counts = numbers[at + n_docs[of]]
    own, first_hit = np.repeat(np.arange(len(size)), n_hits), np.cumsum(n_hits) - n_hits
    gaps = numbers[base[own] + 1 + 2 * n_docs[own] + np.arange(len(own)) - first_hit[own]]
    total, heads = np.cumsum(gaps), np.cumsum(counts) - counts
    return own, np.repeat(ids, counts), total - np.repeat(total[heads] - gaps[heads], counts)


def _lists(tokens: pa.Array, k: np.ndarray, heads: np.ndarray, ids: np.ndarray, places: np.ndarray, block: int) -> pa.RecordBatch:
    """The lists of sorted hits as rows; ``tokens`` and blocks ``k`` are those of the lists."""
    data, cuts, n = _encoded(heads, ids, places, k * block)
    lists = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([tokens, pa.array(k), pa.array(n), pa.array(np.diff(np.append(heads, len(ids)))), lists], ["token", "block", "n_docs", "n_hits", "postings"])


def _heads(rows: pa.Table) -> np.ndarray:
    """Where the word or the block of sorted rows changes."""
    token, k = rows["token"].combine_chunks(), rows["block"].to_numpy()
    changed = pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False) | (k[1:] != k[:-1])
    return np.concatenate(([0], np.flatnonzero(changed) + 1))


def _packed(hits: DataFrame, block: int) -> DataFrame:
    """Hits (token, block, id, place) to posting lists: sorted within partitions and read as a stream, a list at a time at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: pa.Table, heads: np.ndarray) -> pa.RecordBatch:
            tokens = rows["token"].take(pa.array(heads)).combine_chunks()
            return _lists(tokens, rows["block"].to_numpy()[heads], heads, rows["id"].to_numpy(), rows["place"].to_numpy().astype(np.int64), block)

        # What is held is cut only where it has doubled, so that a long list is not looked at for each batch.
        held: list[pa.RecordBatch] = []
        size, limit = 0, 1 << 16
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < limit:
                continue
            rows = pa.Table.from_batches(held)
            heads = _heads(rows)
            if len(heads) > 1:
                yield lists(rows.slice(0, heads[-1]), heads[:-1])
            held = rows.slice(heads[-1]).combine_chunks().to_batches()
            size = len(rows) - int(heads[-1])
            limit = max(1 << 16, 2 * size)
        if held:
            rows = pa.Table.from_batches(held)
            yield lists(rows, _heads(rows))

    return hits.select("token", "block", "id", "place").repartition("token", "block").sortWithinPartitions("token", "block", "id", "place").mapInArrow(pack, POSTINGS)


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, how many of each): the runs of ``INSIDE`` in texts, behind each other."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]].tobytes()
    bounds -= bounds[0]
    inside = np.frombuffer(data.translate(INSIDE), bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]
    edges = bounds[:-1][full], bounds[1:][full] - 1
    first[edges[0]], last[edges[1]] = inside[edges[0]], inside[edges[1]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    length = np.diff(np.searchsorted(starts, bounds))
    ends -= starts - 1
    ends = np.append(0, np.cumsum(ends)).astype(np.int32)
    data = data.translate(None, OUTSIDE)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), length


def _inverted(kept: list[tuple[np.ndarray, pa.Array, np.ndarray]], block: int, buckets: int) -> pa.RecordBatch:
    """Texts (ids, words, how many of each) to a row for each bucket and block."""
    of, length = np.concatenate([x[0] for x in kept]), np.concatenate([x[2] for x in kept])
    coded = pa.chunked_array([x[1] for x in kept]).combine_chunks().dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary
    if (np.diff(of) < 0).any():
        texts = np.argsort(of, kind="stable")
        code, _ = _taken(code, (np.cumsum(length) - length)[texts], length[texts])
        of, length = of[texts], length[texts]
    # Words by bucket; hits are in the order of their ids and places already, so that they are sorted with their numbers as one integer.
    bucket = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(words)) % buckets
    by = np.argsort(bucket, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) << 32
    key = rank[code]
    key |= np.arange(len(code))
    key.sort()
    start, text = np.cumsum(length) - length, np.repeat(np.arange(len(of), dtype=np.int32), length)
    if (np.diff(of) == 0).any():
        # Two texts of one id are merged.
        order = key & 0xFFFFFFFF
        at = text[order]
        key = key[np.lexsort((order - start[at], of[at], key >> 32))]
    new = np.ones(len(key), bool)
    np.not_equal((key[1:] ^ key[:-1]) >> 32, 0, out=new[1:])
    if of[0] // block != of[-1] // block:
        k = (of // block)[text[key & 0xFFFFFFFF]]
        new[1:] |= k[1:] != k[:-1]
    heads = np.flatnonzero(new)
    code, k = by[key[heads] >> 32], of[text[key[heads] & 0xFFFFFFFF]] // block
    ends = np.append(heads[1:], len(key))
    # Encoded some lists at a time, whose arrays stay in the cache.
    edges = np.unique(np.append(np.searchsorted(heads, np.arange(0, len(key), ENCODED)), len(heads)))
    parts, numbers = [], np.empty((len(heads), 5), np.int64)
    for x, y in zip(edges, edges[1:], strict=False):
        order = key[heads[x] : ends[y - 1]] & 0xFFFFFFFF
        at = text[order]
        ids, own = of[at], heads[x:y] - heads[x]
        data, cuts, n = _encoded(own, ids, (order - start[at]).astype(np.int32), k[x:y] * block)
        low, high = ids[own], ids[ends[x:y] - heads[x] - 1]
        numbers[x:y] = np.stack((n, ends[x:y] - heads[x:y], low - k[x:y] * block, high - low, np.diff(cuts)), 1)
        parts.append(data)
    data, b, cuts = np.frombuffer(b"".join(parts), np.uint8), bucket[code], np.cumsum(numbers[:, 4]) - numbers[:, 4]
    if k.min() < k.max():
        order = np.lexsort((k, b))
        data, _ = _taken(data, cuts[order], numbers[order, 4])
        code, k, b, numbers = code[order], k[order], b[order], numbers[order]
    heads = np.concatenate(([0], np.flatnonzero((np.diff(b) != 0) | (np.diff(k) != 0)) + 1))
    ends = np.append(heads, len(k))
    tokens = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.take(pa.array(code))), " ")
    coded, at = to_bytes(numbers.ravel())
    at, cuts = np.append(0, at)[5 * ends], np.append(0, np.cumsum(numbers[:, 4]))[ends]
    binary = lambda cuts, data: pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    columns = [pa.array(b[heads], pa.int32()), pa.array(k[heads]), tokens, pa.array(np.add.reduceat(numbers[:, 1], heads)), binary(at, coded), binary(cuts, data)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "tokens", "n_hits", "numbers", "postings"])


def _partial(texts: DataFrame, block: int, held: int, buckets: int) -> DataFrame:
    """Texts (id, text) to posting lists of what a task has read at a time, so that lists are shuffled and not hits, and those of a bucket and block as one row."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        hits = 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                words, length = _cut(some["text"].cast(pa.string()))
                if hits and hits + len(words) > held:
                    yield _inverted(kept, block, buckets)
                    kept, hits = [], 0
                if len(words):
                    kept.append((some["id"].to_numpy(), words, length))
                    hits += len(words)
        if hits:
            yield _inverted(kept, block, buckets)

    return texts.select("id", "text").mapInArrow(invert, PARTIAL)


def chained(data: np.ndarray, numbers: np.ndarray, heads: np.ndarray, order: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists, where they are cut, documents in each): the lists of one word and block joined; ``order`` names the lists in ``data`` by word, block and lowest id, ``heads`` the first of each join.

    Where one list ends before the next begins, they are joined as bytes: only the first gap of ids changes.
    Lists are decoded only where their documents overlap.
    """
    size = numbers[:, 4]
    at = (np.cumsum(size) - size)[order]
    width = 1 + 2 * numbers[:, 0] + numbers[:, 1]
    base = (np.cumsum(width) - width)[order]
    n, hits, low, span, size = numbers[order].T
    high = low + span
    parts = np.diff(np.append(heads, len(order)))
    own = np.repeat(np.arange(len(heads)), parts)
    mixed = np.zeros(len(heads), bool)
    mixed[own[1:][(own[1:] == own[:-1]) & (low[1:] <= high[:-1])]] = True
    chain = (parts > 1) & ~mixed
    # Pieces of a joined list: its number of documents, then gaps (the first apart), counts and places of every part.
    slots = np.where(chain, 1 + 4 * parts, 1)
    slot = np.cumsum(slots) - slots
    starts, length = np.empty(slots.sum(), np.int64), np.empty(slots.sum(), np.int64)
    one = parts == 1
    starts[slot[one]], length[slot[one]] = at[heads[one]], size[heads[one]]
    source = [data]
    c = np.flatnonzero(chain[own])
    if len(c):
        ends = np.flatnonzero(data < 128) + 1
        g, b = own[c], base[c]
        r = c - heads[g]
        gaps = np.where(r == 0, low[c], low[c] - high[c - 1])
        new, stop = to_bytes(np.concatenate((np.add.reduceat(n, heads)[chain], gaps)))
        source.append(np.frombuffer(new, np.uint8))
        start, stop = np.append(0, stop[:-1]) + len(data), stop + len(data)
        m = int(chain.sum())
        p = slot[g] + 1
        cut = [ends[b + 1], ends[b + n[c]], ends[b + 2 * n[c]], at[c] + size[c]]
        for to, x, y in (
            (slot[chain], start[:m], stop[:m]),
            (p + 2 * r, start[m:], stop[m:]),
            (p + 2 * r + 1, cut[0], cut[1]),
            (p + 2 * parts[g] + r, cut[1], cut[2]),
            (p + 3 * parts[g] + r, cut[2], cut[3]),
        ):
            starts[to], length[to] = x, y - x
    if mixed.any():
        c = np.flatnonzero(mixed[own])
        some, cuts = _taken(data, at[c], size[c])
        lists = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(np.append(cuts, len(some)).astype(np.int32)), pa.py_buffer(some)])
        which, ids, places = decoded_all(lists, n[c], hits[c], first[own[c]])
        group = own[c][which]
        sort = np.lexsort((places, ids, group))
        group, ids, places = group[sort], ids[sort], places[sort]
        new, cuts, joined = _encoded(np.flatnonzero(np.diff(group, prepend=-1)), ids, places, first[mixed])
        starts[slot[mixed]], length[slot[mixed]] = cuts[:-1] + sum(map(len, source)), np.diff(cuts)
        source.append(np.frombuffer(new, np.uint8))
    total = np.add.reduceat(n, heads)
    if mixed.any():
        total[mixed] = joined  # a document may be in two lists
    out, begin = _taken(np.concatenate(source) if len(source) > 1 else data, starts, length)
    return out, np.append(begin[slot], len(out)), total


def _joined(partial: DataFrame, block: int, held: int) -> DataFrame:
    """Lists of one word and block joined; a bucket is dealt out by eights of blocks, so that no part of it grows with the corpus.  One shuffle, of lists.

    All lists of a bucket and block are met in a task, which has no more of them than the texts of a block give.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            words = pc.split_pattern(rows["tokens"], " ").combine_chunks()
            of = np.repeat(np.arange(len(rows)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            coded = pc.list_flatten(words).dictionary_encode()
            code, known = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            numbers = from_bytes(b"".join(rows["numbers"].to_pylist())).reshape(-1, 5)
            data = np.frombuffer(b"".join(rows["postings"].to_pylist()), np.uint8)
            key = group[of] * known + code
            order = np.lexsort((numbers[:, 2], key))
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            k = rows["block"].to_numpy()[of[order[heads]]]
            out, cuts, n = chained(data, numbers, heads, order, k * block)
            joined = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(out)])
            hits = np.add.reduceat(numbers[order, 1], heads)
            return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order[heads]])), pa.array(k), pa.array(n), pa.array(hits), joined], ["token", "block", "n_docs", "n_hits", "postings"])

        def groups(rows: pa.Table) -> np.ndarray:
            b, k = rows["bucket"].to_numpy(), rows["block"].to_numpy()
            return np.cumsum(np.concatenate(([0], (b[1:] != b[:-1]) | (k[1:] != k[:-1]))))

        kept: list[pa.RecordBatch] = []
        hits, limit = 0, held
        for batch in batches:
            for at in range(len(batch)):
                kept.append(batch.slice(at, 1))
                hits += batch["n_hits"][at].as_py()
                if hits < limit:
                    continue
                rows = pa.Table.from_batches(kept)
                group = groups(rows)
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield lists(rows.slice(0, whole), group[:whole])
                kept = kept[whole:]
                hits = sum(x["n_hits"][0].as_py() for x in kept)
                limit = max(held, 2 * hits)
        if kept:
            rows = pa.Table.from_batches(kept)
            yield lists(rows, groups(rows))

    spread = partial.repartition("bucket", F.shiftright("block", 3))
    return spread.sortWithinPartitions("bucket", "block").mapInArrow(join, POSTINGS)


def postings(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, held: int = HELD, buckets: int = BUCKETS) -> DataFrame:
    """One row for each word and block of ids."""
    words = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), plain(F.col(text_col)).alias("text"))
    return _joined(_partial(words, block, held, buckets), block, held)


def add_segment(texts: DataFrame, path: str, segment: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Write what a batch adds; a batch that is tried again writes the same segment anew.

    Ids that earlier segments have are noted apart, so that a search need not look at all of them.
    """
    # Lists of one bucket may be many: its files are cut by their blocks, as the shuffle of lists is.
    rows = postings(texts, id_col, text_col, block, buckets=buckets).withColumn("bucket", bucket_of(F.col("token"), buckets))
    rows = rows.sortWithinPartitions("bucket", "token", "block")
    # Words and lists hardly recur in a file.
    to = rows.write.mode("overwrite").option("parquet.enable.dictionary#token", "false").option("parquet.enable.dictionary#postings", "false")
    to.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    own = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    own.join(_ids(texts.sparkSession, path, "documents").where(F.col("segment") < segment), "id", "left_semi").write.mode("overwrite").parquet(f"{path}/replaced/segment={segment}")
    own.write.mode("overwrite").parquet(f"{path}/documents/segment={segment}")


def _ids(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``id, segment`` of the documents, or of those that a later segment has again."""
    try:
        return spark.read.schema("id bigint, segment bigint").option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select("id", F.col("id").alias("segment"))


def index_stream(texts: DataFrame, path: str, checkpoint: str, **how):
    """Add each batch of a stream as a segment of its own number."""
    return texts.writeStream.foreachBatch(lambda rows, n: add_segment(rows, path, n, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The posting lists of an index."""
    return spark.read.schema(LAYOUT).option("basePath", f"{path}/postings").parquet(f"{path}/postings")


def lists_of(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The rows of some words; the scan opens their buckets alone."""
    where = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(bucket_of(F.col("w"), buckets)).collect()})
    return stored(spark, path).where(F.col("bucket").isin(where) & F.col("token").isin(words))


def search(spark: SparkSession, path: str, query: list[str], phrase: bool = False, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """``id, hits`` of the documents that have every word of ``query``, next to each other if a ``phrase``; no words find nothing."""
    words = list(dict.fromkeys(query))
    if not words:
        return spark.createDataFrame([], "id bigint, hits bigint")
    rows = lists_of(spark, path, words, buckets)
    # As many rows a group as the query has words.
    met = rows.groupBy("segment", "block").agg(F.collect_list(F.struct("token", "postings")).alias("lists")).where(F.size("lists") == len(words))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, k, lists in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                of = {x["token"]: decoded(x["postings"], k * block) for x in lists}
                ids = of[words[0]][0]
                for w in words[1:]:
                    ids = np.intersect1d(ids, of[w][0], assume_unique=True)
                if phrase and len(ids):
                    spots = None
                    for shift, w in enumerate(query):
                        docs, counts, places = of[w]
                        here = np.stack((np.repeat(docs, counts), places - shift), 1)
                        here = here[np.isin(here[:, 0], ids)]
                        keys = here[:, 0] - k * block << 40 | here[:, 1] + len(query)
                        spots = keys if spots is None else np.intersect1d(spots, keys)
                    ids, hits = np.unique((spots >> 40) + k * block, return_counts=True)
                else:
                    hits = np.zeros(len(ids), np.int64)
                    for docs, counts, _ in of.values():
                        hits += counts[np.searchsorted(docs, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), segment), pa.int64()), pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], ["segment", "id", "hits"])

    found = met.mapInArrow(meet, "segment bigint, id bigint, hits bigint")
    later = _ids(spark, path, "replaced").select(F.col("id").alias("_id"), F.col("segment").alias("_s"))
    return found.join(later, (F.col("id") == F.col("_id")) & (F.col("_s") > F.col("segment")), "left_anti").select("id", "hits")


def compacted(spark: SparkSession, path: str, target: str, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """All segments as one, in another folder: of each document the newest, lists of one word and block joined."""
    newest = _ids(spark, path, "documents").groupBy("id").agg(F.max("segment").alias("segment"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, k, segment, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                docs, counts, places = decoded(data, k * block)
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([token] * n, pa.string()), pa.array(np.full(n, k)), pa.array(np.full(n, segment)), pa.array(np.repeat(docs, counts)), pa.array(places, pa.int32())], ["token", "block", "segment", "id", "place"])

    hits = stored(spark, path).select("token", "block", "segment", "postings").mapInArrow(unpack, "token string, block bigint, segment bigint, id bigint, place int")
    kept = hits.join(newest, ["id", "segment"], "left_semi")
    joined = _packed(kept, block).withColumn("bucket", bucket_of(F.col("token"), buckets))
    joined.repartition("bucket", F.pmod(F.hash("token", "block"), F.lit(4))).write.partitionBy("bucket").parquet(f"{target}/postings/segment=0")
    newest.select("id").write.parquet(f"{target}/documents/segment=0")
