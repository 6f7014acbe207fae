"""The stored index and headlines against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossierlake.functions import text as X
from dossierlake.operators import search as S


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def corpus(seed, ids):
    rng = random.Random(seed)
    some = ["alpha", "beta", "gamma", "delta", "the", "of", "é", "Über", "x1"]
    return [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(40))) or None) for i in ids]


def expected(rows, query, phrase=False):
    out = {}
    for i, text in rows.items():
        w = words_of(text)
        if phrase:
            n = sum(w[k : k + len(query)] == query for k in range(len(w)))
        else:
            n = sum(x in query for x in w) if set(query) <= set(w) else 0
        if n:
            out[i] = n
    return out


def test_bytes_round_trip():
    rng = np.random.default_rng(1)
    numbers = np.concatenate(([0, 1, 127, 128, 16383, 16384, 2**62], rng.integers(0, 2**40, 500)))
    data, ends = S.to_bytes(numbers)
    assert (S.from_bytes(data) == numbers).all() and ends[-1] == len(data)
    assert len(S.from_bytes(b"")) == 0
    heads, ids = np.array([0, 3, 4]), np.array([5, 5, 900, 7, 5000, 5000, 8000])
    places = np.array([0, 130, 2, 0, 3, 4, 1_000_000])
    lists, n = S.encoded(heads, ids, places, np.array([0, 0, 4096]))
    assert n.tolist() == [2, 1, 2]
    for k, (a, b) in enumerate(((0, 3), (3, 4), (4, 7))):
        docs, counts, found = S.decoded(lists[k], (0, 0, 4096)[k])
        assert np.repeat(docs, counts).tolist() == ids[a:b].tolist() and found.tolist() == places[a:b].tolist()


def test_lists_are_read_together():
    heads, ids = np.array([0, 3, 4]), np.array([5, 5, 900, 7, 5000, 5000, 8000])
    places, first = np.array([0, 130, 2, 0, 3, 4, 1_000_000]), np.array([0, 0, 4096])
    lists, n = S.encoded(heads, ids, places, first)
    own, got, at = S.decoded_all(pa.array(lists, pa.binary()), n, np.array([3, 1, 3]), first)
    assert own.tolist() == [0, 0, 0, 1, 2, 2, 2] and got.tolist() == ids.tolist() and at.tolist() == places.tolist()


@pytest.mark.parametrize("block", [8192, 7])
def test_searches_equal_brute_force(spark, tmp_path, block):
    path = str(tmp_path / "index")
    first, second = corpus(1, range(0, 300)), corpus(2, [*range(250, 400), -5, 10**12])
    schema = "doc_id long, text string"
    S.add_segment(spark.createDataFrame([*first, (None, "alpha beta")], schema), path, 0, buckets=8, block=block)
    S.add_segment(spark.createDataFrame(second, schema), path, 1, buckets=8, block=block)
    # A batch that is tried again changes nothing.
    S.add_segment(spark.createDataFrame(second, schema), path, 1, buckets=8, block=block)
    rows = dict(first) | dict(second)
    whole = str(tmp_path / "whole")
    S.compacted(spark, path, whole, buckets=8, block=block)
    for where in (path, whole):
        for query, phrase in ((["alpha"], False), (["the", "of"], False), (["alpha", "beta", "gamma", "über"], False), (["the", "of"], True), (["alpha", "alpha"], True), (["é", "x1", "the"], True), (["nothing"], False), (["alpha", "nothing"], False)):
            got = {r.id: r.hits for r in S.search(spark, where, query, phrase, buckets=8, block=block).collect()}
            assert got == expected(rows, query, phrase), (query, phrase)
    assert S.search(spark, path, []).count() == 0
    # A word that all documents have is a row for each block, whatever their number.
    if block == 7:
        assert S.stored(spark, whole).where("token = 'the'").groupBy("block").count().where("count > 1").count() == 0
        assert S.stored(spark, whole).agg(F.max("n_docs")).first()[0] <= 7


@pytest.mark.parametrize("held, block", [(1 << 22, 8192), (50, 7), (1, 3)])
def test_lists_are_shuffled_and_not_hits(spark, held, block):
    """Lists of any number of texts, an id twice in other tasks and in one, ids below zero, texts without words."""
    rows = [*corpus(6, range(-20, 60)), *corpus(7, [3, 3, 40]), *corpus(8, [3]), (60, None), (61, " . "), (None, "alpha")]
    found = S.postings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block, held=held)
    got, lists = {}, found.collect()
    for r in lists:
        docs, counts, places = S.decoded(r.postings, r.block * block)
        assert len(docs) == r.n_docs == len(set(docs)) and counts.sum() == r.n_hits == len(places)
        for i, place in zip(np.repeat(docs, counts).tolist(), places.tolist(), strict=True):
            assert i // block == r.block
            got.setdefault((r.token, i), []).append(place)
    want = {}
    for i, text in rows:
        for place, w in enumerate(words_of(text) if i is not None else ()):
            want.setdefault((w, i), []).append(place)
    assert got == {k: sorted(v) for k, v in want.items()}
    assert len({(r.token, r.block) for r in lists}) == len(lists)
    # Words are met in the task that reads them: what is exchanged by word are lists.
    shown = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in shown and re.search(r"MapInArrow.*RepartitionByExpression.*MapInArrow", shown, re.S)


def test_python_gets_texts_and_the_shuffle_a_row_for_each_bucket_and_block(spark):
    """No arrays of words to Python, and no row for each word through the shuffle."""
    texts = spark.createDataFrame([(k, f"word{k} common {k % 7}") for k in range(2000)], "doc_id long, text string").coalesce(1)
    found = S.postings(texts, block=1000, buckets=4)
    assert "array<string>" not in re.sub(r"#\d+", "", found._jdf.queryExecution().analyzed().treeString()) and "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    shuffled = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "token#" not in shuffled and "tokens#" in shuffled
    assert S._partial(texts.selectExpr("doc_id AS id", "text"), 1000, 1 << 20, 4).count() == 8
    assert found.count() == 2000 + 2 * 8


def test_words_of_plain_texts_are_tokens(spark):
    rng = random.Random(9)
    signs = ["a", "B", "9", "é", "É", "ß", "İ", "Σ", "ς", "e\u0301", "\u00a0", "—", "’", "…", "中", "文", "Ⅷ", "²", "😀", "𝒳", "\u200b", "_", " ", "\n", "-", ".", "\x00", "\x7f", "\ufffd", "I\u0307"]
    rows = ["", None, "a", "a b", "é", " é", "—", "x—y", *("".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string").coalesce(1)
    got = df.select("k", S.plain(F.col("t")).alias("p"), X.tokens(F.col("t")).alias("w")).orderBy("k").collect()
    for a, b in ((0, len(got)), (3, 50)):
        words, length = S._cut(pa.array([r.p for r in got], pa.string()).slice(a, b - a))
        ends, words = np.cumsum(length), words.to_pylist()
        assert [words[e - n : e] for e, n in zip(ends, length, strict=True)] == [r.w for r in got[a:b]]


@pytest.mark.parametrize("overlap", [False, True])
def test_lists_are_joined_as_bytes_where_they_do_not_overlap(monkeypatch, overlap):
    rng = np.random.default_rng(3)
    first, whole, parts = np.array([0, 4096, 8192]), [], []
    for g in range(3):
        ids = np.sort(rng.choice(4096, 40, replace=False)) + first[g]
        # Of the last there is one list; of the second the lists may be mixed.
        part = np.zeros(40, int) if g == 2 else rng.integers(0, 3, 40) if overlap and g == 1 else np.arange(40) // 15
        places = [np.sort(rng.choice(100_000, rng.integers(1, 5), replace=False)) for _ in ids]
        hits = lambda own: (np.repeat(ids[own], [len(places[i]) for i in own]), np.concatenate([places[i] for i in own]))
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            i, at = hits(own)
            (data,), n = S.encoded(np.array([0]), i, at, first[g : g + 1])
            parts.append((g, i[0] - first[g], data, [n[0], len(i), i[0] - first[g], i[-1] - i[0], len(data)]))
        i, at = hits(np.arange(40))
        whole.append(S.encoded(np.array([0]), i, at, first[g : g + 1])[0][0])
    rng.shuffle(parts)
    if not overlap:
        monkeypatch.setattr(S, "decoded_all", None)
    order = np.lexsort(([p[1] for p in parts], [p[0] for p in parts]))
    heads = np.flatnonzero(np.diff([parts[o][0] for o in order], prepend=-1))
    out, cuts, n = S.chained(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), np.array([p[3] for p in parts]), heads, order, first)
    assert [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] == whole and n.tolist() == [40, 40, 40]


def test_ids_in_any_order_and_twice_in_a_task(spark):
    rows = corpus(11, [*range(200), 7, 7, 150])
    random.Random(12).shuffle(rows)
    found = S.postings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), block=64)
    got = {(r.token, i) for r in found.collect() for i in S.decoded(r.postings, r.block * 64)[0].tolist()}
    assert got == {(w, i) for i, text in rows for w in words_of(text)}


def test_a_search_opens_only_the_buckets_of_its_words(spark, tmp_path):
    path = str(tmp_path)
    S.add_segment(spark.createDataFrame([(k, f"word{k} common") for k in range(500)], "doc_id long, text string"), path, 0)
    found = S.search(spark, path, ["word7", "common"])
    plan = found._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "postings" in line)
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)\]", scan) and "In(token" in scan
    assert [tuple(r) for r in found.collect()] == [(7, 2)]


def test_a_stream_adds_segments(spark, tmp_path):
    rows = corpus(3, range(60))
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it finds nothing new
        S.index_stream(stream, str(tmp_path / "index"), str(tmp_path / "at")).awaitTermination()
    assert S._ids(spark, str(tmp_path / "index"), "documents").select("segment").distinct().count() == 3
    got = {r.id: r.hits for r in S.search(spark, str(tmp_path / "index"), ["alpha", "the"]).collect()}
    assert got == expected(dict(rows), ["alpha", "the"])


def headline_by_hand(text, query, most=2, longest=18, shortest=5):
    if text is None:
        return None
    words = text.split()
    own = [set(words_of(w)) & set(query) for w in words]
    windows = sorted(
        (-len(set().union(*own[a : b + 1])), b - a + 1, a, b) for a in range(len(words)) if own[a] for b in range(a, min(len(words), a + longest)) if own[b]
    )
    taken = []
    for _, _, a, b in windows:
        if len(taken) < most and all(b < x or a > y for x, y in taken):
            taken.append((a, b))
    if not taken:
        return " ".join(words[:shortest])
    taken.sort()
    out, low = [], 0
    for k, (a, b) in enumerate(taken):
        high = taken[k + 1][0] - 1 if k + 1 < len(taken) else len(words) - 1
        start = max(low, a - (longest - (b - a + 1)) // 2)
        end = min(high, start + longest - 1)
        low = end + 1
        out.append(" ".join(f"<b>{words[i]}</b>" if own[i] else words[i] for i in range(start, end + 1)))
    return " ... ".join(out)


@pytest.mark.parametrize("query, most, longest", [(["alpha", "beta"], 2, 18), (["alpha", "beta", "the"], 3, 6), (["of"], 1, 5), (["nothing"], 2, 18)])
def test_fragments_equal_all_windows(spark, query, most, longest):
    rng = random.Random(4)
    rows = [t for _, t in corpus(5, range(60))] + [" ".join(rng.choice(["alpha", "Beta,", "the", *["z"] * 9]) for _ in range(rng.randrange(150))) for _ in range(60)] + [None, "", "  ", "one", "z " * 5000 + "alpha beta-alpha"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = {r.k: r.h for r in df.select("k", X.fragments(F.col("t"), query, most, longest).alias("h")).collect()}
    assert got == {k: headline_by_hand(t, query, most, longest) for k, t in enumerate(rows)}
