"""The pipeline against the composition of its parts on a small table."""

import os

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    kept = spark.read.parquet(str(tmp_path / "mixing"))
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32").collect()} == {tuple(r) for r in docs.select("doc_id", "piece", "ids_crc32").collect()}


def test_sequences_follow_the_mix(spark):
    """Without the mixing stage, or if packing forgot its order, neither order would hold."""
    from dossierlake.llm.mixing import pfair_slots

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = docs.join(spark.createDataFrame([(i,) for i in {r.doc_id for r in rows}], "doc_id long"), "doc_id", "left_semi")
    place = {r.doc_id: (r.slot, r.turn) for r in pfair_slots(left).collect()}
    first = {}
    for r in rows:
        at = (*place[r.doc_id], r.piece)
        first[r.sequence_id] = min(first.get(r.sequence_id, at), at)
    assert sorted(first) == list(range(len(first))) and len(first) > 10
    order = [first[k] for k in range(len(first))]
    assert order == sorted(order)
    parts = {}
    for r in rows:
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in parts.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 1024


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, _id string, kept string, component_id int, slot int, length int"


def test_stages_on_edges(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, an empty table, clashing names."""
    prose = " ".join(f"word{i % 97} other{i % 31}" for i in range(400))
    texts = [prose, prose, prose + " end", None, "", " \t ", "short text", "x " * 30_000]
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, len(t or "") if i % 4 else None, 1, "y", "z", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[0], (None, prose, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, EXTRA)
    folder = str(tmp_path)
    spark.createDataFrame([(0, 1, 0), (6, 0, 0), (None, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        if name != "packing":
            assert got.columns == docs.columns
        ids[name] = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x))
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == got.columns and empty.count() == 0
    assert ids["exact_dedup"] == [0, 2, 5, 6, 7]
    assert ids["near_dedup"] == [0, 3, 4, 5, 6, 7, None]
    assert ids["mixing"] == sorted((r[0] for r in rows), key=lambda x: (x is None, x))
    assert len([i for i in ids["packing"] if i == 7]) > 1 and set(ids["packing"]) == {r[0] for r in rows}


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null ids and ids that repeat with other texts are filtered like all others, each row by itself."""
    prose = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(4)]
    rows = [(1, prose[0]), (1, prose[1]), (1, prose[1]), (None, prose[0]), (None, prose[1] + " end"), (None, prose[2]), (None, prose[2]), (None, prose[2] + " end"), (2, prose[3]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    order = lambda got: sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    every = order(stages["quality"](spark, docs, str(tmp_path)))
    assert every == sorted(set(rows), key=str)
    exact = stages["exact_dedup"](spark, docs, str(tmp_path))
    assert [r for r in order(exact) if r[1]] == sorted([(1, prose[0]), (1, prose[1]), (None, prose[1] + " end"), (None, prose[2]), (None, prose[2] + " end"), (2, prose[3])], key=str)
    assert exact.count() == 7
    near = [r for r in order(stages["near_dedup"](spark, exact, str(tmp_path))) if r[1]]
    assert [r for r in near if r[0]] == sorted([(1, prose[0]), (1, prose[1]), (2, prose[3])], key=str)
    assert [r[1].startswith(prose[2]) for r in near if r[0] is None] == [True]
