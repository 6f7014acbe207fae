"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats and clashes."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import exact_dedup, license_scan, line_dedup, maxent_lm, mixing, near_join, packing, quality, text, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, _id string, rank int"
WORDS = [f"w{i}" for i in range(60)]


def make(spark, texts, sources=None):
    """Documents with columns whose names clash with those inside the operators."""
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], len(t or ""), 7, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edge_texts():
    base = prose(1)
    words = base.split()
    near = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in (20, 60, 100)]
    return [base, base, base.replace(" ", "\n"), *near, None, "", " \t ", "two words", "Two  WORDS", "é", prose(2, 30_000), prose(3), prose(4, 12)]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


# -- 9 ------------------------------------------------------------------------


@pytest.mark.parametrize("first, widen", [(64, 8), (2, 2)])
def test_exact_dedup(spark, first, widen):
    texts = edge_texts() + ["ab", "a b", "a  b", "abc", "abd"]
    got = {r.doc_id: r for r in exact_dedup.radix_groups(make(spark, texts), first=first, widen=widen).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    for norm, ids in groups.items():
        best = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(ids), i == best, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_dedup_repeated_rows_and_empty(spark):
    docs = make(spark, ["a b", "ab", "c"])
    twice = docs.unionByName(docs.where("doc_id = 0"))
    got = exact_dedup.radix_groups(twice).collect()
    assert len(got) == 4 and sum(r.kept for r in got if r.keep_id == 0) == 1
    keyed = twice.withColumn("__key", exact_dedup.row_key(twice))
    kept = exact_dedup.keep_rows(twice, exact_dedup.radix_groups(keyed, "__key"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and kept.columns == docs.columns
    assert exact_dedup.radix_groups(docs.limit(0)).count() == 0
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.radix_groups(nulls).collect()} == {(None, None, True), (1, None, False), (2, 2, True)}


# -- 4 ------------------------------------------------------------------------


def components(texts, percent=75):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


def family(seed, copies=60, n=90):
    """Near copies with few to many changed words, around and below the threshold."""
    rng, base = random.Random(seed), prose(seed, n).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("side, known", [(4096, True), (8, True), (8, False)])
def test_near_duplicates(spark, monkeypatch, side, known):
    """Also with small tiles, and with an order that knows no frequent shingle."""
    monkeypatch.setattr(near_join, "TILE_SIDE", side)
    if not known:
        monkeypatch.setattr(near_join, "_frequent", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(near_join, "TREE_ROWS", 16)
    texts = edge_texts() + family(11) + family(12, 30) + [prose(50 + i, 40) + " a common line of words that many texts share here" for i in range(40)]
    sets, want = components(texts)
    got = {r.doc_id: r for r in near_join.near_duplicates(make(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), want[i]), texts[i]


def test_near_duplicates_without_first_round(spark, monkeypatch):
    """The tiles alone find every link."""
    monkeypatch.setattr(near_join, "_tree_pairs", lambda keyed, *_: keyed.sparkSession.createDataFrame([], "a long, b long"))
    texts = family(21, 40) + edge_texts()
    _, want = components(texts)
    got = {r.doc_id: r.component_id for r in near_join.near_duplicates(make(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_repeats_and_empty(spark):
    docs = make(spark, ["a b c", "a b c", None])
    again = docs.unionByName(docs)
    got = near_join.near_duplicates(again).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert near_join.near_duplicates(docs.limit(0)).count() == 0
    base = prose(1)
    ids = spark.createDataFrame([(None, base), (None, base + " end"), (4, base + " end"), (9, prose(2)), (None, prose(3)), (None, None)], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.component_id)) for r in near_join.near_duplicates(ids).collect()) == sorted(["(None, 4)", "(None, 4)", "(4, 4)", "(9, 9)", "(None, None)", "(None, None)"])


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [base]
    for _ in range(40):
        s = base.copy()
        k = int(rng.integers(0, 150))
        s[rng.choice(len(s), k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64)
        sets.append(np.unique(s)[: int(rng.integers(200, 400))])
    a, b = np.triu_indices(len(sets), 1)
    keep = near_join._test_bits(a, b, np.array([len(s) for s in sets]), [np.frombuffer(near_join._bitmap(s), np.uint8) for s in sets], 75)
    for i, j, k in zip(a, b, keep, strict=True):
        n = len(np.intersect1d(sets[i], sets[j]))
        assert k or 100 * n < 75 * (len(sets[i]) + len(sets[j]) - n)


# -- 2 ------------------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = edge_texts() + ["<|endoftext|> inside", "日本語 　 \x85 x", *[prose(i, 5 + 37 * i % 700) for i in range(60)]]
    rows = packing.pack_documents(make(spark, texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p.start == at and (p.length == 1024 or not k)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1.05 * total / 1024 + 2


def test_packing_rule():
    assert packing.best_two_fit({6: 1, 4: 1, 3: 2}, 10) == [(1, {6: 1, 4: 1}), (1, {3: 2})]
    # 7 + 2 leaves a gap of 1; two threes do not fit 3, but 1 + 2 does.
    assert packing.best_two_fit({7: 1, 2: 2, 1: 1}, 10)[0] == (1, {7: 1, 2: 1, 1: 1})
    # The smallest gives way to two that fill the gap: 6 + 3 (gap 1) becomes 6 + 2 + 2.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 30, 8), rng.integers(1, 9, 8), strict=True)}
        used = Counter()
        for times, pattern in packing.best_two_fit(counts, 29):
            assert sum(s * n for s, n in pattern.items()) <= 29
            for s, n in pattern.items():
                used[s] += n * times
        assert used == Counter(counts)


def test_packing_empty_and_repeats(spark):
    docs = make(spark, ["a b", None])
    assert packing.pack_documents(docs.limit(0)).count() == 0
    got = packing.pack_documents(docs.unionByName(docs)).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4


# -- 6 ------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"weights": {"a": 5, "b": 3, "c": 1, None: 1}, "block_docs": 2, "slots": 50}])
def test_mixing(spark, options):
    docs = make(spark, [str(i) for i in range(300)], ["a", "a", "a", "b", "c", None, "b", "a"])
    rows = mixing.pfair_slots(docs, **options).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300))
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, set()).add((r.source, r.block, r.share))
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    order = [next(iter(slots[i])) for i in range(len(slots))]
    left, served, share = Counter(s for s, _, _ in order), Counter(), {s: w for s, _, w in order}
    for t, (s, block, _) in enumerate(order):
        assert block == served[s]
        served[s] += 1
        if any(served[x] == left[x] for x in left):
            break
        assert all(abs(served[x] - share[x] * (t + 1)) < 1 for x in left)


def test_mixing_against_simulation(spark):
    """Every block's slot by a plain simulation: windows as fractions, of the released blocks the one due first."""
    names = ["a"] * 70 + ["b"] * 25 + ["c"] * 9 + [None] * 3
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id long, source string")
    rows = mixing.pfair_slots(docs, weights={"a": 5, "b": 3, "c": 1}, block_docs=4, slots=12).collect()
    order = ["a", "b", "c", None]
    w = {None: 1, "a": 9, "b": 5, "c": 2}  # of 16 slots, four for each source
    assert all(abs(r.share - w[r.source] / 17) < 1e-12 for r in rows)
    left, done, base, want = {s: -(-names.count(s) // 4) for s in order}, dict.fromkeys(order, 0), 0, {}
    while any(left.values()):
        c = {s: min(w[s], left[s]) for s in order}

        def service(k, own, c=c):
            return sum(min(Fraction(c[s]), Fraction(k * w[s], own)) for s in order)

        windows = {s: [(math.floor(service(k, w[s])), math.ceil(service(k + 1, w[s]))) for k in range(c[s])] for s in order}
        at = dict.fromkeys(order, 0)
        for t in range(sum(c.values())):
            ready = [(windows[s][at[s]][1], i, s) for i, s in enumerate(order) if at[s] < c[s] and windows[s][at[s]][0] <= t]
            s = min(ready)[2]
            assert t < windows[s][at[s]][1]
            want[s, done[s] + at[s]] = base + t
            at[s] += 1
        for s in order:
            done[s], left[s] = done[s] + c[s], left[s] - c[s]
        base += sum(c.values())
    assert {(r.source, r.block): r.slot for r in rows} == want


def test_mixing_many_sources(spark):
    """Shares stay apart with more sources than slots, and so do their places."""
    sources = [f"s{i:03}" for i in range(40) for _ in range(1 + 4 * (i % 4))]
    docs = make(spark, ["t"] * len(sources), sources)
    rows = mixing.pfair_slots(docs, block_docs=1, slots=10, temperature=1.0).collect()
    assert len(rows) == len(sources) and sorted(r.slot for r in rows) == list(range(len(sources)))
    share = {r.source: r.share for r in rows}
    assert len(set(share.values())) >= 3 and abs(sum(share.values()) - 1) < 1e-9
    assert share["s003"] > share["s002"] > share["s000"]


def test_mixed_rows(spark):
    docs = make(spark, [str(i) for i in range(50)], ["a", "b", None])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sorted(out.collect()) == sorted(docs.collect())
    twice = docs.unionByName(docs.where("doc_id < 5"))
    assert sorted(mixing.mixed(twice).collect()) == sorted(twice.collect())
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.pfair_slots(docs.limit(0)).count() == 0


# -- 3 ------------------------------------------------------------------------


def brute_top(vectors, k):
    ints = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in ints:
        if q % 20 == 0:
            found = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q and len(x) == len(ints[q])))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("size, scale", [(3000, 1.0), (40, 1e4)])
def test_top_k(spark, size, scale):
    rng = np.random.default_rng(5)
    v = {i: (rng.normal(size=16) * scale).round(3).tolist() for i in range(size)}
    v |= {20: v[1], 40: v[1], 41: v[1], 7: None, 8: [None] * 16, 9: [float("nan")] * 16, 10: [float("inf")] * 16, 11: [1.0, 2.0]}
    v |= {i: v[1] for i in range(21, 35)}
    frame = spark.createDataFrame([(i, x, 0, 0) for i, x in v.items()], "vec_id long, embedding array<double>, id int, block int")
    got = topk.top_k(frame, F.col("id") % 20 == 0, 20, query_block=16, candidate_block=512)
    assert {tuple(r) for r in got.collect()} == brute_top(v, 20)
    assert topk.top_k(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_levels_and_envelopes_never_lose_a_score():
    """Bounds against all scores; on near vectors most pairs fall away, coarse to fine, and most tiles with them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32)) * 300
    x = np.floor(np.repeat(centres, 120, 0) + rng.normal(size=(1440, 32)) * 4)
    turn = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, ::-1]
    x = x[np.argsort((x @ turn)[:, 0])].astype(np.int64)
    ids, counts = np.arange(len(x)), []
    got = topk.tile_top(ids[::40], x[::40], ids, x, 5, turn, counts=counts)
    score = x[::40] @ x.T
    score[np.arange(36), ids[::40]] = -(10**15)
    for i, row in enumerate(score):
        want = np.lexsort((ids, -row))[:5]
        own = got[0] == ids[::40][i]
        assert got[1][own].tolist() == want.tolist() and got[2][own].tolist() == row[want].tolist()
    assert all(a >= b for seen in counts for a, b in zip(seen[1:], seen[2:], strict=False)) and sum(s[-1] for s in counts) < 0.2 * sum(s[0] for s in counts)
    blocks = np.split(x, 12)
    tops = [topk.envelope(b @ turn) for b in blocks]
    kept = 0
    for i, a in enumerate(blocks):
        worst = np.sort(a @ a.T, 1)[:, -6].min()
        for j, b in enumerate(blocks):
            assert topk.most(tops[i], tops[j]) >= (a @ b.T).max()
            kept += topk.most(tops[i], tops[j]) >= worst
    assert kept < 80


def test_top_k_by_tiles(spark):
    """Several blocks on both sides, seeds first, then the tiles that may do better."""
    rng = np.random.default_rng(8)
    v = {i: ((rng.normal(size=8) + 9 * (i % 5)) * 2).round(2).tolist() for i in range(600)}
    frame = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("id") % 20 == 0, 20, query_block=8, candidate_block=64)
    assert {tuple(r) for r in got.collect()} == brute_top(v, 20)


# -- 7 ------------------------------------------------------------------------


def test_scores(spark):
    texts = edge_texts() + [prose(i, 30) for i in range(60)]
    got = {r.doc_id: r for r in maxent_lm.score_texts(make(spark, texts)).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n = sum(c.values())
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t))
        assert np.isfinite(r.score)
    assert maxent_lm.score_texts(make(spark, [None]).limit(0)).count() == 0
    assert np.isfinite(maxent_lm.score_texts(make(spark, ["a b"])).first().score)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(sum(maxent_lm.TABLE), maxent_lm.CLASSES)).astype(np.float32), rng.normal(size=maxent_lm.CLASSES).astype(np.float32)
    rows = np.array([[1, maxent_lm.TABLE[0] + 2, sum(maxent_lm.TABLE[:2]) + 3]] * maxent_lm.CLASSES)
    assert np.exp(maxent_lm._log_chosen(w, b, rows, np.arange(maxent_lm.CLASSES))).sum() == pytest.approx(1, abs=1e-4)


def test_training_learns(spark):
    """Held-out texts that alternate between two vocabularies score above the unigram base."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "ba", "ca"] if k else ["ax", "bx", "cx"]) for _ in range(200)) for k in [i % 2 for i in range(300)]]
    rows = maxent_lm.score_texts(make(spark, texts)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.1 * sum(r.n_tokens for r in rows)


def test_tasks_keep_what_one_task_learns(spark, monkeypatch):
    """A text whose next word depends on the two before, learned by one task and in rounds of up to four."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    nexts = {}

    def text(n):
        out = ["au", "bv"]
        for _ in range(n):
            out.append(rng.choice(nexts.setdefault((out[-2][1], out[-1]), rng.sample(words, 4))))
        return " ".join(out)

    docs = make(spark, [text(150) for _ in range(800)])
    found, tasks = {}, []
    inner = maxent_lm._round
    monkeypatch.setattr(maxent_lm, "_round", lambda texts, *more: tasks.append(texts.rdd.getNumPartitions()) or inner(texts, *more))
    for name, start, size in (("one", 10**9, 10**9), ("four", 14_000, 14_000)):
        monkeypatch.setattr(maxent_lm, "START", start)
        monkeypatch.setattr(maxent_lm, "TASK_TOKENS", size)
        found[name] = maxent_lm.score_texts(docs).where("held_out").select((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).first()[0]
    assert tasks[:3] == [1, 1, 1] and max(tasks) == 4
    assert found["one"] > 0.2 and found["four"] >= 0.9 * found["one"]


def test_steps_of_tasks_are_merged():
    """One task: its own step.  Cells of one task alone: whole.  Cells that all share: as with all squares in sight."""
    before = np.array([0.0, 0.0, 4.0])
    step, after = maxent_lm.merged(before, [np.array([1.0, 0.0, 2.0])], [np.array([1.0, 0.0, 5.0])])
    assert step.tolist() == [1, 0, 2] and after.tolist() == [1, 0, 9]
    step, after = maxent_lm.merged(before, [np.array([1.0, 1.0, 1.0]), np.array([0.0, 1.0, 1.0])], [np.array([1.0, 2.0, 6.0]), np.array([0.0, 2.0, 6.0])])
    assert step == pytest.approx([1, 2 / np.sqrt(2), 2 * np.sqrt(10 / 16)]) and after.tolist() == [1, 4, 16]
    assert maxent_lm._bounds(0) == [0] and maxent_lm._bounds(5 * maxent_lm.START) == [maxent_lm.START * k for k in (1, 2, 4, 5)]


def test_scores_from_given_weights(spark, monkeypatch):
    """The score of each text by the formulas, token by token, for weights drawn here."""
    rng = np.random.default_rng(8)
    weights, seen = rng.normal(size=(sum(maxent_lm.TABLE), maxent_lm.CLASSES)).astype(np.float32), {}
    monkeypatch.setattr(maxent_lm, "_train", lambda docs, total, top, top_class, bias: seen.update(top=dict(zip(top.tolist(), top_class.tolist(), strict=True))) or weights)
    texts = [prose(k, 40) for k in range(60)] + [None, "", "Z", "never seen words"]
    got = {r.doc_id: r for r in maxent_lm.score_texts(make(spark, texts)).collect()}
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)

    def code(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return int(text.span_hashes(data, np.array([0]), np.array([len(data)]))[0])

    def mixed(x):
        return int(text.mix(np.array([x % 2**64], np.uint64))[0])

    def kind(w):
        if w is None:
            return maxent_lm.TOP
        data = w.encode()
        two = data[-1] * 256 + (data[-2] if len(data) > 1 else 0) + 1
        return seen["top"].get(code(w), maxent_lm.TOP + 1 + mixed(two) % maxent_lm.SUFFIXES)

    # The most frequent words have classes of their own.
    frequent = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], np.uint64(code(w)).view(np.int64)))[: maxent_lm.TOP]
    assert seen["top"] == {code(w): k for k, w in enumerate(frequent)}
    mass, kinds = Counter(), Counter()
    for w, c in counts.items():
        mass[kind(w)] += c
        kinds[kind(w)] += 1
    total, distinct = sum(counts.values()), len(counts)
    bias = np.array([log10((mass[k] + 0.1 * (kinds[k] + 1)) / (total + 0.1 * (distinct + maxent_lm.CLASSES))) * np.log(10) for k in range(maxent_lm.CLASSES)])
    a, b, c = maxent_lm.TABLE
    for i, t in enumerate(tokens):
        want, one, two = 0.0, int(maxent_lm.BEGIN), int(maxent_lm.BEGIN)
        for w in t:
            z = weights[mixed(one) % a].astype(float) + weights[a + mixed(two + 7) % b] + weights[a + b + mixed(3 * one + 5 * two) % c] + bias
            want += (z[kind(w)] - np.log(np.exp(z).sum())) / np.log(10)
            want += log10((counts[w] + 0.1) / (mass[kind(w)] + 0.1 * (kinds[kind(w)] + 1)))
            one, two = (int(maxent_lm.END) if w is None else code(w)), one
        assert got[i].score == pytest.approx(want, rel=1e-4)


# -- 8 ------------------------------------------------------------------------


def test_lines(spark):
    texts = ["one two three four five\nown line here is this\n", "x\nONE  two three four FIVE\n\none two three four five", "é one two three four five", None, "", "short\nshort"]
    rows = line_dedup.removed_spans(make(spark, texts), unit="line", min_words=5).collect()
    assert {(r.doc_id, r.start, r.end, r.n_words, r.keep_doc_id) for r in rows} == {(1, 2, 26, 5, 0), (1, 28, 51, 5, 0)}
    clean = {r.doc_id: r for r in line_dedup.without_repeats(make(spark, texts), unit="line", min_words=5).collect()}
    assert clean[1].text == "x\n\n\n" and clean[0].text == texts[0] and clean[3].text == ""
    assert all("".join((texts[i] or "")[s.start : s.end] for s in clean[i].kept) == clean[i].text for i in range(len(texts)))
    assert line_dedup.removed_spans(make(spark, texts).limit(0), unit="line").count() == 0
    assert line_dedup.removed_spans(make(spark, ["a b c d e\nf\n \ng", "a b c d e\nf"]), unit="paragraph", min_words=5).count() == 1
    with pytest.raises(ValueError):
        line_dedup.removed_spans(make(spark, texts), unit="page")


def pieces(t):
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]


def repeated_words(texts, size, ids=None):
    """Brute force: (document, word) of all words in a run of ``size`` words that an earlier place has."""
    first, out = {}, set()
    ids = ids or list(range(len(texts)))
    for i in sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0)):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), texts[i][a:b]) for a, b in pieces(texts[i])]
        for k in range(len(w) - size + 1):
            d, at = first.setdefault(tuple(w[k : k + size]), (i, k))
            if d != i or k - at >= size:
                out |= {(i, j) for j in range(k, k + size)}
    return out


def words_in(rows, texts, of=lambda r: r.doc_id):
    got = set()
    for r in rows:
        inside = [k for k, (a, b) in enumerate(pieces(texts[of(r)])) if r.start <= a and b <= r.end]
        assert len(inside) == r.n_words and pieces(texts[of(r)])[inside[0]][0] == r.start and pieces(texts[of(r)])[inside[-1]][1] == r.end
        got |= {(of(r), k) for k in inside}
    return got


def test_runs_of_any_words(spark):
    """Passages that begin inside a sentence or hold no stop, against all windows of 50 words."""
    plain, cut, back = prose(81, 70), prose(82, 50), " ".join(f"u{i}" for i in range(55))
    texts = [f"{prose(83, 9)} {plain} {prose(84, 9)}", f"É one. {plain.upper()} {prose(85, 9)}", f"a. {cut} b.", f"c {cut} d. e", " ".join(cut.split()[:49]), f"{back} {back}", "x " * 160, None, "", f"{prose(86, 9)} {plain} {cut}"]
    rows = line_dedup.removed_spans(make(spark, texts)).collect()
    assert words_in(rows, texts) == repeated_words(texts, 50) and {r.doc_id for r in rows} == {1, 3, 5, 6, 9}
    assert {(r.doc_id, r.keep_doc_id) for r in rows} == {(1, 0), (3, 2), (5, 5), (6, 6), (9, 0)}
    clean = {r.doc_id: r.text for r in line_dedup.without_repeats(make(spark, texts)).collect()}
    assert clean[3] == "c  d. e" and clean[5].strip() == back and clean[0] == texts[0]
    assert line_dedup.removed_spans(make(spark, texts).limit(0)).count() == 0
    # A repeated line that is long enough is a repeated run.
    lines = line_dedup.removed_spans(make(spark, [f"{cut}\nown", f"other\n{cut}\n"]), unit="line").collect()
    assert [(r.doc_id, r.start, r.end) for r in lines] == [(1, 6, 6 + len(cut))]


@pytest.mark.parametrize("size", [3, 6, 9])
def test_runs_against_all_windows(spark, size):
    """Few words, so that runs repeat in all ways: other neighbours, overlaps, periods, several kinds of places."""
    texts = []
    for seed in range(60):
        rng = random.Random(seed)
        texts.append(" ".join(rng.choice("ab" if seed % 3 else "abcd") for _ in range(rng.randrange(60))))
    texts += [" ".join("ab" * 40), " ".join("abc" * 30), " ".join("abb" * 20) + " c " + " ".join("abb" * 20), "a " * 90]
    rows = line_dedup.removed_spans(make(spark, texts), min_words=size).collect()
    assert words_in(rows, texts) == repeated_words(texts, size)


def test_runs_of_repeated_and_null_ids(spark):
    """Rows with the same id and text are one document; other texts with that id, or none, are their own."""
    passage, other = prose(90, 60), prose(91, 60)
    docs = make(spark, [passage])
    assert line_dedup.removed_spans(docs.unionByName(docs)).count() == 0
    ids, texts = [None, 5, None, 5, 7], [passage, passage, f"{passage} end", other, f"x {other}"]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    found = line_dedup.removed_spans(rows).collect()
    assert sorted((r.doc_id or -1, r.keep_doc_id, r.n_words) for r in found) == [(-1, 5, 60), (-1, 5, 60), (7, 5, 60)]
    clean = sorted(r.text for r in line_dedup.without_repeats(rows).collect())
    assert clean == sorted(["", passage, " end", other, "x "])


# -- 1 ------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    page = '<html lang="en"><head><title>T &amp; U</title><script>var t="</p>";</script></head><body><!-- x --><p title="a>b">One<br>two</p><a href="/x">l</a><div>5 < 6 &lt; 7</div></body></html>'
    pages = spark.createDataFrame([(1, "http://e/1", page, "z"), (2, None, None, "z"), (3, "http://e/3", "plain " * 20_000, "z")], "page_id long, url string, html string, block string")
    rows = {(r.page_id, r.kind): r for r in warc.derivatives(pages).collect()}
    assert len(rows) == 6
    conversion, metadata = rows[1, "conversion"], rows[1, "metadata"]
    assert conversion.block == "One\ntwo\nl\n5 < 6 < 7" and conversion.refers_to == metadata.refers_to != conversion.record_id
    assert "title: T & U\r\nlanguage: en\r\n" in metadata.block and "outlink: /x\r\n" in metadata.block and conversion.source_digest in metadata.block
    assert conversion.source_digest == warc.digest(page.encode()) and conversion.block_digest == warc.digest(conversion.block.encode())
    assert rows[2, "conversion"].block == "" and rows[2, "conversion"].target_uri is None
    assert warc.derivatives(pages.limit(0)).count() == 0
    for compress in (True, False):
        data = b"".join(bytes(r.record) for r in warc.record_bytes(warc.derivatives(pages), compress).orderBy("page_id", "kind").collect())
        back = list(warc.from_bytes(data))
        assert [(h["warc-type"], b.decode()) for h, b in back] == [(k, rows[i, k].block) for i in (1, 2, 3) for k in ("conversion", "metadata")]
        assert back[0][0]["warc-refers-to"] == conversion.refers_to and "warc-target-uri" not in back[2][0]
    response = warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://e")], (warc.HTTP_HEAD + page).encode())
    (tmp_path / "a.warc.gz").write_bytes(warc.to_bytes([("WARC-Type", "warcinfo")], b"") + response)
    assert tuple(warc.read_responses(spark, str(tmp_path / "a.warc.gz")).first()) == ("<urn:x>", "http://e", page)


def test_warc_keeps_what_the_response_says(spark, tmp_path):
    """From a WARC file to derived records and back: id, date, digest and HTTP headers of the response."""
    body = b"<title>T</title>caf\xe9"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2;\r\n path=/\r\nX-Empty:\r\n\r\n"
    one = warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://e"), ("WARC-Date", "2021-05-06T07:08:09Z"), ("WARC-Payload-Digest", "sha1:GIVEN")], http + body)
    two = warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://f")], http + body)
    three = warc.to_bytes([("WARC-Type", "response"), ("WARC-Target-URI", "http://g")], body)
    (tmp_path / "a.warc.gz").write_bytes(one + two + three)
    derived = warc.derivatives(warc.read_response_records(spark, str(tmp_path / "a.warc.gz")))
    rows = {(r.target_uri, r.kind): r for r in derived.collect()}
    assert len(rows) == 6
    for kind in ("metadata", "conversion"):
        r = rows["http://e", kind]
        assert (r.refers_to, r.warc_date, r.source_digest) == ("<urn:uuid:1>", "2021-05-06T07:08:09Z", "sha1:GIVEN")
        r = rows["http://f", kind]
        assert (r.refers_to, r.warc_date, r.source_digest) == ("<urn:uuid:2>", warc.DATE, warc.digest(body))
        assert rows["http://g", kind].refers_to.startswith("<urn:uuid:") and rows["http://g", kind].source_digest == warc.digest(body)
    assert "source-content-type: text/html; charset=latin-1\r\nsource-set-cookie: a=1\r\nsource-set-cookie: b=2; path=/\r\nsource-x-empty: \r\nsource-warc-record-id: <urn:uuid:1>\r\n" in rows["http://e", "metadata"].block
    back = [h for r in warc.record_bytes(derived).collect() for h, _ in warc.from_bytes(bytes(r.record))]
    assert sum((h["warc-refers-to"], h["warc-date"]) == ("<urn:uuid:1>", "2021-05-06T07:08:09Z") for h in back) == 2
    short = warc.derivatives(warc.read_responses(spark, str(tmp_path / "a.warc.gz"))).where("target_uri = 'http://e'").first()
    assert short.refers_to == "<urn:uuid:1>"


@pytest.mark.parametrize("chunked", [False, True])
def test_payloads_are_decoded(spark, tmp_path, chunked):
    """Transfer and content codings and charsets, also where they are broken."""
    page = "<title>Caf\u00e9</title>d\u00e9j\u00e0 vu"

    def response(key, body, *headers):
        if chunked:
            body = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
            headers = (*headers, "Transfer-Encoding: chunked")
        http = "HTTP/1.1 200 OK\r\n" + "".join(f"{h}\r\n" for h in headers) + "\r\n"
        return warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", key)], http.encode() + body)

    latin = page.encode("latin-1")
    records = [
        response("zip", gzip.compress(latin), "Content-Encoding: gzip", "Content-Type: text/html; charset=ISO-8859-1"),
        response("raw", zlib.compress(latin)[2:-4], "content-encoding: DEFLATE", 'Content-Type: text/html; charset="latin-1"'),
        response("meta", b'<meta charset="iso-8859-1">' + latin),
        response("odd", page.encode(), "Content-Encoding: snappy", "Content-Type: text/html; charset=no-such"),
        response("cut", gzip.compress(latin)[:-9], "Content-Encoding: gzip"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = {r.page_id: r.html for r in warc.read_response_records(spark, str(tmp_path / "a.warc")).collect()}
    assert got["zip"] == got["raw"] == got["odd"] == page and got["meta"].endswith(page) and len(got) == 5
    assert warc.payload_text("Transfer-Encoding: chunked", b"no chunks") == "no chunks"


def records_of(n):
    """Response records, one of them larger than a piece."""
    rng = random.Random(n)
    return [warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>")], (warc.HTTP_HEAD + prose(i, 9000 if i == 2 else 5) + str(rng.random())).encode(), False) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_archives(spark, tmp_path, packed):
    """What is whole is read, before and behind a fault; one damaged file does not stop the others."""
    plain = records_of(6)
    parts = [gzip.compress(r, mtime=0) for r in plain] if packed else plain
    at = [sum(map(len, parts[:k])) for k in range(7)]
    flip = bytearray(parts[3])
    flip[len(flip) // 2 : len(flip) // 2 + 4] = b"\xff\xfe\xfd\xfc"
    no_length = plain[3].replace(b"Content-Length: ", b"Content-Length: -")
    files = {
        "whole": (b"".join(parts), {0, 1, 2, 3, 4, 5}, []),
        "zeros": (b"".join(parts) + b"\0" * 99, {0, 1, 2, 3, 4, 5}, [] if packed else [at[6]]),
        "length": (b"".join(parts[:3]) + (gzip.compress(no_length) if packed else no_length) + b"".join(parts[4:]), {0, 1, 2, 4, 5}, [at[3]]),
        "cut": (b"".join(parts)[:-20], {0, 1, 2, 3, 4}, [at[5]]),
        "head": (b"".join(parts[:4]) + parts[4][:15], {0, 1, 2, 3}, [at[4]]),
        "none": (b"<html>no archive</html>", set(), [0]),
        "empty": (b"", set(), []),
    }
    if packed:
        files["flipped"] = (b"".join(parts[:3]) + bytes(flip) + b"".join(parts[4:]), {0, 1, 2, 4, 5}, [at[3]])
        files["behind"] = (b"".join(parts) + b"garbage", {0, 1, 2, 3, 4, 5}, [at[6]])
        files["one"] = (gzip.compress(b"".join(plain)), {0, 1, 2, 3, 4, 5}, [])
        files["split"] = (b"".join(gzip.compress(b"".join(plain)[k : k + 1000]) for k in range(0, sum(map(len, plain)), 1000)), {0, 1, 2, 3, 4, 5}, [])
    for name, (data, ids, faults) in files.items():
        (tmp_path / name).write_bytes(data)
        found = list(warc.archive_records(data))
        got = [x for x in found if not isinstance(x, warc.Fault)]
        assert {int(h["warc-record-id"][5:-1]) for h, _ in got} == ids, name
        assert all(block.decode() in plain[int(h["warc-record-id"][5:-1])].decode() for h, block in got)
        assert [x.at for x in found if isinstance(x, warc.Fault)] == faults, name
    rows = Counter(r.page_id for r in warc.read_response_records(spark, str(tmp_path)).collect())
    assert rows == Counter(f"<urn:{i}>" for _, ids, _ in files.values() for i in ids)
    spots = {(r.path.rsplit("/", 1)[1], r.at) for r in warc.archive_faults(spark, str(tmp_path)).collect()}
    assert spots == {(name, k) for name, (_, _, faults) in files.items() for k in faults}
    with pytest.raises(ValueError):
        list(warc.from_bytes(files["cut"][0]))


def test_headers_stay_within_their_field(spark):
    uri = "http://e/\r\nWARC-Type: response\r\n\r\nWARC/1.0\n"
    pages = spark.createDataFrame([(1, uri, "<p>x", "X-A: 1\rWARC-Type: request\r\nX-B: 2", "d\r\nx")], "page_id long, url string, html string, http_headers string, payload_digest string")
    derived = warc.derivatives(pages)
    for r in warc.record_bytes(derived).collect():
        [(headers, block)] = warc.from_bytes(bytes(r.record))
        assert headers["warc-type"] == r.kind and headers["warc-target-uri"] == "http://e/ WARC-Type: response WARC/1.0"
        if r.kind == "metadata":
            assert block.decode().split("\r\n")[2:4] == ["source-x-a: 1 WARC-Type: request", "source-x-b: 2"] or "source-x-a: 1 WARC-Type: request\r\nsource-x-b: 2\r\n" in block.decode()
            assert "source-warc-payload-digest: d x\r\n" in block.decode()


# -- 5 ------------------------------------------------------------------------


def test_license_files_and_many_notices(spark):
    """Whole texts are found as themselves, and a text of many notices costs no more than its length."""
    names = [n for n in license_scan.TEMPLATES if n.endswith("(text)")]
    texts = [f"Copyright 2020 x\n\n{license_scan.TEMPLATES[n]}\n" for n in names]
    many = "é Released under the MIT License. " * 30_000
    rows = license_scan.scan(make(spark, [*texts, many])).collect()
    assert {r.doc_id: r.license for r in rows if r.doc_id < len(names)} == dict(enumerate(names))
    assert sum(r.doc_id < len(names) for r in rows) == len(names)
    spans = sorted((r.start, r.end) for r in rows if r.doc_id == len(names))
    assert len(spans) == 30_000 and all(many[a:b] == "Released under the MIT License" for a, b in spans[::1000])
    assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    broken = mit.replace("without restriction", "with no restriction").replace(" sublicense,", "")
    texts = [f"é {prose(1)} {mit} {prose(2)}", broken.upper().replace(" ", "\n"), "Released under the MIT License. x y\nReleased under the MIT License.", "the license of this work", None, "", f"{prose(3, 30000)} Licensed under CC BY-NC 4.0."]
    rows = license_scan.scan(make(spark, texts)).collect()
    found = Counter((r.doc_id, r.license) for r in rows)
    assert found == {(0, "MIT"): 1, (1, "MIT"): 1, (2, "MIT (notice)"): 2, (6, "CC-BY-NC-4.0 (notice)"): 1}
    for r in rows:
        assert 0.8 <= r.coverage <= 1
    whole = next(r for r in rows if r.doc_id == 0)
    assert whole.coverage == 1 and texts[0][whole.start : whole.end] == mit.rstrip(".")
    assert license_scan.scan(make(spark, texts).limit(0)).count() == 0


def test_changed_licenses_against_longest_common_subsequences(spark):
    """Changed templates: coverage is never above the best alignment, and few that reach the threshold are missed."""

    def words(t):
        return re.findall(r"[a-z0-9\u0080-\uffff]+", t.lower())

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = 0
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng, texts, names = random.Random(6), [], []
    for name, t in license_scan.TEMPLATES.items():
        for _ in range(6):
            w, rate = t.split(), rng.choice([0.02, 0.06, 0.12])
            w = [x if rng.random() > rate else rng.choice(["", "other", f"{x} more", rng.choice(w)]) for x in w]
            texts.append(f"{prose(len(texts), 20)} {' '.join(w)} {prose(900 + len(texts), 20)}")
            names.append(name)
    rows = {}
    for r in license_scan.scan(make(spark, texts)).collect():
        rows[r.doc_id, r.license] = max(r.coverage, rows.get((r.doc_id, r.license), 0))
    best = {(i, n): common(words(texts[i]), words(license_scan.TEMPLATES[n])) / len(words(license_scan.TEMPLATES[n])) for i, n in enumerate(names)}
    assert all(rows[k] <= best[k] + 1e-9 for k in best if k in rows)
    due = [k for k in best if best[k] >= 0.8]
    missed = [k for k in due if k not in rows and not any(i == k[0] for i, _ in rows)]
    assert len(due) > 50 and len(missed) <= 0.05 * len(due)


def test_patience():
    rng = random.Random(4)
    for _ in range(200):
        v = [rng.randrange(20) for _ in range(rng.randrange(9))]
        picks = ([v[i] for i in range(len(v)) if m >> i & 1] for m in range(1 << len(v)))
        best = max(len(p) for p in picks if p == sorted(set(p)))
        got = [v[i] for i in license_scan.longest_increasing(v)]
        assert len(got) == best and got == sorted(set(got))
    assert license_scan.patience(list("xabcyd"), list("abcd")) == [(1, 0), (2, 1), (3, 2), (5, 3)]


# -- 10 -----------------------------------------------------------------------


def test_quality(spark):
    good, bad = [prose(i, 60) for i in range(120)], [" ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(200, 240)]
    texts = good + bad + [None, ""]
    docs = make(spark, texts, ["a", "b", "c", None])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 160, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(texts)
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, 160))
    assert all(0 <= r.path_rate <= 1 and 0 <= r.score <= 1 for r in got.values())
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in quality.quality(docs, labels.limit(0)).collect())


def test_rates_shrink(spark):
    """A site with one bad document stays near the global rate; one with many does not."""
    good, bad = [prose(i, 60) for i in range(150)], [" ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(60)]
    rows = [(i, t, "en", "big") for i, t in enumerate(good)] + [(1000 + i, t, "en", "junk") for i, t in enumerate(bad[1:])] + [(5000, bad[0], "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") < 1000).cast("int").alias("quality"))
    rate = {r.source: r.site_rate for r in quality.quality(docs, labels).join(docs.select("doc_id", "source"), "doc_id").collect()}
    assert rate["junk"] < rate["tiny"] < rate["big"]


def test_rates_against_brute_force(spark):
    """Three levels: the rates and scores by the formulas, group by group."""
    rng = random.Random(4)
    good, bad = [prose(i, 40) for i in range(80)], [" ".join(w.upper() + "!!" for w in prose(i, 40).split()) for i in range(40)]
    rows = [(i, t, rng.choice(["x.org", "y.org", None]), rng.choice(["a", "b"]), rng.choice(["1", "2", None])) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, folder string, page string")
    labels = docs.select("doc_id", (F.col("doc_id") < 80).cast("int").alias("quality")).where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in quality.quality(docs, labels, levels=("host", "folder", "page")).collect()}
    prior = np.log(2 / 1)
    p = {i: 1 / (1 + np.exp(-(got[i].evidence + prior))) for i in got}
    up, others, first = {(): sum(p.values()) / len(p)}, {}, {}
    for depth in (1, 2, 3):
        groups = {}
        for i, _, *names in rows:
            groups.setdefault(tuple(names[:depth]), []).append(p[i])
        above = [up[g[:-1]] for g in groups]
        n, share = np.array([len(v) for v in groups.values()]), np.array([np.mean(v) for v in groups.values()])
        tau = max(((n * (share - above) ** 2).sum() - sum(a * (1 - a) for a in above)) / n.sum(), 1e-9)
        mean = np.mean(above)
        m = min(max(mean * (1 - mean) / tau - 1, 1), 1e6)
        up |= {g: (sum(v) + m * up[g[:-1]]) / (len(v) + m) for g, v in groups.items()}
        # A document's own rates are those of the others.
        for i, _, *names in rows:
            g = tuple(names[:depth])
            above = others[i] if depth > 1 else (sum(p.values()) - p[i]) / (len(p) - 1)
            others[i] = (sum(groups[g]) - p[i] + m * above) / (len(groups[g]) - 1 + m)
            first.setdefault(i, others[i])
    for i in others:
        path = min(max(others[i], 1e-6), 1 - 1e-6)
        score = 1 / (1 + np.exp(-(got[i].evidence + np.log(path / (1 - path)))))
        assert abs(got[i].site_rate - first[i]) < 1e-9 and abs(got[i].path_rate - others[i]) < 1e-9 and abs(got[i].score - score) < 1e-9


def test_evidence_counts_once(spark):
    """A document that is alone on its site and its path meets the rate of all others."""
    good, bad = [prose(i, 40) for i in range(80)], [" ".join(w.upper() + "!!" for w in prose(i, 40).split()) for i in range(40)]
    docs = make(spark, good + bad, [f"site{i}" for i in range(120)])
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(0, 120, 3)], "doc_id long, quality int")
    rows = quality.quality(docs, labels).collect()
    own = {r.doc_id: 1 / (1 + np.exp(-(r.evidence + np.log(27 / 13)))) for r in rows}
    for r in rows:
        want = (sum(own.values()) - own[r.doc_id]) / 119
        assert r.site_rate == pytest.approx(want) and r.path_rate == pytest.approx(want)


def test_levels_of_urls_and_bounded_training(spark):
    urls = ["HTTPS://u@Ex.org:80/a/b/c.html?x=/y/", "http://ex.org", "http://ex.org/top.html", "no url", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in rows.select(*[c.alias(f"l{i}") for i, c in enumerate(quality.url_levels(F.col("u")))]).collect()]
    assert got == [("ex.org", "ex.org/a", "ex.org/a/b"), ("ex.org", "ex.org/", "ex.org/"), ("ex.org", "ex.org/", "ex.org/"), (None, None, None), (None, None, None)]
    docs = make(spark, [prose(1), "!! ??"] * 30).withColumn("doc_id", F.col("doc_id") % 2)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    x, _ = quality._training_rows(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), labels.toDF("_l", "_y"), 10)
    assert len(x) <= 10


# -- kernels ------------------------------------------------------------------


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["", None, " a\tB\x0b c ", "é ü x", "\x1fa b", "A" * 3000, *[prose(i, 9) for i in range(5)]]
    for a, b, part, starts, ends, words, counts in text.lowered_words(pa.array(texts)):
        k = 0
        for i in range(a, b):
            want = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
            assert counts[i - a] == len(want)
            assert [part[s:e].tobytes().decode() for s, e in zip(starts[k : k + len(want)], ends[k : k + len(want)], strict=True)] == want
            k += len(want)
        assert len(set(words.tolist())) == len({part[s:e].tobytes() for s, e in zip(starts, ends, strict=True)})
