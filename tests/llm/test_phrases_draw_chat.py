"""Phrase mining, importance resampling and chat trees against brute-force versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import chat_tree, collocations, packing, resampling

DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, key string, row long"


def make(spark, texts, langs=("en",)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], "a", 1, "x", "y", 2) for i, t in enumerate(texts)], DOCS)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- 11 -----------------------------------------------------------------------


def phrases_by_hand(texts, langs, longest=3, least=10, covered=50, top=2000):
    count, n = Counter(), Counter()
    for t, lang in zip(texts, langs, strict=True):
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    frequent = {k: c for k, c in count.items() if len(k[1]) > 1 and c >= least}
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        if any(
            lang == other and len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (other, v), b in frequent.items()
        ):
            continue
        score, _, left, right = min((1000000 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    rows = {}
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return rows


def chatter(seed, n=300, vocabulary=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "naïve", "日本", "THE"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  ", "\r", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest, least, bits", [(3, 10, None), (2, 3, 16), (5, 4, None)])
def test_phrases(spark, longest, least, bits):
    texts = [*chatter(1), None, "", " \t ", "one", "fixed phrase of words here. " * 40]
    langs = ["en", None, "de", "und"]
    docs = make(spark, texts, langs)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, longest, least, bits=bits).collect()}
    assert got == phrases_by_hand(texts, [langs[i % 4] for i in range(len(texts))], longest, least)
    assert got


def test_phrases_when_buckets_and_tasks_are_crowded(spark, monkeypatch):
    # 16 bits for everything and counts handed over early: more work, the same rows.
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "SALTS", 3)
    texts = chatter(2, 400, 120)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(make(spark, texts), least=3, top=20, bits=16).collect()}
    assert got == phrases_by_hand(texts, ["en"] * len(texts), least=3, top=20)
    assert len(got) == 20


def test_buckets_stop_at_255_but_still_count():
    b = collocations._Buckets(16)
    for _ in range(3):
        b.add(np.repeat(np.array([5 << 48], np.uint64), 200))
    (c, data), = b.chunks()
    assert c == 0 and collocations._cells(data, 1 << 16)[1].tolist() == [255]


def test_products_beyond_64_bits(spark):
    # Counts as they would be on a large corpus, through the same expression.
    row = spark.sql("select cast(1000000000000 as decimal(15,0)) a, cast(2000000000000 as decimal(15,0)) l")
    assert row.select(F.expr("cast((a * a * cast(1000000 as decimal(7,0))) div (l * l) as bigint)")).first()[0] == 250000


def test_phrases_of_nothing(spark):
    assert collocations.collocations(make(spark, [])).count() == 0
    assert collocations.collocations(make(spark, [None, "", "a b c"])).count() == 0


def test_very_long_text_of_phrases(spark):
    text = " ".join(f"a{i % 7} b{i % 3}" for i in range(300_000))
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(make(spark, [text, " " * 2_000_000])).collect()}
    assert got == phrases_by_hand([text, ""], ["en", "en"])


# -- 12 -----------------------------------------------------------------------


def draw_by_hand(rows, target, percent=10, min_words=20, longest=1, buckets=10_000, seed=2024):
    def features(t):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, n, f in own:
        gain = sum(math.floor(1000 * math.log(float((t[b] + 1) * (S + buckets)) / float((s[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = gain // len(f) if f else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] if x[0] is not None else 0))
    rank = {x[0]: k for k, x in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((i, f, w, sc, rank.get(i)) for i, n, f, w, sc in out), key=repr)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (2, 50, 60), (1, 1, 100)])
def test_draw(spark, longest, buckets, percent):
    texts = [*chatter(3, 200), None, "", "Two words", "日本 " * 30, "a-b_c d9 " * 20_000]
    rows = [(k - 40, t) for k, t in enumerate(texts)] + [(None, "word " * 25)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score long, rank long")
    target = [*chatter(4, 20), None, "日本"]
    want = draw_by_hand(rows, target, percent, longest=longest, buckets=buckets)
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent, longest=longest, buckets=buckets).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sum(r.rank is not None for r in got) == percent * sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))) >= 20 for _, t in rows) // 100


def test_selection_of_the_kth_key_with_many_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([-3, 0, 0, 0, 7, 100000]), rng.randrange(-50, 50), k) for k in range(600)]
    df = spark.createDataFrame(rows, "score long, doc_id long, row long")
    keyed = df.withColumn("key", resampling.draw_key(F.col("score"), F.col("doc_id"), F.col("row"), True))
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    by_key = {bytes(r.key): (r.score, r.doc_id, r.row) for r in keyed.collect()}
    assert [by_key[k] for k in sorted(by_key)] == order
    for k in (1, 2, 299, 300, 301, 600):
        assert by_key[resampling.kth_key(keyed, k)] == order[k - 1]
    assert resampling.kth_key(keyed, 0) is None and resampling.kth_key(keyed, 601) is None
    got = resampling.ranked(keyed.repartition(5)).collect()
    assert [(r.score, r.doc_id, r.row) for r in sorted(got, key=lambda r: r.rank)] == order
    with pytest.raises(ValueError):
        resampling.kth_key(keyed.unionAll(keyed), 3)


def test_draw_with_repeated_rows_and_names_as_ids(spark):
    docs = spark.createDataFrame([(n, "some words " * 15) for n in ["b", "a", "a", "c", None]], "doc_id string, text string")
    got = resampling.resample(docs, docs, percent=60).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert sorted(r.rank for r in got if r.rank) == [k for k, _ in enumerate(sorted((-r.score for r in got if r.rank)), 1)]


def test_draw_from_nothing(spark):
    docs = make(spark, [])
    assert resampling.resample(docs, docs).count() == 0
    few = resampling.resample(make(spark, ["too short", None]), docs).collect()
    assert [r.rank for r in few] == [None, None]


# -- 13 -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, node long, ids string"


def talks():
    rows = []
    for c in range(60):
        depth = 1 + c % 5
        for k in range(depth):
            # The first two turns are shared by many, later ones by few.
            text = ("hello", f"answer {c % 2}", f"more {c % 6}", f"last {c}", "end")[k]
            rows.append((c, k, ("user", "assistant")[k % 2], text))
    odd = [r"a\b", "<|end|>", r"<\|", r"\\|<|<||", "<|turn|>assistant<|text|>no<|end|>", r"\### Assistant: </turn> ok", "<|endoftext|>", "日本語 é\n\n", "", None, "x" * 5000]
    for k, t in enumerate(odd):
        rows += [(100 + k, 0, "user", t), (100 + k, 1, "assistant", t), (100 + k, 2, None, t), (100 + k, 2, "<|text|>", "role")]
    rows += [(200, None, "user", "no turn"), (200, 3, "assistant", "a"), (200, 3, "assistant", "a"), (200, 1, "system", "first")]
    rows += [(300, k, "assistant", f"long {k}") for k in range(400)]
    rows += [(None, 0, "user", "alone"), (None, 1, "assistant", "apart")]
    return rows


def conversations(rows):
    by = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        by[(c, k if c is None else 0)].append(((turn is not None, turn or 0), role or "", text or ""))
    return [(c, [(role, text) for _, role, text in sorted(x)]) for (c, _), x in by.items()]


def digest(c, turns):
    said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
    size = sum(len(chat_tree.escape(r)) + len(chat_tree.escape(t)) + len("<|turn|><|text|><|end|>") for r, t in turns)
    return (c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)


@pytest.mark.parametrize("max_tokens, in_order", [(65_536, True), (65_536, False), (200, True), (1, False)])
def test_chats_come_back(spark, max_tokens, in_order):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS).repartition(3)
    got = chat_tree.read_back(chat_tree.chat_trees(df, max_tokens=max_tokens), in_order).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((digest(c, t) for c, t in conversations(rows)), key=repr)


@pytest.mark.parametrize("max_tokens", [65_536, 60])
def test_trees_hold_shared_turns_once(spark, max_tokens):
    rows = talks()
    # One range, so that trees are cut by size alone.
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = chat_tree.chat_trees(spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS), max_tokens=max_tokens).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sequences = defaultdict(dict)
    for r in found:
        if r.ids is not None:
            sequences[r.sequence_id][r.node] = r
    decode = chat_tree._decoder(chat_tree.RANKS)
    emitted = Counter()
    for nodes in sequences.values():
        at = 0
        for k in range(len(nodes)):
            node = nodes[k]
            # Depth first, without gaps.
            assert (node.offset, node.length) == (at, len(node.ids)) and (node.parent is None) == (k == 0)
            at += node.length
            above, up = [], node
            while up.parent is not None:
                up = nodes[up.parent]
                above.insert(0, up)
            assert node.position == sum(x.length for x in above)
            seen = {p for a, b in node.attends for p in range(a, b)}
            assert seen == {p for x in above for p in range(x.offset, x.offset + x.length)}
            assert all(a[1] < b[0] for a, b in zip(node.attends, node.attends[1:], strict=False))
            text = decode(np.array(node.ids))
            role, said = re.fullmatch(r"<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>", text, re.DOTALL).groups()
            assert decode(np.array(node.ids[node.loss_from : node.loss_to], dtype=int)) == (said if role == "assistant" else "")
            emitted[tuple(decode(np.array(x.ids)) for x in [*above, node])] += 1
        assert at <= max_tokens or len({r.node for r in found if r.ids is None and r.sequence_id == nodes[0].sequence_id}) == 1
    prefixes = {tuple(map(str, t[: k + 1])) for _, t in conversations(rows) for k in range(len(t))}
    assert len(emitted) == len(prefixes)
    if max_tokens > 1000:
        assert set(emitted.values()) == {1}
        assert len(sequences) == len({p for p in prefixes if len(p) == 1})
        # The turns of 60 conversations: one root, and fewer nodes than turns.
        assert len(emitted) < len(rows)


def test_chats_of_nothing(spark):
    assert chat_tree.chat_trees(spark.createDataFrame([], TURNS)).count() == 0


def test_equal_conversations_have_one_node_each_turn(spark):
    df = spark.createDataFrame([(c, k, "user", f"t{k}") for c in range(500) for k in range(3)], "conv_id long, turn long, role string, text string")
    trees = chat_tree.chat_trees(df).cache()
    n = trees.select("sequence_id").distinct().count()
    assert trees.where("ids is not null").count() == 3 * n and trees.where("ids is null").count() == 500


# -- 2: texts that the fast encoder gives up on ------------------------------------


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 300_000, "x" + " " * 1_200_000 + "y<|endoftext|>"])
def test_very_long_runs_are_packed(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 2]
    got = sorted(packing.pack_documents(make(spark, [text, "short"])).where("doc_id = 0").collect(), key=lambda r: r.piece)
    assert sum(r.length for r in got) == len(want)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
