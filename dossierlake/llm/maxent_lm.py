"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class).

* Classes: the ``TOP`` most frequent words and the end token have classes of
  their own; every other word, seen or not, belongs to one of ``SUFFIXES``
  classes by a hash of its last two bytes.
* P(class | history) is a softmax over the classes; its logits are rows of a
  hashed weight table, one each for the word before, the word before that (a
  skip feature) and the two together.
* Training goes in rounds over ever more of the training texts, which a hash of
  the id deals out: the first has ``START`` tokens and one task, each later one as
  many tokens as all before it, in tasks of ``TASK_TOKENS``.  Every task of a round
  runs AdaGrad from the same weights and squared gradients.  Their steps are added,
  each made smaller to what it would have been with the squared gradients of all
  tasks in sight, and these are added too.  Since a round sees no more than what
  was learned before, no weight is pushed far by many tasks at once.
* P(word | class) has add-0.1 smoothed counts, with one slot a class for all
  unseen words, so that the model sums to one just as the unigram base does.

Counts cover every training document and stay distributed.  A bounded head of
the most frequent words is broadcast; occurrences of other words are joined with
the counts table.

Defined results
  * null or empty text: the end token alone.  Very long texts: whole.
  * null id: counts as the empty text, whose remainder is 0, so held out.
  * repeated rows: each counts and is scored.  Words are told apart by 64-bit hash.
  * no training documents: all counts are 0 and classes are equally likely.
  * empty table: an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .store import discard, materialize, small_batches

TOP = 31
SUFFIXES = 32
CLASSES = TOP + 1 + SUFFIXES
#: Rows of the weight table for the three kinds of features; at most 2**16 in all.
TABLE = (1 << 13, 1 << 12, 1 << 12)
#: Words broadcast with their counts, at most.
HEAD = 1 << 18
#: Tokens of the first round, those of one training task, on average, and tasks of a round at most.
START = 250_000
TASK_TOKENS = 1_000_000
MAX_TASKS = 4096
RATE = 0.3
_BATCH = 8192
_FLUSH = 2_000_000
#: Parts of the weight table that are merged apart; of all tasks a part has 128 MB at most.
_CHUNKS = 256
_EACH = np.arange(CLASSES)
END = np.uint64(0xE703C6EF372FE94F)
BEGIN = np.uint64(0xB5297A4D3F84D5B5)


def _suffix(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix class of each word, from its last two bytes."""
    last = part[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, part[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (X.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(SUFFIXES)).astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last document, token hashes with ends, suffix classes (-1: end), tokens per document)."""
    for a, b, part, starts, ends, words, counts in X.lowered_words(column):
        at = np.cumsum(counts)
        yield a, b, np.insert(words, at, END), np.insert(_suffix(part, starts, ends) if len(starts) else np.zeros(0, np.int64), at, -1), counts + 1


def _histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(tokens, 3): rows of the weight table for each token's history."""
    first = np.cumsum(sizes) - sizes
    one = np.empty_like(tokens)
    one[1:] = tokens[:-1]
    one[first] = BEGIN
    two = np.empty_like(tokens)
    two[1:] = one[:-1]
    two[first] = BEGIN
    out = np.empty((len(tokens), 3), np.int64)
    with np.errstate(over="ignore"):
        out[:, 0] = X.mix(one) % np.uint64(TABLE[0])
        out[:, 1] = TABLE[0] + (X.mix(two + np.uint64(7)) % np.uint64(TABLE[1])).astype(np.int64)
        out[:, 2] = TABLE[0] + TABLE[1] + (X.mix(one * np.uint64(3) + two * np.uint64(5)) % np.uint64(TABLE[2])).astype(np.int64)
    return out


def _classes(tokens: np.ndarray, suffix: np.ndarray, top: np.ndarray, top_class: np.ndarray) -> np.ndarray:
    c = np.where(suffix < 0, TOP, TOP + 1 + suffix)
    if len(top):
        at = np.minimum(np.searchsorted(top, tokens), len(top) - 1)
        c = np.where((top[at] == tokens) & (suffix >= 0), top_class[at], c)
    return c


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]]
    z += weights[rows[:, 1]]
    z += weights[rows[:, 2]]
    z += bias
    if z.max(initial=0) > 60 or z.min(initial=0) < -60:
        z -= z.max(1, keepdims=True)
    return z


def _log_chosen(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log-probability of each token's class."""
    z = _logits(weights, bias, rows)
    chosen = z[np.arange(len(classes)), classes]
    return chosen - np.log(np.exp(z, out=z).sum(1))


def _descend(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One AdaGrad step on a batch of tokens."""
    gradient = _logits(weights, bias, rows)
    np.exp(gradient, out=gradient)
    gradient /= gradient.sum(1, keepdims=True)
    gradient[np.arange(len(classes)), classes] -= 1
    flat = gradient.astype(np.float64).ravel()
    for j in range(3):
        # Gradients are summed by row with one count over (row, class).
        own = rows[:, j].astype(np.uint16)
        order = own.argsort(kind="stable")
        ranked = own[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        row, mine = ranked[new], np.empty(len(own), np.int64)
        mine[order] = (np.cumsum(new) - 1) * CLASSES
        total = np.bincount((mine[:, None] + _EACH).ravel(), flat, len(row) * CLASSES).reshape(-1, CLASSES).astype(np.float32)
        more = squares[row] + total * total
        squares[row] = more
        total *= RATE
        total /= np.sqrt(more + 1e-6)
        weights[row] -= total


def _count(docs: DataFrame) -> DataFrame:
    """(h, s, c): hash, suffix class and count of every training token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def fold():
            h, at, c = np.unique(np.concatenate([x for x, _ in held]), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate([s for _, s in held])[at]), pa.array(c)], ["h", "s", "c"])

        for batch in batches:
            for _, _, tokens, suffix, _ in _tokens(batch.column(0)):
                held.append((tokens, suffix))
                size += len(tokens)
                if size >= _FLUSH:
                    yield fold()
                    held, size = [], 0
        if held:
            yield fold()

    found = docs.where("not held_out").select("_text").mapInArrow(count, "h long, s long, c long")
    return materialize(found.groupBy("h", "s").agg(F.sum("c").alias("c")), "counts")


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the most frequent tokens, at most HEAD, sorted by hash."""
    # At most 63 rows, one for each power of two.
    by = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("c")).alias("p")).count().collect()}
    p, rows = max(by, default=0), 0
    while p >= 0 and rows + by.get(p, 0) <= HEAD:
        rows += by.get(p, 0)
        p -= 1
    # Of the next power, those from a threshold on that surely fit.
    fine = {r[0]: r[1] for r in counts.where(F.floor(F.log2("c")) == p).groupBy(F.floor(F.col("c") / F.pow(F.lit(2.0), p - 6)).alias("q")).count().collect()} if p >= 0 else {}
    q = max(fine, default=0)
    while q in fine and rows + fine[q] <= HEAD:
        rows += fine[q]
        q -= 1
    least = (q + 1) * 2.0 ** (p - 6) if fine else 2.0 ** (p + 1)
    found = counts.where(F.col("c") >= least).select("h", "c").toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _bounds(total: int) -> list[int]:
    """The tokens that have been seen at the end of each round."""
    out = [min(total, START)]
    while out[-1] < total:
        out.append(min(total, 2 * out[-1]))
    return out


def merged(before: np.ndarray, steps: list[np.ndarray], squares: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(step, squares) of a round from those of its tasks; ``before`` are the squared gradients that it began with."""
    after = before + sum(squares)
    safe = np.maximum(after, 1e-30)
    return sum(step * np.sqrt((before + own) / safe) for step, own in zip(steps, squares, strict=True)), after


def _round(texts: DataFrame, weights: np.ndarray, squares: np.ndarray, top, top_class, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, squares) after a round in which each partition of ``texts`` is a task; twice ``sum(TABLE) * CLASSES`` numbers reach the driver."""
    size, step = sum(TABLE), sum(TABLE) // _CHUNKS
    known = texts.sparkSession.sparkContext.broadcast((weights, squares, top, top_class, bias))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, top, top_class, bias = known.value
        own, more = weights.copy(), squares.copy()
        some = False
        for batch in batches:
            for _, _, tokens, suffix, sizes in _tokens(batch.column(0)):
                rows, classes = _histories(tokens, sizes), _classes(tokens, suffix, top, top_class)
                for a in range(0, len(tokens), _BATCH):
                    _descend(own, more, bias, rows[a : a + _BATCH], classes[a : a + _BATCH])
                    some = True
        if some:
            parts = [[(x[k * step : (k + 1) * step]).tobytes() for k in range(_CHUNKS)] for x in (own - weights, more - squares)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["chunk", "w", "g"])

    def merge(table: pa.Table) -> pa.Table:
        k = table.column("chunk")[0].as_py()
        steps, own = ([np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.column(c)] for c in ("w", "g"))
        start, before = (known.value[i][k * step : (k + 1) * step].astype(np.float64).ravel() for i in (0, 1))
        moved, after = merged(before, steps, own)
        return pa.table({"chunk": table.column("chunk")[:1], "w": pa.array([(start + moved).astype(np.float32).tobytes()], pa.binary()), "g": pa.array([after.astype(np.float32).tobytes()], pa.binary())})

    learned = texts.mapInArrow(learn, "chunk int, w binary, g binary")
    # Written, so that the shuffle files of a round go before the next one.
    found = materialize(learned.groupBy("chunk").applyInArrow(merge, "chunk int, w binary, g binary"), "weights")
    chunks = {r[0]: r for r in found.collect()}
    discard(found)
    if not chunks:
        return weights, squares
    table = lambda i: np.concatenate([np.frombuffer(chunks[k][i], np.float32) for k in range(_CHUNKS)]).reshape(size, CLASSES)
    return table(1), table(2)


def _train(docs: DataFrame, total: int, top, top_class, bias: np.ndarray) -> np.ndarray:
    """The weight table, learned in rounds."""
    weights, squares = np.zeros((sum(TABLE), CLASSES), np.float32), np.zeros((sum(TABLE), CLASSES), np.float32)
    if not total:
        return weights
    bounds = _bounds(total)
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    number = sum(((place >= b / total).cast("int") for b in bounds[:-1]), F.lit(0))
    texts = docs.where("not held_out").select("_text", number.alias("_round"))
    if len(bounds) > 1:
        texts = materialize(texts, "rounds", by="_round")
    for k, (begin, end) in enumerate(zip([0, *bounds], bounds, strict=False)):
        own = texts.where(F.col("_round") == k).select("_text")
        tasks = int(min(MAX_TASKS, max(1, round((end - begin) / TASK_TOKENS))))
        # Texts are dealt out in turn, so that tasks have about as many wherever the files lie.  What a
        # task returns does not shrink with its share, so there are never more tasks than tokens ask for.
        own = own.repartition(tasks) if tasks > 1 else own.coalesce(1)
        weights, squares = _round(own, weights, squares, top, top_class, bias)
    discard(texts)
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    small_batches(spark)
    held_out = F.pmod(F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))), F.lit(10)) == 0
    docs = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), held_out.alias("held_out"))
    counts = _count(docs)
    total, distinct = (int(x or 0) for x in counts.select(F.sum("c"), F.count("*")).first())
    best = counts.where("s >= 0").orderBy(F.desc("c"), "h").limit(TOP).collect()
    top = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(top)
    top, top_class = top[order], order.astype(np.int64)
    tokens_of, kinds_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for s, c, n in counts.groupBy("s").agg(F.sum("c"), F.count("*")).collect():
        tokens_of[TOP if s < 0 else TOP + 1 + s], kinds_of[TOP if s < 0 else TOP + 1 + s] = c, n
    for k, r in enumerate(best):
        tokens_of[k], kinds_of[k] = r["c"], 1
        tokens_of[TOP + 1 + r["s"]] -= r["c"]
        kinds_of[TOP + 1 + r["s"]] -= 1
    bias = np.log((tokens_of + 0.1 * (kinds_of + 1)) / (total + 0.1 * (distinct + CLASSES))).astype(np.float32)
    within = np.log10(tokens_of + 0.1 * (kinds_of + 1))
    weights = _train(docs, total, top, top_class, bias)
    head, often = _head(counts)
    model = spark.sparkContext.broadcast((weights, bias, within, top, top_class, head, often))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, within, top, top_class, head, often = model.value
        log_often = np.log10(often + 0.1)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "known", "s", "model", "rare", "times", "many")}
            for a, b, tokens, suffix, sizes in _tokens(batch.column(1)):
                rows, classes = _histories(tokens, sizes), _classes(tokens, suffix, top, top_class)
                by_class = np.empty(len(tokens))
                for i in range(0, len(tokens), _BATCH):
                    part = classes[i : i + _BATCH]
                    by_class[i : i + _BATCH] = _log_chosen(weights, bias, rows[i : i + _BATCH], part)
                by_class = by_class / np.log(10) - within[classes]
                if len(head):
                    at = np.minimum(np.searchsorted(head, tokens), len(head) - 1)
                    there = head[at] == tokens
                    logs = np.where(there, log_often[at], 0.0)
                else:
                    there, logs = np.zeros(len(tokens), bool), np.zeros(len(tokens))
                first = np.cumsum(sizes) - sizes
                out["n"].append(sizes)
                out["known"].append(np.add.reduceat(there.astype(np.int64), first))
                out["s"].append(np.add.reduceat(logs, first))
                out["model"].append(np.add.reduceat(by_class, first))
                # The other words of each document, with how often they occur there.
                doc = np.repeat(np.arange(b - a), sizes)[~there]
                rest = tokens[~there]
                order = np.lexsort((rest, doc))
                doc, rest = doc[order], rest[order]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])))) if len(rest) else np.zeros(0, np.int64)
                out["rare"].append(rest[new].view(np.int64))
                out["times"].append(np.diff(np.concatenate((new, [len(rest)]))).astype(np.int64))
                out["many"].append(np.bincount(doc[new], minlength=b - a))
            join = lambda c, kind: np.concatenate(out[c]) if out[c] else np.zeros(0, kind)
            lists = pa.array(np.concatenate(([0], np.cumsum(join("many", np.int64)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(join("n", np.int64)), pa.array(join("known", np.int64)), pa.array(join("s", float)), pa.array(join("model", float)), pa.ListArray.from_arrays(lists, pa.array(join("rare", np.int64))), pa.ListArray.from_arrays(lists, pa.array(join("times", np.int64)))],
                ["_id", "held_out", "n", "known", "s", "model", "rare", "times"],
            )

    kind = docs.schema["_id"].dataType.simpleString()
    scored = docs.select("_id", "_text", "held_out").mapInArrow(score, f"_id {kind}, held_out boolean, n long, known long, s double, model double, rare array<long>, times array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    logs = F.log10(F.coalesce("c", F.lit(0)) + 0.1) * F.col("times")
    tail = rare.join(counts.select("h", "c").hint("merge"), "h", "left").groupBy("row").agg(F.sum(logs).alias("tail_s"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    s = F.col("s") + F.coalesce("tail_s", F.lit(0.0))
    return scored.drop("rare", "times").join(tail, "row", "left").select(
        F.col("_id").alias("doc_id"),
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (s - F.col("n") * F.lit(float(np.log10(total + 0.1 * (distinct + 1))))).alias("base_score"),
        (s + F.col("model")).alias("score"),
    )
