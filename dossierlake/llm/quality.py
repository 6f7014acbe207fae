"""Quality classifier: hierarchical empirical Bayes over document evidence and sites.

1.  Evidence.  Surface statistics of the whole text go through a logistic
    regression fitted on labelled rows, at most ``TRAIN_ROWS`` of them (a hash
    picks which, if there are more).  Its log-odds less the prior log-odds is
    the document's evidence.
2.  Sites.  Over *all* documents, grouped sums of the document posteriors give
    each site and each path below it a mean rate.  ``levels`` names the columns
    from the site down, as many as there are; ``url_levels`` makes them from a URL
    (host, first folder, first two folders).  The registered query has no URLs and
    takes source and language.  A rate is shrunk to its parent, the first level to
    the global rate, by a beta prior whose strength is estimated from the spread
    of the level's groups (method of moments), so that sparse sites stay near what
    is above them.
3.  A document's score is its evidence on top of the rate of its finest group, which
    leaves the document itself out at every level.

The sums are combined before the shuffle; only per-level totals reach the driver.

Defined results
  * null or empty text: statistics of an empty text.  Very long texts: whole.
  * null site or path: a site or path of its own.
  * repeated rows: each is scored.  Repeated or null labels: a null label is
    ignored; a document labelled twice counts twice in the fit.
  * documents repeated under one labelled id: each takes part in the fit, of which
    a hash then picks as many as the bound allows.
  * no labels, or one class only: no evidence; every document is kept.
  * empty table: an empty result.  Extra columns, also such as ``n`` or ``score``, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .store import materialize, small_batches

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
_CLASSES = 12


def _byte_classes() -> np.ndarray:
    c = np.full(256, 10, np.uint8)  # other punctuation
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[128:] = 3
    for k, chars in ((4, " \t\r\v\f"), (5, "\n"), (6, "."), (7, ",;:'\"-()"), (8, "!?"), (9, "|<>{}[]\\/=")):
        for x in chars:
            c[ord(x)] = k
    c[:9] = c[14:32] = 11  # control characters
    return c


_CLASS = _byte_classes()
FEATURES = _CLASSES + 7


def text_features(column: pa.Array) -> np.ndarray:
    """(documents, FEATURES) statistics; all are shares, rates or logarithms."""
    data, offsets = X.buffer_of(column)
    out = np.zeros((len(offsets) - 1, FEATURES))
    for a, b in X.steps(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n, sizes = b - a, np.diff(at)
        doc = np.repeat(np.arange(n), sizes)
        kind = _CLASS[part]
        counts = np.bincount(doc * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
        if len(part):
            twice = np.zeros(len(part), bool)
            twice[1:] = (part[1:] == part[:-1]) & (kind[1:] >= 6)
            doubled = np.bincount(doc[twice], minlength=n)
        else:
            doubled = np.zeros(n)
        starts, ends, words = X.word_spans(part, at)
        word_doc = np.repeat(np.arange(n), words)
        hashes = X.span_hashes(X.LOWER[part], starts, ends)
        echo = word_doc[1:][(hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])]
        caps = np.bincount(word_doc[kind[starts] == 1], minlength=n) if len(starts) else np.zeros(n)
        size, nw = np.maximum(sizes, 1), np.maximum(words, 1)
        out[a:b, :_CLASSES] = np.sqrt(counts / size[:, None])
        out[a:b, _CLASSES] = np.sqrt(doubled / size)
        out[a:b, _CLASSES + 1] = caps / nw
        out[a:b, _CLASSES + 2] = np.log1p((sizes - counts[:, 4] - counts[:, 5]) / nw)
        out[a:b, _CLASSES + 3] = np.log1p(words)
        out[a:b, _CLASSES + 4] = np.log1p(words / (1 + counts[:, 5]))
        out[a:b, _CLASSES + 6] = np.sqrt(np.bincount(echo, minlength=n) / nw)
        out[a:b, _CLASSES + 5] = counts[:, 1] / np.maximum(1, counts[:, 0] + counts[:, 1] + counts[:, 3])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, scale, weights with the intercept last) by Newton steps; None for one class only."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    labels = labels.where("_y is not null and _l is not null")
    n = labels.count()
    if n > limit:
        labels = labels.where(F.pmod(F.xxhash64("_l"), F.lit(1_000_000)) < int(950_000 * limit / n))
    labels = materialize(labels, "labels")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(0))
            at = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(x.ravel())), batch.column(1)], ["x", "y"])

    # At most ``limit`` labels, whose size is bounded, are broadcast.
    met = docs.join(F.broadcast(labels), F.col("_id") == F.col("_l")).select("_id", "_text", F.col("_y").cast("double").alias("_y"))
    # Ids that repeat could bring more rows than labels.
    rows = materialize(met.select("_text", "_y", F.xxhash64("_id", "_text").alias("_h")), "labelled")
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod("_h", F.lit(1_000_000)) < int(1_000_000 * limit / n)).limit(limit)
    rows = rows.select("_text", "_y").mapInArrow(features, "x array<double>, y double").toPandas()
    return (np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, FEATURES))), rows["y"].to_numpy(float)


def _strength(groups: DataFrame, parent: str) -> float:
    """Beta prior strength from the spread of the groups' mean rates around the parent's."""
    n, between, within = groups.select(
        F.sum("n"), F.sum(F.col("n") * F.pow(F.col("p") / F.col("n") - F.col(parent), 2)), F.sum(F.col(parent) * (1 - F.col(parent)))
    ).first()
    groups_n, pi = groups.select(F.count("*"), F.avg(parent)).first()
    if not n or groups_n < 2:
        return 1000.0
    tau = max((between - within) / n, 1e-9)
    return float(min(max(pi * (1 - pi) / tau - 1, 1.0), 1e6))


def url_levels(url: Column, folders: int = 2) -> list[Column]:
    """The host of a URL, lower-cased, and its first folders, one column for each level; null for no URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*/)", 1), "/"), lambda x: x != "")
    host = F.nullif(host, F.lit(""))
    return [host, *[F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, k), "/")) for k in range(1, folders + 1)]]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[str | Column, ...] = ("source", "lang"), label_id: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, evidence, site_rate, path_rate, score, kept``.

    ``site_rate`` is the rate of the first level, ``path_rate`` that of the last; both
    are those of the other documents, so that no evidence counts twice.  ``key``, if given,
    stands for the id in the result; labels always go by id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = [f"_g{i}" for i in range(len(levels))]
    groups = [(docs[c] if isinstance(c, str) else c).cast("string").alias(n) for c, n in zip(levels, names, strict=True)]
    known = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    docs = docs.select((docs[id_col] if key is None else key).alias("_id"), docs[text_col].alias("_text"), *groups)
    x, y = _training_rows(known, labels.select(labels[label_id].alias("_l"), labels[label_col].alias("_y")), train_rows)
    model = fit_logistic(x, y)
    prior = float(np.log(y.mean() / (1 - y.mean()))) if model else float(np.log(0.99 / 0.01))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                e = np.zeros(batch.num_rows)
            else:
                mean, scale, w = shared.value
                e = np.clip((text_features(batch.column(1)) - mean) / scale @ w[:-1] + w[-1], -30, 30) - prior
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(e)], ["_id", *names, "e"])

    kind = docs.schema["_id"].dataType.simpleString()
    logistic = lambda z: 1 / (1 + F.exp(-z))
    scored = materialize(docs.select("_id", "_text", *names).mapInArrow(evidence, f"_id {kind}, {', '.join(f'{n} string' for n in names)}, e double"), "evidence")
    finest = materialize(scored.groupBy(*names).agg(F.count("*").alias("n"), F.sum(logistic(F.col("e") + prior)).alias("p")), "groups")
    whole = finest.select(F.sum("n"), F.sum("p")).first()
    above, sums, strengths = None, [], []
    for i, name in enumerate(names):
        own = finest.groupBy(*names[: i + 1]).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        if above is None:
            own = own.withColumn("up", F.lit(float(whole[1] / whole[0] if whole[0] else 0.5)))
        else:
            on = [F.col(n).eqNullSafe(F.col(f"{n}u")) for n in names[:i]]
            own = own.join(above, on[0] if len(on) == 1 else on).drop(*[f"{n}u" for n in names[:i]])
        own = materialize(own, "level")
        m = _strength(own, "up")
        strengths.append(m)
        kept = [*names[: i + 1], *sums]
        sums += [f"n{i}", f"p{i}"]
        own = own.select(*kept, F.col("n").alias(f"n{i}"), F.col("p").alias(f"p{i}"), ((F.col("p") + m * F.col("up")) / (F.col("n") + m)).alias("up"))
        above = own.select(*[F.col(n).alias(f"{n}u") for n in names[: i + 1]], *sums, "up")
    final = materialize(above.drop("up"), "rates")
    # The rates that a document meets leave itself out, as its evidence is added to them.
    own = logistic(F.col("e") + prior)
    others = lambda total: F.greatest(total - own, F.lit(0.0))
    rate = others(F.lit(float(whole[1]))) / F.lit(float(whole[0] - 1)) if (whole[0] or 0) > 1 else F.lit(0.5)
    rates = []
    for i, m in enumerate(strengths):
        rate = (others(F.col(f"p{i}")) + m * rate) / (F.col(f"n{i}") - 1 + m)
        rates.append(rate)
    safe = F.least(F.greatest(rates[-1], F.lit(1e-6)), F.lit(1 - 1e-6))
    score = logistic(F.col("e") + F.log(safe / (1 - safe)))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}u"))
    return scored.join(final, on).select(
        F.col("_id").alias("doc_id"), F.col("e").alias("evidence"), rates[0].alias("site_rate"), rates[-1].alias("path_rate"), score.alias("score"), (score >= threshold).alias("kept")
    )
