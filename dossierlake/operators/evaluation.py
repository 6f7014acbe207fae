"""Evaluation metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running_sum


def auc(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC by ranks; of equal scores positives rank first, as the lower.  Null for one class only.

    Ranks come from counts by distinct score and their running sum.
    """
    by = scores.groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    below = running_sum(by, score, "n", "upto").withColumn("under", F.col("upto") - F.col("n"))
    wins = below.agg(F.sum(F.col("p") * F.col("under")).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def auc_mid_rank(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC with ties counted half."""
    by = scores.groupBy(score).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    below = running_sum(by, score, "n", "upto").withColumn("under", F.col("upto") - F.col("n"))
    wins = below.agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def recall_at_fpr(scores: DataFrame, fpr: float, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold that lets at most ``fpr`` of the negatives above it, and the recall beyond it."""
    n = scores.agg(F.count_if(~F.col(label))).scalar()
    by = scores.where(~F.col(label)).groupBy(score).agg(F.count("*").alias("c"))
    upto = running_sum(by, score, "c", "upto")
    threshold = upto.where(F.col("upto") > F.least(n - 1, F.ceil(n * (1 - fpr)))).agg(F.min(score)).scalar()
    positives = scores.where(label).withColumn("threshold", threshold)
    return positives.groupBy("threshold").agg(F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("recall"))


def overlap(rows: DataFrame, inter: str = "inter", union: str = "union_px") -> DataFrame:
    return rows.agg((F.sum(inter) / F.nullif(F.sum(union), F.lit(0))).alias("iou"))


def error_rate(rows: DataFrame, truth: str, read: str) -> DataFrame:
    """Character error rate and share of exact reads."""
    return rows.agg((F.sum(F.levenshtein(truth, read)) / F.sum(F.length(truth))).alias("cer"), F.avg((F.col(truth) == F.col(read)).cast("double")).alias("exact"))


def roll_up(rows: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """Measures by each key alone and over all rows."""
    sets = [[k] for k in keys] + [[]]
    return rows.groupingSets(sets, *keys).agg(*measures)


def share_text(good: Column, all_: Column) -> Column:
    """``a/b (p%)``."""
    return F.concat(good.cast("string"), F.lit("/"), all_.cast("string"), F.lit(" ("), F.format_number(100 * good / all_, 1), F.lit("%)"))


def quantiles(rows: DataFrame, value: str, *points: float) -> DataFrame:
    """Exact percentiles, interpolated, and the mean; from counts by distinct value and their running sum."""
    by = running_sum(rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c")), value, "c", "upto")
    n = rows.agg(F.count(value)).scalar()
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    out = by.agg(
        *[f(p).alias(f"{name}{round(p * 100)}") for p in points for name, f in (("lo", lambda p: at(F.floor((n - 1) * p))), ("hi", lambda p: at(F.ceil((n - 1) * p))))],
        (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max("upto").alias("n"),
    )
    place = lambda p: (F.col("n") - 1) * p
    between = lambda p: F.col(f"lo{round(p * 100)}") + (place(p) - F.floor(place(p))) * (F.col(f"hi{round(p * 100)}") - F.col(f"lo{round(p * 100)}"))
    return out.select(*[between(p).alias(f"p{round(p * 100)}") for p in points], "mean")
