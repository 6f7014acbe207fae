"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are compared after deleting ASCII white space.  The first digit of a text
is its byte length with its first bytes; each later digit is the next run of
bytes, eight times as wide as the one before.  Every level splits the groups
that are left by their next digit, and a group leaves as soon as it is a
singleton or its bytes have ended.  Since the length is part of the first
digit, the members of a group end together, and a group that has ended is a set
of equal texts.  No digest decides equality; the SHA-256 is only reported.

A level is one grouped count, combined before the shuffle, whose result is
written and joined back, so that a group that holds a third of all rows is
split by the adaptive skew join.  Joins that carry texts are sort-merge joins at
every size, so that what they move grows in proportion.  The number of levels grows with the logarithm
of the longest *repeated* text.

Defined results
  * null text: counts as the empty text; all empty texts are equal.
  * ties: of equal texts the one with most code points stays, then the smallest
    id; a null id comes last.  Rows repeated with the same id: one of them stays.
  * empty table: an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

FIRST_DIGIT = 64
WIDEN = 8
SPACE = r"[\x20\x09-\x0D]+"


def normalized(text):
    """The text without ASCII white space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    norm = docs.select(docs[id_col].alias("_id"), F.length(F.coalesce(docs[text_col], F.lit(""))).alias("_cp"), normalized(docs[text_col]).alias("_n"))
    head = [F.octet_length("_n").alias("_nb"), F.substring(F.col("_n").cast("binary"), 1, first).alias("_d")]
    shared = materialize(norm.select(*head).groupBy("_nb", "_d").agg(F.count("*").alias("_c")).where("_c > 1").select("_nb", "_d", F.monotonically_increasing_id().alias("_g")), "radix0")
    rest = F.when(F.col("_g").isNotNull() & (F.col("_nb") > first), F.expr(f"substring(cast(_n as binary), {first + 1})"))
    level = materialize(
        norm.select("_id", "_cp", "_n", *head)
        .join(shared.hint("merge"), ["_nb", "_d"], "left")
        .select("_id", "_cp", F.sha2("_n", 256).alias("_sha"), "_g", rest.alias("_r"), F.monotonically_increasing_id().alias("_row")),
        "radix1",
    )
    done, width = [level.where("_r is null").drop("_r")], first * widen
    longest = level.agg(F.max(F.octet_length("_r"))).first()[0]
    while longest:
        part = level.where("_r is not null").withColumn("_d", F.substring("_r", 1, width))
        shared = materialize(part.groupBy(F.col("_g").alias("_pg"), F.col("_d").alias("_pd")).agg(F.count("*").alias("_c")).where("_c > 1").select("_pg", "_pd", F.monotonically_increasing_id().alias("_ng")), "radixn")
        more = F.when(F.col("_ng").isNotNull() & (F.octet_length("_r") > width), F.expr(f"substring(_r, {width + 1})"))
        level = materialize(
            part.join(shared.hint("merge"), (F.col("_g") == F.col("_pg")) & (F.col("_d") == F.col("_pd")), "left").select("_id", "_cp", "_sha", (F.lit(len(done)) * F.lit(1 << 53) + F.col("_ng")).alias("_g"), more.alias("_r"), "_row"),
            "radixn",
        )
        done.append(level.where("_r is null").drop("_r"))
        width *= widen
        longest = level.agg(F.max(F.octet_length("_r"))).first()[0]
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    order = F.struct((-F.col("_cp")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col("_row").alias("d"))
    best = materialize(rows.where("_g is not null").groupBy(F.col("_g").alias("_bg")).agg(F.count("*").alias("_size"), F.min(order).alias("_best")), "radixbest")
    return rows.join(best, F.col("_g") == F.col("_bg"), "left").select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_bg").isNull(), F.col("_id")).otherwise(F.col("_best.c")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best.d") == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells the rows of ``docs`` apart: id and text.  Keys sort as the ids do, with null ids last."""
    return F.struct(docs[id_col].isNull().alias("no"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("a"), F.xxhash64(F.lit(1), docs[text_col]).alias("b"))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps; its ``doc_id`` is the ``row_key`` of a row, beside it stands ``kept``.

    Rows that share an id but not their text are decided apart, and so are those
    without an id.  Rows that share both are kept once if one of them stays.
    """
    key, own = "__dossierlake_key", "__dossierlake_row"
    by_key = decisions.groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("_any"), F.count("*").alias("_n"))
    verdict = materialize(by_key.where("not _any or _n > 1"), "verdict")
    met = (F.col(own)["a"] == F.col(key)["a"]) & (F.col(own)["b"] == F.col(key)["b"]) & F.col(own)["id"].eqNullSafe(F.col(key)["id"])
    keyed = docs.withColumn(own, row_key(docs, id_col, text_col))
    out = keyed.join(verdict.where("not _any").select(key).hint("merge"), met, "left_anti")
    twice = verdict.where("_any").select(key)
    if not twice.isEmpty():
        # Rows that share id and text are few; keep one row of each.
        again = out.join(twice.hint("merge"), met, "left_semi").dropDuplicates([own])
        out = out.join(twice.hint("merge"), met, "left_anti").unionByName(again)
    return out.drop(own)
