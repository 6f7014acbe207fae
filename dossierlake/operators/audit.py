"""Tamper evidence: hash chains, integrity classes and alerts on changes of state.

A record is checked against the *stored* hash of the one before, so all records
are checked independently; see ``windows`` for the row before.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import GENESIS, iso_millis, payload_hash, record_digest
from .windows import before_each, running_sum

PARTS = ("user_id", "action", "document_id", "case_id", "version")


def record_hash(prev: Column, detail: Column) -> Column:
    """The entry hash over the columns of an audit row."""
    return payload_hash(prev, *[F.col(p) for p in PARTS], iso_millis(F.col("occurred_at")), detail)


def verify_chain(log: DataFrame, detail: str = "detail") -> DataFrame:
    """One row: ``intact`` and ``broken_at``, the first id whose link or hash is wrong."""
    rows = before_each(log, "id", "entry_hash", GENESIS)
    good = F.col("prev_hash").eqNullSafe(F.col("_before")) & record_hash(F.col("prev_hash"), F.col(detail)).eqNullSafe(F.col("entry_hash"))
    return rows.agg(F.min(F.when(~good, F.col("id"))).alias("broken_at")).select(F.col("broken_at").isNull().alias("intact"), "broken_at")


def kept_for(seconds: float, work: Callable[[], object], clock: Callable[[], float] = time.monotonic) -> Callable[[], object]:
    """``work`` that is run again only when its last result is older; a failure is not kept.

    For the verdict on a whole log, which many views ask for.
    """
    last: list = []

    def ask() -> object:
        if not last or clock() - last[0] >= seconds:
            last[:] = [clock(), work()]
        return last[1]

    return ask


def verify_log(log: DataFrame) -> DataFrame:
    """One row for a JSON-lines log: ``valid, records, broken_at_seq, head``; seq must count from 1."""
    numbered = log.withColumn("_line", F.monotonically_increasing_id())
    rows = before_each(numbered, "_line", "hash", GENESIS)
    total = running_sum(rows.withColumn("_one", F.lit(1)), "_line", "_one", "_place")
    good = F.col("prev_hash").eqNullSafe(F.col("_before")) & F.col("digest").eqNullSafe(F.col("hash")) & F.col("seq").eqNullSafe(F.col("_place"))
    out = total.agg(F.count("*").alias("records"), F.min(F.when(~good, F.struct("_line", "seq"))).alias("bad"), F.max_by("hash", "_line").alias("head"))
    return out.select(F.col("bad").isNull().alias("valid"), "records", F.col("bad.seq").alias("broken_at_seq"), F.when(F.col("bad").isNull(), F.col("head")).alias("head"))


def build_chain(rows: DataFrame, order: str = "id", prev: str = GENESIS) -> DataFrame:
    """Rows with ``prev_hash`` and ``entry_hash``; an ordered fold, in one task by its nature.

    ``rows`` carries ``body``, the payload after the previous hash.  The task reads its rows sorted,
    as a stream, and holds one batch of them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = prev
        for batch in batches:
            before, own = [], []
            for body in batch.column("body").to_pylist():
                before.append(last)
                last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], [*batch.schema.names, "prev_hash", "entry_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", prev_hash string, entry_hash string"
    return rows.repartition(1).sortWithinPartitions(F.col(order).asc_nulls_last()).mapInArrow(fold, schema)


def append_records(events: list[dict], seq: int = 0, prev: str = GENESIS) -> list[dict]:
    """Events as chained log records."""
    out = []
    for event in events:
        seq += 1
        record = {"seq": seq, "prev_hash": prev, **event}
        record["hash"] = prev = record_digest(record)
        out.append(record)
    return out


def tamper_reason(failure: Column, anchored: Column, stored: Column, recorded: Column, ledger: Column) -> Column:
    """Why a version counts as tampered with, in order of weight; a pending anchor never does."""
    return F.when(failure.isNotNull(), failure).when(~stored.eqNullSafe(recorded), "hash_mismatch").when(anchored & (ledger.isNull() | (ledger != recorded)), "ledger_mismatch")


def integrity(versions: DataFrame, stored: DataFrame, ledger: DataFrame) -> DataFrame:
    """Versions with ``verified`` and ``reason``: stored, recorded and ledger hashes compared."""
    now = ledger.groupBy("version_id").agg(F.max_by("sha256", "seq").alias("ledger_hash"))
    joined = versions.join(stored, versions["id"] == stored["version_id"], "left").drop("version_id").join(now, versions["id"] == now["version_id"], "left").drop("version_id")
    reason = tamper_reason(F.col("failure"), F.col("anchor_status") == "anchored", F.col("stored_hash"), F.col("sha256"), F.col("ledger_hash"))
    same = F.col("failure").isNull() & F.col("ledger_hash").isNotNull() & (F.col("stored_hash") == F.col("sha256")) & (F.col("ledger_hash") == F.col("sha256"))
    return joined.withColumn("reason", reason).withColumn("verified", F.coalesce(same, F.lit(False)))


def state_changes(checks: DataFrame, key: str, order: str, failed: str = "failed") -> DataFrame:
    """Checks whose result differs from the one before; nothing before counts as passed."""
    before = F.lag(failed, 1, False).over(Window.partitionBy(key).orderBy(order))
    return checks.withColumn("was", before).where(F.col("was") != F.col(failed))


def custody(ledger: DataFrame, version: object) -> DataFrame:
    """The chain of custody of one version, oldest first."""
    return ledger.where(F.col("version_id") == version).orderBy("seq")


def bad_anchors(arrivals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger events that break its rules: created twice, no hash, unknown action, or custody of nothing."""
    known = ledger.select("version_id").distinct().withColumn("_k", F.lit(True))
    creates = F.col("action") == "anchor"
    reason = (
        F.when(creates & F.col("_k").isNotNull(), "exists")
        .when(creates & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash")
        .when(~creates & ~F.col("action").isin("transfer", "share", "export"), "action")
        .when(~creates & F.col("_k").isNull(), "missing")
    )
    return arrivals.join(known, "version_id", "left").withColumn("reason", reason).where("reason is not null").drop("_k")


def sweep_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("checked"), F.count_if(F.col("reason").isNotNull()).alias("failing"), F.count_if("alert").alias("alerts"), F.count_if("skipped").alias("skipped"))
