"""Streaming forms of the polling loops; each has a batch twin that it must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def versions_stream(spark: SparkSession, path: str, schema: str, files: int = 5) -> DataFrame:
    """New versions as they arrive, a few files at a time; offsets replace claims."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def process_each(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Run ``work`` on each batch and write it once, by its batch id."""

    def batch(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def isolated(returns: str, work: Callable) -> Callable[..., Column]:
    """``work`` on single values as a column of (value, error): a row that fails does not fail its batch."""

    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for value in values:
            try:
                out.append((work(value), None))
            except Exception as e:  # the error is the row's result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return F.pandas_udf(run, f"value {returns}, error string")


def run_every(spark: SparkSession, work: Callable[[int], None], checkpoint: str, minutes: float = 20, once: bool = False):
    """Run ``work(number)`` now and every so many minutes; a run that is still going is left to finish first.

    A failed run is started again with the query, under its own number.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, number: work(number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(minutes * 60)} seconds")).start()


def after_commit(stream: Callable[[], DataFrame], effects: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> dict:
    """One query for each side effect of new versions, so that one that fails holds back neither the others nor the commit.

    ``stream`` opens the versions once for each effect; every effect keeps its own offsets.
    """
    return {
        name: stream().writeStream.queryName(name).foreachBatch(effect).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
        for name, effect in effects.items()
    }


def expired_sessions(activity: DataFrame, key: str, at: str, minutes: int = 30, late: int = 5) -> DataFrame:
    """Sessions (key, started, expired, actions) that had no activity for so long, once time has passed them."""
    quiet = F.session_window(at, f"{minutes} minutes")
    found = activity.withWatermark(at, f"{late} minutes").groupBy(key, quiet).agg(F.count("*").alias("actions"))
    return found.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expired"), "actions")


def stale_claims(claims: DataFrame, key: str, at: str, minutes: int = 15) -> DataFrame:
    """Keys claimed (``status`` processing) and not finished within so many minutes of event time.

    claims: key, at, status, with a watermark.
    """
    kind = claims.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [name[0]], "since": [pd.Timestamp(since, unit="ms")]})
            return
        last = pd.concat(list(batches)).sort_values(at).iloc[-1]
        if last["status"] == "processing":
            since = int(last[at].value // 1_000_000)
            state.update((since,))
            state.setTimeoutTimestamp(max(since + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [], "since": pd.Series([], dtype="datetime64[ns]")})

    return claims.select(key, at, "status").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, since timestamp", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def edge_alerts(checks: DataFrame, key: str, order: str) -> DataFrame:
    """Changes of ``failed`` per key: the state is the last result."""
    kind = checks.schema[key].dataType.simpleString()
    when = checks.schema[order].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else False
        out = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples():
            failed = bool(row.failed)
            if failed != was:
                out.append((name[0], getattr(row, order), failed))
            was = failed
        state.update((was,))
        yield pd.DataFrame(out, columns=[key, order, "failed"])

    return checks.select(key, order, "failed").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {when}, failed boolean", "failed boolean", "append", GroupStateTimeout.NoTimeout)


def chain_appends(events: DataFrame) -> DataFrame:
    """Events (id, body) with chained hashes; one key and so one task, as each hash needs the one before."""
    from ..functions.hashing import GENESIS

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import hashlib

        last = state.get[0] if state.exists else GENESIS
        out = []
        for row in pd.concat(list(batches)).sort_values("id").itertuples():
            entry = hashlib.sha256(f"{last}|{row.body}".encode()).hexdigest()
            out.append((row.id, last, entry))
            last = entry
        state.update((last,))
        yield pd.DataFrame(out, columns=["id", "prev_hash", "entry_hash"])

    return events.select("id", "body", F.lit(0).alias("k")).groupBy("k").applyInPandasWithState(step, "id bigint, prev_hash string, entry_hash string", "last string", "append", GroupStateTimeout.NoTimeout)


def rate_limit(requests: DataFrame, key: str, at: str, minutes: int = 15, most: int = 10) -> DataFrame:
    """Each request with whether its first-request-anchored window still admits it.

    Keys are sorted within their partition and read as a stream, so that a key may
    have any number of requests.
    """
    kind, when = (requests.schema[c].dataType.simpleString() for c in (key, at))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = object(), None, 0
        span = pd.Timedelta(minutes=minutes)
        for rows in batches:
            allowed = []
            for name, moment in zip(rows[key].astype(object).where(rows[key].notna(), None), rows[at], strict=True):
                if name != last or moment >= start + span:
                    last, start, n = name, moment, 0
                n += 1
                allowed.append(n <= most)
            yield rows.assign(allowed=allowed)

    return requests.select(key, at).repartition(key).sortWithinPartitions(key, at).mapInPandas(run, f"{key} {kind}, {at} {when}, allowed boolean")


def rate_limit_stream(requests: DataFrame, key: str, at: str, minutes: int = 15, most: int = 10) -> DataFrame:
    """The same on a stream: the state is the window's start and count."""
    kind, when = (requests.schema[c].dataType.simpleString() for c in (key, at))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        out = []
        for moment in pd.concat(list(batches))[at].sort_values():
            if start is None or moment >= start + pd.Timedelta(minutes=minutes):
                start, n = moment, 0
            n += 1
            out.append((name[0], moment, n <= most))
        state.update((int(start.value // 1000), n))
        yield pd.DataFrame(out, columns=[key, at, "allowed"])

    return requests.select(key, at).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} {when}, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.NoTimeout)
