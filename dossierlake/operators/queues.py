"""Claiming work: oldest first, by several workers at once, under leases.

Events of a queue are ``job`` (``id``), ``ask`` (a ``worker`` wants ``n`` jobs), ``done`` and ``failed``
(a worker gives a job back).  What happens is told in rows: ``claimed``, ``returned`` (the lease ran out, the
job waits again at its old place), ``done``, ``failed`` (it was tried too often, or its worker
says so), ``late`` (a report of a worker that no longer holds the job).

``first_claims`` needs no order of execution: without leases, the jobs that the requests up
to r have claimed are min(N_r, min over s <= r of A_s + N_r - N_s), with A the jobs that
there were and N the jobs asked for.  Leases bring jobs back, so ``leased`` reads a queue's events in
order, as a stream with a heap; ``streaming.claims`` does the same on a stream, with the queue in its state.
A queue is an order of its own and so one task; ``sharded`` cuts a hot queue into parts
that are each in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "queue string, at timestamp, kind string, id string, worker string, n int"
OUTCOMES = "queue string, at timestamp, what string, id string, worker string, attempt int, until timestamp"
COLUMNS = ["queue", "at", "what", "id", "worker", "attempt", "until"]
#: Jobs of a moment are there before requests of that moment are served; reports come first.
KINDS = {"done": 0, "failed": 0, "job": 1, "ask": 2}


def first_claims(jobs: DataFrame, asks: DataFrame) -> DataFrame:
    """``queue, id, worker, claimed_at``: each job (queue, id, at) with the request (queue, worker, at, n) that takes it; null if none does.

    Jobs go by (at, id), requests by (at, worker).  A queue's events are one window.
    """
    j = jobs.select("queue", "at", "id", F.lit(None).cast("string").alias("worker"), F.lit(0).alias("n"), F.lit(1).alias("_kind"))
    a = asks.select("queue", "at", F.lit(None).cast(jobs.schema["id"].dataType).alias("id"), F.col("worker").cast("string"), F.greatest(F.col("n"), F.lit(0)).alias("n"), F.lit(2).alias("_kind"))
    so_far = Window.partitionBy("queue").orderBy("at", "_kind", "id", "worker").rowsBetween(Window.unboundedPreceding, 0)
    both = j.unionByName(a).withColumn("_jobs", F.sum((F.col("_kind") == 1).cast("long")).over(so_far)).withColumn("_asked", F.sum(F.col("n").cast("long")).over(so_far))
    both = both.withColumn("_taken", F.col("_asked") + F.least(F.lit(0), F.min(F.when(F.col("_kind") == 2, F.col("_jobs") - F.col("_asked"))).over(so_far)))
    # The k-th job goes to the first request with k jobs taken: it follows all with fewer.
    served = both.where("_kind = 2").select("queue", F.col("_taken").alias("_k"), F.struct("at", "worker").alias("_ask"), F.lit(1).alias("_side"), F.lit(None).cast(jobs.schema["id"].dataType).alias("id"))
    waiting = both.where("_kind = 1").select("queue", F.col("_jobs").alias("_k"), F.lit(None).cast(served.schema["_ask"].dataType).alias("_ask"), F.lit(0).alias("_side"), "id")
    # Read backwards, so that the window only ever grows.
    after = Window.partitionBy("queue").orderBy(F.desc("_k"), F.desc("_side"), F.desc("_ask.at"), F.desc("_ask.worker"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    met = waiting.unionByName(served).withColumn("_by", F.last("_ask", ignorenulls=True).over(after)).where("_side = 0")
    return met.select("queue", "id", F.col("_by.worker").alias("worker"), F.col("_by.at").alias("claimed_at"))


def sharded(events: DataFrame, shards: int) -> DataFrame:
    """A hot queue as ``shards`` queues: jobs and reports by a hash of the id, requests to a shard by a hash of worker and time.

    Order is kept within a shard only, and a worker that finds its shard empty asks again.
    """
    of = F.when(F.col("kind") == "ask", F.xxhash64("worker", "at")).otherwise(F.xxhash64("id"))
    return events.withColumn("queue", F.concat_ws("#", "queue", F.pmod(of, F.lit(shards)).cast("string")))


class Queue:
    """The rules of one queue over a store of its state.

    ``store`` has numbered jobs (``get``, ``put``, ``drop`` of number -> (id, attempts)), ``ends`` (first and
    next number), ``back`` (numbers that came back, oldest first) and leases (id -> (number, worker, until, attempt)),
    of which ``due`` takes those that end by a moment, by ``Ends``.
    Times are milliseconds.
    """

    def __init__(self, store, lease: int, most: int):
        self.store, self.lease, self.most = store, lease, most

    def expire(self, now: int) -> list[tuple]:
        """Leases that ended by ``now``, in the order of their ends."""
        out = []
        for until, number, name, worker, attempt in self.store.due(now):
            self.store.release(name)
            out.append(self._back(until, number, name, worker, attempt, attempt >= self.most))
        return out

    def _back(self, at: int, number: int, name: str, worker: str, attempt: int, given_up: bool) -> tuple:
        if given_up:
            self.store.drop(number)
            return (at, "failed", name, worker, attempt, None)
        self.store.put(number, name, attempt)
        self.store.put_back(number)
        return (at, "returned", name, worker, attempt, None)

    def handle(self, at: int, kind: str, name: str, worker: str, n: int) -> list[tuple]:
        """What an event leads to, leases that end before it first."""
        out = self.expire(at)
        if kind == "job":
            self.store.add(name)
        elif kind == "ask":
            for _ in range(n):
                number = self.store.next()
                if number is None:
                    break
                job, attempts = self.store.get(number)
                self.store.lease(job, (number, worker, at + self.lease, attempts + 1))
                out.append((at, "claimed", job, worker, attempts + 1, at + self.lease))
        else:
            held = self.store.lease_of(name)
            if held is None or held[1] != worker:
                out.append((at, "late", name, worker, None, None))
            else:
                self.store.release(name)
                if kind == "done":
                    self.store.drop(held[0])
                    out.append((at, "done", name, worker, held[3], None))
                else:
                    out.append(self._back(at, held[0], name, worker, held[3], held[3] >= self.most))
        return out


class Ends:
    """The ends of leases in order, so that an event looks at those that are over and at no others.

    An entry whose lease was released or given anew meanwhile is passed over.
    """

    def __init__(self, leases=()):
        self.heap, self.count = [], 0
        for name, value in leases:
            self.add(name, value)

    def add(self, name: str, value: tuple) -> None:
        self.count += 1
        heapq.heappush(self.heap, (value[2], value[0], self.count, name, value))

    def over(self, now: int, lease_of: Callable[[str], tuple | None]) -> list[tuple]:
        """(until, number, id, worker, attempt) of the leases that ended by ``now``."""
        out = []
        while self.heap and self.heap[0][0] <= now:
            *_, name, value = heapq.heappop(self.heap)
            if lease_of(name) == value:
                number, worker, until, attempt = value
                out.append((until, number, name, worker, attempt))
        return out


class Memory:
    """A store in memory."""

    def __init__(self):
        self.ends = Ends()
        self.jobs, self.back, self.held, self.first, self.last = {}, [], {}, 0, 0

    def add(self, name):
        self.jobs[self.last] = (name, 0)
        self.last += 1

    def next(self):
        if self.back:
            return heapq.heappop(self.back)
        if self.first == self.last:
            return None
        self.first += 1
        return self.first - 1

    def get(self, number):
        return self.jobs[number]

    def put(self, number, name, attempts):
        self.jobs[number] = (name, attempts)

    def drop(self, number):
        self.jobs.pop(number, None)

    def put_back(self, number):
        heapq.heappush(self.back, number)

    def due(self, now):
        return self.ends.over(now, self.held.get)

    def lease(self, name, value):
        self.held[name] = value
        self.ends.add(name, value)

    def lease_of(self, name):
        return self.held.get(name)

    def release(self, name):
        self.held.pop(name, None)


def in_order(rows: pd.DataFrame) -> list[tuple]:
    """(ms, kind, id, worker, n) of events, in the order in which they count."""
    ms = rows["at"].astype("datetime64[ms]").astype("int64")
    named = [None if pd.isna(x) else x for x in rows["id"]], [None if pd.isna(x) else x for x in rows["worker"]]
    found = zip(ms, rows["kind"], *named, rows["n"].fillna(0).astype(int), strict=True)
    return sorted(found, key=lambda e: (e[0], KINDS[e[1]], e[2] or "", e[3] or ""))


def outcome_rows(queue: str, found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(queue, *x) for x in found], columns=COLUMNS)
    for c in ("at", "until"):
        out[c] = pd.to_datetime(out[c].astype("Int64"), unit="ms")
    return out.astype({"attempt": "Int32"})


def leased(events: DataFrame, minutes: float = 15, most: int = 3, until: object | None = None) -> DataFrame:
    """What happens to the jobs of each queue; leases that end by ``until`` (a timestamp) without an event after them still return their jobs.

    A queue's events are sorted within its partition and read as a stream; its jobs, not its events, are held.
    Events of unknown kind or without a time are ignored; a null queue is a queue.
    """
    lease, end = int(minutes * 60_000), None if until is None else pd.Timestamp(until).value // 1_000_000
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    order = [rank.alias("_k"), F.coalesce("id", F.lit("")).alias("_i"), F.coalesce("worker", F.lit("")).alias("_w")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, queue = object(), None
        for rows in batches:
            # Within a partition rows are already in order, so a batch is cut by queue only.
            for key, part in rows.groupby("queue", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if queue is None or key != name:
                    if queue is not None and end is not None:
                        yield outcome_rows(name, queue.expire(end))
                    name, queue = key, Queue(Memory(), lease, most)
                yield outcome_rows(key, [x for e in in_order(part) for x in queue.handle(*e)])
        if queue is not None and end is not None:
            yield outcome_rows(name, queue.expire(end))

    rows = events.where(F.col("at").isNotNull() & F.col("kind").isin(*KINDS)).select("queue", "at", "kind", "id", "worker", "n", *order)
    return rows.repartition("queue").sortWithinPartitions("queue", "at", "_k", "_i", "_w").select("queue", "at", "kind", "id", "worker", "n").mapInPandas(run, OUTCOMES)


def working(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The jobs that are held at a moment: the last word on each is a claim whose lease still runs."""
    last = F.max_by(F.struct("what", "worker", "until"), F.struct("at", F.coalesce("attempt", F.lit(0)), (F.col("what") != "claimed").cast("int")))
    real = outcomes.where((F.col("at") <= as_of) & (F.col("what") != "late"))
    return real.groupBy("queue", "id").agg(last.alias("l")).where((F.col("l.what") == "claimed") & (F.col("l.until") > as_of)).select("queue", "id", "l.worker", "l.until")
