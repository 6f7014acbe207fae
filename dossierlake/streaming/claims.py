"""Claims and leases on a stream of events, by a queue that lives in Spark's state.

The rules are those of ``operators.queues``.  The state of a queue is a ring: jobs by number in a map and the two
ends, so that a claim touches one entry however many jobs wait; leases are a second map,
each with a timer; jobs that came back are a short list.  A lease that ends while
no event comes is taken back by its timer, one that ends before an event by that event.
State survives a lost executor or a restart through the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queues import OUTCOMES, Ends, Queue, in_order, outcome_rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _State:
    """The store of a queue in the state of its key."""

    def __init__(self, handle: StatefulProcessorHandle, remembered: int | None):
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "number long", "id string, attempts int")
        self.ends = handle.getValueState("ends", "first long, last long")
        self.back = handle.getListState("back", "number long")
        self.over: Ends | None = None
        self.held = handle.getMapState("leases", "id string", "number long, worker string, until long, attempt int")
        self.seen = handle.getMapState("seen", "id string", "at long", ttlDurationMs=remembered) if remembered else None

    def _ends(self) -> tuple[int, int]:
        return tuple(self.ends.get()) if self.ends.exists() else (0, 0)

    def add(self, name: str) -> None:
        # A source that delivers a job again while it is remembered adds nothing.
        if self.seen is not None:
            if self.seen.containsKey((name,)):
                return
            self.seen.updateValue((name,), (0,))
        first, last = self._ends()
        self.jobs.updateValue((last,), (name, 0))
        self.ends.update((first, last + 1))

    def next(self) -> int | None:
        waiting = sorted(x[0] for x in self.back.get()) if self.back.exists() else []
        if waiting:
            self.back.put([(x,) for x in waiting[1:]]) if waiting[1:] else self.back.clear()
            return waiting[0]
        first, last = self._ends()
        if first == last:
            return None
        self.ends.update((first + 1, last))
        return first

    def get(self, number: int) -> tuple[str, int]:
        return tuple(self.jobs.getValue((number,)))

    def put(self, number: int, name: str, attempts: int) -> None:
        self.jobs.updateValue((number,), (name, attempts))

    def drop(self, number: int) -> None:
        self.jobs.removeKey((number,))

    def put_back(self, number: int) -> None:
        self.back.appendValue((number,))

    def leases(self) -> list[tuple[str, tuple]]:
        return [(k[0], tuple(v)) for k, v in self.held.iterator()] if self.held.exists() else []

    def begin(self) -> None:
        """What is remembered is of the key before."""
        self.over = None

    def due(self, now: int) -> list[tuple]:
        # The leases are read once for each batch of a key.
        if self.over is None:
            self.over = Ends(self.leases())
        return self.over.over(now, self.lease_of)

    def lease(self, name: str, value: tuple) -> None:
        self.held.updateValue((name,), value)
        if self.over is not None:
            self.over.add(name, value)
        self.handle.registerTimer(value[2])

    def lease_of(self, name: str) -> tuple | None:
        return tuple(self.held.getValue((name,))) if self.held.containsKey((name,)) else None

    def release(self, name: str) -> None:
        if self.held.containsKey((name,)):
            self.held.removeKey((name,))


class Claims(StatefulProcessor):
    """One queue; ``clock`` takes the time of events from the cluster instead of their own ``at``."""

    def __init__(self, lease: int, most: int, clock: bool, remembered: int | None):
        self.how = lease, most, clock, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        lease, most, self.clock, remembered = self.how
        self.queue = Queue(_State(handle, remembered), lease, most)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else None
        events = in_order(pd.concat(list(rows)))
        self.queue.store.begin()
        yield outcome_rows(key[0], [x for e in events for x in self.queue.handle(now or e[0], *e[1:])])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.queue.store.begin()
        yield outcome_rows(key[0], self.queue.expire(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def claims_stream(events: DataFrame, minutes: float = 15, most: int = 3, clock: bool = False, remembered_minutes: float | None = None) -> DataFrame:
    """Outcomes of a stream of events (``operators.queues.EVENTS``).

    By default times are those of the events, which need a watermark; late events are taken at their own time as
    they come.  ``clock`` uses processing time for claims and leases; then jobs can be remembered for
    ``remembered_minutes``, so that one delivered twice is added once; such a stream keeps looking at its clock, so
    it needs a trigger by time, as one that is to end with its input (``availableNow``) would not.
    Needs the session's state store to be RocksDB (``PROVIDER``).
    """
    if remembered_minutes and not clock:
        raise ValueError("jobs are remembered by processing time only")
    processor = Claims(int(minutes * 60_000), most, clock, int(remembered_minutes * 60_000) if remembered_minutes else None)
    return events.where("at is not null").groupBy("queue").transformWithStateInPandas(processor, OUTCOMES, "Append", "ProcessingTime" if clock else "EventTime")
