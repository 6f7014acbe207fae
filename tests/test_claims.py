"""Claims and leases: windows, the fold over events and the stream against a plain simulation."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import queues as Q
from dossierlake.streaming import claims

T0 = datetime(2026, 1, 1)


def events(seed, n=200, queues=3):
    rng = random.Random(seed)
    out, jobs = [], 0
    for k in range(n):
        at, q, w = T0 + timedelta(seconds=rng.randrange(40) + 30 * k), f"q{rng.randrange(queues)}", f"w{rng.randrange(2)}"
        kind = rng.choice(["job", "job", "ask", "ask", "done", "done", "done", "failed"])
        if kind == "job":
            jobs += 1
            out.append((q, at, "job", f"{q}-{jobs:04d}", None, None))
        elif kind == "ask":
            out.append((q, at, "ask", None, w, rng.randrange(4)))
        else:
            same = [e[3] for e in out if e[2] == "job" and e[0] == q]
            if same:
                out.append((q, at, kind, rng.choice(same), w, None))
    return out


def simulate(rows, minutes, most, until):
    """All queues at once, by scanning everything at each step."""
    jobs, out = [], []  # a job: queue, id, state, worker, until, attempts
    rank = {"done": 0, "failed": 0, "job": 1, "ask": 2}

    def expire(q, now):
        for j in sorted((j for j in jobs if j["queue"] == q and j["state"] == "held" and j["until"] <= now), key=lambda j: (j["until"], jobs.index(j))):
            give_back(j, j["until"])

    def give_back(j, at):
        worn = j["tries"] >= most
        out.append((j["queue"], at, "failed" if worn else "returned", j["id"], j["worker"], j["tries"], None))
        j["state"] = "gone" if worn else "waiting"

    for q, at, kind, name, worker, n in sorted(rows, key=lambda e: (e[1], rank[e[2]], e[3] or "", e[4] or "")):
        expire(q, at)
        if kind == "job":
            jobs.append({"queue": q, "id": name, "state": "waiting", "tries": 0})
        elif kind == "ask":
            for j in [j for j in jobs if j["queue"] == q and j["state"] == "waiting"][: n or 0]:
                j.update(state="held", worker=worker, until=at + timedelta(minutes=minutes), tries=j["tries"] + 1)
                out.append((q, at, "claimed", j["id"], worker, j["tries"], j["until"]))
        else:
            j = next((j for j in jobs if j["queue"] == q and j["id"] == name and j["state"] == "held" and j["worker"] == worker), None)
            if j is None:
                out.append((q, at, "late", name, worker, None, None))
            elif kind == "done":
                out.append((q, at, "done", name, worker, j["tries"], None))
                j["state"] = "gone"
            else:
                give_back(j, at)
    for q in {j["queue"] for j in jobs}:
        expire(q, until)
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_leases_equal_a_simulation(spark):
    rows = events(1)
    end = T0 + timedelta(days=2)
    got = plain(Q.leased(spark.createDataFrame(rows, Q.EVENTS).repartition(4), minutes=4, most=2, until=end))
    assert got == simulate(rows, 4, 2, end)
    assert {r[2] for r in got} == {"claimed", "returned", "done", "failed", "late"}


def test_no_job_has_two_holders(spark):
    rows = events(2, 400)
    df = Q.leased(spark.createDataFrame(rows, Q.EVENTS), minutes=4, most=5)
    held = {}
    for q, at, what, name, worker, attempt, until in sorted(plain(df), key=lambda r: (r[1], {"returned": 0, "failed": 0, "done": 1, "late": 1, "claimed": 2}[r[2]])):
        if what == "claimed":
            assert (q, name) not in held and until > at
            held[q, name] = until
        elif what != "late":
            assert (q, name) in held
            del held[q, name]
    moment = T0 + timedelta(seconds=30 * 200)
    now = {(r.queue, r.id) for r in Q.working(df, F.lit(moment)).collect()}
    want = set()
    for q, at, what, name, _, _, until in sorted(plain(df), key=lambda r: (r[1], r[2] == "claimed")):
        if at <= moment and what != "late":
            want.discard((q, name))
            if what == "claimed" and until > moment:
                want.add((q, name))
    assert now == want and now


def test_first_claims_equal_leases_that_never_end(spark):
    rows = [e for e in events(3, 300) if e[2] in ("job", "ask")]
    df = spark.createDataFrame(rows, Q.EVENTS)
    got = Q.first_claims(df.where("kind = 'job'").select("queue", "id", "at"), df.where("kind = 'ask'").select("queue", "worker", "at", "n"))
    want = {(r[0], r[3]): (r[4], r[1]) for r in simulate(rows, 10**6, 1, T0)}
    jobs = {(e[0], e[3]) for e in rows if e[2] == "job"}
    assert {(r.queue, r.id): (r.worker, r.claimed_at) for r in got.collect()} == {k: want.get(k, (None, None)) for k in jobs}
    assert 0 < len(want) < len(jobs) + 1


def test_odd_events(spark):
    rows = [(None, T0, "job", "a", None, None), (None, T0, "ask", None, "w", 5), ("q", None, "job", "b", None, None), ("q", T0, "other", "c", None, None), ("q", T0, "ask", None, None, None)]
    got = plain(Q.leased(spark.createDataFrame(rows, Q.EVENTS)))
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(None, "claimed", "a", "w")]
    assert Q.leased(spark.createDataFrame([], Q.EVENTS)).count() == 0
    parts = Q.sharded(spark.createDataFrame(events(4), Q.EVENTS), 4)
    assert parts.where("kind <> 'ask'").groupBy("id").agg(F.count_distinct("queue").alias("n")).where("n > 1").count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, claims.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def run(spark, batches, folder, name, **how):
    """The outcomes of a stream that reads one file a batch and is restarted half way."""
    for k, rows in enumerate(batches):
        if k == len(batches) // 2:
            start(spark, folder, **how)
        spark.createDataFrame(rows, Q.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    start(spark, folder, **how)
    return plain(spark.read.schema(Q.OUTCOMES).parquet(f"{folder}/out"))


def start(spark, folder, **how):
    stream = spark.readStream.schema(Q.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("at", "0 seconds")
    found = claims.claims_stream(stream, **how)
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_the_fold(rocks, tmp_path):
    rows = sorted(events(5, 120), key=lambda e: e[1])
    cut = [rows[k : k + 20] for k in range(0, len(rows), 20)]
    last = [("other", T0 + timedelta(days=1), "job", "end", None, None)]
    got = run(rocks, [*cut, last], str(tmp_path), "claims", minutes=4, most=2)
    want = plain(Q.leased(rocks.createDataFrame(rows, Q.EVENTS), minutes=4, most=2, until=T0 + timedelta(hours=23)))
    assert got == want
    assert any(r[2] == "returned" for r in got)


def test_clock_returns_a_lease_without_events(rocks, tmp_path):
    folder = str(tmp_path)
    add = lambda rows: rocks.createDataFrame(rows, Q.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    story = lambda: [(r.what, r.id, r.worker, r.attempt) for r in rocks.sql("SELECT * FROM outcomes_by_clock ORDER BY at, what = 'claimed'").collect()]

    def wait(n):
        began = time.time()
        while len(story()) < n and time.time() - began < 60:
            time.sleep(0.5)

    add([("q", T0, "job", "a", None, None), ("q", T0, "job", "a", None, None), ("q", T0, "ask", None, "w1", 5)])
    stream = rocks.readStream.schema(Q.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = claims.claims_stream(stream, minutes=0.0005, most=3, clock=True, remembered_minutes=60)
    going = found.writeStream.format("memory").queryName("outcomes_by_clock").option("checkpointLocation", f"{folder}/at").trigger(processingTime="0 seconds").start()
    try:
        wait(2)
        # Delivered twice, added once; the lease ended though nothing came.
        assert story() == [("claimed", "a", "w1", 1), ("returned", "a", "w1", 1)]
        add([("q", T0, "ask", None, "w2", 5)])
        wait(3)
        assert story()[2] == ("claimed", "a", "w2", 2)
    finally:
        going.stop()
    with pytest.raises(ValueError):
        claims.claims_stream(rocks.createDataFrame([], Q.EVENTS), remembered_minutes=1)
