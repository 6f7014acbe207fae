"""Exact top-k inner-product search by multi-resolution segment statistics.

A component x becomes floor(64*x); the score is the integer inner product.  Cut
a vector into segments and keep the mean and the deviation of each: by
Cauchy-Schwarz the squared distance of two vectors is at least
``sum L * ((mean - mean')**2 + (dev - dev')**2)`` over segments of length L.
Since score = (|q|^2 + |x|^2 - distance^2) / 2, that bounds the score from above.

1.  Blocks.  Vectors are turned so that their first axes hold most of the spread
    (distances stay as they are), sorted along the first axis and cut into blocks
    of bounded size.  A block has an envelope: the least and greatest of each
    statistic, and its greatest norm.
2.  Seeds.  Every query block meets the candidate block that its envelope allows
    most, which gives each query a k-th score to beat, whatever the other tile.
3.  Tiles.  Of all other pairs of blocks only those go on whose envelopes allow a
    better score than the worst of the query block has; their vectors move.
4.  In a tile pairs are bounded with 1, 4, 16 and 32 segments, coarse to fine.
    Exact scores are computed for the rows and columns that have survivors.

A tile yields at most k rows a query.

Defined results
  * null vectors and vectors with null or non-finite components take no part.
  * scores exist between vectors of equal length only.
  * ties: the smaller vec_id first.  A row with the query's own vec_id is no candidate.
  * repeated rows: each row that asks and each candidate counts; rows that share a
    vec_id share one list of k.
  * fewer than k candidates: all of them.  Empty table: an empty result.
  * null vec_id: no part.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 8192
LEVELS = (1, 4, 16, 32)
#: Segments of an envelope.
ENVELOPE = 16
#: Vectors from which the turn is found, at most; any turn gives the same result.
SAMPLE = 10_000
#: Envelopes that meet in one group.
PAIR_GROUP = 256
_CHUNK = 256


def _statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that sums of squares bound squared distances."""
    out = []
    for part in np.array_split(v, min(segments, v.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(1) * root, part.std(1) * root]
    return np.stack(out, 1)


def _slack(dims: int, big: float) -> float:
    """More than the rounding error of a bound; scores are integers below 2**53."""
    return 0.5 + 1e-9 * dims * big * big


def envelope(v: np.ndarray) -> np.ndarray:
    """(greatest squared norm, least and greatest statistics) of a block of turned vectors."""
    s = _statistics(v, ENVELOPE) if v.shape[1] else np.zeros((len(v), 0))
    return np.concatenate(([(v * v).sum(1).max()], s.min(0), s.max(0)))


def most(a: np.ndarray, b: np.ndarray) -> float:
    """The greatest score that two envelopes allow."""
    half = (len(a) - 1) // 2
    gap = np.maximum(0, np.maximum(a[1 : 1 + half] - b[1 + half :], b[1 : 1 + half] - a[1 + half :]))
    big = np.sqrt(max(a[0], b[0]))
    return float((a[0] + b[0] - (gap * gap).sum()) / 2) + _slack(1, big)


def tile_top(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, turn: np.ndarray | None = None, least: np.ndarray | None = None, counts: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best of each query in one tile; ``least`` has the scores to reach.

    ``counts`` gets (pairs, survivors of each level).
    """
    big, dims = max(int(np.abs(q).max(initial=0)), int(np.abs(x).max(initial=0)), 1), q.shape[1]
    exact = np.float32 if dims * big * big < 1 << 24 else np.float64 if dims * big * big < 1 << 53 else np.int64
    kind = np.float32 if dims * big * big < 1 << 18 else np.float64
    slack = _slack(dims, float(big))
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    if turn is not None:
        qf, xf = qf @ turn, xf @ turn
    # Half of the squared norms goes to each side, so that one product gives the bound.
    levels = [(_statistics(qf, s).astype(kind), _statistics(xf, s).astype(kind).T) for s in LEVELS if s < dims]
    qn, xn = (qf * qf).sum(1) / 2, (xf * xf).sum(1) / 2
    qe, xe = q.astype(exact), x.astype(exact)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = -np.inf if exact is not np.int64 else np.iinfo(np.int64).min
    for a in range(0, len(q), _CHUNK):
        b = min(len(q), a + _CHUNK)
        alive = q_ids[a:b, None] != x_ids[None, :]
        reach = (np.full(b - a, -np.inf) if least is None else least[a:b]) - slack
        seen = [int(alive.sum())]
        for u, v in levels:
            # The distance of the statistics, by their norms and product.
            rest = qn[a:b, None] - (u[a:b].astype(np.float64) ** 2).sum(1)[:, None] / 2 + (xn - (v.astype(np.float64) ** 2).sum(0) / 2)[None, :]
            bound = u[a:b] @ v + rest
            if len(x) > 4 * k:
                # The k-th best of the candidates most promising so far is a score to reach.
                seeds = np.argpartition(-np.where(alive, bound, -np.inf), 2 * k, axis=1)[:, : 2 * k]
                score = np.einsum("ijd,id->ij", xe[seeds], qe[a:b])
                score = np.where(np.take_along_axis(alive, seeds, 1), score, low)
                reach = np.maximum(reach, np.partition(score, k, axis=1)[:, k].astype(np.float64) - slack)
            alive &= bound >= reach[:, None]
            seen.append(int(alive.sum()))
        if counts is not None:
            counts.append(seen)
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        part = alive[np.ix_(rows, columns)]
        score = qe[a + rows] @ xe[columns].T
        # Exact scores below the one to reach can be in no answer and stay here.
        part &= score >= reach[rows, None]
        score = np.where(part, score, low)
        for i, row, here in zip(rows.tolist(), score, part, strict=True):
            if len(row) > k:
                at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            else:
                at = np.arange(len(row))
            at = at[here[at]]
            ids = x_ids[columns[at]]
            at = at[np.lexsort((ids, -row[at].astype(np.float64) if exact is not np.int64 else -row[at]))][:k]
            out.append((np.full(len(at), q_ids[a + i]), x_ids[columns[at]], row[at].astype(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _integers(lists: pa.Array, dims: int) -> np.ndarray:
    return np.floor(64.0 * lists.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)


def _turns(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length the axes by falling spread, from at most SAMPLE vectors."""
    table = rows.select("dim", "v").limit(SAMPLE).toArrow()
    out = {}
    for dims in set(table.column("dim").to_pylist()) - {0}:
        v = _integers(table.filter(pa.compute.equal(table.column("dim"), dims)).column("v").combine_chunks(), dims)
        out[dims] = np.linalg.eigh(np.atleast_2d(np.cov(v, rowvar=False, bias=True)))[1][:, ::-1].copy()
    return out


def _blocks(rows: DataFrame, size: int, total: int, turns, tag: str) -> DataFrame:
    """(block, dim, ids, kind, vectors, env): blocks of at most ``size`` vectors that are near along the first axis."""

    def first_axis(dims: int, turn: np.ndarray) -> Column:
        return F.when(F.col("dim") == dims, F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in turn[:, 0]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))

    axis = F.coalesce(*[first_axis(d, t) for d, t in turns.value.items()], F.lit(0.0))
    placed = rows.withColumn("axis", axis).repartitionByRange(max(1, -(-total // size)), "dim", "axis", F.xxhash64("id")).sortWithinPartitions("dim", "axis").select("id", "dim", "v")

    def pack(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        big, dims = np.abs(v).max(initial=0), v.shape[1]
        kind = "<i2" if big < 1 << 15 else "<i4" if big < 1 << 31 else "<i8"
        env = envelope(v @ turns.value[dims] if dims in turns.value else v)
        one = (pa.array([dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype("<i8"), v.astype(kind), env)), pa.array([kind]))
        return pa.RecordBatch.from_arrays(list(one), ["dim", "ids", "vectors", "env", "kind"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, dims = np.zeros(0, np.int64), np.zeros((0, 0)), -1
        for batch in batches:
            dim = batch.column(1).to_numpy(zero_copy_only=False)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                if d != dims and len(ids):
                    yield pack(ids, vectors)
                    ids = ids[:0]
                if d != dims:
                    vectors, dims = np.zeros((0, d)), d
                ids = np.concatenate((ids, batch.column(0).to_numpy(zero_copy_only=False)[at]))
                vectors = np.concatenate((vectors, _integers(batch.column(2).take(pa.array(at)), d)))
                while len(ids) >= size:
                    yield pack(ids[:size], vectors[:size])
                    ids, vectors = ids[size:], vectors[size:]
        if len(ids):
            yield pack(ids, vectors)

    out = placed.mapInArrow(gather, "dim int, ids binary, vectors binary, env binary, kind string").withColumn("block", F.monotonically_increasing_id())
    return materialize(out, tag)


def _pairs(q: DataFrame, x: DataFrame) -> DataFrame:
    """(qb, xb, most): what the envelopes of every pair of blocks allow."""
    groups = max(1, x.count() // PAIR_GROUP)
    a = q.select(F.col("block").alias("qb"), F.col("dim").alias("qd"), F.col("env").alias("qenv"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    b = x.select(F.col("block").alias("xb"), "dim", "env", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("xg"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [most(np.frombuffer(u.as_buffer()), np.frombuffer(v.as_buffer())) for u, v in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], ["qb", "xb", "most"])

    met = a.join(b, (F.col("g") == F.col("xg")) & (F.col("qd") == F.col("dim")))
    return materialize(met.select("qb", "xb", "qenv", "env").mapInArrow(bound, "qb long, xb long, most double"), "pairs")


def _meet(tiles: DataFrame, q: DataFrame, x: DataFrame, k: int, turns) -> DataFrame:
    """The k best of each query in each tile; tiles: qb, xb; q may have ``least``, the scores to reach."""
    least = F.col("least") if "least" in q.columns else F.lit(None).cast("binary")
    # Candidates are repeated for each query block, query blocks joined last.
    side = x.select(F.col("block").alias("xb"), "dim", F.col("ids").alias("x_ids"), F.col("vectors").alias("xv"), F.col("kind").alias("xk"))
    own = q.select(F.col("block").alias("qb"), "ids", "vectors", "kind", least.alias("least"))
    # Tiles are few bytes and much work, so they are dealt out by number; where blocks are broadcast, that holds.
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tiles.select("qb", "xb").repartition(parts).join(side, "xb").join(own, "qb").select("dim", "ids", "vectors", "kind", "least", "x_ids", "xv", "xk")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, v, kind, least, x_ids, xv, xk = (c[i] for c in batch.columns)
                ids, x_ids = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x_ids.as_buffer(), "<i8")
                vectors = np.frombuffer(v.as_buffer(), kind.as_py()).reshape(len(ids), dim.as_py())
                others = np.frombuffer(xv.as_buffer(), xk.as_py()).reshape(len(x_ids), dim.as_py())
                found = tile_top(ids, vectors, x_ids, others, k, turns.value.get(dim.as_py()), np.frombuffer(least.as_buffer()) if least.is_valid else None)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return met.mapInArrow(score, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` best candidates of every row for which ``queries`` (over column ``id``) holds.

    Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).withColumn("dim", F.size("v"))
    total, asked = rows.select(F.count("*"), F.count_if(queries)).first()
    turns = spark.sparkContext.broadcast(_turns(rows))
    q = _blocks(rows.where(queries), query_block, asked, turns, "queries")
    x = _blocks(rows, candidate_block, total, turns, "candidates")
    pairs = _pairs(q, x)

    first = materialize(pairs.groupBy("qb").agg(F.max_by("xb", "most").alias("xb")), "first")
    seeds = materialize(_meet(first, q, x, k, turns), "seeds")
    # The k-th score of each query so far, in the order of its block.
    kth = seeds.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
    place = q.select("block", "dim", F.posexplode(_ids_of("ids")).alias("pos", "query_id"))
    reach = place.join(kth, "query_id", "left").select("block", "pos", F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("s"))
    reach = reach.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("p"), F.min("s").alias("worst"))
    reach = materialize(reach.select("block", "worst", _bytes_of(F.transform("p", lambda y: y["s"])).alias("least")), "reach")
    rest = pairs.join(first.withColumnsRenamed({"qb": "fq", "xb": "fx"}), (F.col("qb") == F.col("fq")) & (F.col("xb") == F.col("fx")), "left_anti")
    rest = rest.join(reach.select(F.col("block").alias("qb"), "worst"), "qb").where(F.col("most") >= F.col("worst"))
    better = _meet(materialize(rest.select("qb", "xb"), "tiles"), q.join(reach.drop("worst"), "block"), x, k, turns)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return seeds.unionByName(better).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids_of(column: str) -> Column:
    """The 64-bit numbers of a binary column."""

    def read(values):
        return values.map(lambda b: np.frombuffer(b, "<i8").tolist())

    return F.pandas_udf(read, "array<long>")(column)


def _bytes_of(numbers: Column) -> Column:
    """Doubles as a binary column."""

    def write(values):
        return values.map(lambda x: np.array(x, "<f8").tobytes())

    return F.pandas_udf(write, "binary")(numbers)
