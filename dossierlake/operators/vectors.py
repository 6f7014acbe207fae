"""Pairs of similar vectors, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK = 4096
PIVOTS = 16
#: Rows of a block in one matrix product.
STRIP = 512
#: More than the rounding of an angle.
SLACK = 1e-6
PACKED = "own long, ids binary, v binary, low array<double>, high array<double>"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def held_as(vectors: DataFrame, vector_col: str) -> type:
    """How blocks hold components: single floats stay so, without loss, and take half the shuffle."""
    return np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``own, ids, v, low, high``: vectors with the same nearest pivot, in blocks of bounded size, with the least and greatest angle to each pivot."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where("v is not null")
    kind = held_as(vectors, vector_col)
    # At most ``pivots`` vectors reach the driver; any will do.
    chosen = [r[0] for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(pivots).select("v").collect()]
    centres = _unit(np.array(chosen, float)) if chosen else np.zeros((0, 1))
    # Few vectors need few cells.
    homes = max(1, min(pivots, rows.count() // block))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
                cell = (_unit(x) @ centres[:homes].T).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64())], ["id", "v", "cell"])

    cells = rows.mapInArrow(near, "id long, v array<double>, cell long")
    # One number for each pivot.
    parts = {c: -(-n // block) for c, n in cells.groupBy("cell").count().collect()}
    of = F.create_map(*[F.lit(k).cast("long") for kv in parts.items() for k in kv]) if parts else F.create_map().cast("map<bigint,bigint>")
    dealt = cells.withColumn("own", F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("id"), of[F.col("cell")]))

    def pack(table: pa.Table) -> pa.Table:
        x = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(len(table), -1)
        angles = np.arccos(np.clip(_unit(x) @ centres.T, -1, 1))
        data = [pa.array([b], pa.binary()) for b in (table.column("id").to_numpy().tobytes(), x.astype(kind).tobytes())]
        return pa.table([table.column("own").combine_chunks()[:1], *data, pa.array([angles.min(0)]), pa.array([angles.max(0)])], ["own", "ids", "v", "low", "high"])

    return written(dealt.groupBy("own").applyInArrow(pack, PACKED), "blocks")


def tiles_of(blocks: DataFrame, threshold: float) -> DataFrame:
    """``i, j``, i <= j: the pairs of blocks that may hold a similar pair.

    If two vectors are within an angle, so are their angles to any third.  Blocks
    meet by bands of their angles to the first pivot; then all pivots must let them pass.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    width = max(reach, 0.01)
    span = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(0.0))
    a = blocks.select(F.col("own").alias("i"), F.col("low").alias("a0"), F.col("high").alias("a1"), F.explode(span(first("low"), first("high"))).alias("band"))
    b = blocks.select(F.col("own").alias("j"), F.col("low").alias("b0"), F.col("high").alias("b1"), F.explode(span(first("low") - reach, first("high") + reach)).alias("band"))
    apart = lambda x, y: F.exists(F.zip_with(x, y, lambda low, high: low - high), lambda gap: gap > reach)
    met = a.join(b, "band").where((F.col("i") <= F.col("j")) & ~apart("a0", "b1") & ~apart("b0", "a1"))
    return met.select("i", "j").distinct()


def similar_pairs(vectors: DataFrame, id_col: str, vector_col: str, threshold: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs whose cosine reaches ``threshold``.

    Each pair of blocks that the angles to the pivots do not rule out is a tile, which
    matrix products settle, a strip of rows at a time; only pairs over the threshold leave it.
    """
    kind = held_as(vectors, vector_col)
    blocks = blocks_of(vectors, id_col, vector_col, block, pivots)
    tiles = tiles_of(blocks, threshold)
    sides = tiles.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    dealt = blocks.select("own", "ids", "v").join(sides, "own")

    def meet(table: pa.Table) -> pa.Table:
        parts = []
        for ids, v in zip(table.column("ids"), table.column("v"), strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            x = np.frombuffer(v.as_buffer(), kind).astype(float).reshape(len(ids), -1)
            parts.append((ids, x, np.sqrt((x * x).sum(1))))
        alone = len(parts) == 1
        (p, x, nx), (q, y, ny) = (parts * 2)[:2]
        found = []
        for k in range(0, len(p), STRIP):
            own = slice(k, k + STRIP)
            s = x[own] @ y.T / (nx[own, None] * ny[None, :] + 1e-9)
            at = np.nonzero((s >= threshold) & ((p[own, None] < q[None, :]) | (not alone)))
            found.append((p[own][at[0]], q[at[1]], s[at]))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return dealt.groupBy("i", "j").applyInArrow(meet, "a long, b long, similarity double")
