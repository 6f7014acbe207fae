"""Windows over a total order, without putting all rows in one partition.

Rows are cut into slices by quantiles of the order, which are literals of the
plan and so the same in every pass.  A window runs inside each slice; what must
cross slices is one row for each of them.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliced(rows: DataFrame, order: str, slices: int | None = None) -> DataFrame:
    """Rows with ``_slice``; slices follow each other in ``order``, a number or time without nulls."""
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_x", F.col(order).cast("timestamp").cast("double") if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order).cast("double"))
    # At most ``slices`` numbers reach the driver.
    cuts = sorted(set(keyed.approxQuantile("_x", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    if not cuts:
        return keyed.withColumn("_slice", F.lit(0.0)).drop("_x")
    splits = [-float("inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol="_x", outputCol="_slice", handleInvalid="keep").transform(keyed).drop("_x")


def before_each(rows: DataFrame, order: str, value: str, first: object, slices: int | None = None) -> DataFrame:
    """Rows with ``_before``: ``value`` of the row before by ``order``; ``first`` for the first row."""
    cut = sliced(rows, order, slices)
    inside = Window.partitionBy("_slice").orderBy(order)
    ends = cut.groupBy("_slice").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_end"))
    heads = ends.select(F.lead("_slice").over(Window.orderBy("_slice")).alias("_slice"), "_end").where("_slice is not null")
    own = cut.withColumn("_nth", F.row_number().over(inside)).withColumn("_in", F.lag(value).over(inside))
    joined = own.join(F.broadcast(heads), "_slice", "left")
    before = F.when(F.col("_nth") > 1, F.col("_in")).when(F.col("_end").isNotNull(), F.col("_end.v")).otherwise(F.lit(first))
    return joined.withColumn("_before", before).drop("_slice", "_nth", "_in", "_end")


def running_sum(rows: DataFrame, order: str, value: str, name: str, slices: int | None = None) -> DataFrame:
    """Rows with the sum of ``value`` over all rows up to and including this one by ``order``."""
    cut = sliced(rows, order, slices)
    inside = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy("_slice").agg(F.sum(value).alias("_all"))
    start = sums.select("_slice", F.sum("_all").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_start"))
    joined = cut.withColumn("_in", F.sum(value).over(inside)).join(F.broadcast(start), "_slice")
    return joined.withColumn(name, F.col("_in") + F.coalesce("_start", F.lit(0))).drop("_slice", "_in", "_start")
