"""Written intermediate tables in the shared folder that the session names.

An operator that needs a result more than once writes it as Parquet under
``spark.checkpoint.dir`` and reads it back.  That cuts the lineage, and a lost
executor costs a reread rather than a recomputation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: Rows handed to Python at once; Spark bounds the bytes itself, by 64 MB.
ARROW_ROWS = 2000
#: Spark deletes the shuffle files of a query that has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` if the session has it.  Otherwise a temporary
    folder, in local mode only: on a cluster no machine-local folder will do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/dossierlake-{app}"
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="dossierlake-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, in a folder for each value of ``by``, and return it as a plain scan.

    Its shuffle files go as soon as it is written, since nothing can read them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._dossierlake_path = path  # type: ignore[attr-defined]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_dossierlake_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, as document rows carry whole texts.

    The setting stays, because a result that is read later runs with it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def without_clashes(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the needed columns, so that extra columns can never clash with ours."""
    return df.select(*[df[c] for c in needed])
