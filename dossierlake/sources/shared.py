"""Tables that a query writes for itself, in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``; in local mode without it a temporary one."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if base:
        return f"{base.rstrip('/')}/tables-{app}"
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-tables-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written once and read back, which also ends their plan."""
    path = f"{shared_folder(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
