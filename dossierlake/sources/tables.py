"""Reading and writing tables, logs and blobs."""

from __future__ import annotations

import json
import os
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import read_log_line


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; Catalyst pushes filters and columns into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines audit log: the raw line with seq, prev_hash, hash and its digest; blank lines skipped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.col("value").alias("line"), read_log_line("value").alias("r")).select("line", "r.*")


def last_records(log: DataFrame, n: int, screening_id: str | None = None) -> DataFrame:
    """The last ``n`` records, oldest first, of one screening if given."""
    if screening_id is not None:
        log = log.where(F.get_json_object("line", "$.screening_id") == screening_id)
    return log.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def head_of(log: DataFrame) -> DataFrame:
    """The newest (seq, hash)."""
    return log.agg(F.max_by(F.struct("seq", "hash"), "seq").alias("head")).select("head.seq", "head.hash")


def metadata_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Metadata records of one split, JSON lines."""
    return spark.read.json(f"{folder}/{split}.jsonl")


@lru_cache(maxsize=8)
def _read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def config(path: str, override: str | None = None) -> dict:
    """A JSON policy or manifest; small, read once by the driver.  The environment variable ``override`` may name another file."""
    return _read_config(os.environ.get(override, path) if override else path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects as (storage_path, content)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("storage_path"), "content")


def decrypted(content: Column, key: Column, iv: Column, tag: Column) -> Column:
    """AES-GCM plaintext; null where the ciphertext or its tag was changed."""
    return F.try_aes_decrypt(F.concat(iv, content, tag), key, F.lit("GCM"))


def retrieve(versions: DataFrame, stored: DataFrame, key_col: str = "data_key") -> DataFrame:
    """Each version with its plaintext and failure: ciphertext_modified, file_missing or null."""
    joined = versions.join(stored, "storage_path", "left")
    plain = decrypted(F.col("content"), F.col(key_col), F.col("iv"), F.col("auth_tag"))
    failure = F.when(F.col("content").isNull(), "file_missing").when(plain.isNull(), "ciphertext_modified")
    return joined.withColumn("plain", plain).withColumn("failure", failure).drop("content")


def catalog_columns(spark: SparkSession, name: str) -> DataFrame:
    """Columns of a catalog table; empty if there is no such table."""
    columns = spark.catalog.listColumns(name) if spark.catalog.tableExists(name) else []
    return spark.createDataFrame([(name, c.name, c.dataType) for c in columns], "table_name string, column_name string, data_type string")


def labels_of(rows: DataFrame, column: str) -> DataFrame:
    """The values that a column takes, as one sorted text, as a catalog lists the labels of a type."""
    return rows.select(F.col(column).cast("string").alias("v")).distinct().agg(F.array_join(F.array_sort(F.collect_set("v")), ", ").alias("labels"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_markdown(report: DataFrame, path: str) -> None:
    """A report as text files of Markdown table rows, under a header for each file; cells keep no bars or line breaks."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[|\n\r]+", " ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = report.sparkSession.range(1).select(F.lit(0).alias("k"), line([F.lit(c) for c in report.columns]).alias("value"))
    rule = report.sparkSession.range(1).select(F.lit(1).alias("k"), line([F.lit("---")] * len(report.columns)).alias("value"))
    body = report.select(F.lit(2).alias("k"), line([cell(c) for c in report.columns]).alias("value"))
    head.unionByName(rule).unionByName(body).repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
