"""The corpus pipeline: documents through a chain of training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents``.

1.  quality classifier: documents that it rejects go.
2.  exact dedup: of equal texts the longest original stays.
3.  n-gram Jaccard join: of each component the smallest id stays.
4.  mixing: all documents, put in the order of the mix to target weights.
5.  packing: token pieces with their place in a sequence; of each length the
    pieces are taken in the order of the mix, and sequences are numbered by the
    first document they hold.

Defined results of the stages, each on its own input
  * null or empty text: judged by quality as an empty text; all of them are equal
    in exact dedup; linked with nothing in near dedup; one end token in packing.
  * very long texts: whole in every stage.
  * repeated rows: rows with one id and text are kept once.
  * null ids, and ids that repeat with other texts: every row is decided by itself, as
    decisions go by id and text; of copies a row with an id stays before one without.
  * ties: by the smallest id.  No labels: quality keeps every document.
  * empty table: an empty result with the columns of the stage.
  * extra columns: kept by the first four stages whatever their names, ignored by packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm.exact_dedup import keep_rows, radix_groups, row_key
from dossierlake.llm.mixing import mixed
from dossierlake.llm.near_join import near_duplicates
from dossierlake.llm.packing import pack_documents
from dossierlake.llm.quality import quality
from dossierlake.llm.store import materialize


_KEY = "__pipeline_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_KEY, row_key(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score is below the threshold."""
    decisions = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=row_key(docs))
    return keep_rows(docs, decisions.select("doc_id", "kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each set of equal texts."""
    return keep_rows(docs, radix_groups(_keyed(docs), _KEY).select("doc_id", "kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component."""
    found = near_duplicates(_keyed(docs), _KEY)
    return keep_rows(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mix."""
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences, in the order of their files, which is that of the mix."""
    return pack_documents(docs, in_order=True)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier, the schedule or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
