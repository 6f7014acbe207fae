"""Searches of an index that is stored, and headlines of two fragments."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import search as S
from ..sources.shared import shared_folder
from .registry import Tables, query

_BUILT: set[str] = set()
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def document_index(t: Tables) -> str:
    """The folder of the index of ``documents``, which the first query of an application writes."""
    path = f"{shared_folder(t.spark)}/index-{hashlib.sha256(t.folder.encode()).hexdigest()[:16]}"
    if path not in _BUILT:
        S.add_segment(t.documents, path, 0)
        _BUILT.add(path)
    return path


@query(f"""
WITH w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('that', 'and'))) AS BIGINT) AS hits FROM w WHERE list_contains(w, 'that') AND list_contains(w, 'and')""")
def search_stored_index(t: Tables) -> DataFrame:
    """All documents with both words, from the posting lists alone."""
    return S.search(t.spark, document_index(t), ["that", "and"]).select(F.col("id").alias("doc_id"), "hits")


@query(f"""
WITH w AS (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents),
p AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS hits FROM w)
SELECT doc_id, CAST(hits AS BIGINT) AS hits FROM p WHERE hits > 0""")
def search_stored_phrase(t: Tables) -> DataFrame:
    """Words next to each other, by their places in the lists."""
    return S.search(t.spark, document_index(t), ["of", "the"], phrase=True).select(F.col("id").alias("doc_id"), "hits")


@query(f"""
WITH w AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents)
SELECT token, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_hits FROM w GROUP BY token""")
def stored_word_counts(t: Tables) -> DataFrame:
    """How many documents and places each word of the index has."""
    return S.stored(t.spark, document_index(t)).groupBy("token").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_hits").alias("n_hits"))


@query(f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents
  WHERE list_contains({_TOKENS.format('text')}, 'that') AND list_contains({_TOKENS.format('text')}, 'and') ORDER BY n_chars DESC, doc_id LIMIT 25),
m AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
h AS (SELECT doc_id, i, list_intersect({_TOKENS.format('word')}, ['that', 'and']) AS own FROM m WHERE list_has_any({_TOKENS.format('word')}, ['that', 'and'])),
k AS (SELECT doc_id, i, unnest(own) AS token FROM h),
x AS (SELECT a.doc_id, a.i AS a, b.i AS b, count(DISTINCT k.token) AS n FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 17 JOIN k ON k.doc_id = a.doc_id AND k.i BETWEEN a.i AND b.i GROUP BY ALL),
one AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, b - a, a) = 1),
two AS (SELECT x.* FROM x JOIN one o ON o.doc_id = x.doc_id AND (x.b < o.a OR x.a > o.b) QUALIFY row_number() OVER (PARTITION BY x.doc_id ORDER BY x.n DESC, x.b - x.a, x.a) = 1),
s AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM (FROM one UNION ALL FROM two) GROUP BY doc_id),
p AS (SELECT doc_id, w, s.a, s.b, greatest(0, s.a[1] - (17 - s.b[1] + s.a[1]) // 2) AS p FROM d JOIN s USING (doc_id)),
q AS (SELECT *, least(coalesce(a[2] - 1, len(w) - 1), p + 17) AS pe FROM p),
r AS (SELECT *, greatest(pe + 1, a[2] - (17 - b[2] + a[2]) // 2) AS q FROM q),
z AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN list_has_any({_TOKENS.format('x').replace('lambda x', 'lambda y').replace('x <>', 'y <>')}, ['that', 'and']) THEN '<b>' || x || '</b>' ELSE x END) AS w, a, p, pe, q, least(len(w) - 1, q + 17) AS qe FROM r)
SELECT doc_id, array_to_string(w[p + 1:pe + 1], ' ') || CASE WHEN a[2] IS NULL THEN '' ELSE ' ... ' || array_to_string(w[q + 1:qe + 1], ' ') END AS headline FROM z""")
def search_fragments(t: Tables) -> DataFrame:
    """The first page of a search with up to two fragments of each text."""
    hits = S.search(t.spark, document_index(t), ["that", "and"]).select(F.col("id").alias("doc_id"))
    first = t.documents.join(hits, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(R.PER_PAGE)
    return first.select("doc_id", X.fragments(F.col("text"), ["that", "and"]).alias("headline"))
