"""Screening, risk and evaluation queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture as C
from ..operators import evaluation as E
from ..operators import screening as S
from ..operators.vectors import similar_pairs
from .registry import Tables, query

WEIGHT = "CASE WHEN l_quantity < 10 THEN 0.0 WHEN l_quantity < 25 THEN 5.0 WHEN l_quantity < 40 THEN 14.0 ELSE 30.0 END * CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 1.0 END"


def evidence(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.select(
        F.col("l_orderkey").alias("screening_id"), F.col("l_linenumber").cast("int").alias("ordinal"),
        F.when(F.col("l_returnflag") == "R", "identity").when(F.col("l_returnflag") == "A", "format").otherwise("other").alias("category"),
        F.when(q < 10, "info").when(q < 25, "low").when(q < 40, "medium").otherwise("high").alias("severity"),
        F.col("l_partkey").cast("string").alias("code"), F.lit("").alias("message"), F.lit("rules").alias("source"), F.when(F.col("l_linestatus") == "O", "WARN").otherwise("FAIL").alias("status"),
    )


@query(f"""
WITH c AS (SELECT l_orderkey, l_returnflag, least(CASE l_returnflag WHEN 'R' THEN 100.0 WHEN 'A' THEN 30.0 ELSE 50.0 END, sum({WEIGHT})) AS v FROM lineitem GROUP BY l_orderkey, l_returnflag),
s AS (SELECT l_orderkey, 100 * (1 - product(1 - least(v, 100) / 100)) AS score FROM c GROUP BY l_orderkey)
SELECT o_orderkey, floor(round(coalesce(score, 0), 4)) AS score,
       CASE WHEN coalesce(score, 0) >= 59.95 THEN 'HIGH' WHEN coalesce(score, 0) >= 24.95 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def risk_scores(t: Tables):
    """Capped sums by category, combined like independent probabilities."""
    context = t.orders.select(F.col("o_orderkey").alias("screening_id"), F.lit(80.0).alias("capture_quality"), F.lit(True).alias("mrz_expected"), F.lit(True).alias("mrz_verified"), F.lit(True).alias("face_checked"))
    r = S.risk(evidence(t), context)
    return r.select(F.col("screening_id").alias("o_orderkey"), F.floor("exact_score").cast("double").alias("score"), F.col("risk_band").alias("band"))


@query("""
SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS failed, bool_and(l_returnflag <> 'R') AS valid FROM lineitem GROUP BY l_orderkey""")
def check_totals(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("passed"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.bool_and(F.col("l_returnflag") != "R").alias("valid"))


@query("SELECT l_orderkey, l_returnflag, bool_or(l_quantity >= 40) OR count(*) >= 2 AS detected, CAST(count(*) AS BIGINT) AS items FROM lineitem GROUP BY ALL")
def tamper_cases(t: Tables):
    found = evidence(t).withColumn("use_case", F.col("category"))
    name = F.when(F.col("use_case") == "identity", "R").when(F.col("use_case") == "format", "A").otherwise("N")
    return S.tamper_cases(found).select(F.col("screening_id").alias("l_orderkey"), name.alias("l_returnflag"), "detected", "items")


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS strongest FROM lineitem GROUP BY l_orderkey")
def strongest_evidence(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("strongest"))


@query("""
SELECT c.c_custkey, s.s_suppkey, CASE WHEN s.s_suppkey IN (c.c_custkey, c.c_custkey - 50) AND (s.s_nationkey = 0 OR c.c_nationkey = 0 OR s.s_nationkey = c.c_nationkey) THEN 'document_number' ELSE 'name_and_dob' END AS match
FROM customer c JOIN supplier s ON (s.s_suppkey IN (c.c_custkey, c.c_custkey - 50) AND (s.s_nationkey = 0 OR c.c_nationkey = 0 OR s.s_nationkey = c.c_nationkey))
  OR (c.c_custkey % 97 = s.s_suppkey % 97 AND c.c_nationkey = s.s_nationkey)""")
def watchlist(t: Tables):
    """Number or birth date and name, as two equi-joins; names are made equal by nation."""
    state = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), (F.col(c) % 97).cast("int"))
    names = F.array(*[F.lit(chr(65 + i) * 6) for i in range(25)])
    name = lambda c: F.element_at(names, (F.col(c) + 1).cast("int"))
    records = t.customer.select(F.col("c_custkey").cast("string").alias("screening_id"), F.col("c_custkey").cast("string").alias("document_number"), (F.col("c_custkey") - 50).cast("string").alias("passport_number"), state("c_nationkey").alias("issuing_state"), name("c_nationkey").alias("surname"), F.lit(None).cast("string").alias("given_names"), day("c_custkey").alias("date_of_birth"))
    watch = t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.lit(True).alias("active"), F.lit("LOST").alias("list_type"), F.lit("").alias("reason"), F.col("s_suppkey").cast("string").alias("document_number"), state("s_nationkey").alias("issuing_state"), name("s_nationkey").alias("surname"), F.lit(None).cast("string").alias("given_names"), day("s_suppkey").alias("date_of_birth"))
    # The hits are far more than the records, so a small table is spread over all cores.
    records = records.repartition(t.spark.sparkContext.defaultParallelism)
    return S.watchlist_hits(records, watch).select(F.col("screening_id").cast("long").alias("c_custkey"), F.col("entry_id").cast("long").alias("s_suppkey"), "match")


@query("""
SELECT b.o_orderkey AS now, a.o_orderkey AS before, CASE WHEN a.o_custkey % 60 = b.o_custkey % 60 THEN 'shared' END AS pattern
FROM orders a JOIN orders b ON a.o_orderkey % 700 = b.o_orderkey % 700 AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus = b.o_orderstatus AND CAST(a.o_orderdate AS DATE) <> CAST(b.o_orderdate AS DATE)
WHERE a.o_custkey % 60 = b.o_custkey % 60""")
def shared_documents(t: Tables):
    """A number presented before by someone with another birth date."""
    base = t.orders.select(F.col("o_orderkey").cast("string").alias("screening_id"), F.col("o_orderkey").alias("seen_at"), F.concat_ws("-", F.col("o_orderkey") % 700, F.col("o_custkey") % 60).alias("document_number"), F.col("o_orderstatus").alias("document_type"), F.lit("DOE").alias("surname"), F.lit("JO").alias("given_names"), F.to_date("o_orderdate").alias("date_of_birth"), F.lit("UTO").alias("nationality"))
    found = S.identity_conflicts(base, base.withColumn("id", F.col("screening_id")))
    return found.where("severity = 'critical'").select(F.col("screening_id").cast("long").alias("now"), F.col("previous").cast("long").alias("before"), F.lit("shared").alias("pattern"))


@query("""
SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35""")
def similar_faces(t: Tables):
    return similar_pairs(t.embeddings, "vec_id", "embedding", 0.35).select("a", "b")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount * 5 >= 0.363 THEN 'MATCH' WHEN l_discount * 5 < 0.30 THEN 'NO_MATCH' ELSE 'INCONCLUSIVE' END AS decision FROM lineitem")
def face_decisions(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.face_decision(F.col("l_discount") * 5).alias("decision"))


@query("""
WITH n AS (SELECT *, row_number() OVER (ORDER BY n_chars, quality DESC) AS r FROM labels JOIN documents USING (doc_id)),
c AS (SELECT sum(quality) AS p, sum(1 - quality) AS q, sum(CASE WHEN quality = 1 THEN r END) AS ranks FROM n)
SELECT round((ranks - p * (p + 1) / 2) / (p * q), 9) AS auc FROM c""")
def ranking_auc(t: Tables):
    scored = t.labels.join(t.documents, "doc_id").select((F.col("quality") == 1).alias("label"), F.col("n_chars").alias("score"))
    return E.auc(scored).select(F.round("auc", 9).alias("auc"))


@query("""
WITH s AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id))
SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END), 9) AS auc FROM s a, s b WHERE a.quality = 1 AND b.quality = 0""")
def ranking_auc_ties(t: Tables):
    scored = t.labels.join(t.documents, "doc_id").select((F.col("quality") == 1).alias("label"), F.col("n_chars").alias("score"))
    return E.auc_mid_rank(scored).select(F.round("auc", 9).alias("auc"))


@query("""
WITH s AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)),
n AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM s WHERE toxic = 0),
h AS (SELECT n_chars AS threshold FROM n WHERE i = least(n - 1, ceil(n * (1 - 0.05))))
SELECT threshold, round(avg(CASE WHEN n_chars > threshold THEN 1.0 ELSE 0.0 END), 9) AS recall FROM s, h WHERE toxic = 1 GROUP BY threshold""")
def recall_at_fpr(t: Tables):
    scored = t.labels.join(t.documents, "doc_id").select((F.col("toxic") == 1).alias("label"), F.col("n_chars").alias("score"))
    return E.recall_at_fpr(scored, 0.05).select("threshold", F.round("recall", 9).alias("recall"))


@query("SELECT round(sum(least(l_quantity, 20)) / sum(greatest(l_quantity, 20)), 9) AS iou FROM lineitem")
def region_overlap(t: Tables):
    rows = t.lineitem.select(F.least("l_quantity", F.lit(20.0)).alias("inter"), F.greatest("l_quantity", F.lit(20.0)).alias("union_px"))
    return E.overlap(rows).select(F.round("iou", 9).alias("iou"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events")
def latency(t: Tables):
    return E.quantiles(t.events, "value", 0.5, 0.95).select(*[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")])


@query("SELECT round(sum(levenshtein(p_name, reverse(p_name))) / sum(length(p_name)), 9) AS cer, avg(CASE WHEN p_name = reverse(p_name) THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact FROM part")
def read_errors(t: Tables):
    return E.error_rate(t.part.withColumn("read", F.reverse("p_name")), "p_name", "read").select(F.round("cer", 9).alias("cer"), "exact")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS hits FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def results_by_condition(t: Tables):
    return E.roll_up(t.lineitem, ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("hits"))


@query("SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 25) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS share FROM lineitem GROUP BY l_returnflag")
def detection_shares(t: Tables):
    n = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("hits"))
    return n.select("l_returnflag", F.substring_index(E.share_text(F.col("hits"), F.col("n")), " ", 1).alias("share"))


@query("""
WITH r AS (
    SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS valid, ['TD3', 'MRVA', 'TD1', 'TD2'][o_orderkey % 4 + 1] AS fmt, ['P', 'V', 'I', 'IR', 'C'][o_orderkey % 5 + 1] AS code,
           CASE o_orderkey % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.1 END AS word, o_orderkey % 11 = 0 AS hinted, 1.4 + o_orderkey % 13 / 60.0 AS aspect FROM orders),
z AS (
    SELECT *, CASE WHEN valid AND fmt IN ('TD1', 'TD2') THEN CASE WHEN code = 'IR' THEN 2.9 ELSE 0.4 END ELSE 0 END AS permit,
           CASE WHEN valid AND fmt IN ('TD1', 'TD2') THEN CASE WHEN code = 'IR' THEN 0.4 ELSE 2.9 END ELSE 0 END AS card,
           CASE WHEN word >= 0.85 THEN 1.5 * word WHEN word >= 0.7 THEN 0.8 * word ELSE 0 END AS printed FROM r),
s AS (
    SELECT k, [CASE WHEN valid AND fmt = 'TD3' AND code[1] = 'P' THEN 3.0 ELSE 0 END + greatest(0, 0.5 - abs(aspect - 1.42) * 4),
               CASE WHEN valid AND fmt = 'MRVA' THEN 3.0 ELSE 0 END + printed + greatest(0, 0.5 - abs(aspect - 1.5) * 4),
               card + greatest(0, 0.5 - abs(aspect - 1.586) * 4),
               CASE WHEN valid THEN 0 ELSE 0.25 END + CASE WHEN hinted THEN 2.0 ELSE 0 END + greatest(0, 0.5 - abs(aspect - 1.586) * 4),
               permit + greatest(0, 0.5 - abs(aspect - 1.586) * 4)] AS scores FROM z)
SELECT k AS o_orderkey, ['passport', 'visa', 'national_id', 'driving_licence', 'residence_permit'][list_position(list_transform(scores, lambda x: round(x, 9)), round(list_max(scores), 9))] AS kind FROM s""")
def document_kind(t: Tables):
    """The type with most evidence from zone, printed words, choice and shape; of ties the first."""
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    mrz = F.struct((k % 3 != 0).alias("valid_format"), pick(4, "TD3", "MRVA", "TD1", "TD2").alias("format"), pick(5, "P", "V", "I", "IR", "C").alias("document_code"))
    words = F.create_map(F.lit("visa"), F.when(k % 7 == 0, 0.9).when(k % 7 == 1, 0.75).otherwise(0.1))
    kind = C.document_type(mrz, words, F.when(k % 11 == 0, "driving_licence"), 1.4 + (k % 13) / 60.0)
    return t.orders.select("o_orderkey", kind.alias("kind"))


@query("SELECT conv_id, round(avg(CASE WHEN role = 'user' THEN length(text) ELSE 0 END), 6) AS confidence, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def page_totals(t: Tables):
    by = t.conversations.groupBy("conv_id").agg(F.avg(F.coalesce(F.when(F.col("role") == "user", F.length("text")), F.lit(0))).alias("c"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return by.select("conv_id", F.round("c", 6).alias("confidence"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


@query("""
WITH c AS (SELECT conv_id, list(role || CAST(length(text) % 3 AS VARCHAR) ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, list_filter(r, lambda x, i: list_position(r, x) = i) AS seen FROM c""")
def distinct_in_order(t: Tables):
    """Distinct values by first occurrence."""
    value = F.concat("role", (F.length("text") % 3).cast("string"))
    by = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", value.alias("v")))).alias("r"))
    return by.select("conv_id", F.array_distinct(F.transform("r", lambda x: x["v"])).alias("seen"))


@query("SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failing, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS alerts, CAST(count(*) FILTER (WHERE value < 1) AS BIGINT) AS skipped FROM events")
def sweep_totals(t: Tables):
    from ..operators.audit import sweep_totals as totals

    return totals(t.events.select(F.when(F.col("event_type") == "error", "x").alias("reason"), (F.col("value") > 50).alias("alert"), (F.col("value") < 1).alias("skipped")))
