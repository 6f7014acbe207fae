"""Case and evidence queries on the driver's tables.

orders stand in for cases, suppliers of lineitem for assigned officers, customers
for users, conversations for versions, events for the audit log.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import queues as Q
from ..operators import relational as R
from .registry import Tables, query

LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
ASSIGNED = "(SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS user_id FROM lineitem)"


def assignments(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("user_id")).distinct()


def versions(t: Tables):
    c = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version"), "role", "text")
    return c


@query("""
WITH m AS (
  SELECT doc_id, n_chars, source, text FROM documents
  WHERE list_contains(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), 'that')
    AND list_contains(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), 'and'))
SELECT doc_id, CASE WHEN source = 'src0' THEN NULL ELSE left(text, 60) END AS snippet,
       (SELECT CAST(count(*) AS BIGINT) FROM m) AS total_count
FROM m ORDER BY n_chars DESC, doc_id LIMIT 25""")
def search_documents(t: Tables):
    """Texts with all words asked for, protected snippets masked, one page and the total."""
    hits = t.documents.where(X.has_all_words(F.col("text"), ["that", "and"]))
    return R.page(hits, [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", F.when(F.col("source") == "src0", None).otherwise(F.substring("text", 1, 60)).alias("snippet"), "total_count")


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT token, CAST(count(*) AS BIGINT) AS n_docs, CAST(min(doc_id) AS BIGINT) AS first_doc FROM w WHERE token <> '' GROUP BY token""")
def inverted_index(t: Tables):
    """Every word with the number of documents that have it."""
    return t.documents.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT doc_id FROM w WHERE token IN ('of', 'the', 'that') GROUP BY doc_id HAVING count(*) = 3""")
def search_by_index(t: Tables):
    """All words by a join with the index and a count."""
    index = t.documents.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    return index.where(F.col("token").isin("of", "the", "that")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 3").select("doc_id")


@query("""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents
  WHERE list_contains(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), 'that')),
m AS (SELECT doc_id, w, list_transform(w, lambda x: list_contains(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}]+'), 'that')) AS hit FROM d),
p AS (SELECT *, greatest(0, least(list_position(hit, true) - 10, len(w) - 18)) AS a FROM m)
SELECT doc_id, array_to_string(list_transform(range(a + 1, least(a + 18, len(w)) + 1), lambda i: CASE WHEN hit[i] THEN '<b>' || w[i] || '</b>' ELSE w[i] END), ' ') AS headline FROM p""")
def search_headlines(t: Tables):
    """Fragments around the first hit."""
    return t.documents.where(X.has_all_words(F.col("text"), ["that"])).select("doc_id", X.headline(F.col("text"), ["that"]).alias("headline"))


@query(f"SELECT o.o_orderkey, o.o_totalprice FROM orders o JOIN {ASSIGNED} a ON a.case_id = o.o_orderkey WHERE a.user_id = 7 ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 25")
def my_cases(t: Tables):
    cases = t.orders.withColumnRenamed("o_orderkey", "case_id")
    return R.scoped(cases, assignments(t), 7).orderBy(F.desc("o_orderdate"), "case_id").limit(25).select(F.col("case_id").alias("o_orderkey"), "o_totalprice")


@query("SELECT o_orderkey, CAST(15 AS BIGINT) * 1000 AS total_count FROM orders WHERE false")
def page_past_the_end(t: Tables):
    """A page past the end has no rows, whatever the total."""
    return R.page(t.orders, [F.col("o_orderkey")], number=10_000_000, per_page=100).select("o_orderkey", "total_count")


@query("""
SELECT c.conv_id AS document_id, c.turn AS version, c.role, CAST(length(c.text) AS BIGINT) AS size
FROM conversations c JOIN (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY conv_id) m ON m.conv_id = c.conv_id AND m.top = c.turn""")
def current_versions(t: Tables):
    docs = versions(t).groupBy(F.col("document_id").alias("id")).agg(F.max("version").alias("current_version"))
    return R.current(docs.withColumn("current_version", F.col("current_version").cast("int")), versions(t)).select(F.col("id").alias("document_id"), F.col("version").cast("long"), "role", F.length("text").cast("long").alias("size"))


@query("""
WITH c AS (SELECT o_orderkey, o_orderstatus FROM orders), a AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey = 3)
SELECT v.conv_id, v.turn, c.o_orderstatus FROM conversations v JOIN c ON c.o_orderkey = v.conv_id JOIN a ON a.l_orderkey = c.o_orderkey WHERE contains(lower(v.text), 'the')""")
def search_all_versions(t: Tables):
    """Every version, not just the current one, within the officer's cases."""
    v = t.conversations.where(F.contains(F.lower("text"), F.lit("the"))).withColumn("case_id", F.col("conv_id"))
    return R.scoped(v.join(t.orders.select(F.col("o_orderkey").alias("case_id"), "o_orderstatus"), "case_id"), assignments(t), 3).select("conv_id", "turn", "o_orderstatus")


@query("SELECT e.event_id, e.event_type, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_nationkey < 10")
def audit_trail(t: Tables):
    users = t.customer.where("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"), "c_name")
    return t.events.join(users, "user_id", "left").select("event_id", "event_type", "c_name")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_cases FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def officers_with_counts(t: Tables):
    n = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_cases"))


@query("""
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS integrity_failed,
       EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus NOT IN ('F')) AS screening_flagged FROM orders""")
def case_documents_flags(t: Tables):
    v = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("integrity_failed_at"), F.when(F.col("l_linestatus") == "F", "CLEAR").otherwise("HIT").alias("disposition"))
    return R.flags(t.orders.select(F.col("o_orderkey").alias("id")), v).select(F.col("id").alias("o_orderkey"), "integrity_failed", "screening_flagged")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def cases_without_officers(t: Tables):
    return t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'login' OR e.value > 90")
def live_sessions(t: Tables):
    return t.events.where("event_type = 'login' or value > 90").join(t.customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")


@query(f"SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM {ASSIGNED} a WHERE a.case_id = e.event_id AND a.user_id = e.user_id)")
def notifications_in_scope(t: Tables):
    notes = t.events.select("event_id", F.col("event_id").alias("case_id"), "user_id")
    return R.scoped(notes, assignments(t)).select("event_id")


@query("SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE o.o_orderstatus = 'O' AND l.l_quantity > 45")
def sweep_candidates(t: Tables):
    return t.lineitem.where("l_quantity > 45").join(t.orders.where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT o_orderkey, n_name IS NOT NULL AS linked, CASE WHEN n_name IS NULL THEN 'not_found' END AS reason FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 12")
def external_links(t: Tables):
    """A case with its outside record, or why there is none."""
    n = F.broadcast(t.nation.where("n_nationkey < 12"))  # a fixed list of at most 25 rows
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.col("n_name").isNotNull().alias("linked"), F.when(F.col("n_name").isNull(), "not_found").alias("reason"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS large FROM orders GROUP BY o_orderstatus")
def status_counts(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def labels_by_group(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("""
SELECT user_id, coalesce(max(ts) > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 DAY, false) AS recent, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY user_id""")
def recent_requests(t: Tables):
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return t.events.groupBy("user_id").agg(F.coalesce(F.max("ts") > as_of - F.expr("INTERVAL 1 DAY"), F.lit(False)).alias("recent"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
def requests_in_lookback(t: Tables):
    return t.events.selectExpr("event_id", "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW) AS n")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS seq
FROM lineitem""")
def evidence_sequence(t: Tables):
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*LINE_ORDER)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w).alias("seq"))


@query("""
WITH e AS (SELECT o_custkey, max(o_orderkey) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o.o_orderkey, CAST(coalesce(e.top, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS BIGINT) AS seq
FROM orders o LEFT JOIN e ON e.o_custkey = o.o_custkey WHERE o.o_orderstatus = 'O'""")
def next_numbers(t: Tables):
    existing = t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("seq"))
    return R.numbered(t.orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey"), existing, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", F.col("seq").cast("long"))


@query("""
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'FIR' WHEN 1 THEN 'STM' WHEN 2 THEN 'FSR' WHEN 3 THEN 'CHS' WHEN 4 THEN 'CRT' WHEN 5 THEN 'NTC' WHEN 6 THEN 'IDN' ELSE 'OTH' END
       || '-' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS number FROM part""")
def evidence_numbers(t: Tables):
    kinds = F.array(*[F.lit(k) for k in ("fir", "statement", "forensic_report", "charge_sheet", "court_filing", "notice", "identity_document", "other")])
    return t.part.select("p_partkey", X.evidence_number(F.element_at(kinds, (F.col("p_size") % 8 + 1).cast("int")), F.col("p_partkey")).alias("number"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE CAST(coalesce(n, 0) AS BIGINT) END AS prior_entries FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey")
def prior_entries(t: Tables):
    from ..operators.screening import entries_on_visa

    records = t.customer.select("c_custkey", F.when(F.col("c_nationkey") > 0, F.col("c_custkey").cast("string")).alias("visa_number"))
    travel = t.orders.select(F.col("o_custkey").cast("string").alias("visa_number"), F.when(F.col("o_orderstatus") == "F", "ENTRY").otherwise("EXIT").alias("direction"))
    return entries_on_visa(records, travel).select("c_custkey", "prior_entries")


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 50")
def latest_notifications(t: Tables):
    return t.events.select("event_id", "ts").orderBy(F.desc("event_id")).limit(50)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 5")
def claim_oldest(t: Tables):
    return t.orders.where("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(5).select("o_orderkey")


@query("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 40")
def officers_sorted(t: Tables):
    return t.customer.orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey").limit(40).select("c_nationkey", "c_custkey")


@query("SELECT event_id, value FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def last_records(t: Tables):
    return t.events.orderBy(F.desc("event_id")).limit(20).orderBy("event_id").select("event_id", "value")


@query("SELECT max(event_id) AS seq, arg_max(props, event_id) AS hash FROM events")
def log_head(t: Tables):
    from ..sources.tables import head_of

    return head_of(t.events.select(F.col("event_id").alias("seq"), F.col("props").alias("hash")))


@query("SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS at FROM orders GROUP BY o_custkey")
def latest_status(t: Tables):
    """A status log as its latest state."""
    log = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"))
    return R.latest(log, ["k"], ["at"])


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1")
def live_challenges(t: Tables):
    """Only the newest challenge of a user counts."""
    from ..operators.screening import newest

    return newest(t.events, "user_id", "ts").select("event_id", "user_id")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 20)")
def insert_where_new(t: Tables):
    """ON CONFLICT DO NOTHING: only keys that the target lacks."""
    return R.insert_new(t.supplier.where("s_suppkey <= 20").select(F.col("s_nationkey").alias("c_nationkey")), t.customer.select("c_nationkey"), ["c_nationkey"])


@query("""
WITH arr AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS kind FROM orders GROUP BY o_custkey)
SELECT k, kind FROM arr UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT k FROM arr)""")
def upsert_identities(t: Tables):
    target = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind"))
    return R.upsert(target, t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("kind"), "o_orderkey"), ["k"], "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_using(t: Tables):
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


@query(f"SELECT o.o_orderkey AS case_id, a.user_id FROM orders o JOIN {ASSIGNED} a ON a.case_id = o.o_orderkey WHERE o.o_totalprice > 300000")
def alert_fan_out(t: Tables):
    alerts = t.orders.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("case_id"))
    return R.fan_out(alerts, assignments(t)).select("case_id", "user_id")


@query("""
SELECT a.event_id, list_sort(list_filter(['event_type', 'user_id'], lambda k: (k = 'event_type' AND a.event_type IS DISTINCT FROM b.event_type) OR (k = 'user_id' AND a.user_id IS DISTINCT FROM b.user_id))) AS fields
FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type IS DISTINCT FROM b.event_type OR a.user_id IS DISTINCT FROM b.user_id""")
def field_changes(t: Tables):
    a = t.events.select("event_id", F.struct("event_type", "user_id").alias("was"))
    b = t.events.select((F.col("event_id") - 1).alias("event_id"), F.struct("event_type", "user_id").alias("now"))
    diff = R.changed(F.col("was"), F.col("now"), ["event_type", "user_id"])
    return a.join(b, "event_id").select("event_id", F.array_sort(F.map_keys(diff)).alias("fields")).where("fields is not null")


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r, o_custkey FROM orders)
SELECT o_orderkey, coalesce(r < lag(r) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false) AS refused FROM r""")
def sensitivity_ratchet(t: Tables):
    level = F.when(F.col("o_orderstatus") == "F", "normal").when(F.col("o_orderstatus") == "O", "sensitive").otherwise("protected")
    return R.ratchet(t.orders.withColumn("sensitivity", level), "o_custkey", "o_orderkey").select("o_orderkey", "refused")


@query("SELECT event_id, CASE WHEN user_id = 5 THEN coalesce(CASE WHEN value > 50 THEN ts END, TIMESTAMP '2030-01-01') ELSE CASE WHEN value > 50 THEN ts END END AS read_at FROM events")
def mark_read(t: Tables):
    notes = t.events.select("event_id", "user_id", F.when(F.col("value") > 50, F.col("ts")).alias("read_at"))
    return R.mark_read(notes, 5, F.expr("TIMESTAMP_NTZ '2030-01-01 00:00:00'")).select("event_id", "read_at")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(t: Tables):
    return R.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 3)")
def orphan_rows(t: Tables):
    parents = t.supplier.where("s_nationkey > 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return R.orphans(t.lineitem, parents, ["l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT a.c_custkey FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey")
def altered_identities(t: Tables):
    after = t.customer.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_nationkey")
    return R.altered(t.customer.select("c_custkey", "c_nationkey"), after, "c_custkey", ["c_nationkey"]).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O') AND (NULL IS NULL OR o_orderpriority = NULL)")
def optional_filter(t: Tables):
    return t.orders.where(R.optional(F.col("o_orderstatus"), "O") & R.optional(F.col("o_orderpriority"), None)).select("o_orderkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.k') NOT IN ('1') AS flagged FROM events")
def json_disposition(t: Tables):
    """A path of a JSON column; a missing value is not flagged."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return t.events.select("event_id", k.alias("k"), (~k.isin("1")).alias("flagged"))


@query(f"""
WITH p(rank, action) AS (VALUES ('AUTOMOBILE', 'F'), ('AUTOMOBILE', 'O'), ('BUILDING', 'O'), ('MACHINERY', 'P')),
q AS (SELECT o_orderkey, c_mktsegment AS rank, o_orderstatus AS action, o_orderkey % 50 AS user_id FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT q.o_orderkey, CASE WHEN p.rank IS NULL THEN 'rank' WHEN a.case_id IS NULL THEN 'not_assigned' END AS reason, p.rank IS NOT NULL AND a.case_id IS NOT NULL AS allowed
FROM q LEFT JOIN p ON p.rank = q.rank AND p.action = q.action LEFT JOIN {ASSIGNED} a ON a.case_id = q.o_orderkey AND a.user_id = q.user_id""")
def access_decisions(t: Tables):
    permissions = t.spark.createDataFrame([("AUTOMOBILE", "F"), ("AUTOMOBILE", "O"), ("BUILDING", "O"), ("MACHINERY", "P")], "rank string, action string")
    asked = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("case_id"), F.col("c_mktsegment").alias("rank"), F.col("o_orderstatus").alias("action"), (F.col("o_orderkey") % 50).alias("user_id"))
    return R.access_decision(asked, permissions, assignments(t)).select(F.col("case_id").alias("o_orderkey"), "reason", "allowed")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '1%' THEN 'original' WHEN o_orderstatus <> 'F' THEN 'analysis_incomplete' WHEN o_totalprice > 200000 THEN 'redaction_unsupported_format' ELSE 'redacted' END AS status FROM orders""")
def release_gate(t: Tables):
    mime = F.when(F.col("o_totalprice") > 200000, "image/png").otherwise("text/plain")
    status = R.release_status(F.when(F.col("o_orderpriority").like("1%"), "protected").otherwise("normal"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending"), mime)
    return t.orders.select("o_orderkey", status.alias("status"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND (value < 10 OR ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 15 MINUTES)")
def stale_claims(t: Tables):
    status = F.when(F.col("event_type") == "click", "processing").otherwise("done")
    started = F.when(F.col("value") >= 10, F.col("ts"))
    return t.events.where(R.stale(status, started, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))).select("event_id")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'index' WHEN source IN ('src2', 'src3') THEN 'recognise' ELSE 'done' END AS way FROM documents")
def processing_route(t: Tables):
    mime = F.when(F.col("source") == "src1", "text/plain").when(F.col("source") == "src2", "application/pdf").when(F.col("source") == "src3", "image/png").otherwise("audio/wav")
    return t.documents.select("doc_id", R.route(mime).alias("way"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE contains(lower(c_name), '7')) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS unread FROM customer")
def client_counts(t: Tables):
    return t.customer.agg(F.count("*").alias("n"), F.count_if(F.contains(F.lower("c_name"), F.lit("7"))).alias("found"), F.count_if(F.col("c_acctbal") < 0).alias("unread"))


@query("SELECT doc_id, source AS pointer, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes FROM documents")
def exchange_metadata(t: Tables):
    """A pointer and a hash, never the content."""
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.col("source").alias("pointer"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size_bytes"))


@query("SELECT l_orderkey, CAST(l_orderkey % 7 AS BIGINT) AS k, list_sort(list(DISTINCT l_suppkey)) AS officers FROM lineitem WHERE l_quantity > 48 GROUP BY l_orderkey")
def officers_by_case(t: Tables):
    return t.lineitem.where("l_quantity > 48").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("officers")).select("l_orderkey", (F.col("l_orderkey") % 7).alias("k"), "officers")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(coalesce(text, ''), '[\\s]+', '', 'g')) >= 20")
def useful_text(t: Tables):
    return t.documents.where(X.is_useful(F.col("text"))).select("doc_id")


#: Events as a queue of work: purchases are jobs, clicks ask for one to three of them.
_KEY = "user_id % 20"


@query(f"""
WITH RECURSIVE j AS (SELECT {_KEY} AS q, event_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts, event_id) AS k, ts FROM events WHERE event_type = 'purchase'),
a AS (SELECT {_KEY} AS q, user_id, event_id % 3 + 1 AS n, ts, row_number() OVER (PARTITION BY {_KEY} ORDER BY ts, CAST(user_id AS VARCHAR)) AS r FROM events WHERE event_type = 'click'),
s AS (SELECT a.*, (SELECT count(*) FROM j WHERE j.q = a.q AND j.ts <= a.ts) AS there FROM a),
c AS (
  SELECT q, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS taken FROM (SELECT DISTINCT q FROM s)
  UNION ALL SELECT c.q, s.r, c.taken, CAST(least(c.taken + s.n, s.there) AS BIGINT) FROM c JOIN s ON s.q = c.q AND s.r = c.r + 1)
SELECT j.event_id AS job, CAST(s.user_id AS VARCHAR) AS worker, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS claimed_at
FROM j LEFT JOIN c ON c.q = j.q AND j.k > c.before AND j.k <= c.taken LEFT JOIN s ON s.q = c.q AND s.r = c.r""")
def claimed_jobs(t: Tables):
    """Each job with the request that claims it, oldest first within its queue."""
    queue = F.expr(_KEY).cast("string").alias("queue")
    jobs = t.events.where("event_type = 'purchase'").select(queue, F.col("event_id").alias("id"), F.col("ts").alias("at"))
    asks = t.events.where("event_type = 'click'").select(queue, F.col("user_id").alias("worker"), F.col("ts").alias("at"), (F.col("event_id") % 3 + 1).cast("int").alias("n"))
    return Q.first_claims(jobs, asks).select(F.col("id").alias("job"), "worker", F.date_format("claimed_at", "yyyy-MM-dd HH:mm:ss").alias("claimed_at"))


def work_events(t: Tables):
    """The events as jobs, requests and reports: a view is a report on the purchase before it."""
    kind = F.when(F.col("event_type") == "purchase", "job").when(F.col("event_type") == "click", "ask").otherwise(F.when(F.col("event_id") % 5 == 0, "failed").otherwise("done"))
    e = t.events.select(F.expr(_KEY).cast("string").alias("queue"), F.col("ts").alias("at"), kind.alias("kind"), "event_id", (F.col("user_id") % 40).cast("string").alias("worker"))
    before = F.last(F.when(F.col("kind") == "job", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("queue").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("queue", "at", "kind", F.when(F.col("kind") != "ask", before.cast("string")).alias("id"), "worker", F.when(F.col("kind") == "ask", (F.col("event_id") % 3 + 1).cast("int")).alias("n"))


@query()
def leased_jobs(t: Tables):
    """What happens to each job under leases of a day and three attempts."""
    return Q.leased(work_events(t), minutes=24 * 60, until="2100-01-01")
