"""Text, hash and zone queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import hashing as H
from ..functions import mrz as M
from ..functions import patterns as P
from ..functions import text as X
from ..operators import audit as A
from ..operators.windows import running_sum
from ..sources.shared import written
from .registry import Tables, query

# The SQL engine's word edges are those of ASCII, as in the rules.
PHONE, EMAIL, AADHAAR = P.PHONE, P.EMAIL, P.AADHAAR
#: Case data that the tables lack, written behind each text: the same text in both engines.
PLANTED = """coalesce(text, '') || ' FIR No. ' || (doc_id % 99999 + 1) || '/2021 under Section ' || (doc_id % 500 + 1) || '(2) and IPC 302, dated 2021-03-0' || (doc_id % 9 + 1)
    || ' and 5/6/2021. Complainant: Asha Verma r/o ' || doc_id || ' Lake Road, Bhopal; phone 98765' || lpad(CAST(doc_id % 100000 AS STRING), 5, '0') || ', also +91 9000000001, mail z' || doc_id
    || '@ex.org, admin@ex.org and z' || doc_id || '@ex.org; card 1234 5678 ' || (doc_id % 9000 + 1000) || '. ASHA VERMA asked Ashaverma.'"""
_SQL = PLANTED.replace("AS STRING", "AS VARCHAR")
_FOUND = "list_filter({m}, lambda x, i: list_position({m}, x) = i)"


def _sql_matches(pattern: str) -> str:
    """Distinct matches in order of first occurrence."""
    return _FOUND.format(m=f"regexp_extract_all(t, '{pattern}')")


@query(rf"""
WITH d AS (SELECT doc_id, {_SQL} AS t FROM documents)
SELECT doc_id, {_sql_matches(EMAIL)} AS emails FROM d""")
def emails(t: Tables):
    """Addresses of every text, each once, in order of first occurrence."""
    return t.documents.select("doc_id", X.matches(F.expr(PLANTED), P.EMAIL).alias("emails"))


@query(rf"""
WITH d AS (SELECT doc_id, {_SQL} AS t FROM documents)
SELECT doc_id, ['Asha Verma'] AS persons, [doc_id || ' Lake Road, Bhopal'] AS addresses, {_sql_matches(PHONE)} AS phones, {_sql_matches(EMAIL)} AS emails, {_sql_matches(AADHAAR)} AS aadhaar,
       {_sql_matches(P.FIR_NUMBER)} AS fir_numbers, {_sql_matches(P.SECTION)} AS sections, {_sql_matches(P.DATE)} AS dates
FROM d""")
def entities(t: Tables):
    """All rules over all texts."""
    found = t.documents.select("doc_id", X.entities(F.expr(PLANTED)).alias("e"))
    return found.select("doc_id", *[F.col(f"e.{c}") for c in ("persons", "addresses", "phones", "emails", "aadhaar", "fir_numbers", "sections", "dates")])


@query(rf"""
WITH d AS (SELECT doc_id, {_SQL} AS t FROM documents),
m AS (SELECT *, [list_extract(regexp_extract_all(t, 'FIR No. [0-9]+/2021'), -1)] AS f FROM d)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{EMAIL}', '[REDACTED]', 'g'), '{PHONE}', '[REDACTED]', 'g'), '{AADHAAR}', '[REDACTED]', 'g'), '\bAsha Verma\b', '[REDACTED]', 'gi') AS text,
       CAST(len(regexp_extract_all(t, '{EMAIL}')) + len(regexp_extract_all(t, '{PHONE}')) + len(regexp_extract_all(t, '{AADHAAR}')) + len(regexp_extract_all(t, '(?i)\bAsha Verma\b')) AS INTEGER) AS removed
FROM m""")
def redacted_texts(t: Tables):
    """Registered names and identifying patterns go; numbers of evidence stay, also where one is a target."""
    targets = F.array(F.lit("Asha Verma"), F.expr("'FIR No. ' || (doc_id % 99999 + 1) || '/2021'"))
    return t.documents.select("doc_id", X.redact(F.expr(PLANTED), targets).alias("r")).select("doc_id", "r.text", "r.removed")


@query(rf"""
WITH d AS (SELECT doc_id, {_SQL} AS t FROM documents), p AS (SELECT doc_id, t, regexp_extract_all(t, '{EMAIL}') AS m FROM d),
u AS (SELECT doc_id, t, m, unnest(range(1, len(m) + 1)) AS i FROM p),
s AS (SELECT doc_id, m[i] AS value, string_split(t, m[i]) AS parts, len(list_filter(m[1:i - 1], lambda x: x = m[i])) AS before FROM u)
SELECT doc_id, value, CAST(list_sum(list_transform(parts[1:before + 1], lambda x: length(x))) + before * length(value) AS INTEGER) AS start FROM s""")
def entity_spans(t: Tables):
    """Every address with its offset."""
    found = t.documents.select("doc_id", F.explode(X.span_finder(P.EMAIL)(F.expr(PLANTED))).alias("s"))
    return found.select("doc_id", "s.value", "s.start")


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT doc_id, CAST(count(*) AS INTEGER) AS removed FROM w WHERE token = 'with' GROUP BY doc_id""")
def whole_words(t: Tables):
    """Occurrences of a literal as a whole word, through the redactor."""
    r = X.redact(F.regexp_replace("text", "@", " "), F.array(F.lit("With")))
    return t.documents.select("doc_id", r["removed"].alias("removed")).where("removed > 0")


@query("""
WITH i AS (SELECT DISTINCT l_orderkey, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + 4 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT l_orderkey, min(a) AS start, max(b) AS "end" FROM g GROUP BY l_orderkey, island""")
def merged_spans(t: Tables):
    q = F.col("l_quantity").cast("int")
    return X.merged_rows(t.lineitem.select("l_orderkey", q.alias("start"), (q + 4).alias("end")), "l_orderkey")


@query("""
WITH i AS (SELECT DISTINCT l_orderkey, l_returnflag = 'R' AS keep, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + 5 AS b FROM lineitem)
SELECT l_orderkey, a AS start, b AS "end" FROM i c WHERE NOT keep AND NOT EXISTS (SELECT 1 FROM i k WHERE k.keep AND k.l_orderkey = c.l_orderkey AND c.a < k.b AND k.a < c.b)""")
def spans_outside(t: Tables):
    """Candidate spans that touch no preserved one."""
    q = F.col("l_quantity").cast("int")
    span = F.struct(q.alias("start"), (q + 5).alias("end"))
    by = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "R", span)).alias("c"), F.collect_set(F.when(F.col("l_returnflag") == "R", span)).alias("k"))
    return by.select("l_orderkey", F.explode(X.outside(F.col("c"), F.col("k"))).alias("s")).select("l_orderkey", "s.start", "s.end")


@query("SELECT c_custkey, '+91' || CAST(9000000000 + c_custkey AS VARCHAR) AS mobile, '+91' || repeat('*', 8) || right(CAST(9000000000 + c_custkey AS VARCHAR), 2) AS masked FROM customer")
def mobiles(t: Tables):
    raw = (F.lit(9000000000) + F.col("c_custkey")).cast("string")
    e164 = X.mobile(F.concat_ws(" ", F.substring(raw, 1, 5), F.substring(raw, 6, 5)))
    return t.customer.select("c_custkey", e164.alias("mobile"), X.masked_mobile(e164).alias("masked"))


@query("SELECT c_custkey, trim(regexp_replace(replace(upper(c_name), '<', ' '), '\\s+', ' ', 'g')) AS name, translate(regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g'), 'OQDILSBZG', '000115826') AS number FROM customer")
def canonical_forms(t: Tables):
    return t.customer.select("c_custkey", X.canonical_name(F.col("c_name")).alias("name"), X.canonical_number(F.col("c_name")).alias("number"))


@query("SELECT doc_id, array_to_string(list_filter([source, lang, CASE WHEN n_chars > 1000 THEN 'long' END], lambda x: x IS NOT NULL), '  |  ') AS label FROM documents")
def stamp_labels(t: Tables):
    return t.documents.select("doc_id", X.stamp_label(F.col("source"), F.col("lang"), F.when(F.col("n_chars") > 1000, "long")).alias("label"))


@query("""
SELECT event_id, sha256(repeat('0', 64) || '|' || coalesce(CAST(user_id AS VARCHAR), '') || '|' || event_type || '|||' || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|' || props) AS h FROM events""")
def record_hashes(t: Tables):
    rows = t.events.select("event_id", F.col("user_id"), F.col("event_type").alias("action"), F.lit(None).alias("document_id"), F.lit(None).alias("case_id"), F.lit(None).alias("version"), F.col("ts").alias("occurred_at"), F.col("props").alias("detail"))
    return rows.select("event_id", A.record_hash(F.lit(H.GENESIS), F.col("detail")).alias("h"))


@query("""
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS total FROM events)
SELECT k.kind, k.kind = 'whole' AS intact, CASE WHEN k.kind <> 'whole' THEN (SELECT min(event_id) FROM e WHERE n > total * k.share) END AS broken_at
FROM (VALUES ('whole', 0.0), ('edited', 0.5), ('removed', 0.75)) AS k(kind, share)""")
def chain_intact(t: Tables):
    """The audit log, chained and verified: as it is, with a record edited, and with one removed."""
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("document_id", "case_id", "version")], F.date_trunc("millisecond", F.col("ts")).cast("timestamp").alias("occurred_at"), F.col("props").alias("detail"))
    body = H.payload(*[F.col(p) for p in A.PARTS], H.iso_millis(F.col("occurred_at")), F.col("detail"))
    # Each verification reads the log several times, but it is chained once.
    chain = written(A.build_chain(rows.withColumn("body", body)), "chain")
    total = rows.count()
    at = [int(total * share) + 1 for share in (0.5, 0.75)]
    found = dict(running_sum(rows.select("id", F.lit(1).alias("one")), "id", "one", "n").where(F.col("n").isin(at)).select("n", "id").collect())
    middle, late = (found.get(n) for n in at)
    edited = chain.withColumn("action", F.when(F.col("id") == middle, F.lit("forged")).otherwise(F.col("action")))
    # Without its record, the next one names a record that is not there.
    before = rows.where(F.col("id") < late).agg(F.max("id")).first()[0]
    out = None
    for kind, log in (("whole", chain), ("edited", edited), ("removed", chain.where(F.col("id") != before))):
        one = A.verify_chain(log).select(F.lit(kind).alias("kind"), "intact", "broken_at")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_id, lag(event_type, 1, 'first') OVER (ORDER BY event_id) AS before FROM events")
def previous_records(t: Tables):
    """The record before each, without a window over one partition."""
    return A.before_each(t.events.select("event_id", "event_type"), "event_id", "event_type", "first").select("event_id", F.col("_before").alias("before"))


@query("SELECT event_id, props::JSON::VARCHAR AS canonical FROM events")
def canonical_details(t: Tables):
    return t.events.select("event_id", F.regexp_replace(H.canonical(F.col("props")), ":", ": ").alias("canonical"))


@query("SELECT user_id, event_id, was, failed FROM (SELECT *, lag(failed, 1, false) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM (SELECT *, event_type = 'error' AS failed FROM events)) WHERE was <> failed")
def integrity_edges(t: Tables):
    return A.state_changes(t.events.withColumn("failed", F.col("event_type") == "error"), "user_id", "ts").select("user_id", "event_id", "was", "failed")


@query("""
WITH v AS (SELECT doc_id, sha256(coalesce(text, '')) AS rec, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS stored, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'y' ELSE sha256(coalesce(text, '')) END AS ledger FROM documents)
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'file_missing' WHEN stored <> rec THEN 'hash_mismatch' WHEN doc_id % 2 = 0 AND (ledger IS NULL OR ledger <> rec) THEN 'ledger_mismatch' END AS reason,
       coalesce(doc_id % 17 <> 0 AND ledger IS NOT NULL AND stored = rec AND ledger = rec, false) AS verified FROM v""")
def integrity_check(t: Tables):
    rec = F.sha2(F.coalesce("text", F.lit("")), 256)
    d = F.col("doc_id")
    v = t.documents.select(d.alias("id"), rec.alias("sha256"), F.when(d % 2 == 0, "anchored").otherwise("pending").alias("anchor_status"))
    stored = t.documents.select(d.alias("version_id"), F.when(d % 7 == 0, "x").otherwise(rec).alias("stored_hash"), F.when(d % 17 == 0, "file_missing").alias("failure"))
    ledger = t.documents.where(d % 11 != 0).select(d.alias("version_id"), F.lit(1).alias("seq"), F.when(d % 13 == 0, "y").otherwise(rec).alias("sha256"))
    return A.integrity(v, stored, ledger).select(F.col("id").alias("doc_id"), "reason", "verified")


@query("SELECT l_orderkey AS version_id, l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey = 7")
def custody_history(t: Tables):
    ledger = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("seq"), "l_shipdate")
    return A.custody(ledger, 7).select("version_id", F.col("seq").alias("l_linenumber"), "l_shipdate")


@query("""
WITH c AS (SELECT p_partkey, upper(replace(p_name, ' ', '<')) AS s FROM part),
e AS (SELECT p_partkey, unnest(range(1, length(s) + 1)) AS i, s FROM c),
v AS (SELECT p_partkey, i, ascii(substr(s, i, 1)) AS a FROM e)
SELECT p_partkey, CAST(CAST(sum((CASE WHEN a BETWEEN 48 AND 57 THEN a - 48 WHEN a BETWEEN 65 AND 90 THEN a - 55 ELSE 0 END) * (CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END)) % 10 AS INTEGER) AS VARCHAR) AS digit
FROM v GROUP BY p_partkey""")
def check_digits(t: Tables):
    return t.part.select("p_partkey", M.check_digit(F.translate(F.upper("p_name"), " ", "<")).alias("digit"))


def _sql_digit(data: str) -> str:
    """A check digit in the SQL engine."""
    worth = "CASE WHEN ascii(c) BETWEEN 48 AND 57 THEN ascii(c) - 48 WHEN ascii(c) BETWEEN 65 AND 90 THEN ascii(c) - 55 ELSE 0 END * [7, 3, 1][(i - 1) % 3 + 1]"
    return f"CAST(list_sum(list_transform(string_split({data}, ''), lambda c, i: {worth})) % 10 AS VARCHAR)"


@query(f"""
WITH c AS (SELECT c_custkey, rpad(CAST(c_custkey AS VARCHAR), 9, '<') AS n, lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') || '0101' AS b FROM customer),
d AS (SELECT c_custkey, n || {_sql_digit("n")} AS n, b || {_sql_digit("b")} AS b, '300101' || {_sql_digit("'300101'")} AS x, repeat('<', 14) || '0' AS o FROM c),
z AS (SELECT c_custkey, 'P<UTODOE<<JANE' || repeat('<', 30) AS upper, n || 'UTO' || b || 'F' || x || o AS lower, {_sql_digit("(n || b || x || o)")} AS total FROM d)
SELECT c_custkey, [upper, lower || CASE WHEN c_custkey % 10 = 3 THEN CAST((CAST(total AS INTEGER) + 1) % 10 AS VARCHAR) ELSE total END] AS lines, c_custkey % 10 <> 3 AS sound, CAST(c_custkey AS VARCHAR) AS number,
       CASE WHEN c_custkey % 10 <> 3 THEN 'JANE' END AS given_names, lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') || '0101' AS date_of_birth, CASE WHEN c_custkey % 10 = 4 THEN 1 ELSE 0 END AS repairs
FROM z""")
def zone_round_trip(t: Tables):
    """Zones written and read back: most sound, some with a wrong composite digit, some with a letter in a date."""
    key = F.col("c_custkey")
    birth = F.concat(F.lpad((key % 90).cast("string"), 2, "0"), F.lit("0101"))
    rows = t.spread(t.customer.select("c_custkey")).select("c_custkey", M.generate("TD3", F.lit("P"), F.lit("UTO"), key.cast("string"), F.lit("UTO"), birth, F.lit("F"), F.lit("300101"), F.lit("DOE"), F.lit("JANE")).alias("whole"))
    last = F.substring(F.col("whole")[1], 44, 1)
    # A tenth has the next composite digit; another tenth the letter I where its date has the digit 1.
    forged = F.concat(F.substring(F.col("whole")[1], 1, 43), ((last.cast("int") + 1) % 10).cast("string"))
    blurred = F.concat(F.substring(F.col("whole")[1], 1, 16), F.lit("I"), F.substring(F.col("whole")[1], 18, 27))
    rows = rows.withColumn("lines", F.array(F.col("whole")[0], F.when(key % 10 == 3, forged).otherwise(F.col("whole")[1])))
    rows = rows.withColumn("seen", F.when(key % 10 == 4, F.array(F.col("whole")[0], blurred)).otherwise(F.col("lines")))
    z = M.with_zone(rows, "seen")
    ok = F.col("zone.overall_check_digit_valid")
    return z.select("c_custkey", "lines", ok.alias("sound"), F.col("zone.document_number").alias("number"), F.when(ok, F.col("zone.given_names")).alias("given_names"), "zone.date_of_birth", F.size("zone.repairs").alias("repairs"))


@query("""
SELECT o_orderkey, CAST(date_part('year', DATE '2026-02-28') - date_part('year', o_orderdate) - CASE WHEN (2, 28) < (date_part('month', o_orderdate), date_part('day', o_orderdate)) THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders""")
def completed_years(t: Tables):
    return t.orders.select("o_orderkey", D.age(F.to_date("o_orderdate"), F.lit("2026-02-28").cast("date")).cast("int").alias("age"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders""")
def printed_dates(t: Tables):
    """Dates printed with month names, read back."""
    return t.orders.select("o_orderkey", D.parse_date(F.upper(F.date_format("o_orderdate", "dd MMM yyyy"))).alias("d"))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) > DATE '2026-01-01' THEN CAST(o_orderdate AS DATE) - INTERVAL 100 YEARS ELSE o_orderdate END::DATE AS birth FROM orders")
def zone_dates(t: Tables):
    short = F.date_format("o_orderdate", "yyMMdd")
    return t.orders.select("o_orderkey", D.mrz_date(short, "birth", F.lit("2026-01-01").cast("date")).alias("birth"))


@query("SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS t FROM documents")
def normalised_pages(t: Tables):
    return t.documents.select("doc_id", X.page_text(F.array("text")).alias("t"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
w AS (
    SELECT user_id, i, ts, ts AS start, 1 AS n FROM e WHERE i = 1
    UNION ALL
    SELECT e.user_id, e.i, e.ts, CASE WHEN e.ts >= w.start + INTERVAL 15 MINUTE THEN e.ts ELSE w.start END, CASE WHEN e.ts >= w.start + INTERVAL 15 MINUTE THEN 1 ELSE w.n + 1 END
    FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.i = w.i + 1)
SELECT user_id, ts, n <= 2 AS allowed FROM w""")
def fixed_window_limits(t: Tables):
    """First-request-anchored windows; no built-in window has these bounds."""
    from ..streaming.streams import rate_limit

    return rate_limit(t.events, "user_id", "ts", 15, 2)
