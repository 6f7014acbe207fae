"""Rules of access, validation and risk, each through its operator and written a second time in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import mrz as M
from ..operators import relational as R
from ..operators import screening as S
from .registry import Tables, query
from .screening_queries import WEIGHT, evidence
from .validation_queries import _BASE, TODAY, records

_AS_OF = "2024-01-15 12:00:00"


@query(f"""
SELECT event_id, user_id FROM events e
WHERE ts + to_hours(CAST(event_id % 72 AS INTEGER)) > TIMESTAMP '{_AS_OF}' AND event_id % 3 <> 0 AND event_id % 7 < 5
  AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_custkey % 2 = 0)""")
def open_challenges(t: Tables):
    """One-time codes that may still be tried."""
    codes = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("verified_at"), F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 72 as int), 0, 0)").alias("expires_at"), (F.col("event_id") % 7).alias("attempts"), F.lit(5).alias("max_attempts"))
    users = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("is_active"))
    return R.live_challenges(codes, users, F.lit(_AS_OF).cast("timestamp")).select("event_id", "user_id")


@query(f"SELECT event_id, user_id FROM events WHERE ts + to_hours(CAST(event_id % 72 AS INTEGER)) >= TIMESTAMP '{_AS_OF}'")
def open_sessions(t: Tables):
    """Sessions that have not expired."""
    sessions = t.events.select("event_id", "user_id", F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 72 as int), 0, 0)").alias("expires_at"))
    return R.live_sessions(sessions, F.lit(_AS_OF).cast("timestamp")).select("event_id", "user_id")


#: A passport beside each record, for both engines.
_PASSPORT = {
    "linked": "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'PO' || lpad(CAST(k % 1000 AS {s}), 6, '0') WHEN 2 THEN 'X999999' ELSE 'P0' || lpad(CAST(k % 1000 AS {s}), 6, '0') END",
    "own": "CASE k % 8 WHEN 0 THEN '' ELSE 'P0' || lpad(CAST(k % 1000 AS {s}), 6, '0') END",
    "p_sur": "CASE k % 10 WHEN 0 THEN '' WHEN 3 THEN 'DOF' ELSE 'DOE' END",
    "p_nat": "CASE k % 4 WHEN 0 THEN 'IND' WHEN 1 THEN 'QQQ' ELSE '' END",
    "p_days": "CAST(k * 41 % 5000 AS INTEGER)",
}
_STAY = "entry + stay"


@query(f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS od FROM orders), r AS (SELECT k, od, {_BASE} FROM o),
v AS (SELECT *, {", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in _PASSPORT.items())} FROM r WHERE kind = 'visa'),
c AS (
  SELECT k, 'visa_passport_link' AS id, CASE WHEN replace(linked, 'O', '0') = own THEN 'PASS' ELSE 'FAIL' END AS status, 'critical' AS worst FROM v WHERE linked <> '' AND own <> ''
  UNION ALL SELECT k, 'visa_passport_surname', CASE WHEN sur = p_sur THEN 'PASS' ELSE 'FAIL' END, 'high' FROM v WHERE p_sur <> ''
  UNION ALL SELECT k, 'visa_passport_date_of_birth', CASE WHEN k % 12 = 0 THEN 'FAIL' ELSE 'PASS' END, 'high' FROM v
  UNION ALL SELECT k, 'visa_passport_nationality', CASE WHEN nat = p_nat THEN 'PASS' ELSE 'FAIL' END, 'high' FROM v WHERE p_nat <> ''
  UNION ALL SELECT k, 'passport_covers_stay', 'WARN', 'medium' FROM v WHERE expiry IS NOT NULL AND od + p_days < least(expiry, {_STAY}))
SELECT k AS o_orderkey, id, status, CASE status WHEN 'PASS' THEN 'info' ELSE worst END AS severity FROM c""")
def visa_companions(t: Tables):
    """Visas against the passports presented with them."""
    r = records(t).where("document_type = 'visa'").withColumn("k", F.col("o_orderkey"))
    r = r.withColumns({n: F.expr(e.format(s="STRING")) for n, e in _PASSPORT.items()})
    until = F.date_format(F.date_add(F.to_date("fields.valid_from"), F.col("p_days")), "yyyy-MM-dd")
    given = {"document_number": F.col("own"), "surname": F.col("p_sur"), "date_of_birth": F.when(F.col("k") % 12 == 0, "1901-01-01").otherwise(F.col("fields.date_of_birth")), "nationality": F.col("p_nat"), "date_of_expiry": until}
    r = r.withColumns({"fields": F.col("fields").withField("passport_number", F.col("linked")), "passport": F.struct(*[v.alias(n) for n, v in given.items()])})
    rows = S.check_rows(S.validate(r, F.lit(TODAY).cast("date"), "passport"), "o_orderkey")
    return rows.where("startswith(id, 'visa_passport_') or id = 'passport_covers_stay'").select("o_orderkey", "id", "status", "severity")


@query(f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS od FROM orders), r AS (SELECT k, od, {_BASE} FROM o)
SELECT k AS o_orderkey, CASE WHEN sound THEN 'K0000012' ELSE nullif(viz_num, '') END AS document_number, CASE WHEN sound THEN 'mrz' WHEN viz_num <> '' THEN 'viz' END AS number_source,
       CASE WHEN sound THEN 'DOE' ELSE nullif(viz_sur, '') END AS surname, CASE WHEN sound THEN 'JANE' END AS given_names,
       CASE WHEN sound THEN '1980-01-01' ELSE strftime(birth, '%Y-%m-%d') END AS date_of_birth, CASE WHEN sound THEN 'mrz' WHEN birth IS NOT NULL THEN 'viz' END AS birth_source,
       CASE WHEN sound THEN 'M' ELSE nullif(sex, '') END AS sex
FROM r""")
def merged_fields(t: Tables):
    """The zone where all its digits hold, print elsewhere, and where each value is from."""
    fields, sources = S.merge_fields(F.col("mrz"), F.col("viz_fields"), F.lit(TODAY).cast("date"))
    r = records(t).select("o_orderkey", fields.alias("f"), sources.alias("s"))
    return r.select("o_orderkey", "f.document_number", F.col("s.document_number").alias("number_source"), "f.surname", "f.given_names", "f.date_of_birth", F.col("s.date_of_birth").alias("birth_source"), "f.sex")


@query(f"""
WITH e AS (
  SELECT l_orderkey, l_returnflag, l_linenumber, {WEIGHT} AS w, CAST(l_partkey AS VARCHAR) AS code, CASE WHEN l_quantity < 10 THEN 'info' WHEN l_quantity < 25 THEN 'low' WHEN l_quantity < 40 THEN 'medium' ELSE 'high' END AS severity,
         CASE l_returnflag WHEN 'R' THEN 'identity' WHEN 'A' THEN 'format' ELSE 'other' END AS category FROM lineitem),
c AS (SELECT l_orderkey, least(CASE l_returnflag WHEN 'R' THEN 100.0 WHEN 'A' THEN 30.0 ELSE 50.0 END, sum(w)) AS v FROM e GROUP BY l_orderkey, l_returnflag),
s AS (SELECT l_orderkey, 100 * (1 - product(1 - least(v, 100) / 100)) AS score FROM c GROUP BY l_orderkey),
n AS (SELECT l_orderkey, string_agg(code, ',' ORDER BY w DESC, l_linenumber, severity, category, code) AS reasons FROM e WHERE w > 0 GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderkey % 100 AS quality, o_orderkey % 3 <> 0 AS expected, o_orderkey % 4 <> 0 AS verified, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS face, coalesce(score, 0) AS score, coalesce(reasons, '') AS reasons
      FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN n ON n.l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN score >= 59.95 THEN 'REFER_TO_SUPERVISOR' WHEN quality < 40 AND expected AND NOT verified THEN 'RECAPTURE' WHEN score >= 24.95 OR (expected AND NOT verified) THEN 'SECONDARY_INSPECTION' ELSE 'CLEAR' END AS disposition,
       coalesce(100.0 * (CAST(expected AND verified AS INTEGER) + CAST(coalesce(face, false) AS INTEGER)) / nullif(CAST(expected AS INTEGER) + CAST(face IS NOT NULL AS INTEGER), 0), 100.0) AS coverage, reasons
FROM o""")
def risk_dispositions(t: Tables):
    """What to do with a traveller, how much could be assessed, and the reasons by weight."""
    k = F.col("o_orderkey")
    context = t.orders.select(k.alias("screening_id"), (k % 100).cast("double").alias("capture_quality"), (k % 3 != 0).alias("mrz_expected"), (k % 4 != 0).alias("mrz_verified"), F.when(k % 5 > 0, k % 5 > 1).alias("face_checked"))
    r = S.risk(evidence(t), context)
    return r.select(F.col("screening_id").alias("o_orderkey"), "disposition", F.col("assessment_coverage").alias("coverage"), F.array_join("reasons.code", ",").alias("reasons"))


def _lcs(a: str, b: str) -> str:
    """The length of the longest common subsequence of two lists of characters, row by row."""
    row = f"list_reduce(range(1, len({a}) + 1), lambda new, i: list_append(new, CASE WHEN {a}[i] = c THEN old[i] + 1 ELSE greatest(new[len(new)], old[i + 1]) END), [0])"
    return f"list_reduce({b}, lambda old, c: {row}, list_transform(range(len({a}) + 1), lambda z: 0))[len({a}) + 1]"


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"


@query(f"""
WITH p AS (SELECT p_partkey, p_name AS a, coalesce(lag(p_name) OVER (ORDER BY p_partkey), '') AS b FROM part),
c AS (SELECT p_partkey, string_split(a, '') AS a, string_split(b, '') AS b, string_split({_SORTED.format('a')}, '') AS sa, string_split({_SORTED.format('b')}, '') AS sb FROM p WHERE b <> '')
SELECT p_partkey, round(200.0 * {_lcs('a', 'b')} / (len(a) + len(b)), 6) AS ratio, round(200.0 * {_lcs('sa', 'sb')} / (len(sa) + len(sb)), 6) AS sorted_ratio FROM c""")
def name_ratios(t: Tables):
    """Names against those of their neighbours, letter by letter and with sorted words."""
    after = t.part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("b"))
    p = t.part.select("p_partkey", F.col("p_name").alias("a")).join(after, "p_partkey")
    return p.select("p_partkey", F.round(fuzzy.fuzz_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), F.round(fuzzy.fuzz_token_sort(F.col("a"), F.col("b")), 6).alias("sorted_ratio"))


@query("""
SELECT c_custkey, ['TD1', 'TD2', 'TD3', 'MRVA', 'MRVB'][c_custkey % 5 + 1] AS format, true AS sound, 'K' || lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '0') AS number,
       CASE c_custkey % 3 WHEN 0 THEN 'DOE' WHEN 1 THEN 'DE LA CRUZ' ELSE 'OBRIEN' END AS surname, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'JANE MARY' END AS given_names,
       lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') || '0101' AS date_of_birth, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex
FROM customer""")
def zones_of_all_formats(t: Tables):
    """Zones of the five formats written and read back."""
    k = F.col("c_custkey")
    surname = F.when(k % 3 == 0, "DOE").when(k % 3 == 1, "DE LA CRUZ").otherwise("OBRIEN")
    birth, number = F.concat(F.lpad((k % 90).cast("string"), 2, "0"), F.lit("0101")), F.concat(F.lit("K"), F.lpad((k % 100000000).cast("string"), 8, "0"))

    def zone(fmt: str):
        code = F.lit("V" if fmt.startswith("MRV") else "P" if fmt == "TD3" else "I")
        return M.generate(fmt, code, F.lit("UTO"), number, F.lit("UTO"), birth, F.when(k % 2 == 0, "F").otherwise("M"), F.lit("300101"), surname, F.when(k % 4 == 0, "").otherwise("JANE MARY"))

    formats = ["TD1", "TD2", "TD3", "MRVA", "MRVB"]
    lines = F.coalesce(*[F.when(k % 5 == i, zone(fmt)) for i, fmt in enumerate(formats)])
    z = M.with_zone(t.spread(t.customer.select("c_custkey")).select("c_custkey", lines.alias("lines")), "lines")
    return z.select("c_custkey", "zone.format", F.col("zone.overall_check_digit_valid").alias("sound"), F.col("zone.document_number").alias("number"), "zone.surname", "zone.given_names", "zone.date_of_birth", "zone.sex")
