"""Operators on their own domain: cases, audit chains, screening, risk, streams."""

import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.functions import hashing as H
from dossierlake.functions import mrz as M
from dossierlake.operators import audit as A
from dossierlake.operators import evaluation as E
from dossierlake.operators import heatmaps as HM
from dossierlake.operators import relational as R
from dossierlake.operators import screening as S
from dossierlake.sources import tables as T
from dossierlake.streaming import streams as ST


def test_page_and_scope(spark):
    rows = spark.range(10).withColumnRenamed("id", "case_id")
    mine = spark.createDataFrame([(2, "u"), (3, "u"), (4, "v")], "case_id long, user_id string")
    assert [r[0] for r in R.scoped(rows, mine, "u").orderBy("case_id").collect()] == [2, 3]
    p = R.page(rows, [F.desc("case_id")], 2, 4).collect()
    assert sorted(r.case_id for r in p) == [2, 3, 4, 5] and {r.total_count for r in p} == {10}


def test_access(spark):
    asked = spark.createDataFrame([("u", "io", "read", 1), ("u", "io", "erase", 1), ("u", "io", "read", None), ("u", "io", "case.create", None), ("v", "io", "read", 1)], "user_id string, rank string, action string, case_id long")
    may = spark.createDataFrame([("io", "read"), ("io", "case.create")], "rank string, action string")
    on = spark.createDataFrame([(1, "u")], "case_id long, user_id string")
    got = {(r.user_id, r.action, r.case_id): (r.allowed, r.reason) for r in R.access_decision(asked, may, on).collect()}
    assert got == {("u", "read", 1): (True, None), ("u", "erase", 1): (False, "rank"), ("u", "read", None): (False, "no_case_context"), ("u", "case.create", None): (True, None), ("v", "read", 1): (False, "not_assigned")}


def chain(spark, n=50):
    rows = spark.range(1, n + 1).select("id", F.lit("u").alias("user_id"), F.lit("view").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("document_id", "case_id", "version")], F.timestamp_seconds(F.col("id")).alias("occurred_at"), F.lit("{}").alias("detail"))
    return A.build_chain(rows.withColumn("body", H.payload(*[F.col(p) for p in A.PARTS], H.iso_millis(F.col("occurred_at")), F.col("detail"))))


def test_chain(spark):
    log = chain(spark)
    assert A.verify_chain(log).first() == (True, None)
    assert A.verify_chain(log.withColumn("action", F.when(F.col("id") == 20, "edit").otherwise(F.col("action")))).first() == (False, 20)
    assert A.verify_chain(log.where("id <> 30")).first() == (False, 31)


def test_json_log(spark, tmp_path):
    records = A.append_records([{"event": f"é{i}", "screening_id": str(i % 2)} for i in range(9)])
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    log = T.log_lines(spark, str(path))
    assert A.verify_log(log).first() == (True, 9, None, records[-1]["hash"])
    assert [r.seq for r in T.last_records(log, 2, "0").collect()] == [7, 9]
    assert tuple(T.head_of(log).first()) == (9, records[-1]["hash"])
    records[1]["event"] = "changed"
    path.write_text("\n".join(json.dumps(r) for r in records))
    assert A.verify_log(T.log_lines(spark, str(path))).first()[:3] == (False, 9, 2)


@pytest.mark.parametrize("failure, anchored, stored, ledger, reason", [("file_missing", True, "b", None, "file_missing"), (None, True, "b", "a", "hash_mismatch"), (None, True, "a", "b", "ledger_mismatch"), (None, False, "a", None, None), (None, True, "a", "a", None)])
def test_tamper_reason(spark, failure, anchored, stored, ledger, reason):
    c = A.tamper_reason(F.lit(failure).cast("string"), F.lit(anchored), F.lit(stored), F.lit("a"), F.lit(ledger).cast("string"))
    assert spark.range(1).select(c).first()[0] == reason


def test_encrypted_blobs(spark):
    key, iv = b"k" * 16, b"i" * 12
    v = spark.createDataFrame([("p", bytearray(b"hello"))], "storage_path string, plain string").select("storage_path", F.aes_encrypt(F.lit("hello"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(iv)).alias("all"))
    parts = v.select("storage_path", F.expr("substring(all, 13, length(all) - 28)").alias("content"), F.expr("substring(all, 1, 12)").alias("iv"), F.expr("substring(all, length(all) - 15, 16)").alias("auth_tag"), F.lit(key).alias("data_key"))
    versions = parts.drop("content").unionByName(parts.drop("content").withColumn("storage_path", F.lit("gone")))
    got = {r.storage_path: (r.plain, r.failure) for r in T.retrieve(versions, parts.select("storage_path", "content")).collect()}
    assert bytes(got["p"][0]) == b"hello" and got["p"][1] is None and got["gone"] == (None, "file_missing")
    broken = parts.select("storage_path", F.concat(F.lit(b"x"), F.expr("substring(content, 2)")).alias("content"))
    assert T.retrieve(parts.drop("content"), broken).first().failure == "ciphertext_modified"


def today():
    return F.lit("2026-09-16").cast("date")


EMPTY = dict.fromkeys(S.FIELDS)
RECORD = (
    f"screening_id string, document_type string, fields struct<{','.join(f'{f}:string' for f in S.FIELDS)}>, viz_fields struct<{','.join(f'{f}:string' for f in S.FIELDS)}>, "
    "mrz struct<valid_format:boolean,format:string,document_code:string,document_number:string,surname:string,given_names:string,nationality:string,issuing_state:string,sex:string,date_of_birth:string,date_of_expiry:string,optional_data:string,overall_check_digit_valid:boolean,check_digits:map<string,boolean>,repairs:array<string>>, "
    f"viz_confidences map<string,double>, printed_dates array<date>, entry_date date, mrz_read_reliable boolean, prior_entries int, intended_stay_days int, other struct<{','.join(f'{f}:string' for f in S.FIELDS)}>"
)
ZONE = {"valid_format": True, "format": "TD3", "document_code": "P<", "document_number": "K71M4P829", "surname": "GUPTA", "given_names": "AKSHIT", "nationality": "UTO", "issuing_state": "UTO", "sex": "M", "date_of_birth": "020214", "date_of_expiry": "350918", "optional_data": "", "overall_check_digit_valid": True, "check_digits": {"document_number": True, "composite": True}, "repairs": []}


def checked(spark, kind, fields, mrz=None, viz=None, prior=None, stay=None, other=None, printed=None):
    row = ("s", kind, EMPTY | fields, EMPTY | (viz or {}), mrz, {}, printed, None, True, prior, stay, other and EMPTY | other)
    r = S.validate(spark.createDataFrame([row], RECORD), today(), "other").first()
    return r, {c.id: c.status for c in r.checks}


GOOD = {"document_number": "K71M4P829", "surname": "GUPTA", "given_names": "AKSHIT", "nationality": "UTO", "issuing_state": "UTO", "sex": "M", "date_of_birth": "2002-02-14", "date_of_expiry": "2035-09-18", "date_of_issue": "2025-09-19"}


def test_valid_passport(spark):
    r, c = checked(spark, "passport", GOOD, ZONE, GOOD)
    assert r.valid and c["viz_mrz_document_number"] == "PASS" and c["validity_period"] == "PASS" and c["mrz_check_composite"] == "PASS"


def test_impossible_dates(spark):
    r, c = checked(spark, "passport", GOOD | {"date_of_birth": "2030-01-01", "date_of_issue": "2027-01-01", "date_of_expiry": "2020-01-01"}, ZONE)
    assert not r.valid and {k for k, v in c.items() if v == "FAIL"} >= {"dob_not_future", "not_expired", "issue_not_future"}


def test_print_against_zone(spark):
    _, c = checked(spark, "passport", GOOD, ZONE, GOOD | {"document_number": "K71M4PB29"})
    assert c["viz_mrz_document_number"] == "PASS"
    _, c = checked(spark, "passport", GOOD, ZONE, GOOD | {"date_of_expiry": "2038-12-31"}, printed=[date(2040, 1, 1)])
    assert c["viz_mrz_date_of_expiry"] == "FAIL" and c["printed_dates_within_mrz_range"] == "FAIL"


def test_visa(spark):
    visa = {"document_number": "VX1234567", "valid_from": "2026-01-01", "date_of_expiry": "2026-09-30", "number_of_entries": "SINGLE", "duration_of_stay_days": "10", "passport_number": "K71M4P829", "surname": "GUPTA", "date_of_birth": "2002-02-14"}
    _, c = checked(spark, "visa", visa, prior=1, stay=30, other={"document_number": "Z9999999", "surname": "OTHER", "date_of_birth": "2002-02-14"})
    assert {k for k, v in c.items() if v == "FAIL"} == {"visa_entries_remaining", "visa_stay_duration", "visa_passport_link", "visa_passport_surname"}


def test_merge(spark):
    fields, source = S.merge_fields(F.col("mrz"), F.col("viz_fields"), today())
    row = ("s", "passport", EMPTY, EMPTY | {"surname": "X", "valid_from": "2020-01-01"}, ZONE, {}, None, None, True, None, None, None)
    r = spark.createDataFrame([row], RECORD).select(fields.alias("f"), source.alias("s")).first()
    assert (r.f.surname, r.s.surname, r.f.valid_from, r.s.valid_from) == ("GUPTA", "mrz", "2020-01-01", "viz")


def test_watchlist(spark):
    w = spark.createDataFrame([("1", True, "LOST_STOLEN", "r", "K71M4P829", "UTO", None, None, None), ("2", True, "WANTED", "r", None, None, "SINGH", "RHEA", "1999-07-08"), ("3", False, "WANTED", "r", "K71M4P829", None, None, None, None)], "id string, active boolean, list_type string, reason string, document_number string, issuing_state string, surname string, given_names string, date_of_birth string")
    r = spark.createDataFrame([("a", "K71M4P829", None, "UTO", "GUPTA", "AKSHIT", "2002-02-14"), ("b", "X", None, None, "SINGH", "RHEA KUMARI", "1999-07-08"), ("c", "K71M4P829", None, "IND", "Z", "Z", "2000-01-01")], "screening_id string, document_number string, passport_number string, issuing_state string, surname string, given_names string, date_of_birth string")
    assert {(x.screening_id, x.entry_id, x.match) for x in S.watchlist_hits(r, w).collect()} == {("a", "1", "document_number"), ("b", "2", "name_and_dob")}


def test_conflicts(spark):
    cols = "screening_id string, seen_at long, document_number string, document_type string, surname string, given_names string, date_of_birth string, nationality string"
    seen = spark.createDataFrame([("old", 1, "P1111111", "passport", "KHAN", "ALI", "1990-01-01", "IND"), ("old2", 2, "P2222222", "passport", "ROY", "MIA", "1991-01-01", "IND")], cols).withColumn("id", F.col("screening_id"))
    now = spark.createDataFrame([("n1", 9, "P1111111", "passport", "OTHER", "ONE", "1980-01-01", "IND"), ("n2", 9, "P3333333", "passport", "ROY", "MIA", "1991-01-01", "NPL"), ("n3", 9, "P2222222", "passport", "ROY", "MIA", "1991-01-01", "IND"), ("n4", 0, "P1111111", "passport", "OTHER", "ONE", "1980-01-01", "IND")], cols)
    faces = spark.createDataFrame([("n1", "old2", 0.9), ("n3", "old2", 0.9), ("n2", "old", 0.5)], "screening_id string, identity_id string, similarity double")
    got = {(x.screening_id, x.previous, x.pattern) for x in S.identity_conflicts(now, seen, faces).collect()}
    assert got == {("n1", "old", "document_shared_by_different_identities"), ("n2", "old2", "same_biographics_different_nationality_documents"), ("n1", "old2", "same_face_different_identity")}


@pytest.mark.parametrize(
    "items, quality, verified, disposition, score",
    [
        ([], 80.0, True, "CLEAR", 0.0),
        ([("integrity", "critical", "FAIL")], 80.0, False, "REFER_TO_SUPERVISOR", 60.0),
        ([("validity", "high", "FAIL")], 80.0, True, "SECONDARY_INSPECTION", 30.0),
        ([("capture", "medium", "WARN")], 20.0, False, "RECAPTURE", 7.0),
        ([("format", "high", "FAIL"), ("format", "high", "FAIL"), ("validity", "high", "FAIL")], 80.0, True, "SECONDARY_INSPECTION", 51.0),
    ],
)
def test_risk(spark, items, quality, verified, disposition, score):
    ev = spark.createDataFrame([("s", i, c, v, str(i), "", "x", st) for i, (c, v, st) in enumerate(items)], "screening_id string, ordinal int, category string, severity string, code string, message string, source string, status string")
    ctx = spark.createDataFrame([("s", quality, True, verified, True)], "screening_id string, capture_quality double, mrz_expected boolean, mrz_verified boolean, face_checked boolean")
    r = S.risk(ev, ctx).first()
    assert (r.disposition, r.risk_score) == (disposition, score)
    assert len(r.reasons) == len(items)


def test_summary_and_reliability(spark):
    doc = json.dumps({"risk": {"risk_score": 12.5, "risk_band": "LOW", "disposition": "CLEAR", "reasons": [1, 2]}, "documents": [{"role": "other", "document_type": "visa"}, {"role": "primary", "document_type": "passport"}]})
    r = spark.range(1).select(S.verdict_summary(F.lit(doc)).alias("a"), S.verdict_summary(F.lit("[]")).alias("b"), S.read_is_reliable(F.lit(50.0), F.array(*[F.lit(0.7)] * 20), F.lit(1.0)).alias("c"), S.face_decision(F.lit(0.31)).alias("d")).first()
    assert tuple(r.a) == (12.5, "LOW", "CLEAR", "passport", 2) and r.b.disposition is None and r.c and r.d == "INCONCLUSIVE"


def test_metrics(spark):
    s = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.4), (False, 0.1)], "label boolean, score double")
    assert E.auc(s).first()[0] == 0.75 and E.auc_mid_rank(s).first()[0] == 0.875
    assert E.auc(s.where("label")).first()[0] is None
    assert tuple(E.recall_at_fpr(s, 0.5).first()) == (0.4, 0.5)


def test_edges_stream_equals_batch(spark, tmp_path):
    rows = [(k, t, bool((t * 7 + k) % 3 == 0)) for k in range(3) for t in range(12)]
    frame = spark.createDataFrame(rows, "version long, at long, failed boolean")
    batch = {(r.version, r.at) for r in A.state_changes(frame, "version", "at").collect()}
    for i in range(3):
        frame.where(f"at div 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ST.edge_alerts(stream, "version", "at").writeStream.format("memory").queryName("edges").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.version, r.at) for r in spark.table("edges").collect()} == batch


def test_rate_limit(spark):
    at = lambda m: datetime(2026, 1, 1, 0, m)
    rows = spark.createDataFrame([("ip", at(m)) for m in (0, 5, 10, 16, 17, 31)], "ip string, at timestamp")
    assert [r.allowed for r in ST.rate_limit(rows, "ip", "at", 15, 2).orderBy("at").collect()] == [True, True, False, True, True, True]


def test_process_each(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ST.versions_stream(spark, str(tmp_path / "in"), "id long", 1)
    ST.process_each(stream, lambda d: d.withColumn("x", F.col("id") + 1), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_capture(spark):
    from dossierlake.operators import capture as C

    f = lambda *v: [F.lit(float(x)) for x in v]
    r = spark.range(1).select(C.quality_score(*f(100, 145, 50, 0, 0)), C.quality_score(*f(0, 0, 0, 1, 99)), C.quality_warnings(*f(10, 10, 50, 0.5, 0)), C.capture_tips(*f(10, 100, 0, 0, 0.9, 1, 700, 0.2)), C.gated(F.lit(0.9), F.lit(0.6)), C.metadata_findings(F.lit("Adobe Photoshop 25"), F.lit(""), F.lit("2026:01:02 x"), F.lit("2026:01:01 y"), F.lit(True), F.lit("JPEG"))).first()
    assert (r[0], r[1]) == (100.0, 0.0) and r[2] == ["blur", "dark", "glare"] and r[3] == ["recapture", "hold steady"] and r[4] is None and r[5] == ["editing_software", "timestamp_mismatch"]


def test_printed_values(spark):
    from dossierlake.operators import capture as C

    cases = [("date_of_birth", "14 FEB 2002.", "2002-02-14"), ("sex", " male", "M"), ("nationality", "Indian", "IND"), ("document_number", "k71-m4p", "K71M4P"), ("duration_of_stay_days", "3 MONTHS", "90"), ("number_of_entries", "SINGLF", "SINGLE"), ("number_of_entries", "x 3", "3"), ("remarks", " :a  b. ", "A B"), ("sex", "?", None)]
    got = spark.range(1).select(*[C.printed_value(f, F.lit(v)).alias(f"c{i}") for i, (f, v, _) in enumerate(cases)]).first()
    assert list(got) == [w for *_, w in cases]
    r = spark.range(1).select(C.dates_without_labels(F.array(*map(F.lit, ("2030-01-01", "1990-01-01", "2020-01-01")))), C.number_without_label(F.array(*map(F.lit, ("PASSEPORT", "AB12345678", "AB1234567")))), C.is_plausible("surname", F.lit("12")), C.is_plausible("document_number", F.lit("K71M4"))).first()
    assert tuple(r[0]) == ("1990-01-01", "2020-01-01", "2030-01-01") and r[1] == "AB12345678" and not r[2] and r[3]


def test_document_type_and_boxes(spark):
    from dossierlake.operators import capture as C

    mrz = "struct<valid_format:boolean,document_code:string,format:string>"
    rows = spark.createDataFrame([((True, "P<", "TD3"), {}), ((True, "IR", "TD1"), {}), ((False, None, None), {}), ((False, None, None), {"visa": 0.9}), (None, {})], f"mrz {mrz}, words map<string,double>")
    assert [r[0] for r in rows.select(C.document_type(F.col("mrz"), F.col("words"))).collect()] == ["passport", "residence_permit", "driving_licence", "visa", "driving_licence"]
    items = spark.createDataFrame([(1, 10.0, 20.0, 100.0, 10.0, "0123456789", [(2, 4)])], "page int, x double, y double, width double, height double, text string, spans array<struct<start:int,end:int>>")
    assert tuple(C.covering_boxes(items).first()) == (1, 15.0, 17.5, 50.0, 15.0)
    z = spark.createDataFrame([(1, "s", 0, 0, 10, 10)], "region_id int, screening_id string, x0 int, y0 int, x1 int, y1 int")
    zones = spark.createDataFrame([("s", "photo", 0, 0, 4, 10), ("s", "text", 4, 0, 10, 10)], "screening_id string, zone string, zx0 int, zy0 int, zx1 int, zy1 int")
    assert S.best_zone(z, zones).first().zone == "text"


def test_aggregator(spark):
    from dossierlake.operators import capture as C

    rows = spark.range(200).select((F.col("id") % 4 == 0).alias("label"), (F.when(F.col("id") % 4 == 0, 1.0).otherwise(0.0) + F.col("id") / 1000).alias("a"))
    assembler, model = C.fit_aggregator(rows, ["a"], "label")
    assert model.transform(assembler.transform(rows)).where((F.col("prediction") == 1) != F.col("label")).count() == 0


def test_windows_over_a_total_order(spark):
    from dossierlake.operators import windows as W

    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    ordered = sorted(rows.collect())
    for n in (1, 7, 64):
        got = {r.k: r._before for r in W.before_each(rows, "k", "v", -1, n).collect()}
        assert got == {b.k: (a.v if a else -1) for a, b in zip([None, *ordered], ordered, strict=False)}
        total, want = 0, {}
        for r in ordered:
            total += r.v or 0
            want[r.k] = total
        assert {r.k: r.t for r in W.running_sum(rows.fillna(0), "k", "v", "t", n).collect()} == want


def run_stream(spark, frame, build, tmp_path, name):
    for i in range(3):
        frame.where(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}c")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_chain_stream_equals_batch(spark, tmp_path):
    rows = spark.range(1, 31).select("id", F.concat(F.lit("b"), "id").alias("body"), F.floor((F.col("id") - 1) / 10).alias("part"))
    got = {(r.id, r.prev_hash, r.entry_hash) for r in run_stream(spark, rows, ST.chain_appends, tmp_path, "chained").collect()}
    assert got == {(r.id, r.prev_hash, r.entry_hash) for r in A.build_chain(rows.drop("part")).collect()}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 2).alias("ip"), F.timestamp_seconds(F.col("id") * 241).alias("at"), F.floor(F.col("id") / 20).alias("part"))
    got = {tuple(r) for r in run_stream(spark, rows, lambda s: ST.rate_limit_stream(s, "ip", "at", 15, 1), tmp_path, "limited").collect()}
    assert got == {tuple(r) for r in ST.rate_limit(rows.drop("part"), "ip", "at", 15, 1).collect()} and {a for *_, a in got} == {True, False}


def test_pages_past_the_end_and_permissions(spark):
    rows = spark.range(60)
    assert [r.id for r in R.page(rows, [F.col("id")], 3).collect()] == list(range(50, 60)) and R.page(rows, [F.col("id")], 4).count() == 0
    held = spark.createDataFrame([("si", "b"), ("si", "a"), ("pc", "a"), ("si", "a")], "rank string, action string")
    assert {r["rank"]: r.permissions for r in R.permissions_of(held).collect()} == {"si": ["a", "b"], "pc": ["a"]}


def test_decision_context(spark):
    requests = spark.createDataFrame([("d1",), ("d9",)], "document_id string")
    documents = spark.createDataFrame([("d1", "c1")], "id string, case_id string")
    cases = spark.createDataFrame([("c1", "protected", "7/2024")], "id string, sensitivity string, case_number string")
    named = spark.createDataFrame([("c1", "B"), ("c1", "A")], "case_id string, value string")
    got = {r.document_id: r for r in R.decision_context(requests, documents, cases, named).collect()}
    assert got["d1"].sensitivity == "protected" and got["d1"].identities == ["A", "B"] and got["d9"].case_id is None


def test_challenges_and_sessions(spark):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    rows = [("ok", "u", None, "2026-01-01 12:05", 2, 3), ("late", "u", None, "2026-01-01 11:59", 0, 3), ("used", "u", "2026-01-01 11:00", "2026-01-01 12:05", 0, 3), ("tries", "u", None, "2026-01-01 12:05", 3, 3), ("gone", "v", None, "2026-01-01 12:05", 0, 3)]
    challenges = spark.createDataFrame(rows, "id string, user_id string, verified_at string, expires_at string, attempts int, max_attempts int").withColumn("expires_at", F.to_timestamp("expires_at"))
    users = spark.createDataFrame([("u", True), ("v", False)], "id string, is_active boolean")
    assert [r.id for r in R.live_challenges(challenges, users, now).collect()] == ["ok"]
    assert {r.id for r in R.live_sessions(challenges, now).collect()} == {"ok", "used", "tries", "gone"}


def test_unassign_settle_and_watch(spark):
    on = spark.createDataFrame([("c", "a"), ("c", "b")], "case_id string, user_id string")
    wish = spark.createDataFrame([("c", "a", "a"), ("c", "b", "a")], "case_id string, user_id string, removed_by string")
    left, refused = R.unassigned(on, wish)
    assert [r.user_id for r in left.collect()] == ["a"] and [r.user_id for r in refused.collect()] == ["a"]
    log = spark.createDataFrame([("v", 1, "pending", None), ("v", 2, "anchored", "t"), ("v", 3, "pending", None), ("w", 1, "pending", None), ("x", 1, "pending", None), ("x", 2, "failed", None)], "id string, at int, status string, tx string")
    assert {r.id: (r.status, r.tx, r.at) for r in R.settled(log, "id", "at").collect()} == {"v": ("anchored", "t", 2), "w": ("pending", None, 1), "x": ("failed", None, 2)}
    entries = R.watch_entries(spark.createDataFrame([("1", "k71", ""), ("2", "p5", "doe")], "id string, document_number string, surname string"))
    got = R.deactivated(entries, spark.createDataFrame([("2",)], "id string")).orderBy("id").collect()
    assert [(r.document_number, r.surname, r.active) for r in got] == [("K71", None, True), ("P5", "DOE", False)]


def test_stripped(spark):
    rows = spark.sql("select 1 as a, 2 as _b, named_struct('embedding', array(1.0), 'c', named_struct('_d', 1, 'e', 2)) as f, array(named_struct('_g', 1, 'h', 3)) as l, cast(null as struct<x: int, _y: int>) as n")
    assert R.stripped(rows).first().asDict(True) == {"a": 1, "f": {"c": {"e": 2}}, "l": [{"h": 3}], "n": None}


def test_anchors_and_files(spark, tmp_path, monkeypatch):
    ledger = spark.createDataFrame([("v1", 1)], "version_id string, seq int")
    good = "a" * 64
    rows = [("v1", good, "anchor"), ("v2", "x", "anchor"), ("v2", good, "anchor"), ("v1", None, "lend"), ("v9", None, "share"), ("v1", None, "share")]
    arrivals = spark.createDataFrame(rows, "version_id string, sha256 string, action string")
    assert sorted((r.version_id, r.reason) for r in A.bad_anchors(arrivals, ledger).collect()) == [("v1", "action"), ("v1", "exists"), ("v2", "hash"), ("v9", "missing")]
    (tmp_path / "train.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert T.metadata_split(spark, str(tmp_path), "train").count() == 2
    (tmp_path / "p.json").write_text('{"v": 1}')
    (tmp_path / "q.json").write_text('{"v": 2}')
    monkeypatch.setenv("SOME_POLICY", str(tmp_path / "q.json"))
    assert T.config(str(tmp_path / "p.json")) == {"v": 1} and T.config(str(tmp_path / "p.json"), "SOME_POLICY") == {"v": 2}
    report = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    T.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    T.write_markdown(report.coalesce(1), str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.splitlines() == ["| name | n |", "| --- | --- |", "| a b | 1 |", "|  | 2 |"]
    report.createOrReplaceTempView("a_view")
    assert [(r.column_name, r.data_type) for r in T.catalog_columns(spark, "a_view").collect()] == [("name", "string"), ("n", "int")] and T.catalog_columns(spark, "nothing").count() == 0
    assert T.labels_of(report, "n").first().labels == "1, 2"


def test_isolated_rows(spark):
    rows = spark.createDataFrame([("1",), ("x",), ("3",)], "t string")
    got = rows.select(ST.isolated("long", int)("t").alias("r")).select("r.*").collect()
    assert [r.value for r in got] == [1, None, 3] and got[1].error.startswith("ValueError") and got[0].error is None


def test_runs_effects_and_expiry(spark, tmp_path):
    ran = []
    ST.run_every(spark, ran.append, str(tmp_path / "c"), once=True).awaitTermination(60)
    assert len(ran) <= 1
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    rows.write.parquet(str(tmp_path / "versions"))

    def bad(batch, number):
        raise ValueError("no ledger")

    runs = ST.after_commit(lambda: ST.versions_stream(spark, str(tmp_path / "versions"), "id long, t string"), {"screen": lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out{n}")), "anchor": bad}, str(tmp_path / "e"))
    runs["screen"].awaitTermination(60)
    with pytest.raises(Exception, match="no ledger"):
        runs["anchor"].awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out0")).count() == 2
    acts = spark.createDataFrame([("u", "2026-01-01 10:00"), ("u", "2026-01-01 10:10"), ("v", "2026-01-01 12:00"), ("w", "2026-01-01 15:00")], "k string, at string").withColumn("at", F.to_timestamp("at"))
    got = run_stream(spark, acts.withColumn("part", F.lit(0)), lambda s: ST.expired_sessions(s, "k", "at"), tmp_path, "sessions").collect()
    assert {(r.k, str(r.expired), r.actions) for r in got} == {("u", "2026-01-01 10:40:00", 2), ("v", "2026-01-01 12:30:00", 1)}


def test_stale_claims(spark, tmp_path):
    rows = [("a", "2026-01-01 10:00", "processing", 0), ("b", "2026-01-01 10:01", "processing", 0), ("b", "2026-01-01 10:05", "done", 0), ("z", "2026-01-01 11:00", "processing", 1), ("z", "2026-01-01 11:01", "done", 2)]
    claims = spark.createDataFrame(rows, "k string, at string, status string, part int").withColumn("at", F.to_timestamp("at"))
    got = run_stream(spark, claims, lambda s: ST.stale_claims(s.withWatermark("at", "1 minute"), "k", "at"), tmp_path, "claims").collect()
    assert [(r.k, str(r.since)) for r in got] == [("a", "2026-01-01 10:00:00")]


def test_heatmaps(spark):
    p = np.zeros((40, 50))
    p[5:15, 10:20] = 0.9
    p[15, 20] = 0.6
    p[30, 40] = 0.7
    rows = spark.createDataFrame([(p.ravel().tolist(), 50), (None, 5), ([1.0, 2.0, 3.0], 2)], "v array<double>, w int")
    got = [r.s for r in rows.select(HM.heatmap_features("v", "w").alias("s")).collect()]
    assert got[0].n_comps == 2 and abs(got[0].largest_comp_area - 101 / 2000) < 1e-9 and abs(got[0].largest_comp_mean - (90 + 0.6) / 101) < 1e-9
    assert abs(got[0].max_blur7 - 0.9) < 1e-9 and abs(got[0].area_gt80 - 0.05) < 1e-9 and abs(got[0].mean_prob - p.mean()) < 1e-9
    assert all(x is None or np.isnan(x) for r in got[1:] for x in r)
    grey = np.full((80, 80), 100.0)
    grey[:10, :10], grey[70:, 70:] = 250, 10
    b = spark.createDataFrame([(grey.ravel().tolist(), 80)], "v array<double>, w int").select(HM.block_features("v", "w").alias("b")).first().b
    assert (b.local_contrast_p10, b.saturated_blocks, b.dark_blocks, b.min_side) == (0, 1 / 64, 1 / 64, 80)
    quad = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 5D), named_struct('x', 0D, 'y', 5D))"
    q = spark.sql(f"select {quad} as c").select(HM.quad_shape(F.col("c"), F.lit(20.0), F.lit(10.0)).alias("q")).first().q
    assert (q.doc_found, q.coverage, q.skew) == (1.0, 0.25, 1.0)


def test_glyph_decoding(spark):
    def frame(**p):
        out = [0.01] * (len(M.ALPHABET) + 1)
        for g, v in p.items():
            out[0 if g == "blank" else M.ALPHABET.index(g.strip("_")) + 1] = v
        return out

    frames = [frame(A=0.9), frame(A=0.8), frame(blank=0.9), frame(A=0.6, _4=0.5), frame(B=0.9, _8=0.3)]
    rows = spark.createDataFrame([(frames,), (None,)], "f array<array<double>>")
    got = rows.select(M.decoded()("f").alias("g"), M.decoded(2)("f").alias("two"), M.alternatives(F.col("f")[3]).alias("alt")).collect()
    assert got[0].g.text == "AAB" and len(got[0].two.text) == 2 and [a.glyph for a in got[0].alt] == ["A", "4", "0"] and got[1].g.text is None
    zone = F.struct(F.lit(True).alias("valid_format"), F.lit(False).alias("overall_check_digit_valid"), F.create_map(F.lit("a"), F.lit(True), F.lit("b"), F.lit(False), F.lit("passport_number"), F.lit(True)).alias("check_digits"))
    assert spark.range(1).select(M.zone_score(zone, F.lit(0.8)).alias("s")).first().s == 40.0


def test_synthetic_documents(spark):
    """Alike for one seed, sound zones, and every changed field found by the rules."""
    from dossierlake.sources import synthetic as SY

    first, again, other = (SY.documents(spark, 150, seed).collect() for seed in (7, 7, 8))
    assert first == again != other and {r.format for r in first} == {"TD3", "MRVA", "TD1", "TD2"}
    sound = spark.createDataFrame(SY.with_zone_lines(SY.documents(spark, 150, 7), "TD3").collect())
    forged = SY.tampered(sound, 7, 0.8).withColumn("mrz", M.parse_mrz("lines"))
    forged = spark.createDataFrame(forged.collect(), forged.schema)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    none = F.lit(None).cast("string")
    viz = F.struct("document_number", "surname", "given_names", "nationality", F.col("nationality").alias("issuing_state"), "sex", iso("date_of_birth"), iso("date_of_expiry"), iso("date_of_issue"), *[none.alias(c) for c in S.FIELDS[9:]])
    records = forged.select("id", "tampering", "document_type", viz.alias("viz_fields"), "mrz", F.lit(None).cast("map<string,double>").alias("viz_confidences"), F.lit(None).cast("array<date>").alias("printed_dates"), F.lit(None).cast("date").alias("entry_date"), F.lit(True).alias("mrz_read_reliable"), F.lit(None).cast("int").alias("prior_entries"), F.lit(None).cast("int").alias("intended_stay_days"))
    today = F.lit("2026-01-01").cast("date")
    records = records.withColumn("fields", S.merge_fields(F.col("mrz"), F.col("viz_fields"), today)[0])
    got = S.validate(records, today).select("id", "tampering", F.col("mrz.overall_check_digit_valid").alias("sound"), F.exists("checks", lambda c: (c["category"] == "consistency") & (c["status"] != "PASS")).alias("found")).collect()
    assert all(r.sound for r in got) and {r.tampering for r in got} == {None, *SY.TAMPERINGS}
    assert all(r.found == (r.tampering is not None) for r in got)


def test_verdict_is_kept(spark):
    now, runs = [0.0], []
    ask = A.kept_for(30, lambda: runs.append(1) or len(runs), lambda: now[0])
    assert [ask(), ask()] == [1, 1]
    now[0] = 30.0
    assert ask() == 2


def test_rules_are_not_copied_into_each_other(spark):
    row = ("s", "visa", EMPTY, EMPTY, ZONE, {}, None, None, True, None, None, EMPTY)
    for companion in (None, "other"):
        found = S.check_rows(S.validate(spark.createDataFrame([row], RECORD), today(), companion), "screening_id")
        assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_coverage_of_nothing(spark):
    context = spark.createDataFrame([("a", 80.0, False, False, None)], "screening_id string, capture_quality double, mrz_expected boolean, mrz_verified boolean, face_checked boolean")
    none = spark.createDataFrame([], "screening_id string, ordinal int, category string, severity string, code string, message string, source string, status string")
    assert S.risk(none, context).first().assessment_coverage == 100.0
