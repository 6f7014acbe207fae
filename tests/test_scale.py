"""Steps whose cost must not outgrow their input."""

import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dossierlake import plans
from dossierlake.functions import patterns as P
from dossierlake.functions import text as X
from dossierlake.functions.fuzzy import token_sort_ratio
from dossierlake.operators import audit as A
from dossierlake.operators import layout as L
from dossierlake.operators import queues as Q
from dossierlake.operators import screening as S
from dossierlake.operators import vectors as V

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_is_a_stream(spark):
    rows = spark.range(25).select((25 - F.col("id")).alias("id"), F.col("id").cast("string").alias("body"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        log = A.build_chain(rows)
        got = log.orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.prev_hash for r in got] == [A.GENESIS, *(r.entry_hash for r in got[:-1])]
    # No group that holds the whole log.
    assert "FlatMapGroups" not in plan(log)


PERSON = "screening_id string, document_number string, passport_number string, issuing_state string, surname string, given_names string, date_of_birth string"
ENTRY = "id string, active boolean, list_type string, reason string, document_number string, issuing_state string, surname string, given_names string, date_of_birth string"


def test_names_of_a_date_are_compared_once(spark, monkeypatch):
    """Forty bearers of two names meet thirty entries of two names: four comparisons, not 1200."""
    seen = spark.sparkContext.accumulator(0)
    real = S.fuzz_ratio

    def counted(a, b):
        @F.pandas_udf("string")
        def one(x: pd.Series) -> pd.Series:
            seen.add(len(x))
            return x

        return real(one(a), b)

    monkeypatch.setattr(S, "fuzz_ratio", counted)
    people = spark.createDataFrame([(f"p{i}", None, None, None, ("SINGH", "SINHG")[i % 2], None if i % 2 else "RHEA", "1999-07-08") for i in range(40)], PERSON)
    listed = spark.createDataFrame([(f"w{i}", True, "WANTED", "r", None, None, ("SINGH", "ROYAL")[i % 2], None if i % 2 else "RHEA", "1999-07-08") for i in range(30)], ENTRY)
    got = S.watchlist_hits(people, listed).collect()
    assert {(r.screening_id, r.entry_id, r.score) for r in got} == {(f"p{i}", f"w{j}", 100.0) for i in range(0, 40, 2) for j in range(0, 30, 2)} and len(got) == 300
    assert seen.value <= 4


def test_pairs_of_other_dates_need_no_names(spark):
    """Nulls, names on one date and a face join given as a function, against the rule itself."""
    cols = "screening_id string, seen_at long, document_number string, document_type string, surname string, given_names string, date_of_birth string, nationality string"
    days, names = ("1990-01-01", "1991-01-01", None), ("KHAN", "ROY", None)
    rows = [(f"s{i}", i, f"N{i % 4}", "passport", names[i % 3], None, days[i // 3 % 3], "IND" if i % 5 else "NPL") for i in range(54)]
    base = spark.createDataFrame(rows, cols)
    found = S.identity_conflicts(base, base.withColumn("id", F.col("screening_id")), lambda a, b, more: a.crossJoin(b).where(S.same_keys(more) if more else F.lit(True)).withColumn("similarity", F.lit(0.9)))
    got = sorted((r.screening_id, r.previous, r.pattern) for r in found.collect())
    want = []
    for a in rows:
        for b in rows:
            if b[1] >= a[1]:
                continue
            near = token_sort_ratio(a[4] or "", b[4] or "")
            same, apart = a[6] is not None and a[6] == b[6] and bool(a[4]) and near >= 90, a[6] != b[6] or near < 80
            pair = (a[0], b[0])
            want += [(*pair, "document_shared_by_different_identities")] * (a[2] == b[2] and not same and apart)
            want += [(*pair, "same_biographics_different_nationality_documents")] * (same and a[2] != b[2] and a[7] != b[7])
            want += [(*pair, "same_face_different_identity")] * (not same and apart)
    assert got == sorted(want)


RECORD = "screening_id string, seen_at long, document_number string, document_type string, surname string, given_names string, date_of_birth string, nationality string"


def test_pairs_are_not_shuffled(spark):
    """Pairs grow with the square of a group: nothing between their join and the result may write or sort them."""
    rows = [(f"s{i}", i, "N1", "passport", ("KHAN", "ROY")[i % 2], None, "1990-01-01", "IND") for i in range(40)]
    base = spark.createDataFrame(rows, RECORD)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are no longer small
    try:
        found = S.identity_conflicts(base, base.withColumn("id", F.col("screening_id")), lambda a, b, more: a.join(b, S.same_keys([("document_number", "o_document_number"), *more])).withColumn("similarity", F.lit(0.9)))
        above, joins = [], 0
        for line in plan(found).splitlines():
            depth = re.search("[A-Z]", line).start()
            above = [x for x in above if x[0] < depth]
            if "Join" in line and "seen_at" in line:
                joins += 1
                assert not [x for _, x in above if re.search("Exchange|Sort |Join", x)]
            above.append((depth, line))
        got = found.groupBy("pattern").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert joins == 3
    assert {tuple(r) for r in got} == {("document_shared_by_different_identities", 400), ("same_face_different_identity", 400)}


@pytest.mark.parametrize("hot, cuts, block", [(10_000, 3, 10_000), (5, 3, 100), (5, 2, 4)])
def test_hot_groups_are_cut_into_blocks(spark, monkeypatch, hot, cuts, block):
    """Each pair once, however groups are cut; rows of groups that are not hot are not copied."""
    for name, value in (("HOT", hot), ("CUTS", cuts), ("BLOCK", block)):
        monkeypatch.setattr(S, name, value)
    left = [(f"a{i}", "hot" if i % 3 else f"k{i}") for i in range(45)] + [("none", None)]
    right = [(f"b{i}", "hot" if i % 2 else f"k{i}") for i in range(24)] + [("none", None)]
    a, b = spark.createDataFrame(left, "screening_id string, x string"), spark.createDataFrame(right, "previous string, y string")
    joined = S.dealt_join(a, b, [("x", "y")])
    assert sorted((r.screening_id, r.previous) for r in joined.collect()) == sorted((p, q) for p, x in left for q, y in right if x == y and x is not None)
    dealt = max(cuts, -(-12 // block)) if hot < 12 else 1
    copies = spark.createDataFrame([(f"a{i}", "hot") for i in range(30)] + [("cold", "k0")], "screening_id string, x string")
    tiles = S.tiled(copies, S.hot_groups(copies, b, [("x", "y")]), ["x"], "screening_id", "_pa", 0, 4).groupBy("screening_id").agg(F.countDistinct("_pa").alias("n"), F.count("*").alias("m")).collect()
    assert {r.n for r in tiles if r.screening_id != "cold"} == {r.m for r in tiles if r.screening_id != "cold"} == {dealt}
    assert [(r.n, r.m) for r in tiles if r.screening_id == "cold"] == [(1, 1)]


def test_zones_stay_off_the_driver(spark):
    region = spark.createDataFrame([(k, k, 10, 10, 90, 90, 0.0) for k in range(4)], "screening_id long, region_id long, x0 int, y0 int, x1 int, y1 int, ink_ratio double")
    zones = spark.createDataFrame([(k, "portrait", 0, 0, 800, 800) for k in range(4)], "screening_id long, zone string, zx0 int, zy0 int, zx1 int, zy1 int")
    out = L.attributed(region, zones)
    assert "BroadcastExchange" not in plan(out) and "BroadcastHashJoin" not in plan(out)
    assert {r.label for r in out.collect()} == {"photo_replacement"}


def test_an_event_looks_at_no_other_lease():
    """A lease whose end has not come costs an event nothing; one given anew ends at its new end."""

    class Counted(dict):
        looked = 0

        def items(self):
            Counted.looked += len(self)
            return super().items()

        def get(self, *a):
            Counted.looked += 1
            return super().get(*a)

    queue = Q.Queue(Q.Memory(), 10_000, 3)
    queue.store.held = Counted()
    for k in range(500):
        queue.handle(k, "job", f"j{k}", None, 0)
        queue.handle(k, "ask", None, "w", 1)
    assert Counted.looked < 1000
    assert queue.handle(600, "failed", "j0", "w", 0) == [(600, "returned", "j0", "w", 1, None)]
    assert queue.handle(700, "ask", None, "v", 1) == [(700, "claimed", "j0", "v", 2, 10_700)]
    assert queue.expire(10_002) == [(10_001, "returned", "j1", "w", 1, None), (10_002, "returned", "j2", "w", 1, None)]
    assert [x[2] for x in queue.expire(20_000)] == [*(f"j{k}" for k in range(3, 500)), "j0"]


@pytest.mark.parametrize("name", ["printed_labels", "zone_round_trip", "zones_of_all_formats"])
def test_a_small_file_keeps_all_cores_busy(spark, name):
    """Customers are one file and so one task, unless they are dealt out before the costly step."""
    shown = plan(plans.QUERIES[name](spark, FOLDER))
    assert "RoundRobinPartitioning" in shown


def test_blocks_of_single_floats_take_half(spark):
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("v"))
    size = lambda df: V.blocks_of(df, "id", "v").agg(F.sum(F.length("v"))).first()[0]
    assert 2 * size(rows) == size(rows.withColumn("v", F.col("v").cast("array<double>"))) == 40 * 8 * 8


def test_a_pattern_is_tried_only_where_it_may_begin(spark):
    """Each pattern as it is, on letters whose case folds oddly and on pieces of matches in any order; then a long run without a sign."""
    rng = random.Random(9)
    pieces = [*" \n.-+_@/;:xX9éāſıİKश", "ı", "r/o ", "R/O", "address", "ſ/o Ab Cd", "son of ", "complainant: ", "ınformant ", "İnformant Ab", "victim", "Asha Verma", "+91 ", "91-", "9876543210", "1234 5678 9012", "1234", "FIR No. ", "fır", "12/2021", "Section 5(2)", "ſection 7", "IPC 302", "bns", "5/6/2021", "2021-03-04", "a@b.org", "x.y@", "@z.com", ".co-", "%", "\U0001f600"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))),) for _ in range(4000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string").cache()
    t = F.col("t")
    for p in (P.PHONE, P.EMAIL, P.AADHAAR, P.FIR_NUMBER, P.SECTION, P.DATE, P.ROLE_NAME, P.RELATION_NAME, P.ADDRESS):
        plain = F.regexp_extract_all(t, F.lit(p.replace(r"\b", P._EDGE)), F.lit(0))
        assert df.where(~F.regexp_extract_all(t, F.lit(P.java(p)), F.lit(0)).eqNullSafe(plain)).count() == 0 < df.where(F.size(plain) > 0).count()
        assert df.where(X.matches(t, p) != F.array_distinct(F.coalesce(plain, F.array().cast("array<string>")))).count() == 0
        assert p == P.EMAIL or P.java(p) != p.replace(r"\b", P._EDGE)
    # Tried at each of its edges, this run would take 10^11 steps.
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a."), 300_000), F.lit(" x@y.org "), F.repeat(F.lit("b."), 300_000)).alias("t"))
    start = time.monotonic()
    assert long.select(X.matches(F.col("t"), P.EMAIL)).first()[0] == ["x@y.org"]
    assert time.monotonic() - start < 30


def test_rules_run_compiled(spark, capsys):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = plans.QUERIES["validation_checks"](spark, FOLDER)
        shown = found._jdf.queryExecution().optimizedPlan().toString()
        capsys.readouterr()
        found.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # No lambda goes over the rules, no array goes to Python, and no method is too long for the JVM to compile.
    assert "filter(concat(" not in shown and not re.search(r"_read\w*\(array\(", shown)
    assert sizes and max(sizes) <= 8000
