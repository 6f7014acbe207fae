"""Text rules, dates, zones, similarity and hashes on literal cases."""

import random
import re
from datetime import date
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.functions import dates as D
from dossierlake.functions import fuzzy, hashing, icao
from dossierlake.functions import mrz as M
from dossierlake.functions import patterns as P
from dossierlake.functions import text as X


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(*columns).first()
    return row[0] if len(row) == 1 else row


STATEMENT = "Complainant: Sunita Sharma, d/o Ram Sharma, r/o 12 Lake Road Bhopal.\nPhone 9876543210 or sunita@example.org.\nFIR No. 142 of 2026 under Section 115(2) and BNS 64, dated 12/03/2026.\nFIR/0142/2026 Aadhaar 1234 5678 9012.\nInspector Rao recorded it."


def test_entities(spark):
    e = one(spark, X.entities(F.col("t")), t=STATEMENT)
    assert e.persons == ["Sunita Sharma", "Ram Sharma"]
    assert e.addresses == ["12 Lake Road Bhopal"]
    assert e.phones == ["9876543210"] and e.emails == ["sunita@example.org"] and e.aadhaar == ["1234 5678 9012"]
    assert "FIR No. 142 of 2026" in e.fir_numbers and "FIR/0142/2026" in e.fir_numbers
    assert "Section 115(2)" in e.sections and "BNS 64" in e.sections and e.dates == ["12/03/2026"]


@pytest.mark.parametrize(
    "text, found",
    [
        ("the complainant stated that the accused", []),
        ("informant:\nNo Delay", []),
        ("Complainant Signature", []),
        ("victim Sunita Sharma stated", ["Sunita Sharma"]),
        ("victim: सुनीता शर्मा ने", ["सुनीता शर्मा ने"]),
        ("Complainant Victim Police Station", []),
    ],
)
def test_names_need_capitals_and_two_words(spark, text, found):
    assert one(spark, X.persons(F.col("t")), t=text) == found


def test_redaction(spark):
    text, removed = one(spark, X.redact(F.col("t"), F.array(F.lit("Sunita Sharma"), F.lit("Ram Sharma"), F.lit("12 Lake Road Bhopal"))), t=STATEMENT)
    for gone in ("Sunita", "Ram Sharma", "Lake Road", "9876543210", "sunita@example.org", "1234 5678"):
        assert gone not in text
    for kept in ("FIR No. 142 of 2026", "Section 115(2)", "12/03/2026", "FIR/0142/2026", "Inspector Rao"):
        assert kept in text
    assert removed == text.count(P.MARK) == 6


def test_redaction_is_whole_word(spark):
    text, removed = one(spark, X.redact(F.col("t"), F.array(F.lit("sita"))), t="Sita went to Sitapur from Sitapur")
    assert removed == 1 and text.count("Sitapur") == 2


def test_spans(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 7), (0, 2), (2, 4), (6, 9))])
    assert [tuple(s) for s in one(spark, X.merged(spans))] == [(0, 4), (5, 9)] == X.merge_spans([(5, 7), (0, 2), (2, 4), (6, 9)])
    kept = F.array(F.struct(F.lit(7).alias("start"), F.lit(8).alias("end")))
    assert [tuple(s) for s in one(spark, X.outside(spans, kept))] == [(5, 7), (0, 2), (2, 4)]
    assert one(spark, X.span_finder(P.EMAIL)(F.col("t")), t="é a@b.co")[0].start == 2


@pytest.mark.parametrize("raw, full", [("9876543210", "+919876543210"), ("98765 43210", "+919876543210"), ("+919876543210", "+919876543210"), ("12", None), (None, None)])
def test_mobile(spark, raw, full):
    assert one(spark, X.mobile(F.lit(raw).cast("string"))) == full


def test_small_formats(spark):
    assert one(spark, X.masked_mobile(F.lit("+919876543210"))) == "+91********10"
    assert one(spark, X.evidence_number(F.lit("fir"), F.lit(1000)), X.evidence_number(F.lit("x"), F.lit(7))) == ("FIR-1000", "OTH-007")
    assert one(spark, X.stamp_label(F.lit(""), F.lit("हिन्दी")), X.stamp_label(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == ("RELEASED COPY", "a  |  b")
    assert one(spark, X.page_text(F.array(F.lit("a  b \n\n\n\n c"), F.lit("d")))) == "a b\n\nc\n\nd"
    assert not one(spark, X.is_useful(F.lit("a b c")))


def test_similarity():
    assert fuzzy.ratio("ABC", "ABD") == pytest.approx(66.6667, abs=1e-3)
    assert fuzzy.ratio("", "") == 100
    assert fuzzy.token_sort_ratio("RHEA SINGH", "SINGH RHEA") == 100
    assert fuzzy.token_set_ratio("RHEA KUMARI SINGH", "RHEA SINGH") == 100
    assert fuzzy.partial_ratio("PASSPORT", "MY PASSPORT NO") == 100
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("AB"), n)) for n in rng.integers(0, 8, 2))
        subs = {"".join(c for c, k in zip(a, keep, strict=True) if k) for keep in product((0, 1), repeat=len(a))}
        inside = lambda s, t: all(c in it for it in [iter(t)] for c in s)
        assert fuzzy.common(a, b) == max(len(s) for s in subs if inside(s, b))


def test_codes(spark):
    known = icao.codes()
    assert len(known) >= 249 + 26 and {"IND", "UTO", "D", "XXA", "GBR"} <= known
    assert icao.code_of("IND", known) == "IND" and icao.code_of("Indian", known) == "IND" and icao.code_of("NEPALESEE", known) == "NPL" and icao.code_of("zzzz", known) is None
    assert one(spark, icao.is_code(F.lit("D<<")), icao.is_code(F.lit("QQQ")), icao.to_code(F.lit("french"))) == (True, False, "FRA")


@pytest.mark.parametrize("text", ["14 FEB 2002", "14/02/2002", "2002-02-14", "14.02.2002", "14-02-2002"])
def test_dates(spark, text):
    assert D.read_date(text) == date(2002, 2, 14)
    assert one(spark, D.clean_date(F.lit(text)), D.parse_date(F.lit(text))) == (date(2002, 2, 14), date(2002, 2, 14))


def test_odd_dates(spark):
    assert D.read_date("-03-2019") is None and D.read_date("30/02/2002") is None and D.read_date("I4 FEB 2OO2") == date(2002, 2, 14)
    today = F.lit("2026-09-16").cast("date")
    assert one(spark, D.mrz_date(F.lit("990708"), "birth", today), D.mrz_date(F.lit("350918"), "expiry", today)) == (date(1999, 7, 8), date(2035, 9, 18))
    assert one(spark, D.age(F.lit("2008-02-29").cast("date"), F.lit("2026-02-28").cast("date"))) == 17
    assert one(spark, D.add_years(F.lit("2008-02-29").cast("date"), F.lit(1))) == date(2009, 2, 28)
    assert one(spark, D.printed_dates(F.lit("born 14 FEB 2002, until 2030-01-01"))) == ["2002-02-14", "2030-01-01"]


def test_clean_dates_and_what_goes_to_python(spark):
    rng = random.Random(13)
    texts = [f"{rng.choice((1899, 1900, 2000, 2001, 2100, 2101, 3112))}-{rng.randrange(20):02}-{rng.randrange(35):02}{rng.choice(('', '', ' ', chr(10)))}" for _ in range(400)]
    texts += ["".join(rng.choice("0OoDlIı|S 1/-.FEBMAY٣ßn") for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["1 FEB 2OO2", "ID FEB 2002", "3112-19-50", "no date", "20020214", "ß1 FEB 2002", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    got = {r.i: (r.may, r.parsed, r.read) for r in D.with_dates(rows, read=F.col("t")).select("i", "read", D._may_read(F.col("t")).alias("may"), D.parse_date("t").alias("parsed")).collect()}
    for i, t in enumerate(texts):
        want = D.read_date(t) if re.search("[0-9A-Za-z]", t) else None
        assert got[i][1:] == (want, want), t
        assert got[i][0] or want is None, t
    assert sum(may for may, *_ in got.values()) < len(texts) and not got[texts.index("no date")][0]


@pytest.mark.parametrize("now", ["2026-09-16", "2000-02-29", "1996-01-01"])
def test_zone_dates_equal_a_search_of_years(spark, now):
    rng, today = random.Random(5), date.fromisoformat(now)
    texts = [f"{rng.randrange(100):02}{rng.randrange(14):02}{rng.randrange(33):02}" for _ in range(600)] + ["000229", "960101", "960102", "260916", "260917", "76916", "7609160", "8O0101", "", None]

    def day(year, t):
        return D.calendar(year, int(t[2:4]), int(t[4:]))

    def want(t):
        if not t or not re.fullmatch("[0-9]{6}", t):
            return None, None
        year = int(t[:2]) + (2000 if int(t[:2]) + 2000 <= today.year else 1900)
        birth = day(year, t)
        expiry = [d for c in (-100, 0, 100) if (d := day(today.year // 100 * 100 + c + int(t[:2]), t))]
        return day(year - 100, t) if birth and birth > today else birth, min(expiry, key=lambda d: (abs(d - today), d), default=None)

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    on = F.lit(now).cast("date")
    got = rows.select("t", D.mrz_date(F.col("t"), "birth", on).alias("birth"), D.mrz_date(F.col("t"), "expiry", on).alias("expiry")).collect()
    assert len(got) == len(texts) and all((r.birth, r.expiry) == want(r.t) for r in got)


HOLDER = {"issuing_state": "UTO", "document_number": "K71M4P829", "nationality": "UTO", "date_of_birth": "020214", "sex": "M", "date_of_expiry": "350918", "surname": "GUPTA", "given_names": "AKSHIT"}


def zone(spark, fmt):
    code = {"TD1": "I", "MRVA": "V", "MRVB": "V"}.get(fmt, "P")
    return one(spark, M.generate(fmt, F.lit(code), *[F.lit(HOLDER[k]) for k in HOLDER]))


def test_check_digits(spark):
    assert one(spark, *[M.check_digit(F.lit(x)) for x in ("K71M4P829", "020214", "350918")]) == ("4", "7", "0")


@pytest.mark.parametrize("fmt", list(M.SHAPES))
def test_zone_round_trip(spark, fmt):
    lines = zone(spark, fmt)
    assert [len(x) for x in lines] == [M.SHAPES[fmt][1]] * M.SHAPES[fmt][0]
    z = M.read_zone(lines)
    assert z["format"] == fmt and z["overall_check_digit_valid"] and not z["repair_applied"]
    assert all(z[k] == v for k, v in HOLDER.items())
    own = F.array(*map(F.lit, lines))
    assert one(spark, M.detect_format(M.normal_lines(own))) == fmt
    checks = one(spark, M.field_checks(M.framed(own, fmt), fmt))
    assert all(checks) and one(spark, M.composite_check(M.framed(own, fmt), fmt)) in (True, None)


def test_zones_of_a_table(spark):
    """Sound zones without Python and the others with it: the same rows."""
    sound = [zone(spark, f) for f in M.SHAPES]
    lines = sound + [[x.lower() for x in sound[0]], [sound[0][0], sound[0][1][:42] + "Q8"], [sound[1][0]], [], None, ["x"] + sound[4], [sound[2][0].replace("V", "P", 1), sound[2][1]]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, lines array<string>")
    got = {r.i: r.zone.asDict(True) for r in M.with_zone(rows, "lines").collect()}
    for i, x in enumerate(lines):
        want = M.read_zone(x)
        assert {k: v for k, v in got[i].items() if v is not None} == {k: v for k, v in want.items() if v is not None}, x
    native = rows.where("i < 6").select(M.sound_zone(F.col("lines")).isNotNull().alias("s")).collect()
    assert all(r.s for r in native)


def test_zone_repairs(spark):
    lines = zone(spark, "TD3")
    cut = [lines[0], lines[1][:42] + "Q8"]
    z = M.read_zone(cut)
    assert z["repair_applied"] and not z["raw_overall_check_digit_valid"]
    forged = [lines[0], lines[1].replace("0202147", "990214" + M.digit_of("990214"))]
    z = M.read_zone(forged)
    assert z["check_digits"]["date_of_birth"] and not z["check_digits"]["composite"] and not z["overall_check_digit_valid"]
    z = M.read_zone([lines[0].replace("GUPTA", "GUP7A"), lines[1].replace("020214", "O2O214")])
    assert z["overall_check_digit_valid"] and z["surname"] == "GUPTA" and z["date_of_birth"] == "020214"
    row = one(spark, M.parse_mrz(F.array(*map(F.lit, lines))))
    assert row.overall_check_digit_valid and row.check_digits["composite"]


def test_fixed_length_path():
    rng = np.random.default_rng(7)
    for _ in range(60):
        frames, kinds, n = int(rng.integers(1, 6)), 3, int(rng.integers(0, 4))
        p = np.log(rng.dirichlet(np.ones(kinds), frames))
        best = max((sum(p[t, c] for t, c in enumerate(path)) for path in product(range(kinds), repeat=frames) if len(M.greedy_glyphs(list(path))) == n), default=-np.inf)
        labels, score = M.fixed_length_path(p, n)
        assert score == pytest.approx(best) if np.isfinite(best) else not np.isfinite(score)
        if np.isfinite(best):
            assert len(labels) == n


def test_canonical_json(spark):
    assert one(spark, hashing.canonical(F.lit('{"b":1,"a":{"d":[2,1],"c":"x"}}'))) == '{"a":{"c":"x","d":[2,1]},"b":1}'
    assert hashing.record_digest({"b": 1, "a": "é", "hash": "x"}) == hashing.record_digest({"a": "é", "b": 1})
    assert one(spark, hashing.payload(F.lit("p"), F.lit(None).cast("string"), F.lit("x"))) == "p||x"
