"""Capture quality, printed-zone values and document types, from measured columns.

Pixels are measured elsewhere; these rules begin at their figures.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.fuzzy import fuzz_ratio
from ..functions.icao import to_code

# Penalties, limits, document shapes and names of editing programs.
KINDS = ["passport", "visa", "national_id", "driving_licence", "residence_permit"]
ASPECT = {"passport": 1.42, "visa": 1.5, "national_id": 1.586, "driving_licence": 1.586, "residence_permit": 1.586}
EDITORS = [
    "photoshop", "gimp", "paint.net", "pixelmator", "affinity", "canva", "snapseed", "picsart", "lightroom", "photopea", "fotor", "inkscape",
    "illustrator", "corel", "krita", "paintshop", "facetune", "remini", "meitu",
]
SEXES = {"M": "M", "MALE": "M", "F": "F", "FEMALE": "F", "X": "X"}
DATE_FIELDS = ("date_of_birth", "date_of_issue", "date_of_expiry", "valid_from")
GATE_AUC = 0.75


def _above(x: Column, low: float) -> Column:
    return F.greatest(F.lit(0.0), x - low)


def quality_score(blur: Column, brightness: Column, contrast: Column, glare: Column, noise: Column) -> Column:
    """100 less five penalties, each with a limit."""
    penalties = (
        (_above(60.0 - F.least(F.lit(60.0), blur), 0.0) * 0.55, 40.0),
        (F.abs(brightness - 145.0) * 0.17, 25.0),
        (_above(18.0 - contrast, 0.0), 20.0),
        (glare * 70.0, 20.0),
        (_above(noise, 7.0) * 0.45, 10.0),
    )
    score = F.lit(100.0)
    for amount, most in penalties:
        score = score - F.least(F.lit(most), amount)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)


def _listed(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(when, text) for when, text in rules]), lambda x: x.isNotNull())


def quality_warnings(blur: Column, brightness: Column, contrast: Column, glare: Column, noise: Column) -> Column:
    return _listed((blur < 35, "blur"), (brightness < 55, "dark"), (brightness > 225, "overexposed"), (glare > 0.02, "glare"), (contrast < 18, "low contrast"), (noise > 18, "noise"))


def capture_tips(blur: Column, brightness: Column, glare: Column, zone_glare: Column, coverage: Column, skew: Column, short_side: Column, success: Column) -> Column:
    """What to do for a better capture; advice to recapture comes first."""
    return _listed(
        (success < 0.5, "recapture"), (blur < 35, "hold steady"), (brightness < 60, "more light"), (brightness > 220, "less light"), (glare > 0.01, "tilt against glare"),
        (zone_glare > 0.05, "glare on the zone"), (coverage < 0.3, "move closer"), (skew > 1.12, "hold parallel"), (short_side < 600, "higher resolution"),
    )


def gated(score: Column, auc: Column) -> Column:
    """An advisory score, ignored if its model was not good enough."""
    return F.when(auc >= GATE_AUC, score)


def fit_aggregator(rows: DataFrame, features: list[str], label: str) -> tuple[VectorAssembler, object]:
    """A logistic model with classes weighted to equal shares, fitted on the cluster."""
    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    weighted = rows.withColumn("weight", F.when(F.col(label), 0.5 / share).otherwise(0.5 / (1 - share))).withColumn("target", F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return assembler, LogisticRegression(labelCol="target", weightCol="weight", maxIter=50).fit(assembler.transform(weighted))


def metadata_findings(software: Column, xmp: Column, modified: Column, taken: Column, has_exif: Column, fmt: Column) -> Column:
    """Codes of what an image's metadata tells."""
    low = F.lower(F.coalesce(software, F.lit("")))
    edited = F.exists(F.array(*map(F.lit, EDITORS)), lambda e: F.contains(low, e))
    history = F.contains(xmp, F.lit("photoshop:History")) | F.contains(xmp, F.lit('stEvt:action="saved"'))
    return _listed((edited, "editing_software"), (history, "edit_history"), (F.substring(modified, 1, 10) != F.substring(taken, 1, 10), "timestamp_mismatch"), (~has_exif & fmt.isin("JPEG", "HEIC", "MPO"), "metadata_stripped"))


def printed_value(field: str, raw: Column) -> Column:
    """A printed value in its canonical form, as text; null if unreadable."""
    v = F.regexp_replace(F.trim(F.regexp_replace(F.translate(F.upper(raw), "|", "I"), r"\s+", " ")), r"^[ :;,.\-]+|[ :;,.\-]+$", "")
    v = F.nullif(v, F.lit(""))
    token = F.regexp_replace(v, "[^A-Z0-9]", "")
    if field in DATE_FIELDS:
        return F.date_format(D.parse_date(v), "yyyy-MM-dd")
    if field == "sex":
        return F.create_map(*[F.lit(x) for kv in SEXES.items() for x in kv])[token]
    if field in ("nationality", "issuing_state"):
        return F.coalesce(to_code(v), v)
    if field in ("document_number", "passport_number"):
        return F.nullif(token, F.lit(""))
    if field == "duration_of_stay_days":
        digits = F.translate(v, "O", "0")
        n = F.nullif(F.regexp_extract(digits, r"(\d{1,4})", 1), F.lit("")).try_cast("int")
        unit = F.regexp_extract(digits, r"\d{1,4}\s*(DAY|M0NTH|YEAR)", 1)
        return (n * F.when(unit == "M0NTH", 30).when(unit == "YEAR", 365).otherwise(1)).cast("string")
    if field == "number_of_entries":
        letters = F.regexp_replace(v, "[^A-Z]", "")
        known = F.coalesce(*[F.when(fuzz_ratio(F.lit(o), letters) >= 75, o) for o in ("SINGLE", "DOUBLE", "MULTIPLE")])
        return F.coalesce(known, F.nullif(F.regexp_extract(v, r"\d+", 0), F.lit("")))
    return v


def is_plausible(field: str, value: Column) -> Column:
    if field == "sex":
        return value.isin("M", "F", "X")
    if field in ("document_number", "passport_number"):
        return F.length(value).between(5, 20) & (F.regexp_count(value, F.lit("[0-9]")) >= 2)
    if field in ("surname", "given_names", "name"):
        bare = F.length(F.replace(value, F.lit(" "), F.lit("")))
        return F.regexp_count(F.upper(value), F.lit("[A-Z]")) >= F.greatest(F.lit(1), F.floor(bare * 0.85))
    if field == "duration_of_stay_days":
        return value.try_cast("int").between(1, 3999)
    if field == "nationality":
        return F.length(value) == 3
    return value.isNotNull()


def dates_without_labels(dates: Column) -> Column:
    """Unlabelled dates by chronology: the first is the birth, the last the expiry, a third the issue."""
    d = F.array_sort(F.array_distinct(dates))
    n = F.size(d)
    return F.struct(F.when(n >= 1, F.get(d, F.lit(0))).alias("date_of_birth"), F.when(n == 3, F.get(d, F.lit(1))).alias("date_of_issue"), F.when(n >= 2, F.try_element_at(d, F.lit(-1))).alias("date_of_expiry"))


def number_without_label(words: Column) -> Column:
    """The longest word of 8 to 20 letters and digits with at least four digits; of ties the first."""
    tokens = F.transform(words, lambda w: F.regexp_replace(F.upper(w), "[^A-Z0-9]", ""))
    fit = F.filter(tokens, lambda t: F.length(t).between(8, 20) & (F.regexp_count(t, F.lit("[0-9]")) >= 4) & D.clean_date(t).isNull())
    return F.array_max(F.transform(fit, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]


def document_type(mrz: Column, keywords: Column, hint: Column | None = None, aspect: Column | None = None) -> Column:
    """The type with most evidence from zone, printed words, choice and shape; of ties the first of KINDS."""
    valid = F.coalesce(mrz["valid_format"], F.lit(False))
    code, fmt = F.coalesce(mrz["document_code"], F.lit("")), F.coalesce(mrz["format"], F.lit(""))
    card = valid & fmt.isin("TD1", "TD2")
    permit = F.substring(code, 2, 1).isin("R", "P") | code.isin("AR", "IR")
    zone = {
        "passport": F.when(valid & (fmt == "TD3") & F.startswith(code, F.lit("P")), 3.0),
        "visa": F.when(valid & fmt.isin("MRVA", "MRVB"), 3.0),
        "national_id": F.when(card, F.when(permit, 0.4).otherwise(2.9)),
        "residence_permit": F.when(card, F.when(permit, 2.9).otherwise(0.4)),
        "driving_licence": F.when(~valid, 0.25),
    }
    scores = []
    for i, kind in enumerate(KINDS):
        word = F.coalesce(F.try_element_at(keywords, F.lit(kind)), F.lit(0.0))
        printed = F.when(word >= 0.85, 1.5 * word).when(word >= 0.7, 0.8 * word).otherwise(0.0)
        chosen = F.when(hint == kind, 2.0).otherwise(0.0) if hint is not None else F.lit(0.0)
        shape = F.coalesce(_above(0.5 - F.abs(aspect - ASPECT[kind]) * 4, 0.0), F.lit(0.0)) if aspect is not None else F.lit(0.0)
        scores.append(F.struct((F.coalesce(zone[kind], F.lit(0.0)) + printed + chosen + shape).alias("s"), F.lit(-i).alias("i"), F.lit(kind).alias("k")))
    return F.array_max(F.array(*scores))["k"]


def covering_boxes(items: DataFrame, spans: str = "spans", pad: float = 0.35) -> DataFrame:
    """Rectangles over spans of text items (x, y, width, height, text), wider than the estimate."""
    s = items.withColumn("s", F.explode(spans))
    each = F.when(F.length("text") > 0, F.col("width") / F.length("text")).otherwise(0.0)
    slack = F.greatest(F.col("height") * pad, each * 1.5)
    x = F.when(each > 0, F.col("x") + F.col("s.start") * each).otherwise(F.col("x"))
    w = F.when(each > 0, (F.col("s.end") - F.col("s.start")) * each).otherwise(F.col("width"))
    top = F.greatest(F.lit(0.0), F.col("y") - F.col("height") * 0.25)
    return s.select(*[c for c in items.columns if c not in ("x", "y", "width", "height", "text", spans)], F.greatest(F.lit(0.0), x - slack).alias("x"), top.alias("y"), (w + slack * 2).alias("width"), (F.col("height") * 1.5).alias("height"))


def extraction_view(mrz: Column, viz: Column) -> Column:
    """The older field view: zone values as they stand if its digits hold, else print; with warnings."""
    sound = F.coalesce(mrz["overall_check_digit_valid"], F.lit(False)) & F.coalesce(mrz["valid_format"], F.lit(False))
    names = ("document_number", "nationality", "date_of_birth", "sex", "date_of_expiry", "surname", "given_names")
    warnings = _listed(
        (~F.coalesce(mrz["valid_format"], F.lit(False)), "zone unreadable"), (F.coalesce(mrz["valid_format"], F.lit(False)) & ~sound, "check digits failed"), (sound & (F.size(F.coalesce(mrz["repairs"], F.array().cast("array<string>"))) > 0), "zone repaired"),
    )
    return F.struct(*[F.when(sound, mrz[n]).otherwise(viz[n]).alias(n) for n in names], warnings.alias("warnings"))
