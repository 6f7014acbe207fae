"""Made-up identities and documents, field by field, from a seed.

Every value is a hash of the row's number and the seed, so that any part of a
table can be made anywhere, again and alike, without a generator's state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mrz as M

SURNAMES = ("GUPTA", "MEHRA", "SILVA", "OKORO", "TANAKA", "NOVAK", "HANSEN", "ROSSI", "DUBOIS", "GARCIA", "KOWALSKI", "VAN DYK")
GIVEN = ("ASHA", "LEO", "MIRA", "JONAS", "AIKO", "PAULO", "NIA", "IVAN", "CLARA", "OMAR", "EVA MARIA", "JOHN PAUL")
STATES = ("IND", "BRA", "NGA", "JPN", "CZE", "NOR", "ITA", "FRA", "ESP", "POL", "ZAF", "USA")
#: Kinds of documents with the format of their zone, and how many years they hold.
DOCUMENTS = (("passport", "TD3", 10), ("visa", "MRVA", 1), ("national_id", "TD1", 10), ("residence_permit", "TD2", 5))
#: What a forger changes in print; the zone stays as it was.
TAMPERINGS = ("birth_date", "expiry_date", "document_number", "surname", "sex", "nationality")


def _draw(seed: int, what: int, options: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(what)), F.lit(options)).cast("int")


def _pick(values: tuple, seed: int, what: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _draw(seed, what, len(values)) + 1)


def documents(spark: SparkSession, n: int, seed: int = 0, first_day: str = "2026-01-01") -> DataFrame:
    """``n`` sound documents: id, document_type, format of the zone, and fields."""
    day = F.lit(first_day).cast("date")
    rows = spark.range(n).withColumn("kind", _draw(seed, 1, len(DOCUMENTS)))
    by = lambda i: F.element_at(F.array(*[F.lit(d[i]) for d in DOCUMENTS]), F.col("kind") + 1)
    letters = F.concat(*[F.chr(65 + _draw(seed, 10 + i, 26)) for i in range(2)])
    rows = rows.select(
        "id", "kind", by(0).alias("document_type"), by(1).alias("format"), _pick(SURNAMES, seed, 2).alias("surname"), _pick(GIVEN, seed, 3).alias("given_names"), _pick(STATES, seed, 4).alias("nationality"),
        _pick(("M", "F"), seed, 5).alias("sex"), F.date_sub(day, 18 * 366 + _draw(seed, 6, 15_000)).alias("date_of_birth"), F.date_sub(day, _draw(seed, 7, 300)).alias("date_of_issue"),
        F.concat(letters, F.lpad(_draw(seed, 8, 10_000_000).cast("string"), 7, "0")).alias("document_number"), by(2).alias("years"),
    )
    rows = rows.withColumn("date_of_expiry", F.add_months("date_of_issue", F.col("years") * 12))
    return rows.drop("kind", "years")


def with_zone_lines(rows: DataFrame, fmt: str) -> DataFrame:
    """The rows of one format with the ``lines`` of their zone."""
    short = lambda c: F.date_format(c, "yyMMdd")
    code = {"TD3": "P", "MRVA": "V", "TD1": "I", "TD2": "AC"}[fmt]
    zone = M.generate(fmt, F.lit(code), F.col("nationality"), F.col("document_number"), F.col("nationality"), short("date_of_birth"), F.col("sex"), short("date_of_expiry"), F.col("surname"), F.col("given_names"))
    return rows.where(F.col("format") == fmt).withColumn("lines", zone)


def tampered(rows: DataFrame, seed: int = 0, share: float = 0.5) -> DataFrame:
    """``rows`` of ``documents`` with ``tampering`` (null: none); about ``share`` of them have one printed field changed."""
    kind = F.when(_draw(seed, 20, 1000) < int(1000 * share), _pick(TAMPERINGS, seed, 21))
    rows = rows.withColumn("tampering", kind)
    other = lambda values, what: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.array_position(F.array(*map(F.lit, values)), F.col(what)).cast("int"), F.lit(len(values))) + 1)
    digit = F.substring("document_number", 9, 1).cast("int")
    changes = {
        "birth_date": ("date_of_birth", F.date_add("date_of_birth", 1 + _draw(seed, 22, 900))), "expiry_date": ("date_of_expiry", F.add_months("date_of_expiry", 12)),
        "document_number": ("document_number", F.concat(F.substring("document_number", 1, 8), ((digit + 3) % 10).cast("string"))), "surname": ("surname", other(SURNAMES, "surname")),
        "sex": ("sex", F.when(F.col("sex") == "M", "F").otherwise("M")), "nationality": ("nationality", other(STATES, "nationality")),
    }
    for name, (column, value) in changes.items():
        rows = rows.withColumn(column, F.when(F.col("tampering") == name, value).otherwise(F.col(column)))
    return rows
