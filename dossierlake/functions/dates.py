"""Printed and machine-readable dates.

Clean printed forms are parsed by built-in functions; forms with glyph confusions
go through one Arrow-batched function.  ``today`` is always a parameter.
"""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_function

# Fixed values.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
LETTER_FOR = {"0": "O", "1": "I", "5": "S", "8": "B", "6": "G", "4": "A"}
DIGIT_FOR = {"O": "0", "o": "0", "D": "0", "Q": "0", "I": "1", "l": "1", "L": "1", "|": "1", "S": "5", "B": "8", "Z": "2", "G": "6"}
YEARS = (1900, 2100)

_GLYPH = "[0-9OIDQSLBZG]"
#: What ``read_date`` may read: it needs five digits or glyphs at least. Other letters than ASCII may become glyphs in upper case.
_MAY_READ = r"(?:[0-9OIDQSLBZGoidqslbzg|][^0-9OIDQSLBZGoidqslbzg|]*){5}|[^\x00-\x7F]"
_NAMED = re.compile(rf"(\d{{1,2}}|{_GLYPH}{{2}})\s*[ \-/.]?\s*([A-Z0-9]{{3}})[A-Z]*\s*[ \-/.]?\s*(\d{{4}}|{_GLYPH}{{4}})")
_NUMERIC = (
    (re.compile(r"(?<!\d)(\d{4})[\-/. ](\d{1,2})[\-/. ](\d{1,2})(?!\d)"), (1, 2, 3)),
    (re.compile(r"(?<!\d)(\d{1,2})[\-/. ](\d{1,2})[\-/. ](\d{4})(?!\d)"), (3, 2, 1)),
    (re.compile(r"^(\d{4})(\d{2})(\d{2})$"), (1, 2, 3)),
    (re.compile(r"^(\d{2})(\d{2})(\d{4})$"), (3, 2, 1)),
)


def calendar(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day) if YEARS[0] <= year <= YEARS[1] else None
    except ValueError:
        return None


def read_date(text: str | None) -> date | None:
    """The first readable date: a named month first, then numeric forms, then eight digits."""
    value = " ".join((text or "").upper().split())
    named = _NAMED.search(value)
    if named:
        day, month, year = named.groups()
        month = month.translate(str.maketrans(LETTER_FOR))
        day, year = (x.translate(str.maketrans(DIGIT_FOR)) for x in (day, year))
        if month in MONTHS and (day + year).isdigit() and (found := calendar(int(year), MONTHS.index(month) + 1, int(day))):
            return found
    value = value.translate(str.maketrans(DIGIT_FOR))
    for k, (form, order) in enumerate(_NUMERIC):
        m = form.search(value if k < 2 else re.sub(r"\D", "", value))
        if m and (found := calendar(*(int(m[i]) for i in order))):
            return found
    return None


def clean_date(text: Column) -> Column:
    """Dates printed without confusions, by built-in functions alone.

    Each form is asked only for what it can read, as a failed attempt is dear.
    ISO dates are cast: that is done without lambdas, which run uncompiled.
    """
    iso = text.try_cast("date")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.when(F.year(iso).between(*YEARS), iso)).otherwise(_clean_form(text))


def _clean_form(text: Column) -> Column:
    value = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))

    def read(value: Column) -> Column:
        iso, named = F.regexp_replace(value, "[/. ]", "-"), F.regexp_replace(value, "[-/.]", " ")
        found = (
            F.when(iso.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(iso, "yyyy-M-d"))
            .when(iso.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(iso, "d-M-yyyy"))
            .when(named.rlike("^[0-9]{1,2} [A-Z]{3} [0-9]{4}$"), F.try_to_date(F.initcap(F.lower(named)), "d MMM yyyy"))
        )
        return F.transform(F.array(found), lambda d: F.when(F.year(d).between(*YEARS), d))

    # Bound to variables of lambdas, so that nothing is computed twice.
    return F.get(F.flatten(F.transform(F.array(value), read)), F.lit(0))


@arrow_function("date")
def _read(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else read_date(x) for x in texts], dtype=object)


def parse_date(text: Column | str) -> Column:
    """The first readable date; only texts that are no clean date and may be one go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    clean = clean_date(text)
    return F.coalesce(clean, _read(F.when(clean.isNull() & _may_read(text), text)))


def _may_read(text: Column) -> Column:
    return text.rlike("[0-9A-Za-z]") & text.rlike(_MAY_READ)


def with_dates(rows: DataFrame, **texts: Column) -> DataFrame:
    """Rows with a date column for each text.

    Clean dates are read in a projection of their own; Python sees only the
    texts that are left, in one batch for all columns.  A column for each: of null
    arrays, the Arrow writer would go over the batch again for every row.
    """
    kept = rows.columns
    clean = rows.withColumns({f"_clean_{k}": clean_date(v) for k, v in texts.items()} | {f"_text_{k}": v for k, v in texts.items()})
    left = {k: F.when(F.col(f"_clean_{k}").isNull() & _may_read(F.col(f"_text_{k}")), F.col(f"_text_{k}")) for k in texts}
    read = clean.withColumns({f"_read_{k}": _read(v) for k, v in left.items()})
    return read.select(*kept, *[F.coalesce(f"_clean_{k}", f"_read_{k}").alias(k) for k in texts])


def mrz_date(yymmdd: Column, kind: str, today: Column) -> Column:
    """A six-digit date: births are not in the future, expiries are in the nearest century."""

    def read(text: Column) -> Column:
        yy, rest = F.substring(text, 1, 2).cast("int"), F.concat(F.lit("-"), F.substring(text, 3, 2), F.lit("-"), F.substring(text, 5, 2))
        day = lambda year: F.when(year.between(*YEARS), F.concat(year.cast("string"), rest).try_cast("date"))
        if kind == "birth":
            year = F.when(yy + 2000 <= F.year(today), yy + 2000).otherwise(yy + 1900)
            return F.when(day(year) > today, day(year - 100)).otherwise(day(year))
        century = F.floor(F.year(today) / 100) * 100
        options = F.filter(F.array(*[day(century + shift + yy) for shift in (-100, 0, 100)]), lambda d: d.isNotNull())
        return F.array_min(F.transform(options, lambda d: F.struct(F.abs(F.datediff(d, today)).alias("away"), d.alias("day"))))["day"]

    # Bound to the variable of a lambda: written out, the formula would fill a compiled method beyond what the JVM optimizes.
    return F.get(F.transform(F.array(F.when(yymmdd.rlike("^[0-9]{6}$"), yymmdd)), read), F.lit(0))


def age(birth: Column, on: Column) -> Column:
    """Completed years, by calendar."""
    before = (F.month(on) * 100 + F.dayofmonth(on)) < (F.month(birth) * 100 + F.dayofmonth(birth))
    return F.year(on) - F.year(birth) - F.when(before, 1).otherwise(0)


def add_years(day: Column, years: Column) -> Column:
    """The same day years later; 29 February becomes the 28th."""
    return F.add_months(day, (years * 12).cast("int"))


def printed_dates(text: Column) -> Column:
    """Distinct ISO dates of all clean date forms in a text."""
    form = r"\d{1,2}[ /.-](?:[A-Za-z]{3}|\d{1,2})[ /.-]\d{4}|\d{4}-\d{2}-\d{2}"
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(form), F.lit(0)), lambda t: F.date_format(clean_date(t), "yyyy-MM-dd"))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))
