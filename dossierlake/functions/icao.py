"""Issuing-state and nationality codes."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fuzzy import best_match

# Codes beside those of countries.
SPECIAL = [
    "D", "GBD", "GBN", "GBO", "GBP", "GBS", "EUE", "UNO", "UNA", "UNK", "RKS", "XBA", "XIM", "XCC", "XCE", "XCO", "XEC", "XES", "XMP", "XOM", "XPO",
    "XXA", "XXB", "XXC", "XXX", "UTO",
]

# Printed names of nationalities.
DEMONYMS = {
    "INDIAN": "IND", "INDIA": "IND", "NEPALESE": "NPL", "NEPALI": "NPL", "NEPAL": "NPL", "BANGLADESHI": "BGD", "BANGLADESH": "BGD",
    "SRI LANKAN": "LKA", "SRI LANKA": "LKA", "BHUTANESE": "BTN", "BHUTAN": "BTN", "PAKISTANI": "PAK", "PAKISTAN": "PAK", "AFGHAN": "AFG",
    "MYANMAR": "MMR", "BURMESE": "MMR", "CHINESE": "CHN", "CHINA": "CHN", "AMERICAN": "USA", "UNITED STATES OF AMERICA": "USA",
    "BRITISH": "GBR", "BRITISH CITIZEN": "GBR", "UNITED KINGDOM": "GBR", "GERMAN": "DEU", "DEUTSCH": "DEU", "GERMANY": "DEU",
    "FRENCH": "FRA", "FRANCAISE": "FRA", "FRANCE": "FRA", "JAPANESE": "JPN", "JAPAN": "JPN", "RUSSIAN": "RUS", "RUSSIAN FEDERATION": "RUS",
    "AUSTRALIAN": "AUS", "CANADIAN": "CAN", "BRAZILIAN": "BRA", "NIGERIAN": "NGA", "EMIRATI": "ARE", "SINGAPOREAN": "SGP", "UTOPIAN": "UTO",
    "UTOPIA": "UTO", "STATELESS": "XXA", "ITALIAN": "ITA", "SPANISH": "ESP", "DUTCH": "NLD", "SWEDISH": "SWE", "KOREAN": "KOR", "THAI": "THA",
    "MALAYSIAN": "MYS", "INDONESIAN": "IDN", "FILIPINO": "PHL", "VIETNAMESE": "VNM", "SAUDI": "SAU", "IRANIAN": "IRN", "IRAQI": "IRQ",
    "TURKISH": "TUR", "EGYPTIAN": "EGY", "KENYAN": "KEN", "SOUTH AFRICAN": "ZAF", "MEXICAN": "MEX", "ARGENTINE": "ARG", "UKRAINIAN": "UKR",
    "POLISH": "POL",
}


@lru_cache(maxsize=1)
def codes() -> frozenset[str]:
    """Country codes of three letters, as the Java runtime lists them, and the special ones."""
    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    kinds = SparkContext._active_spark_context._jvm.java.util.Locale.IsoCountryCode
    return frozenset(locale.getISOCountries(kinds.PART1_ALPHA3)) | frozenset(SPECIAL)


def is_code(code: Column) -> Column:
    """Whether it is a code; only others are put in upper case."""
    bare, known = F.translate(F.coalesce(code, F.lit("")), "<", ""), sorted(codes())
    return bare.isin(known) | F.upper(bare).isin(known)


def code_of(text: str | None, known: frozenset[str]) -> str | None:
    """A code as it is, else that of a printed name, else of the nearest name."""
    value = " ".join((text or "").upper().replace("<", " ").split())
    return value if value in known else DEMONYMS.get(value) or (best_match(value, DEMONYMS, 85) if value else None)


def to_code(text: Column) -> Column:
    known = codes()

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: code_of(t, known))

    return F.pandas_udf(find, "string")(text)
