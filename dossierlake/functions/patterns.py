r"""Fixed values of the text rules: patterns and word lists.

``\b`` means an edge of ASCII words.  ``java`` and ``python`` give the form of a
pattern for each engine: Java's own ``\b`` knows Unicode letters, and Python's
does unless it is told.
"""

import re

# Fixed values.
PHONE = r"(?:\+?91[-\s]?)?\b[6-9][0-9]{9}\b"
AADHAAR = r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
FIR_NUMBER = r"(?i)\bFIR\s*(?:No\.?|Number)?\s*[0-9]{1,5}\s*(?:of|/|-)\s*[0-9]{4}\b|\b(?:FIR[/\s-]?)?[0-9]{1,5}/[0-9]{4}\b"
SECTION = r"(?i)\b(?:BNS|BNSS|BSA|IPC|CrPC)\s*(?:S(?:ec)?\.?|Section)?\s*[0-9]+[A-Z]?(?:\([0-9]+\))?|\bSection\s+[0-9]+[A-Z]?(?:\([0-9]+\))?"
DATE = r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
NAME = r"((?:[A-Z]\p{L}+[ \t]+){0,3}[A-Z]\p{L}+|\p{IsDevanagari}+(?:[ \t]+\p{IsDevanagari}+){0,3})"
ROLE_NAME = r"(?iu)\b(?:complainant|victim|informant|prosecutrix|deceased)[ \t]*[:\-]?[ \t]*" + NAME
RELATION_NAME = r"(?iu)\b(?:s/o|d/o|w/o|c/o|son of|daughter of|wife of|husband of|father of|mother of)[ \t]*[:\-]?[ \t]*" + NAME
ADDRESS = r"(?iu)\b(?:r/o|resident of|residing at|address)\s*[:\-]?\s*([^\n.;]{4,70})"
NOT_A_NAME = [
    "the", "and", "said", "above", "named", "aforesaid", "complainant", "victim", "informant", "accused", "police", "station",
    "inspector", "sub", "constable", "head", "section", "fir",
]
MARK = "[REDACTED]"
LOOK_ALIKES = ("OQDILSBZG", "000115826")
EVIDENCE_PREFIX = {
    "fir": "FIR", "statement": "STM", "forensic_report": "FSR", "charge_sheet": "CHS", "court_filing": "CRT", "notice": "NTC",
    "identity_document": "IDN",
}
OTHER_PREFIX = "OTH"

IDENTIFYING = (PHONE, EMAIL, AADHAAR)
PRESERVED = (FIR_NUMBER, SECTION, DATE)

#: What every match of a pattern holds; texts without it need no search.
HOLDS = {PHONE: "[0-9]{10}", AADHAAR: "[0-9]{4}", EMAIL: "@", FIR_NUMBER: "[0-9]{4}", SECTION: "[0-9]", DATE: "[0-9][/-][0-9]"}

#: What every match of a pattern begins with, under the flags of the pattern; elsewhere it is not tried.
STARTS = {
    PHONE: "[+6-9]", AADHAAR: "[0-9]", FIR_NUMBER: "[F0-9]", SECTION: "[BICS]", DATE: "[0-9]",
    ROLE_NAME: "[CVIPD]", RELATION_NAME: "[SDWCHFM]", ADDRESS: "[RA]",
}
#: What may go before a search: anything but runs of a pattern's characters beside its sign, which keep their neighbours apart.
DROPS = {EMAIL: r"(?:[^A-Za-z0-9._%+@-]|\A)(?:[^@]*(?:[^A-Za-z0-9._%+@-]|\z))?"}

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    flags, body = re.fullmatch(r"((?:\(\?[a-z]+\))?)(.*)", pattern, re.S).groups()
    if pattern in STARTS:
        body = f"(?={STARTS[pattern]})(?:{body})"
    return flags + body.replace(r"\b", _EDGE)


def python(pattern: str) -> str:
    return pattern.replace(r"\b", r"(?a:\b)")
