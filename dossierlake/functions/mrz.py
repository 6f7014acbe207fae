"""Machine-readable zones: check digits, layouts, reading and writing.

Check digits, formats and fields are column expressions over a layout table.
Only the search for confirmed glyph repairs is an Arrow-batched function;
``with_zone`` sends it only the zones whose digits fail.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_function

# Formats as (lines, width), fields as line, start, length (0-based), and glyph confusions.
SHAPES = {"TD3": (2, 44), "TD2": (2, 36), "TD1": (3, 30), "MRVA": (2, 44), "MRVB": (2, 36)}
FIRST_LETTERS = {"TD3": "P", "TD2": "ACIPV", "TD1": "ACI", "MRVA": "V", "MRVB": "V"}
BRACKETS = "«‹◂·({["
TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "U": "0", "I": "1", "L": "1", "T": "1", "Z": "2", "S": "5", "B": "8", "G": "6", "A": "4"}
TO_LETTER = {"0": "O", "1": "I", "2": "Z", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B"}
LOOKS_LIKE = {"0": "OD", "O": "0D", "D": "0O", "1": "I", "I": "1", "2": "Z", "Z": "2", "5": "S", "S": "5", "8": "B", "B": "8", "6": "G", "G": "6"}


@dataclass(frozen=True)
class Field:
    """A place in the zone; ``check`` is the place of its check digit, ``kind`` the glyphs it may hold."""

    line: int
    start: int
    size: int
    check: tuple[int, int] | None = None
    kind: str = "any"


def _two_lines(optional: Field) -> dict[str, Field]:
    return {
        "document_number": Field(1, 0, 9, (1, 9)),
        "nationality": Field(1, 10, 3, kind="letters"),
        "date_of_birth": Field(1, 13, 6, (1, 19), "digits"),
        "sex": Field(1, 20, 1),
        "date_of_expiry": Field(1, 21, 6, (1, 27), "digits"),
        "optional_data": optional,
    }


FIELDS: dict[str, dict[str, Field]] = {
    "TD3": _two_lines(Field(1, 28, 14, (1, 42))),
    "TD2": _two_lines(Field(1, 28, 7)),
    "MRVA": _two_lines(Field(1, 28, 16)),
    "MRVB": _two_lines(Field(1, 28, 8)),
    "TD1": {
        "document_number": Field(0, 5, 9, (0, 14)),
        "optional_data": Field(0, 15, 15),
        "date_of_birth": Field(1, 0, 6, (1, 6), "digits"),
        "sex": Field(1, 7, 1),
        "date_of_expiry": Field(1, 8, 6, (1, 14), "digits"),
        "nationality": Field(1, 15, 3, kind="letters"),
        "optional_data_2": Field(1, 18, 11),
    },
}
NAMES = {f: Field(0 if n == 2 else 2, 5 if n == 2 else 0, w - 5 if n == 2 else w, kind="letters") for f, (n, w) in SHAPES.items()}
STATE = Field(0, 2, 3, kind="letters")
#: Place of the composite digit and the spans that it covers.
COMPOSITE: dict[str, tuple[tuple[int, int], tuple[Field, ...]]] = {
    "TD3": ((1, 43), (Field(1, 0, 10), Field(1, 13, 7), Field(1, 21, 22))),
    "TD2": ((1, 35), (Field(1, 0, 10), Field(1, 13, 7), Field(1, 21, 14))),
    "TD1": ((1, 29), (Field(0, 5, 25), Field(1, 0, 7), Field(1, 8, 7), Field(1, 18, 11))),
}


# -- column expressions -------------------------------------------------------


def check_digit(data: Column) -> Column:
    """Sum of glyph values with weights 7, 3, 1, modulo 10."""
    glyphs = F.filter(F.split(data, ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        worth = F.when(code.between(48, 57), code - 48).when(code.between(65, 90), code - 55).otherwise(0)
        return worth * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), i % 3 + 1)

    return (F.aggregate(F.transform(glyphs, value), F.lit(0), lambda a, x: a + x) % 10).cast("string")


def normal_line(line: Column) -> Column:
    """Upper case, bracket look-alikes as fillers, other glyphs dropped."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(line, F.lit(""))), BRACKETS, "<" * len(BRACKETS)), "[^A-Z0-9<]", "")


def normal_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, normal_line), lambda x: x != "")


def detect_format(lines: Column) -> Column:
    """The format of normalised lines by their number, length and first letter; null if none."""
    three = F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3))
    last, before = F.try_element_at(lines, F.lit(-1)), F.try_element_at(lines, F.lit(-2))
    mean = (F.length(before) + F.length(last)) / 2
    visa = F.substring(before, 1, 1) == "V"
    return (
        F.when((F.size(lines) >= 3) & F.forall(three, lambda x: F.length(x).between(26, 34)), "TD1")
        .when(mean.between(40, 48), F.when(visa, "MRVA").otherwise("TD3"))
        .when((mean >= 32) & (mean < 40), F.when(visa, "MRVB").otherwise("TD2"))
    )


def framed(lines: Column, fmt: str) -> Column:
    """The last lines of a format, cut and filled to its width."""
    n, width = SHAPES[fmt]
    last = F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), F.lit(n))
    return F.transform(last, lambda x: F.rpad(F.substring(x, 1, width), width, "<"))


def cut(lines: Column, f: Field) -> Column:
    return F.substring(F.get(lines, F.lit(f.line)), f.start + 1, f.size)


def _glyph(lines: Column, at: tuple[int, int]) -> Column:
    return F.substring(F.get(lines, F.lit(at[0])), at[1] + 1, 1)


def field_checks(lines: Column, fmt: str) -> Column:
    """Struct of booleans, one for each field with a check digit."""
    out = []
    for name, f in FIELDS[fmt].items():
        if f.check:
            ok = _glyph(lines, f.check) == check_digit(cut(lines, f))
            if name == "optional_data":
                ok = F.when(cut(lines, f).rlike("^<+$"), _glyph(lines, f.check).isin("<", "0")).otherwise(ok)
            out.append(ok.alias(name))
    return F.struct(*out)


def composite_check(lines: Column, fmt: str) -> Column:
    """Whether the composite digit holds; null where the format has none."""
    if fmt not in COMPOSITE:
        return F.lit(None).cast("boolean")
    at, spans = COMPOSITE[fmt]
    return _glyph(lines, at) == check_digit(F.concat(*[cut(lines, s) for s in spans]))


def _filled(value: Column, size: int) -> Column:
    kept = F.translate(F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9< ]", ""), " ", "<")
    return F.rpad(F.substring(kept, 1, size), size, "<")


def _name_line(surname: Column, given: Column, size: int) -> Column:
    last, first = (F.translate(F.trim(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z ]", "")), " ", "<") for x in (surname, given))
    return F.rpad(F.substring(F.when(first != "", F.concat(last, F.lit("<<"), first)).otherwise(last), 1, size), size, "<")


def generate(fmt: str, document_code: Column, issuing_state: Column, document_number: Column, nationality: Column, date_of_birth: Column, sex: Column, date_of_expiry: Column, surname: Column, given_names: Column, optional_data: Column | None = None, optional_data_2: Column | None = None) -> Column:
    """The lines of a zone with right check digits; dates as YYMMDD."""
    empty = F.lit("")
    optional, second = empty if optional_data is None else optional_data, empty if optional_data_2 is None else optional_data_2
    number, birth, expiry, nation = _filled(document_number, 9), _filled(date_of_birth, 6), _filled(date_of_expiry, 6), _filled(nationality, 3)
    number, birth, expiry = (F.concat(x, check_digit(x)) for x in (number, birth, expiry))
    head = F.concat(_filled(document_code, 2), _filled(issuing_state, 3))
    letter = F.substring(F.upper(F.coalesce(F.nullif(sex, empty), F.lit("<"))), 1, 1)
    width = SHAPES[fmt][1]
    if fmt == "TD1":
        first = F.concat(head, number, _filled(optional, 15))
        rest = _filled(second, 11)
        total = check_digit(F.concat(F.substring(first, 6, 25), birth, expiry, rest))
        return F.array(first, F.concat(birth, letter, expiry, nation, rest, total), _name_line(surname, given_names, 30))
    size = FIELDS[fmt]["optional_data"].size
    extra = _filled(optional, size)
    if fmt == "TD3":
        extra = F.concat(extra, check_digit(extra))
    body = F.concat(number, nation, birth, letter, expiry, extra)
    if fmt in COMPOSITE:
        body = F.concat(body, check_digit(F.concat(number, birth, expiry, extra)))
    return F.array(F.concat(head, _name_line(surname, given_names, width - 5)), body)


def split_name(raw: Column) -> Column:
    """(surname, given_names) of a name field."""
    parts = F.split(F.regexp_replace(raw, "<+$", ""), "<<", 2)
    clean = lambda x: F.trim(F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "<", " "), r"\s+", " "))
    return F.struct(F.trim(F.translate(F.get(parts, F.lit(0)), "<", " ")).alias("surname"), clean(F.get(parts, F.lit(1))).alias("given_names"))


# -- reading with repairs -----------------------------------------------------


def digit_of(data: str) -> str:
    worth = (int(c) if c.isdigit() else ord(c) - 55 if c.isalpha() else 0 for c in data)
    return str(sum(v * (7, 3, 1)[i % 3] for i, v in enumerate(worth)) % 10)


class Zone:
    """The glyphs of one zone while it is repaired."""

    def __init__(self, fmt: str, lines: list[str]):
        self.fmt, self.rows, self.repairs = fmt, [list(x) for x in lines], []

    def text(self, f: Field) -> str:
        return "".join(self.rows[f.line][f.start : f.start + f.size])

    def checks(self) -> dict[str, bool]:
        out = {}
        for name, f in FIELDS[self.fmt].items():
            if f.check:
                value, digit = self.text(f), self.rows[f.check[0]][f.check[1]]
                out[name] = digit in "<0" if name == "optional_data" and not value.strip("<") else digit == digit_of(value)
        return out

    def composite(self) -> bool | None:
        if self.fmt not in COMPOSITE:
            return None
        (line, at), spans = COMPOSITE[self.fmt]
        return self.rows[line][at] == digit_of("".join(map(self.text, spans)))

    def sound(self) -> bool:
        return all(self.checks().values()) and self.composite() is not False

    def fix_kinds(self) -> None:
        """Letters in places for digits and digits in places for letters."""
        places = [(n, f) for n, f in FIELDS[self.fmt].items() if f.kind != "any"]
        places += [(f"{n}_check", Field(*f.check, 1, kind="digits")) for n, f in FIELDS[self.fmt].items() if f.check]
        places += [("issuing_state", STATE), ("name", NAMES[self.fmt])]
        if self.fmt in COMPOSITE:
            places.append(("composite_check", Field(*COMPOSITE[self.fmt][0], 1, kind="digits")))
        for label, f in places:
            table = TO_DIGIT if f.kind == "digits" else TO_LETTER
            for i in range(f.size):
                c = self.rows[f.line][f.start + i]
                if c in table:
                    self.rows[f.line][f.start + i] = table[c]
                    self.repairs.append(f"{label}[{i}] {c}->{table[c]}")

    def fix_confusions(self, alternatives: list | None = None) -> None:
        """Swap glyphs in a failing field if just one swap satisfies its digit and the composite."""
        for name, f in FIELDS[self.fmt].items():
            if not f.check or self.checks()[name] or not (target := self.rows[f.check[0]][f.check[1]]).isdigit():
                continue
            floor = 0.05 if self.fmt in COMPOSITE else 0.2
            options: dict[int, list[str]] = {}
            for i in range(f.size):
                c = self.rows[f.line][f.start + i]
                more = set(LOOKS_LIKE.get(c, "")) if f.kind == "any" else set()
                if alternatives is not None:
                    more |= {a for a, p in alternatives[f.line][f.start + i] if a != c and p >= floor and (f.kind != "digits" or a.isdigit())}
                if more:
                    options[i] = sorted(more)
            swaps = [((i, c),) for i in options for c in options[i]]
            accepted = self._confirmed(f, target, swaps)
            if accepted is None and alternatives is not None and self.fmt in COMPOSITE:
                pairs = [((i, c), (j, d)) for i, j in combinations(options, 2) for c, d in product(options[i], options[j])]
                accepted = self._confirmed(f, target, pairs)
            if accepted and len(accepted) == 1:
                for i, c in accepted[0]:
                    self.repairs.append(f"{name}[{i}] {self.rows[f.line][f.start + i]}->{c} (check digit confirmed)")
                    self.rows[f.line][f.start + i] = c

    def _confirmed(self, f: Field, target: str, swaps: list) -> list | None:
        """Swaps that satisfy both digits; None if none satisfies the field's own."""
        own, both, row = False, [], self.rows[f.line]
        for swap in swaps:
            old = [row[f.start + i] for i, _ in swap]
            for i, c in swap:
                row[f.start + i] = c
            if digit_of(self.text(f)) == target:
                own = True
                if self.composite() is not False:
                    both.append(swap)
            for (i, _), c in zip(swap, old, strict=True):
                row[f.start + i] = c
        return both if own else None


RESULT = (
    "valid_format boolean, format string, document_code string, document_type string, issuing_state string, document_number string, nationality string, "
    "date_of_birth string, sex string, date_of_expiry string, optional_data string, optional_data_2 string, surname string, given_names string, "
    "check_digits map<string,boolean>, composite_check_valid boolean, overall_check_digit_valid boolean, raw_overall_check_digit_valid boolean, "
    "repair_applied boolean, repairs array<string>, normalized_lines array<string>"
)


def read_zone(lines: list[str] | None, alternatives: list | None = None, fmt: str | None = None) -> dict:
    """All fields of a zone, repaired where a check digit confirms it."""
    marks = str.maketrans(dict.fromkeys(BRACKETS, "<"))
    lines = [x for x in (re.sub("[^A-Z0-9<]", "", (line or "").upper().translate(marks)) for line in lines or ()) if x]
    fmt = fmt or _format(lines)
    out: dict = {"valid_format": False, "format": fmt or "", "normalized_lines": lines, "repairs": [], "repair_applied": False, "check_digits": {}}
    if not fmt:
        return out
    count, width = SHAPES[fmt]
    rows = [x[:width].ljust(width, "<") for x in lines[-count:]]
    if len(rows) < count or rows[0][0] not in FIRST_LETTERS[fmt]:
        return out
    zone = Zone(fmt, rows)
    raw = zone.sound()
    if not raw:
        zone.fix_kinds()
        zone.fix_confusions(alternatives)
    checks, composite = zone.checks(), zone.composite()
    values = {n: zone.text(f) for n, f in FIELDS[fmt].items()}
    number = values["document_number"].replace("<", "")
    last, _, first = zone.text(NAMES[fmt]).rstrip("<").partition("<<")
    shown = checks | {"passport_number": checks["document_number"]} | ({} if composite is None else {"composite": composite})
    code = "".join(zone.rows[0][:2])
    return out | values | {
        "valid_format": True, "document_code": code, "document_type": code[0], "issuing_state": zone.text(STATE), "document_number": number,
        "surname": last.replace("<", " ").strip(), "given_names": " ".join(first.replace("<", " ").split()), "check_digits": shown,
        "composite_check_valid": composite, "overall_check_digit_valid": zone.sound(), "raw_overall_check_digit_valid": raw,
        "repair_applied": bool(zone.repairs), "repairs": zone.repairs, "normalized_lines": ["".join(r) for r in zone.rows],
    }


def _format(lines: list[str]) -> str | None:
    if len(lines) >= 3 and all(26 <= len(x) <= 34 for x in lines[-3:]):
        return "TD1"
    if len(lines) < 2:
        return None
    mean, visa = (len(lines[-1]) + len(lines[-2])) / 2, lines[-2].startswith("V")
    if 40 <= mean <= 48:
        return "MRVA" if visa else "TD3"
    return ("MRVB" if visa else "TD2") if 32 <= mean < 40 else None


@arrow_function(RESULT)
def parse_mrz(lines: pd.Series) -> pd.DataFrame:
    """All fields of a zone, repaired where digits confirm it; ``with_zone`` spares sound zones the way to Python."""
    names = [x.split()[0] for x in re.sub("<[^>]*>", "", RESULT).split(", ")]
    rows = [read_zone(None if x is None else list(x)) for x in lines]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _is_sound(rows: Column, fmt: str) -> Column:
    checks = field_checks(rows, fmt)
    ok = (F.size(rows) == SHAPES[fmt][0]) & F.substring(rows[0], 1, 1).isin(*FIRST_LETTERS[fmt])
    for name, f in FIELDS[fmt].items():
        if f.check:
            ok = ok & checks[name]
    return ok & composite_check(rows, fmt) if fmt in COMPOSITE else ok


def _sound_result(rows: Column, fmt: str) -> Column:
    """The result for a zone whose digits all hold."""
    names = split_name(cut(rows, NAMES[fmt]))
    shown = [n for n, f in FIELDS[fmt].items() if f.check] + ["passport_number"] + (["composite"] if fmt in COMPOSITE else [])
    code, none = F.substring(rows[0], 1, 2), F.lit(None).cast("string")
    values = {n: cut(rows, f) for n, f in FIELDS[fmt].items()} | {
        "valid_format": F.lit(True), "format": F.lit(fmt), "document_code": code, "document_type": F.substring(code, 1, 1), "issuing_state": cut(rows, STATE),
        "document_number": F.translate(cut(rows, FIELDS[fmt]["document_number"]), "<", ""), "surname": names["surname"], "given_names": names["given_names"],
        "check_digits": F.create_map(*[F.lit(x) for n in shown for x in (n, True)]), "composite_check_valid": F.lit(True if fmt in COMPOSITE else None).cast("boolean"),
        "overall_check_digit_valid": F.lit(True), "raw_overall_check_digit_valid": F.lit(True), "repair_applied": F.lit(False),
        "repairs": F.array().cast("array<string>"), "normalized_lines": rows,
    }
    fields = [x.split()[0] for x in re.sub("<[^>]*>", "", RESULT).split(", ")]
    return F.struct(*[values.get(n, none).alias(n) for n in fields])


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sound_zone(lines: Column) -> Column:
    """All fields of a zone whose digits all hold, else null; by built-in functions alone."""

    def read(kind: Column, rows: Column) -> Column:
        out = F
        for fmt in SHAPES:
            out = out.when(kind == fmt, F.when(_is_sound(rows, fmt), _sound_result(rows, fmt)))
        return out

    def frame(clean: Column, kind: Column) -> Column:
        out = F
        for fmt in SHAPES:
            out = out.when(kind == fmt, framed(clean, fmt))
        return out

    clean = normal_lines(F.coalesce(lines, F.array().cast("array<string>")))
    return _bound(clean, lambda c: _bound(detect_format(c), lambda k: _bound(frame(c, k), lambda r: read(k, r))))


def with_zone(rows: DataFrame, lines: str, out: str = "zone") -> DataFrame:
    """``rows`` with the fields of the zone in column ``lines``; only zones whose digits fail go to Python.

    A projection of its own keeps the expressions from being computed for every use.
    """
    found = rows.withColumn("_sound", sound_zone(F.col(lines)))
    mended = parse_mrz(F.when(F.col("_sound").isNull(), F.col(lines)))
    return found.withColumn(out, F.when(F.col("_sound").isNotNull(), F.col("_sound")).otherwise(mended)).drop("_sound")


# -- decoding of glyph probabilities --------------------------------------------


def greedy_glyphs(best: list[int], blank: int = 0) -> list[int]:
    """Labels of a frame sequence: repeats collapsed, blanks dropped."""
    return [c for i, c in enumerate(best) if c != blank and (not i or c != best[i - 1])]


def fixed_length_path(log_probs, length: int, blank: int = 0):
    """(labels, score) of the best path through frames that emits exactly ``length`` labels.

    The state is (labels so far, label of the last frame); a label is emitted
    where a frame's label is no blank and differs from that of the frame before.
    """
    import numpy as np

    frames, kinds = log_probs.shape
    score = np.full((length + 1, kinds), -np.inf)
    score[0, blank] = log_probs[0, blank]
    if length:
        for c in range(kinds):
            if c != blank:
                score[1, c] = log_probs[0, c]
    back = []
    for t in range(1, frames):
        new, step = np.full_like(score, -np.inf), np.zeros((length + 1, kinds, 2), int)
        order = score.argsort(1)[:, ::-1]
        for n in range(length + 1):
            for c in range(kinds):
                options = [(score[n, c], n, c)]
                if c == blank:
                    options.append((score[n, order[n, 0]], n, order[n, 0]))
                elif n:
                    p = order[n - 1, 0] if order[n - 1, 0] != c else order[n - 1, 1]
                    options.append((score[n - 1, p], n - 1, p))
                value, m, p = max(options, key=lambda o: o[0])
                new[n, c], step[n, c] = value + log_probs[t, c], (m, p)
        score = new
        back.append(step)
    last = int(score[length].argmax())
    total, n, c, labels = float(score[length, last]), length, last, []
    for step in reversed(back):
        m, p = step[n, c]
        if m < n:
            labels.append(c)
        n, c = int(m), int(p)
    if n:
        labels.append(c)
    return labels[::-1], total


# Fixed value: labels of the decoder after the blank.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"


def alternatives(frame: Column, n: int = 3) -> Column:
    """The ``n`` most probable glyphs of one frame (blank first) as (glyph, p); of ties the first glyph."""
    glyphs = F.transform(F.slice(frame, 2, len(ALPHABET)), lambda p, i: F.struct((-p).alias("order"), i.alias("i"), p.alias("p")))
    best = F.slice(F.array_sort(glyphs), 1, n)
    return F.transform(best, lambda x: F.struct(F.substring(F.lit(ALPHABET), x["i"] + 1, F.lit(1)).alias("glyph"), x["p"].alias("p")))


def decoded(length: int | None = None):
    """A column function frames (array of probability arrays) -> (text, score): greedy, or the best path of ``length`` glyphs."""

    @arrow_function("text string, score double")
    def decode(lines: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for frames in lines:
            if frames is None or not len(frames):
                out.append((None, None))
                continue
            p = np.array([list(f) for f in frames], float)
            if length is None:
                labels, score = greedy_glyphs(p.argmax(1).tolist()), float(np.log(np.maximum(p.max(1), 1e-12)).sum())
            else:
                labels, score = fixed_length_path(np.log(np.maximum(p, 1e-12)), length)
            out.append(("".join(ALPHABET[c - 1] for c in labels), score))
        return pd.DataFrame(out, columns=["text", "score"])

    return decode


def zone_score(zone: Column, confidence: Column) -> Column:
    """0 to 100: shares of sound digits, of all digits together, and the mean confidence of the glyphs."""
    digits = F.map_filter(zone["check_digits"], lambda k, v: k != "passport_number")
    passed = F.size(F.map_filter(digits, lambda k, v: v))
    whole = F.when(zone["overall_check_digit_valid"], 35.0).otherwise(0.0)
    score = 40.0 * passed / F.greatest(F.lit(1), F.size(digits)) + whole + 25.0 * F.coalesce(confidence, F.lit(0.0))
    return F.when(F.coalesce(zone["valid_format"], F.lit(False)), score).otherwise(0.0)
