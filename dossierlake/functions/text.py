"""Text functions: tokens, entity extraction, span algebra and redaction.

Values come from built-in regular-expression functions; only where *offsets* are
needed does an Arrow-batched Python function run.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns as P
from .arrow import arrow_function

SPANS = "array<struct<start:int,end:int,value:string>>"


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, without stemming or stop words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def has_all_words(text: Column, words: list[str]) -> Column:
    """Whether every word (lower case) is among the words of the text; texts without the letters are not cut into words."""
    low = F.lower(text)
    may = F.lit(True)
    for w in words:
        may = may & F.contains(low, F.lit(w))
    return F.when(may, F.forall(F.array(*map(F.lit, words)), lambda w: F.array_contains(tokens(text), w))).otherwise(False)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Distinct values of a pattern in order of first occurrence."""
    if pattern in P.DROPS:
        text = F.regexp_replace(text, P.DROPS[pattern], " ")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(P.java(pattern)), F.lit(group)))
    return F.coalesce(found, F.array().cast("array<string>"))


def captures(text: Column, pattern: str) -> Column:
    """Distinct first groups, squeezed, of more than one character."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(P.java(pattern)), F.lit(1)), squeeze)
    return F.array_distinct(F.filter(found, lambda v: F.length(v) > 1))


def leading_name(value: Column) -> Column:
    """The leading run of words that begin with a capital or a Devanagari letter."""
    words = F.split(value, " ")
    stop = F.array_position(F.transform(words, lambda w: w.rlike(r"^[\p{Lu}\p{IsDevanagari}]")), F.lit(False))
    return F.array_join(F.when(stop == 0, words).otherwise(F.slice(words, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))), " ")


def is_name(value: Column) -> Column:
    """Two to four words, at least one of which is no word of the form itself."""
    words = F.split(value, " ")
    return F.size(words).between(2, 4) & F.exists(words, lambda w: ~F.lower(w).isin(P.NOT_A_NAME))


def persons(text: Column) -> Column:
    named = F.concat(captures(text, P.ROLE_NAME), captures(text, P.RELATION_NAME))
    return F.array_distinct(F.filter(F.transform(named, leading_name), is_name))


def entities(text: Column) -> Column:
    """All rule-based entities as one struct."""
    return F.struct(
        persons(text).alias("persons"),
        captures(text, P.ADDRESS).alias("addresses"),
        matches(text, P.PHONE).alias("phones"),
        matches(text, P.EMAIL).alias("emails"),
        matches(text, P.AADHAAR).alias("aadhaar"),
        matches(text, P.FIR_NUMBER).alias("fir_numbers"),
        matches(text, P.SECTION).alias("sections"),
        matches(text, P.DATE).alias("dates"),
        F.lit("rules").alias("extracted_by"),
    )


def evidence_only(found: Column) -> Column:
    """What of the entities a protected case may show."""
    return F.struct(*[found[c].alias(c) for c in ("fir_numbers", "sections", "dates", "extracted_by")])


def redaction_targets(identities: Column, found: Column) -> Column:
    """Registered identities and found names, addresses and phones; distinct, longer than one character."""
    every = F.concat(F.coalesce(identities, F.array().cast("array<string>")), found["persons"], found["addresses"], found["phones"])
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (F.length(F.trim(v)) > 1)))


# -- spans --------------------------------------------------------------------


def _compiled(group: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(P.python(p)) for p in group]


def find_spans(text: str | None, compiled: list[re.Pattern]) -> list[tuple[int, int]]:
    """Non-empty, non-overlapping matches of each pattern."""
    return [m.span() for p in compiled for m in p.finditer(text or "") if m.end() > m.start()]


def literal_spans(text: str, needle: str) -> list[tuple[int, int]]:
    """Whole-word occurrences of a literal, ignoring case.

    Offsets are those of the lower-cased text.
    """
    wanted = (needle or "").strip().lower()
    if len(wanted) < 2:
        return []
    low, out, at = text.lower(), [], 0
    while (at := low.find(wanted, at)) >= 0:
        edge = at + len(wanted)
        if not (at and text[at - 1 : at].isalnum()) and not text[edge : edge + 1].isalnum():
            out.append((at, edge))
        at = edge
    return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def span_finder(*group: str):
    """A column function text -> array of (start, end, value) of the given patterns.

    Texts that hold no match for sure reach Python as nulls.
    """

    @arrow_function(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = _compiled(group)
        return texts.map(lambda t: [{"start": a, "end": b, "value": t[a:b]} for a, b in find_spans(t, compiled)])

    may = "|".join(P.HOLDS.get(p, "") for p in group)
    return lambda text: find(F.when(text.rlike(may), text))


@arrow_function("text string, removed int")
def _redacted(texts: pd.Series, targets: pd.Series) -> pd.DataFrame:
    remove, keep = _compiled(P.IDENTIFYING), _compiled(P.PRESERVED)
    out, counts = [], []
    for text, wanted in zip(texts, targets, strict=True):
        if text is None:
            out.append(None)
            counts.append(0)
            continue
        found = [s for t in (wanted if wanted is not None else ()) for s in literal_spans(text, t)] + find_spans(text, remove)
        kept = find_spans(text, keep) if found else []
        cut = merge_spans([s for s in found if not any(s[0] < k[1] and k[0] < s[1] for k in kept)])
        edges = [0, *(x for s in cut for x in s), len(text)]
        out.append(P.MARK.join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        counts.append(len(cut))
    return pd.DataFrame({"text": out, "removed": pd.Series(counts, dtype="int32")})


def redact(text: Column, targets: Column) -> Column:
    """Targets and identifying patterns replaced; spans that touch evidence are left alone.

    Only texts that may hold something to remove reach Python.
    """
    named = F.exists(targets, lambda t: F.contains(F.lower(text), F.lower(F.trim(t))))
    may = text.rlike("|".join(P.HOLDS[p] for p in P.IDENTIFYING)) | F.coalesce(named, F.lit(False))
    done = _redacted(F.when(may, text), F.when(may, targets))
    return F.when(may, done).otherwise(F.struct(text.alias("text"), F.lit(0).alias("removed")))


def merged(spans: Column) -> Column:
    """``merge_spans`` of an array of (start, end) as a column expression."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (s["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int>>"), step)


def merged_rows(spans: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of each key joined; as rows, so that a key may have any number of them."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int")
    islands = spans.select(*keys, start, end).withColumn("_reach", reach).withColumn("_island", F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def outside(spans: Column, kept: Column) -> Column:
    """The spans that overlap none of ``kept``; half-open."""
    return F.filter(spans, lambda s: ~F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])))


# -- small formats ------------------------------------------------------------


def page_text(pages: Column) -> Column:
    """Text-layer normalisation: blanks squeezed, lines trimmed, at most one blank line, pages joined by one."""
    one = F.transform(pages, lambda p: F.array_join(F.transform(F.split(F.regexp_replace(F.coalesce(p, F.lit("")), r"[ \t]+", " "), "\n"), lambda line: F.trim(line)), "\n"))
    return F.trim(F.regexp_replace(F.array_join(one, "\n\n"), r"\n{3,}", "\n\n"))


def is_useful(text: Column) -> Column:
    """At least 20 characters that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) >= 20


def stamp_text(text: Column) -> Column:
    """Only characters a Latin-1 stamp can show."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20-\x7E\xA0-\xFF]", ""))


def stamp_label(*parts: Column) -> Column:
    """The non-empty parts, or a fixed label."""
    joined = F.concat_ws("  |  ", *[F.nullif(stamp_text(p), F.lit("")) for p in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("RELEASED COPY"))


def mobile(number: Column) -> Column:
    """E.164, a bare ten-digit number being Indian; else null."""
    bare = F.regexp_replace(F.coalesce(number, F.lit("")), r"[\s().-]", "")
    full = F.when(bare.rlike("^[0-9]{10}$"), F.concat(F.lit("+91"), bare)).otherwise(bare)
    return F.when(full.rlike(r"^\+[1-9][0-9]{7,14}$"), full)


def masked_mobile(number: Column) -> Column:
    """First three and last two characters; the rest starred."""
    hidden = F.repeat(F.lit("*"), (F.length(number) - 5).cast("int"))
    return F.concat(F.substring(number, 1, 3), hidden, F.substring(number, -2, 2))


def evidence_number(kind: Column, seq: Column) -> Column:
    """Prefix by kind and the number with at least three digits."""
    prefix = F.lit(P.OTHER_PREFIX)
    for name, short in P.EVIDENCE_PREFIX.items():
        prefix = F.when(kind == name, short).otherwise(prefix)
    digits = seq.cast("string")
    return F.concat(prefix, F.lit("-"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))


def canonical_name(name: Column) -> Column:
    return squeeze(F.translate(F.upper(F.coalesce(name, F.lit(""))), "<", " "))


def canonical_number(number: Column) -> Column:
    """Letters and digits, look-alike glyphs mapped to one."""
    return F.translate(F.regexp_replace(F.upper(F.coalesce(number.cast("string"), F.lit(""))), "[^A-Z0-9]", ""), *P.LOOK_ALIKES)


def name_letters(name: Column) -> Column:
    return squeeze(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z ]", " "))


# -- search -------------------------------------------------------------------


def headline(text: Column, query: list[str], words: int = 18) -> Column:
    """A fragment of at most ``words`` words around the first hit, hits marked."""

    @arrow_function("string")
    def cut(texts: pd.Series) -> pd.Series:
        wanted = set(query)

        def one(t):
            if t is None:
                return None
            parts = t.split()
            bare = [set(re.findall(r"[^\W_]+", w.lower())) for w in parts]
            hit = next((i for i, b in enumerate(bare) if b & wanted), 0)
            a = max(0, min(hit - words // 2, len(parts) - words))
            return " ".join(f"<b>{w}</b>" if bare[a + i] & wanted else w for i, w in enumerate(parts[a : a + words]))

        return texts.map(one)

    return cut(text)


def fragments(text: Column, query: list[str], most: int = 2, longest: int = 18, shortest: int = 5) -> Column:
    """Up to ``most`` fragments of at most ``longest`` words, hits marked, joined by `` ... ``.

    A window begins and ends with a hit.  Those with more of the query's words come
    first, then shorter, then earlier ones; each further fragment shares no word
    with those taken.  In the order of the text they are then widened to ``longest`` words, first
    half to the left, up to their neighbours.  Without a hit: the first ``shortest`` words.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    wanted = F.array(*map(F.lit, query)) if query else F.array().cast("array<string>")
    # Each step is bound to a variable of a lambda, so that it is computed once.
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    struct = lambda **c: F.struct(*[x.alias(k) for k, x in c.items()])

    def windows(own: Column) -> Column:
        def from_hit(i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(i + longest - 1, F.size(own) - 1)), lambda j: F.size(F.get(own, j)) > 0)
            return F.transform(ends, lambda j: struct(missing=-F.size(F.array_distinct(F.flatten(F.slice(own, i + 1, j - i + 1)))), words=j - i + 1, a=i, b=j))

        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.size(F.get(own, i)) > 0)
        return F.flatten(F.transform(starts, from_hit))

    def chosen(found: Column, taken: Column, left: int) -> Column:
        if not left:
            return F.array_sort(F.transform(taken, lambda w: struct(a=w["a"], b=w["b"])))
        free = F.filter(found, lambda w: ~F.exists(taken, lambda t: (w["a"] <= t["b"]) & (t["a"] <= w["b"])))
        return bind(F.concat(taken, F.slice(F.array_sort(free), 1, 1)), lambda more: chosen(found, more, left - 1))

    def cut(parts: Column, own: Column, spans: Column) -> Column:
        def widen(done: Column, k: Column) -> Column:
            now, after = F.get(spans, k), F.get(spans, k + 1)
            low = F.coalesce(F.get(done, F.size(done) - 1)["b"] + 1, F.lit(0))
            high = F.coalesce(after["a"] - 1, F.size(parts) - 1)
            room = longest - (now["b"] - now["a"] + 1)
            a = F.greatest(low, now["a"] - F.floor(room / 2).cast("int"))
            return F.concat(done, F.array(struct(a=a, b=F.least(high, a + longest - 1))))

        def shown(span: Column) -> Column:
            return F.array_join(F.transform(F.sequence(span["a"], span["b"]), lambda i: F.when(F.size(F.get(own, i)) > 0, F.concat(F.lit("<b>"), F.get(parts, i), F.lit("</b>"))).otherwise(F.get(parts, i))), " ")

        wide = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.array().cast("array<struct<a:int,b:int>>"), widen)
        return F.array_join(F.transform(wide, shown), " ... ")

    def laid(parts: Column) -> Column:
        own = F.transform(parts, lambda w: F.array_intersect(tokens(w), wanted))
        none = F.array().cast("array<struct<missing:int,words:int,a:int,b:int>>")
        some = bind(own, lambda o: bind(windows(o), lambda found: bind(chosen(found, none, most), lambda spans: cut(parts, o, spans))))
        hit = F.exists(parts, lambda w: F.size(F.array_intersect(tokens(w), wanted)) > 0)
        return F.when(hit, some).otherwise(F.array_join(F.slice(parts, 1, shortest), " "))

    return F.when(text.isNotNull(), bind(words, laid))
