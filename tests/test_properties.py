"""Properties on generated cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from dossierlake.functions import fuzzy
from dossierlake.functions import mrz as M
from dossierlake.functions import text as X

spans = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)).map(lambda p: (p[0], p[0] + p[1])), max_size=12)


@given(spans)
def test_merged_spans_cover_the_same(found):
    out = X.merge_spans(found)
    cover = lambda s: {i for a, b in s for i in range(a, b)}
    assert cover(out) == cover(found)
    assert all(a[1] < b[0] for a, b in zip(out, out[1:], strict=False))


@given(st.text(max_size=60), st.text(min_size=1, max_size=5))
def test_literals_stand_alone(text, needle):
    for a, b in X.literal_spans(text, needle):
        assert text.lower()[a:b] == needle.strip().lower()
        assert not text[b : b + 1].isalnum() and not (a and text[a - 1].isalnum())


@given(st.text("ABC ", max_size=12), st.text("ABC ", max_size=12))
def test_ratios(a, b):
    for f in (fuzzy.ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.partial_ratio):
        assert 0 <= f(a, b) <= 100
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a) and fuzzy.ratio(a, a) == 100
    assert fuzzy.partial_ratio(a, b) >= fuzzy.ratio(a, b) - 1e-9 or len(a) != len(b)


@settings(max_examples=60)
@given(st.sampled_from(sorted(M.SHAPES)), st.text("ABC019<", min_size=30, max_size=44), st.text("ABC019<", min_size=30, max_size=44))
def test_any_zone_is_read(fmt, first, second):
    z = M.read_zone([M.FIRST_LETTERS[fmt][0] + first, second, second], fmt=fmt)
    assert z["format"] == fmt and (not z["valid_format"] or set(z["check_digits"]) >= {"document_number", "date_of_birth"})
