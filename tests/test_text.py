import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.functions.markup import strip_html
from quillspark.settings import Settings

LONG_LINE = "Điều này quy định về trách nhiệm của các cơ quan nhà nước"


def body(lines=10):
    return "\n".join([LONG_LINE] * lines)


@pytest.mark.parametrize(
    "text,kind,issued,expected",
    [
        ("  \n ", "x", "", "no_content"),
        ("abc", "x", "", "corrupted"),
        ("!@#$%^&*()!@#$%^&*()!@#$" + body(), "x", "", "corrupted"),
        ("|a" * 400 + body(), "x", "", "corrupted"),
        ("plain ascii words only " * 40, "x", "", "corrupted"),
        (body(2), "Công văn", "", "too_short"),
        (LONG_LINE * 10000, "x", "", "too_long"),
        (LONG_LINE * 10, "x", "", "few_lines"),
        (body(), "Công văn số 1", "01/01/1970", "legal_type"),
        (body(), "Luật", "01/01/1985", "too_old"),
        (body(), "Luật", "01/01/1986", None),
        (body(), "Luật", "unknown", None),
    ],
)
def test_reject_reason(one, text, kind, issued, expected):
    got = one(lambda t, k, d: T.reject_reason(t, k, d, Settings()), t=text, k=kind, d=issued)
    assert got == expected


def test_rulers_are_not_meaningful(one):
    text = "-" * 40 + "\n" + "| = # _ - " * 5 + "\r\n" + LONG_LINE + "\u2028" + LONG_LINE + "\x0bshort"
    assert one(T.meaningful_lines, t=text) == 2


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aăâđĐéèẽẹỨỬß ñ'́Áx1", max_size=20))
def test_fold(one, text):
    plain = unicodedata.normalize("NFD", text.translate(str.maketrans("đĐ", "dD")))
    assert one(T.fold, t=text) == "".join(c for c in plain if unicodedata.category(c) != "Mn").lower()


@pytest.mark.parametrize(
    "text,expected",
    [
        ("short", "short"),
        ("aaaaaaaa. bbbbbbbbbbbbbb", "aaaaaaaa."),
        ("aaaaaaaa? bbbbbbbbbbbbbb", "aaaaaaaa?"),
        ("a. bbbbbbb\nbbbbbbbbbbbbbbb", "a. bbbbbbb"),
        ("a. bbbbbbbbbbbbbbbbbbbbbbbb", "a. bbbbbbbbbbbb…"),
        ("aaaaaaaaa      bbbbbbbbbbbb", "aaaaaaaaa…"),
    ],
)
def test_smart_truncate(one, text, expected):
    assert one(lambda t: T.smart_truncate(t, 15), t=text) == expected


@pytest.mark.parametrize("text,year", [(" 01/02/2019 ", 2019), ("2019", None), ("01/02/19", None), ("", None)])
def test_year(one, text, year):
    assert one(T.year_of, t=text) == year


def test_stop_words_fall_back_to_all_tokens(one):
    assert sorted(one(T.content_tokens, t="Và LÀ a của")) == sorted(["và", "là", "a", "của"])
    assert one(T.content_tokens, t="và Thuế thuế x2") == ["thuế", "x2"]


def test_html(one):
    page = "<html><head><meta charset='x'><title>t</title></head><body><p> a &amp;lt; b </p><script>x</script>c<link rel=y>d"
    assert one(strip_html, t=page) == "a < b\nc\nd"
    assert one(lambda t: strip_html(t, strict=True), t=page) == ""
    assert one(strip_html, t="no tags &amp; here") == "no tags & here"
    assert one(strip_html, t="<head><head>a</head>b</head>c") == "c"
    assert one(strip_html, t="<header>a</header><!-- b --><STYLE>c</style ><script/>d<br/>&nbsp;<div unfinished") == "a\nd"
    assert one(strip_html, t="<p>a<script>b") == "a"
    assert one(lambda t: strip_html(t), t=None) == ""


def test_default_models_use_the_whole_text(one):
    assert one(models.ExtractiveGenerator().answer, q="q", c="a\n---\nb\n---\nc") == "q\na\n\nb\n\nc"
    written = one(models.SentenceWriter().questions, t="One. Two?\n\n Three")
    assert [r["question"] for r in written] == ["One?", "Two?", "Three?"]
    assert one(models.SentenceWriter().questions, t=" .\n") is None
