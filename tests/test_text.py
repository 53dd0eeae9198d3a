import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.functions.regex import Untranslatable, to_java

ODD = "aZ9_ é²ß½\n\r\t  ’'.-!?,*#“”—\U0001f600ıſK"


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


SAMPLES = ["", "We'll revise; we’ll ship.", "a_b 3.5 x² ’q \U0001f600 Straße", "Ünï-cödé don't 'quoted'", "  padded \n", "--\nid: 1\n---\nbody", "tab\tand\r\nline"]


def test_tokens(spark):
    got = column(spark, SAMPLES, t.tokens)
    assert got == [re.findall(r"\w+(?:['’]\w+)*", s.lower()) for s in SAMPLES]
    assert got[1] == ["we'll", "revise", "we’ll", "ship"]
    assert column(spark, [None], t.tokens) == [[]]
    assert column(spark, SAMPLES, t.token_count) == [len(x) for x in got]


def test_strip_opener_and_casefold(spark):
    assert column(spark, SAMPLES, t.strip) == [s.strip() for s in SAMPLES]
    assert column(spark, ["123 don't go", "42.", "²nd"], t.opener) == ["don't", "", "²nd"]
    words = ["STRASSE", "Straße", "ΣΊΣΥΦΟΣ", "ﬁn", "µ"]
    assert column(spark, words, t.casefold) == [w.casefold() for w in words]


@pytest.mark.parametrize(("word", "n"), [("the", 1), ("cake", 1), ("apple", 2), ("table", 2), ("syllable", 3), ("makes", 1), ("likes", 1), ("catches", 2), ("boxes", 2), ("tables", 2), ("liked", 1), ("walked", 1), ("wanted", 2), ("needed", 2), ("le", 1), ("123", 1), ("queue", 1), ("rhythm", 1)])
def test_syllables(spark, word, n):
    assert column(spark, [word], t.syllables) == [n]


def test_frontmatter_slug_and_ids(spark):
    assert column(spark, ["---\na: 1\n---\nbody", "--- no", "---\nopen", "x\n---\n"], t.strip_frontmatter) == ["body", "--- no", "---\nopen", "x\n---\n"]
    assert column(spark, ["My Title: 2!", "---", "É"], t.slug) == ["my-title-2", "doc", "doc"]
    import hashlib

    assert column(spark, ["a/b.md"], t.sample_id) == ["sample-" + hashlib.sha256(b"a/b.md").hexdigest()[:12]]


def test_positions_and_excerpt(spark):
    text = "one\ntwo \U0001f600 three"
    for at in (0, 3, 4, 9):
        assert column(spark, [text], lambda c, at=at: t.place_of(t.line_starts(c), F.lit(at))) == [(text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at))]
    assert column(spark, ["a  b\n" * 100], t.excerpt)[0] == ("a b " * 100)[:179].rstrip() + "…"
    assert column(spark, [" short\ntext "], t.excerpt) == ["short text"]


PATTERNS = [r"(?i)\b(?:straße|k|is)\b", r"\w+", r"[^\W\d_][\w'-]*", r"\s+\S", r"\d+(?:\.\d+)?", r"(?m)^\S+", r"(?m)\S$", r"(?<=[.!?])\s*\w", r"(?!a)\w\b", r".", r"(?s)a.", r"[\w\-]+?_", r"(['’])\w\1?", r"[^a-z]\Z", r"\B\w", r"(?i:Z)\w|x{2,3}"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=25), min_size=30, max_size=30))
def test_translated_patterns_match_alike(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    found = df.select("v", *(t.matches(F.col("v"), to_java(p)).alias(f"m{k}") for k, p in enumerate(PATTERNS))).collect()
    for r in found:
        for k, p in enumerate(PATTERNS):
            assert [(m["text"], m["start"]) for m in r[f"m{k}"]] == [(m[0], m.start()) for m in re.finditer(p, r["v"])], (p, r["v"])


def test_what_cannot_be_translated():
    for bad in (r"a*", r"(?:)", r"x|"):
        with pytest.raises(Untranslatable):
            to_java(bad)
    with pytest.raises(re.error):
        to_java("(")
