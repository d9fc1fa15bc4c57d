"""Column functions on small values."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import numbers, paths, text


def value(spark, column, **columns):
    names = list(columns)
    frame = spark.createDataFrame([tuple(columns[n] for n in names)] if names else [(1,)], names or ["x"])
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize(("given", "expected"), [("A landlord's Rent, 2.5%!", ["a", "landlord", "s", "rent", "2", "5"]), ("", []), ("--", [])])
def test_tokens(spark, given, expected):
    assert value(spark, text.tokens(F.col("t")), t=given) == expected


@pytest.mark.parametrize(("given", "expected"), [("abcd", ["abc", "bcd"]), ("a b", ["a b"]), ("ab", ["ab"]), ("", []), ("Ab-cd", ["ab ", "b c", " cd"]), ("aaaaa", ["aaa", "aaa", "aaa"])])
def test_trigrams(spark, given, expected):
    assert value(spark, text.trigrams(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    ("given", "expected"),
    [("a<br>b <b>c</b>", "a b c"), ("x&nbsp;&amp;&#65;&#x42;&bogus;", "x &AB&bogus;"), ("&amp;lt;", "&lt;"), ("  a \n b﻿ ", "a b"), ("", "")],
)
def test_html_text(spark, given, expected):
    assert value(spark, text.html_text(F.col("t")), t=given) == expected
    assert text.html_text_of(given) == expected


@pytest.mark.parametrize(("given", "expected"), [("Tenant's Rights & Duties", "tenant-s-rights-duties"), ("Émile  Zola", "emile-zola"), ("***", "section")])
def test_slugify(spark, given, expected):
    assert value(spark, text.slugify(F.col("t")), t=given) == expected


def test_regions_and_chrome(spark):
    page = "<body><nav>x</nav><main class='m'>in <ul class=\"big toc\"><li>no</li></ul><svg/>end</main></body>"
    assert value(spark, text.content_region(F.col("t")), t=page).startswith("in <ul")
    assert "no" not in value(spark, text.strip_chrome(F.col("t")), t=page) and "x" not in value(spark, text.strip_chrome(F.col("t")), t=page)
    assert value(spark, text.content_region(F.col("t")), t="<p>bare</p>") == "<p>bare</p>"
    assert value(spark, text.table_cells(F.col("t")), t="<table><tr><th>A</th><td> b<br>c </td></tr><tr></tr></table>") == [["A", "b c"], []]


@pytest.mark.parametrize(
    ("kind", "given", "label", "rest"),
    [("section", "5.1. Purposes", "5.1", "Purposes"), ("section", "5 Purposes", "5", "Purposes"), ("subsection", "(2.1) A landlord", "2.1", "A landlord"), ("letter_clause", "(a.1) if", "a.1", "if"), ("subparagraph", "iv. by mail", "iv", "by mail"), ("section", "none", None, None)],
)
def test_head_markers(spark, kind, given, label, rest):
    found = value(spark, text.head_marker(F.col("t"), kind), t=given)
    assert (found and found.label, found and found.rest) == (label, rest)


def test_labels(spark):
    assert value(spark, text.coordinate_label(F.col("t"), "schedule"), t="Schedule 1 Useful life") == "Schedule 1"
    assert value(spark, text.coordinate_label(F.col("t"), "schedule"), t="Schedule Useful") == "Schedule"
    assert value(spark, text.coordinate_label(F.col("t"), "table"), t="Tabletop") is None
    assert value(spark, text.definition_term(F.col("t")), t=" “Board” means the board") == "Board"
    assert value(spark, text.part_number(F.col("t")), t="part v.1 rest") == "V.1"
    assert value(spark, text.strip_code_fence(F.col("t")), t="```json\n{\"a\": 1}\n```") == '{"a": 1}'


def test_cap_summary(spark):
    assert value(spark, text.cap_summary(F.col("t"), 10), t="aaaa bbbb cccc") == "aaaa bbbb"
    assert value(spark, text.cap_summary(F.col("t"), 10), t="aa bbbbbbbbbbbbb") == "aa bbbbbbb"
    assert value(spark, text.cap_summary(F.col("t"), 10), t="short") == "short"


def test_trace_and_redaction(spark):
    header = value(spark, text.traceparent(F.col("a"), F.col("b")), a="0" * 32, b="1" * 16)
    assert len(header) == 55 and value(spark, text.traceparent_ids(F.col("h")), h=header).span_id == "1" * 16
    assert value(spark, text.traceparent_ids(F.col("h")), h="nope") is None
    assert value(spark, text.redact(F.col("t"), ["key123"], 20), t="failed with key123 and more text") == "failed with [redacte…"


def test_paths(spark):
    parsed = value(spark, paths.parse_key(F.col("k")), k="rta|part:V|section:49|subsection:1|clause:a:b")
    assert parsed.document_id == "rta" and parsed.segments[-1].label == "a:b"
    for bad in ("rta|chapter:1", "rta|section:", "|section:1", "rta|section"):
        assert value(spark, paths.parse_key(F.col("k")), k=bad) is None
    key = paths.parse_key(F.col("k"))
    assert value(spark, paths.human_path(key["document_id"], key["segments"]), k="rta|part:V|section:49|subsection:1") == "rta / Part V / s. 49 / (1)"
    assert value(spark, paths.path_key(key["document_id"], key["segments"]), k="rta|section:4") == "rta|section:4"


@pytest.mark.parametrize(
    ("required", "candidate", "known", "expected"),
    [("d|section:4", "d|section:4", True, "exact"), ("d|section:4", "d|section:4|clause:a", True, "descendant-satisfies-ancestor"), ("d|section:4|clause:a", "d|section:4", True, "ancestor-partial"), ("d|section:4", "d|section:49", True, "no-match"), ("d|section:4", "d|section:4", False, "unresolvable"), ("d", "d|section:1", True, "descendant-satisfies-ancestor"), ("d|section:1", "e|section:1", True, "no-match")],
)
def test_cite_verdict(spark, required, candidate, known, expected):
    assert value(spark, paths.cite_verdict(F.col("r"), F.col("c"), F.col("k")), r=required, c=candidate, k=known) == expected


def test_numbers(spark):
    assert value(spark, numbers.kappa_of(F.lit(0.7), F.lit(0.5), F.lit(0.6))) == pytest.approx(0.4)
    assert value(spark, numbers.kappa_of(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 1.0
    assert value(spark, numbers.kappa_of(F.lit(0.0), F.lit(1.0), F.lit(1.0))) == 0.0
    assert [value(spark, numbers.trust_band(F.lit(k))) for k in (0.61, 0.41, 0.4)] == ["trusted", "published-with-analysis", "not-trusted"]
    assert value(spark, numbers.token_cost(F.col("p"), F.col("c"), F.col("o")), p=1_000_000, c=400_000, o=100_000) == pytest.approx(0.6 * 1.25 + 0.4 * 0.31 + 1.0)
    assert value(spark, numbers.dense_cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert numbers.canonical_json({"b": 1, "a": {"d": "é", "c": [1]}}) == '{"a":{"c":[1],"d":"é"},"b":1}'
    for before, after in ((b"a\nx __uzdbm_1 y\nb", b"a\nb"), (b"a\n__uzdbm_1", b"a\n"), (b"akam\r\n__UZDBM_1\n\xff", b"akam\r\n__UZDBM_1\n\xff"), (b"__uzdbm_1\n", b"")):
        assert bytes(value(spark, numbers.normalize_bytes(F.col("b"), "strip-waf"), b=bytearray(before))) == after
    assert bytes(value(spark, numbers.normalize_bytes(F.col("b"), "crlf-to-lf"), b=bytearray(b"a\r\nb\rc\xff"))) == b"a\nb\nc\xff"
