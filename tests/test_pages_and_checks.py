"""Pages, ranges of versions, schemas, traces and row checks on small literal tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weft.functions import values
from weft.operators import checks, joins, numbering, pages, ranges, schemas, traces

RANGES = [
    ("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False),
    ("1.5.0", "~1", True), ("1.2.3", ">=1.2.3 <2", True), ("2.0.0-rc.1", "<2", False), ("1.9.0", ">1", False), ("1.2.3", "1.2.x", True), ("1.2.3", "*", True), ("2.3.0", "1.0.0 - 2.3", True),
    ("2.4.0", "1.0.0 - 2.3", False), ("1.2.3-beta.2", ">=1.2.3-beta.1", True), ("1.2.4-beta.2", ">=1.2.3-beta.1", False), ("3.0.0", "1.x || >=2.5.0 || 5.0.0 - 7.2.3", True), ("1.0.0", "nonsense!", None), (None, "*", None),
]


@pytest.mark.parametrize("version,text,want", RANGES)
def test_version_ranges(version, text, want):
    assert ranges.is_within(version, text) is want


def test_lowest_of_ranges():
    wanted = {"^1.2.3": "1.2.3", ">1.2.3": "1.2.4", "~1.2": "1.2.0", "*": "0.0.0", "<2": "0.0.0", ">=1.0.0 <0.5.0": None, "1.x || 0.5.0": "0.5.0", ">1": "2.0.0", "what?": None}
    assert {r: ranges.lowest(r) for r in wanted} == wanted


def test_covered_by_whole_spellings(spark):
    items = spark.createDataFrame([(1, ["order page"], False), (2, ["F-01"], True), (3, ["x"], True), (4, [None, ""], False), (5, ["/api/x"], False)], "id long, match array<string>, whole boolean")
    texts = spark.createDataFrame([(1, "the reorder\n  PAGES"), (2, "see f-01."), (3, "f-012 /API/x/y"), (4, None), (5, ""), (6, "x")], "k long, t string")
    report = joins.covered(items, texts, "id", "match", "k", "t", "whole")
    assert rows(report) == [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, None, 0), (5, 3, 1)]
    assert rows(joins.coverage_totals(report)) == [(5, 4, 80)]
    assert rows(joins.covered(items, texts.where("false"), "id", "match", "k", "t").select("texts")) == [(0,)] * 5


def test_words_settle_spellings_of_one_part(spark, monkeypatch):
    """Only spellings of several parts are looked for in whole texts, whose rows then stand once for a text; words that settle the same items are told as one."""
    tables, keep = [], joins.saved
    monkeypatch.setattr(joins, "saved", lambda df: tables.append(keep(df)) or tables[-1])
    items = spark.createDataFrame([(1, ["the"], False), (2, ["The", "ne"], True), (3, ["a b"], False), (4, ["c d e", "the"], True)], "id long, match array<string>, whole boolean")
    texts = spark.createDataFrame([(1, "other lathe (ne)"), (2, "the\tNE"), (3, "aa bc d e"), (4, "xa  by"), (None, "the")], "k long, t string")
    report = joins.covered(items, texts, "id", "match", "k", "t", "whole")
    assert rows(report) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 2, 1)]
    met = {r.k: (sorted(r.like), sorted(a.m for a in r.asked)) for t in tables if "like" in t.columns and "asked" in t.columns and "k" in t.columns for r in t.collect()}
    assert met == {1: (["(ne)", "lathe"], []), 2: (["(ne)", "the"], []), 3: ([], ["a b", "c d e"]), 4: ([], ["a b"])}


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("k"), "id")
    got = [tuple(r) for r in numbering.numbered(df, ("k", "id"), "n").collect()]
    assert sorted(got) == sorted((k, i, n) for n, (k, i, _) in enumerate(sorted(got), 1))
    assert numbering.numbered(df.where("false"), ("k",), "n").isEmpty()


def test_marks_and_references(spark):
    df = spark.createDataFrame([("Cafe <b> orders",), (None,), ("",)], "t string")
    assert [r.m for r in df.select(pages.marked("t", ["cafe", "orders"]).alias("m")).collect()] == ["<mark>Cafe</mark> &lt;b&gt; <mark>orders</mark>", None, ""]
    assert [r.d for r in df.select(pages.decode_references(F.concat("t", F.lit("&amp;"))).alias("d")).collect()] == ["Cafe <b> orders&", None, "&"]
    urls = spark.createDataFrame([("http://[::1]:80/x",), ("https://u:p@A.b.:444",), ("mailto:x",), (None,)], "u string")
    assert [r.k for r in urls.select(values.application_key("u").alias("k")).collect()] == ["loopback:", "a.b:444", None, None]


def test_row_errors(spark):
    fields = (checks.Field("name", "string", required=True), checks.Field("n", "number", least=0))
    df = spark.createDataFrame([(1, '{"name": "5", "n": 1.5}'), (2, '{"name": 5, "n": -1}'), (3, "[]"), (4, None), (5, "{}"), (6, '{"naem": null, "name": null}')], "k long, j string")
    assert rows(checks.errors(df, fields, "k", "j").select("k", "path", "error", "hint")) == [
        (2, "n", "minimum", None), (2, "name", "type", None), (3, "", "invalid", None), (4, "", "invalid", None), (5, "name", "missing", None), (6, "naem", "unknown", "name"), (6, "name", "missing", None)
    ]


def test_nearby_and_imports(spark):
    place = lambda *x: spark.createDataFrame([("f", p) for p in x], "file string, place long")
    assert rows(traces.nearby(place(1, 50), place(5, 200), "file", 4)) == [("f", 1)]
    assert rows(traces.nearby(place(5), place(1, 5), "file", 4)) == [("f", 1), ("f", 5)]
    files = spark.createDataFrame([("a/b.ts", "import './c'; import '../d'; require('./b')"), ("a/c/index.ts", ""), ("d.js", None)], "file string, text string")
    assert rows(schemas.import_edges(files)) == [("a/b.ts", "a/c/index.ts"), ("a/b.ts", "d.js")]
    with pytest.raises(ValueError):
        pages.facts_table(files, ("nothing",))
