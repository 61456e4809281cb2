"""Text functions on literal inputs."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weft.functions import text as fx
from weft.operators.filters import answer_state, glob_pattern
from weft.operators.ranking import osa_distance


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_versions_sort(spark):
    versions = ["1.0.0", "1.0.0-rc.1", "1.0.0-alpha", "0.9.0", "1.0.0-alpha.1", "1.0.0-beta.11", "1.0.0-beta.2", "latest", "1.10.0", "1.9.0"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    expected = ["0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.9.0", "1.10.0", "latest"]
    assert [r.v for r in df.orderBy(fx.version_key("v")).collect()] == expected


@pytest.mark.parametrize("text,term,expected", [("reorders", "orders", 1), ("the orders", "orders", 2), ("nothing", "orders", 0), ("orders", "orders", 2)])
def test_hit(spark, text, term, expected):
    assert one(spark, fx.hit("t", term), t=text) == expected


@pytest.mark.parametrize("n,expected", [(10, 5), (4, 5), (1, 2)])
def test_occurrences_stop_at_four(spark, n, expected):
    assert one(spark, fx.occurrences("t", "orders"), t="orders " * n) == expected


@pytest.mark.parametrize(
    "function,text,expected",
    [
        (fx.fold, "  Éléments Ça ", "elements ca"),
        (fx.slug, "Où est Żle ?", "ou-est-le"),
        (fx.slug, "!!!", "section"),
        (fx.escape_html, "a<b & \"c\"'", "a&lt;b &amp; &quot;c&quot;'"),
        (fx.one_line, "a\r\n\tb\x07c", "a b c"),
        (fx.plain_text, "<p>a &amp;lt; b</p><svg><t>x</t></svg>c", "a &lt; b c"),
        (fx.inert_markup, "a <b> < c </d>", "a &lt;b> < c &lt;/d>"),
        (fx.strip_credentials, "https://u:p@host/x", "https://host/x"),
        (fx.safe_filename, "a/b c+1.json", "a_b_c+1.json"),
        (fx.normal_route, "/a/[id]/{x}/:y/", "/a/{}/{}/{}"),
        (fx.ticket, "ABC-12", "jira"),
        (fx.ticket, "acme/app#3", "github"),
        (fx.content_hash, "\ufeffa\r\nb", hashlib.sha256(b"a\nb").hexdigest()[:16]),
    ],
)
def test_strings(spark, function, text, expected):
    got = one(spark, function("t"), t=text)
    assert got == expected


def test_hosts_and_headings(spark):
    assert one(spark, fx.hosts("t"), t="see https://u@B.example./x and http://a.example:80?q https://a.example") == ["a.example", "b.example"]
    assert one(spark, fx.headings("t"), t="# No\n## One \n```\n## code\n```\n### Two") == ["One", "Two"]
    assert one(spark, fx.whole_count("t", "café"), t="café cafés café, un-café") == 3
    assert one(spark, fx.mask("t", ["ab", "abc"]), t="xABCx") == "x••••••••x"
    assert one(spark, fx.hidden_characters("t"), t="a​b‮") == ["​", "‮"]
    assert round(one(spark, fx.contrast(fx.luminance(F.lit(0), F.lit(0), F.lit(0)), fx.luminance(F.lit(255), F.lit(255), F.lit(255)))), 3) == 21.0


def test_majors_behind(spark):
    df = spark.createDataFrame([("1.2", "3.0"), ("4", "3"), ("x", "3")], "a string, b string")
    assert [r.x for r in df.select(fx.majors_behind("a", "b").alias("x")).collect()] == [2, 0, None]


@pytest.mark.parametrize("a,b,most,expected", [("ordrs", "orders", 1, 1), ("oredrs", "orders", 1, 1), ("taks", "task", 1, 1), ("abcd", "wxyz", 1, 2), ("a", "abc", 1, 2)])
def test_edit_distance_counts_swaps(a, b, most, expected):
    assert osa_distance(a, b, most) == expected


@pytest.mark.parametrize("glob,path,ok", [("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("src/*.ts", "src/a/b.ts", False), ("*.{ts,js}", "a.js", True), ("a?.md", "ab.md", True), ("a?.md", "a/.md", False)])
def test_globs(glob, path, ok):
    import re

    assert bool(re.match(glob_pattern(glob), path)) is ok


def test_answers(spark):
    df = spark.createDataFrame([("N/A",), ("na: none",), ("national",), ("unknown",), ("",), (None,)], "v string")
    assert [r.x for r in df.select(answer_state(F.col("v")).alias("x")).collect()] == ["na", "na", "answered", "unknown", "missing", "missing"]
