"""Sources, sinks and streams on files."""

import json

from conftest import rows
from pyspark.sql import functions as F

from weft.sources import files, logs
from weft.streaming import usage


def span(at, version="1.0.0", ms=5, **more):
    return json.dumps({"at": at, "version": version, "run": "r", "step": "facts", "ms": ms, **more})


def test_usage_log(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text("\n".join([span("2026-01-02T00:00:00Z"), "not json", '{"no":"ms"}', "", span("2026-01-01T00:00:00Z", tokens={"in": 3}, pages=["a", "b"])]))
    spans = logs.read_usage(spark, str(tmp_path))
    assert [r.at[:10] for r in spans.orderBy("at").collect()] == ["2026-01-01", "2026-01-02"]
    report = logs.usage_report(spans).orderBy("at")
    assert len(report.columns) == 16 and report.first().pages == "a b" and report.first().tokens_in == 3
    logs.append_usage(spans, str(tmp_path / "log"))
    logs.append_usage(spans, str(tmp_path / "log"))
    again = logs.read_usage(spark, str(tmp_path / "log"))
    assert again.count() == 4 and {r.actor for r in again.collect()} == {"kit"}


def test_safe_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "x"'), ("plain", None)], "a string, b string")
    logs.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part*.csv")).read_text()
    assert text.splitlines() == ['"a","b"', '"\'=1+1","say ""x"""', '"plain",""']


def test_numstat(spark):
    lines = ["@@h1\tAda\t2026-01-01", "3\t1\tsrc/a.ts", "-\t-\tlogo.png", "", "@@h2\tBob\t2026-01-02", "2\t0\tsrc/a.ts"]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)], "log string, pos long, value string")
    got = rows(logs.parse_numstat(df), "hash", "path")
    assert got == [("h1", "Ada", "2026-01-01", "logo.png", 0, 0), ("h1", "Ada", "2026-01-01", "src/a.ts", 3, 1), ("h2", "Bob", "2026-01-02", "src/a.ts", 2, 0)]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.md").write_text("# A")
    (tmp_path / "src" / "big.txt").write_text("x" * 100)
    (tmp_path / "src" / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "node_modules" / "x.js").write_text("x")
    found = files.list_files(spark, str(tmp_path), most_bytes=50)
    assert sorted(r.path for r in found.collect()) == ["src/a.md", "src/bad.txt", "src/big.txt"]
    good, bad = files.file_texts(found)
    assert rows(good) == [("src/a.md", "# A")]
    assert rows(bad) == [("src/bad.txt", "not UTF-8"), ("src/big.txt", "too large")]
    assert [r.f for r in spark.createDataFrame([("a.MD",), ("b.puml",), ("c.zip",)], "p string").select(files.format_of("p").alias("f")).collect()] == ["markdown", "diagram", None]
    assert files.list_files(spark, str(tmp_path), globs=("**/*.md",)).count() == 1


def test_facts_and_outline(spark, tmp_path):
    items = spark.createDataFrame([("GET", "/a"), ("POST", "/b")], "method string, route string")
    files.write_facts(items, str(tmp_path / "facts"), "api", "kit", "2026-01-01", "abc", "app")
    assert rows(files.read_facts(spark, str(tmp_path / "facts"), "method:string,route:string")) == [("api", "abc", "GET", "/a"), ("api", "abc", "POST", "/b")]
    (tmp_path / "toc.json").write_text(json.dumps({"sections": [{"id": "s", "title": "S", "groups": [{"title": "G", "pages": [{"id": "p1", "title": "P1"}, {"id": "p2", "title": "P2"}]}]}]}))
    assert [r.page for r in files.read_outline(spark, str(tmp_path / "toc.json")).orderBy("page_pos").collect()] == ["p1", "p2"]
    (tmp_path / "sync.json").write_text(json.dumps({"version": "1", "pages": {"p1": {"version": "1", "hash": "x"}}}))
    assert rows(files.read_states(spark, str(tmp_path / "sync.json"))) == [("p1", "1", "x")]
    assert spark.range(1).select(files.canonical_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("j")).first().j == '{"a":2,"b":1}'


def test_env(spark):
    df = spark.createDataFrame([(".env", "A=1\nexport B=\"two words\" # note\n# C=3\nD='x#y'\nbad line\nE=plain # c")], "file string, text string")
    assert rows(files.parse_env(df), "line") == [(".env", 1, "A", "1"), (".env", 2, "B", "two words"), (".env", 4, "D", "x#y"), (".env", 6, "E", "plain")]


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.jsonl").write_text("\n".join([span("2026-01-01 00:00:01"), span("2026-01-01 00:00:01"), span("2026-01-01 00:07:00", ms=7)]))
    for name, frame, mode in (("w", usage.by_window(usage.follow(spark, str(log))), "complete"), ("o", usage.once(usage.follow(spark, str(log))), "append")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [(r.ms, r.n) for r in spark.table("w").orderBy("start").collect()] == [(10, 2), (7, 1)]
    assert spark.table("o").count() == 2
    usage.append_to(usage.follow(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    (log / "2.jsonl").write_text(span("2026-01-01 01:00:00"))
    usage.append_to(usage.follow(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    q = usage.sessions(usage.follow(spark, str(log))).writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("s").count() >= 0
