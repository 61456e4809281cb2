"""Operators on small literal tables."""

from conftest import rows
from pyspark.sql import functions as F

from weft.operators import aggregates, graph, joins, ordered, ranking, scanners, state

USAGE = "step string, sub string, part string, ms long, actor string, model string, run string, tokens_in long, tokens_out long, cache_read long, cache_write long"


def usage(spark):
    base = [("capture", None, None, 1000), ("capture", "a", "wait", 600), ("capture", "b", "wait", 200), ("capture", "a", "shot", 100), ("facts", None, None, 500), ("facts", "api", None, 300)]
    data = [(*x, None, None, "r", None, None, None, None) for x in base] + [("generate", None, None, 2000, "agent", "sonnet", "r", 1000, 200, 50, None)]
    return spark.createDataFrame(data, USAGE)


def test_usage_by_step(spark):
    got = {r.key: (r.ms, r.share) for r in aggregates.usage_rollup(usage(spark)).collect()}
    assert got == {"generate": (2000, 57), "capture": (1000, 29), "capture › wait": (800, 80), "capture › shot": (100, 10), "facts": (500, 14), "facts › api": (300, 60)}
    assert rows(aggregates.usage_totals(usage(spark))) == [(3500, 1250, 1)]
    assert {r.key for r in aggregates.usage_rollup(usage(spark), "model").collect()} == {"sonnet", "—"}


def test_history_and_bus_factor(spark):
    data = [("1", "Ada", "2026-08-01", "a.ts", 100, 0), ("2", "Ada", "2026-09-01", "a.ts", 5, 5), ("3", "Bob", "2026-09-30", "a.ts", 6, 0), ("3", "Bob", "2026-09-30", "logo.png", 0, 0)]
    commits = spark.createDataFrame(data, "hash string, author string, date string, path string, added long, deleted long")
    assert rows(aggregates.file_history(commits))[0] == ("a.ts", 3, 116, 2, "Ada", 67, "2026-09-30")
    tracked = spark.createDataFrame([("a.ts",)], "path string")
    assert aggregates.file_history(commits, tracked).count() == 1
    assert rows(aggregates.bus_factor(commits)) == [(1, 2, 3)]


def test_duplicate_lines(spark):
    block = "\n".join(f"line number {i}" for i in range(7))
    files = spark.createDataFrame([("a", block + "\nunique one"), ("b", "other\n" + block), ("c", "short"), ("d", None)], "file string, text string")
    got = {r.file: (r.eligible, r.duplicated) for r in aggregates.duplicate_lines(files).collect()}
    assert got["a"] == (8, 7) and got["b"] == (8, 7) and got["c"] == (1, 0)


def test_levels_and_depth(spark):
    criteria = spark.createDataFrame([("x", 1, True), ("x", 2, False), ("x", 3, True), ("y", 1, True)], "k string, level int, ok boolean")
    assert rows(aggregates.level_of(criteria, "k")) == [("x", 1), ("y", 4)]
    df = spark.createDataFrame([([1.0, None, 0.6],), ([None],)], "p array<double>")
    assert [r.s for r in df.select(aggregates.depth_score(F.col("p")).alias("s")).collect()] == [80, None]


def test_diff(spark):
    a = spark.createDataFrame([("api", "user", ["x", "y"]), ("old", "none", [])], "k string, auth string, cols array<string>")
    b = spark.createDataFrame([("api", "none", ["y", "x"]), ("new", "none", [])], "k string, auth string, cols array<string>")
    assert rows(joins.diff(a, b, "k", ("auth", "cols"))) == [("api", "changed", "auth", "user", "none"), ("new", "added", None, None, None), ("old", "removed", None, None, None)]
    assert joins.diff(a, a, "k", ("auth", "cols")).isEmpty()


def test_routes(spark):
    items = spark.createDataFrame([("/api/orders/{id}",), ("/orders",), ("/x/:a/b",)], "route string")
    written = spark.createDataFrame([("/orders/:n",), ("/x/1/b",)], "path string")
    assert rows(joins.routes_called(written, items)) == [("/api/orders/{id}",), ("/x/:a/b",)]


def test_ranges(spark):
    r = spark.createDataFrame([("f", 1, 2), ("f", 3, 4), ("f", 9, 9), ("g", 5, 5)], "file string, lo long, hi long")
    assert rows(ordered.merge_ranges(r, "file")) == [("f", 1, 4), ("f", 9, 9), ("g", 5, 5)]
    t = spark.createDataFrame([("f", 4, 100), ("g", 6, 7)], "file string, lo long, hi long")
    assert rows(joins.overlapping(r, t, "file", width=3)) == [("f", 3, 4, 1), ("f", 9, 9, 1)]


def test_budget_cuts_in_order(spark):
    data = [("d", 0, "page", "x" * 400, "c", 0), ("d", 1, "excerpt", "x" * 400, "c", 1), ("d", 2, "excerpt", "x" * 400, "c", 9), ("d", 3, "digest", "x" * 400, "c", 0)]
    parts = spark.createDataFrame(data, "doc string, pos long, kind string, text string, cut_line string, priority long")
    assert [r.pos for r in ordered.fit_budget(parts, 230).where("cut").orderBy("pos").collect()] == [2, 3]
    assert ordered.fit_budget(parts, 1000).where("cut").isEmpty()


def test_sections(spark):
    pages = spark.createDataFrame([("p", "intro\n## One\nbody  one\n### Two\nlast")], "page string, text string")
    assert rows(ordered.sections(pages, "page", "text"), "n") == [("p", 0, None, "intro"), ("p", 1, "One", "body one"), ("p", 2, "Two", "last")]


def test_close_words_and_search(spark):
    entries = spark.createDataFrame([(0, "h", "words", "page", "taken takes takeover talks tanks taking tags tabs"), (1, "h", "the task list", "page", "tasks")], "pos long, anchor string, title string, page string, body string")
    close = [r.word for r in ranking.close_words(ranking.vocabulary(entries), "taks").collect()]
    assert len(close) == 8 and {"takes", "task", "tasks"} <= set(close)
    assert ranking.close_words(ranking.vocabulary(entries), "odr").isEmpty()
    found = ranking.search(entries, {"tasks": ["tasks"]})
    assert rows(found) == [(1, 2)]


def test_did_you_mean(spark):
    keys = spark.createDataFrame([("tilte",), ("zzzzzzzz",), ("title",)], "key string")
    known = spark.createDataFrame([("title", 0), ("subtitle", 1)], "name string, pos long")
    assert rows(ranking.did_you_mean(keys, known)) == [("tilte", "title"), ("zzzzzzzz", None)]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "g")], "src string, dst string")
    assert rows(graph.strong_components(edges)) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 2), ("e", "d", 2)]
    levels = {r.node: r.level for r in graph.topological(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")).collect()}
    assert levels == {"c": 0, "b": 1, "a": 2, "x": None, "y": None}
    roots = spark.createDataFrame([("f",)], "node string")
    assert {r.node: r.depth for r in graph.shortest_depths(roots, edges).collect()} == {"f": 0, "a": 1, "b": 2, "c": 3}
    pairs = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "a long, b long")
    assert rows(graph.groups(pairs)) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(70)], "src string, dst string")
    assert {r.level for r in graph.topological(chain).collect()} == set(range(71))
    assert max(r.depth for r in graph.shortest_depths(spark.createDataFrame([("000",)], "node string"), chain.where("src < '016'")).collect()) == 16
    states = spark.createDataFrame([("000", "fresh"), ("001", "fresh"), ("009", "fresh"), ("002", "stale")], "node string, state string")
    assert rows(graph.late_states(states, chain.where("src < '012'"))) == [("000", "stale"), ("001", "stale"), ("002", "stale"), ("009", "fresh")]
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.strong_components(empty).isEmpty() and graph.topological(empty).isEmpty()


def test_scan_and_mentions(spark, monkeypatch):
    files = spark.createDataFrame([("a.js", 'x\nel.innerHTML = y\nel.innerHTML = sanitize(y)\nconst token = "abcdefghij"'), ("b.py", "eval(x)\nmy.eval(x)")], "file string, text string")
    got = rows(scanners.scan(files, scanners.SECURITY_RULES).select("file", "line", "rule", "severity"))
    assert got == [("a.js", 2, "xss.innerHTML", "low"), ("a.js", 3, "xss.innerHTML", "low"), ("a.js", 4, "secret.default", "medium"), ("b.py", 1, "code.eval", "high")]
    assert scanners.scan(files.where("false"), scanners.SECURITY_RULES).isEmpty()
    names = spark.createDataFrame([("Cosmos", ["azure", "cosmos", "db"]), ("Azure", ["azure"])], "name string, words array<string>")
    docs = spark.createDataFrame([(1, "We use Azure Cosmos DB and azure.")], "doc_id long, text string")
    assert rows(scanners.mentions(docs, names)) == [(1, "Azure", 1), (1, "Cosmos", 1)]
    longer = spark.createDataFrame([("MongoDB on Cosmos", "azure cosmos db for mongodb".split()), ("MongoDB", ["mongodb"]), ("C#", ["c#"]), ("C++", ["c++"]), ("empty", [])], "name string, words array<string>")
    docs = spark.createDataFrame([(1, "We use Azure Cosmos DB for MongoDB."), (2, "C# and C++, not MongoDBs"), (3, None), (4, "")], "doc_id long, text string")
    assert rows(scanners.mentions(docs, longer)) == [(1, "MongoDB on Cosmos", 1), (2, "C#", 1), (2, "C++", 1)]
    assert scanners.mentions(docs, longer.where("false")).isEmpty()
    short = rows(scanners.mentions(docs, longer))
    monkeypatch.setattr(scanners, "MOST_NAMES", 2)  # beyond it the names are joined
    assert rows(scanners.mentions(docs, longer)) == short


def test_states(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "9", "c": "3"}, ["a"])], "r map<string,string>, n map<string,string>, cited array<string>")
    assert df.select(state.merge_labels(F.col("r"), F.col("n"), F.col("cited")).alias("m")).first().m == {"a": "1", "c": "3"}
