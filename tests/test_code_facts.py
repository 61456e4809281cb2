"""Proofs, backlogs and code facts on literal inputs."""

from conftest import rows

from weft.operators import backlog, code_facts, proofs

FILE = "file string, text string"


def test_manifests(spark):
    files = spark.createDataFrame(
        [
            ("a/package.json", '{"dependencies": {"next": "^15.0.0"}, "devDependencies": {"jest": "1"}}'),
            ("composer.json", '{"require": {"php": ">=8", "a/b": "^1"}}'),
            ("requirements-dev.txt", "# note\nfastapi[all]>=0.1,<2 ; x\nplain\n-r other.txt"),
            ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = [] }\n[dev-dependencies]\ninsta = "1"'),
            ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\nrequire golang.org/x/y v0.1.0"),
            ("Gemfile", 'gem "rails", "~> 7"\n  gem \'pg\''),
            ("b/package.json", "broken {"),
        ],
        FILE,
    )
    got = {(r.ecosystem, r.name, r.spec, r.dev) for r in code_facts.manifests(files).collect()}
    assert got == {
        ("npm", "next", "^15.0.0", False),
        ("npm", "jest", "1", True),
        ("composer", "a/b", "^1", False),
        ("pypi", "fastapi", ">=0.1,<2", True),
        ("pypi", "plain", None, True),
        ("cargo", "serde", "1.0", False),
        ("cargo", "tokio", "1.2", False),
        ("cargo", "insta", "1", True),
        ("go", "github.com/a/b", "v1.2.3", False),
        ("go", "golang.org/x/y", "v0.1.0", False),
        ("gem", "rails", "~> 7", False),
        ("gem", "pg", None, False),
    }


def test_docker_stages(spark):
    text = "ARG V=1\nFROM node:20-alpine AS build\nENV A=1\nEXPOSE 3000\nUSER node\nFROM --platform=linux/amd64 reg.io:5000/run@sha256:abc\nEXPOSE 80\nEXPOSE 443"
    files = spark.createDataFrame([("svc/Dockerfile", text), ("x.txt", "FROM a")], FILE)
    assert rows(code_facts.docker_stages(files)) == [("svc/Dockerfile", 1, "node", "20-alpine", [3000], False, ["A"]), ("svc/Dockerfile", 2, "reg.io:5000/run", None, [80, 443], True, [])]


def test_routes_screens_and_behaviours(spark):
    files = spark.createDataFrame(
        [("a.ts", "@Get('x')\nrouter.all(\"/y\", h)\nq.orderBy('a').limit(5)"), ("C.java", '@GetMapping("/z")'), ("m.go", 'r.POST("/w", f)'), ("src/app/(shop)/orders/[id]/page.tsx", ""), ("app/page.js", "")], FILE
    )
    assert sorted((r.framework, r.method, r.route, r.line) for r in code_facts.routes(files).collect()) == [("express", "ANY", "/y", 2), ("go", "POST", "/w", 1), ("nestjs", "GET", "/x", 1), ("spring", "GET", "/z", 1)]
    assert rows(code_facts.screens(files).select("route")) == [("/",), ("/orders/[id]",)]
    hints = code_facts.behaviours(files)
    assert rows(hints.select("family", "signal", "line")) == [("pagination", "limit", 3), ("sort", "orderBy", 3)]
    assert rows(code_facts.kinds_of(hints)) == [("list",)]


def test_proofs(spark):
    files = spark.createDataFrame([("a.ts", "one\ntwo\nthree\ntwo"), ("b.ts", "x\ny")], FILE)
    hashes = {(r.file, r.line): r.hash for r in proofs.line_hashes(files).collect()}
    data = [("a.ts", 1, hashes["a.ts", 1]), ("a.ts", 9, hashes["a.ts", 3]), ("a.ts", 9, hashes["a.ts", 2]), ("b.ts", 1, "none"), ("gone.ts", 1, "h")]
    recorded = spark.createDataFrame(data, "file string, line long, hash string")
    got = {(r.file, r.line, r.state): r.now for r in proofs.locate_proofs(recorded, files).collect()}
    assert got == {("a.ts", 1, "intact"): 1, ("a.ts", 9, "moved"): 3, ("a.ts", 9, "broken: ambiguous"): None, ("b.ts", 1, "broken: text not found"): None, ("gone.ts", 1, "broken: file deleted"): None}
    refs = proofs.proof_references(spark.createDataFrame([("p", "src/a.ts:3 and b.py:10-12.")], "page string, text string"))
    assert rows(refs) == [("p", 0, "src/a.ts", 3, 3), ("p", 1, "b.py", 10, 12)]
    cites = refs.select("page", "file", "lo", "hi")
    touched = spark.createDataFrame([("b.py", 12, 20)], "file string, lo long, hi long")
    states = spark.createDataFrame([("p", "intact"), ("p", "broken: ambiguous")], "page string, state string")
    assert rows(proofs.page_drift(cites, touched, states)) == [("p", 1, 1, 1)]


def test_keys_and_paths(spark):
    code = spark.createDataFrame([("a", "t('x') + t(\"a.b\") + 'menu.item.one' fetch(`/api/users/${id}/x`) get('/one') '/v1/a'")], FILE)
    assert {r.key for r in proofs.message_keys(code).collect()} == {"x", "a.b", "menu.item.one"}
    assert {r.path for r in proofs.api_paths(code).collect()} == {"/api/users/:param/x", "/v1/a"}


def test_latest_records(spark):
    df = spark.createDataFrame([("k", "1.9.0", 1), ("k", "1.10.0", 2), ("j", "x", 3)], "k string, version string, n int")
    assert rows(proofs.latest_records(df, "k")) == [("j", "x", 3), ("k", "1.10.0", 2)]


def test_board(spark):
    df = spark.createDataFrame([("F-1", "E1", "Orders", "1.0", [("1.1", "As a buyer")]), ("F-2", "E2", "Stock", "1.1", [])], "feature string, epic string, title string, version string, stories array<struct<version:string,title:string>>")
    assert [r.feature for r in backlog.board(df, version="1.1").orderBy("feature").collect()] == ["F-1", "F-2"]
    assert [r.feature for r in backlog.board(df, text="BUYER").collect()] == ["F-1"]
    assert backlog.board(df, epic="E2", text="orders").isEmpty()


def test_flat_messages_keep_every_string_at_any_depth(spark):
    deep = '{"a":' * 60 + '"end"' + "}" * 60
    odd = r'{"y": "2024", "t": "true", "d": "[Draft] title", "o": "{\"k\": \"v\"}", "e": "", "n": 5, "b": true, "l": ["x"], "z": null, "h": "\ud800", "p": {"": "q"}}'
    df = spark.createDataFrame([(1, deep), (2, odd), (3, None), (4, "{bad"), (5, "[]"), (6, '{"a": {"b": "x"}, "a.b": "last"}')], "file long, json string")
    want = [(1, ".".join("a" * 60), "end"), (2, "d", "[Draft] title"), (2, "e", ""), (2, "h", "\ufffd"), (2, "o", '{"k": "v"}'), (2, "p.", "q"), (2, "t", "true"), (2, "y", "2024"), (6, "a.b", "last")]
    assert sorted(tuple(r) for r in proofs.flat_messages(df).collect()) == want
