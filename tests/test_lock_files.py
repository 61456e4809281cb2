"""Lock files of each format: nested installs, ranges, versions, cycles, and what can't be read."""

import json

from conftest import rows
from weft.operators import lock_files

V3 = {
    "lockfileVersion": 3,
    "packages": {
        "": {"dependencies": {"a": "^1"}, "devDependencies": {"t": "1"}},
        "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "*", "x": "^2", "@s/y": "*"}},
        "node_modules/a/node_modules/x": {"version": "2.0.0", "optionalDependencies": {"b": "*"}},
        "node_modules/b": {"version": "1.1.0", "dependencies": {"x": "^1", "a": "*", "missing": "*"}},
        "node_modules/x": {"version": "1.2.0"},
        "node_modules/@s/y": {"version": "3.0.0", "dependencies": {"x": "^2"}},
        "node_modules/@s/y/node_modules/x": {"version": "2.5.0"},
        "node_modules/t": {"version": "9.0.0", "dev": True},
        "packages/w": {"version": "0.0.1"},
        "node_modules/w": {"resolved": "packages/w", "link": True},
    },
}
V1 = {"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "requires": {"x": "^2"}, "dependencies": {"x": {"version": "2.0.0", "requires": {"b": "*"}}}}, "b": {"version": "1.1.0", "dev": True, "requires": {"x": "^1"}}, "x": {"version": "1.2.0"}}}
YARN = '''# yarn lockfile v1


"@s/y@^3", "@s/y@^3.1":
  version "3.1.0"
  dependencies:
    x "^1.0.0"

a@^1:
  version "1.0.0"
  resolved "https://r/a"
  dependencies:
    "@s/y" "^3"
    x "^2"

x@^1.0.0:
  version "1.4.0"

x@^2:
  version "2.0.0"
'''
POETRY = '[[package]]\nname = "Django"\nversion = "5.0"\n\n[package.dependencies]\nasgi_ref = ">=3"\ntzdata = {version = "*", markers = "x"}\n\n[package.extras]\nno = ["bcrypt"]\n\n[[package]]\nname = "asgi-ref"\nversion = "3.8"\n'
UV = 'version = 1\n\n[[package]]\nname = "me"\nversion = "0.1"\nsource = { virtual = "." }\ndependencies = [\n    { name = "anyio" },\n]\n\n[[package]]\nname = "anyio"\nversion = "4.0"\nsource = { registry = "https://p" }\ndependencies = [\n    { name = "idna", marker = "x" },\n    { name = "sniffio" },\n]\n\n[[package]]\nname = "idna"\nversion = "3.7"\nsource = { registry = "https://p" }\n\n[[package]]\nname = "sniffio"\nversion = "1.3"\nsource = { registry = "https://p" }\n'
CARGO = '[[package]]\nname = "me"\nversion = "0.1.0"\ndependencies = [\n "rand 0.8.5",\n "serde",\n]\n\n[[package]]\nname = "rand"\nversion = "0.8.5"\nsource = "r"\ndependencies = [\n "rand 0.7.3",\n]\n\n[[package]]\nname = "rand"\nversion = "0.7.3"\nsource = "r"\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\nsource = "r"\n'


def test_installs_edges_and_chains(spark):
    data = [("n/package-lock.json", json.dumps(V3)), ("o/package-lock.json", json.dumps(V1)), ("o/package.json", '{"dependencies": {"a": "^1"}}'), ("y/yarn.lock", YARN), ("y/package.json", '{"dependencies": {"a": "^1"}}')]
    data += [("p/poetry.lock", POETRY), ("u/uv.lock", UV), ("c/Cargo.lock", CARGO), ("bad/package-lock.json", "{not json"), ("null/yarn.lock", None), ("empty/Cargo.lock", "")]
    installs, edges = lock_files.locked_packages(spark.createDataFrame(data, "file string, text string"))
    of = lambda df, m, *c: [x[1:] for x in rows(df.select("manifest", *c)) if x[0] == m]
    nm = "node_modules/"
    assert of(installs, "n/package-lock.json", "key", "version", "dev", "direct") == sorted(
        [
            (nm + "a", "1.0.0", False, True),
            (nm + "a/" + nm + "x", "2.0.0", False, False),
            (nm + "b", "1.1.0", False, False),
            (nm + "x", "1.2.0", False, False),
            (nm + "@s/y", "3.0.0", False, False),
            (nm + "@s/y/" + nm + "x", "2.5.0", False, False),
            (nm + "t", "9.0.0", True, True),
        ],
        key=repr,
    )
    assert of(edges, "n/package-lock.json", "src", "dst") == sorted(
        [(nm + "a", nm + "b"), (nm + "a", nm + "a/" + nm + "x"), (nm + "a", nm + "@s/y"), (nm + "a/" + nm + "x", nm + "b"), (nm + "b", nm + "x"), (nm + "b", nm + "a"), (nm + "@s/y", nm + "@s/y/" + nm + "x")], key=repr
    )
    assert of(installs, "o/package-lock.json", "key", "version", "dev", "direct") == sorted([(nm + "a", "1.0.0", False, True), (nm + "a/" + nm + "x", "2.0.0", False, False), (nm + "b", "1.1.0", True, False), (nm + "x", "1.2.0", False, False)], key=repr)
    assert of(edges, "o/package-lock.json", "src", "dst") == sorted([(nm + "a", nm + "a/" + nm + "x"), (nm + "a/" + nm + "x", nm + "b"), (nm + "b", nm + "x")], key=repr)
    assert of(installs, "y/yarn.lock", "key", "direct") == sorted([("@s/y@3.1.0", False), ("a@1.0.0", True), ("x@1.4.0", False), ("x@2.0.0", False)], key=repr)
    assert of(edges, "y/yarn.lock", "src", "dst") == sorted([("@s/y@3.1.0", "x@1.4.0"), ("a@1.0.0", "@s/y@3.1.0"), ("a@1.0.0", "x@2.0.0")], key=repr)
    assert of(edges, "p/poetry.lock", "src", "dst") == [("django@5.0", "asgi-ref@3.8")]
    assert of(installs, "u/uv.lock", "name", "direct") == sorted([("anyio", True), ("idna", False), ("sniffio", False)], key=repr)
    assert of(edges, "u/uv.lock", "src", "dst") == [("anyio@4.0", "idna@3.7"), ("anyio@4.0", "sniffio@1.3")]
    assert of(installs, "c/Cargo.lock", "key", "direct") == sorted([("rand@0.8.5", True), ("rand@0.7.3", False), ("serde@1.0.1", True)], key=repr)
    assert of(edges, "c/Cargo.lock", "src", "dst") == [("rand@0.8.5", "rand@0.7.3")]
    chains = lock_files.via_chains(installs, edges)
    assert of(chains, "n/package-lock.json", "name", "via") == [("@s/y", ["a"]), ("b", ["a"]), ("x", ["a"])]
    assert of(chains, "u/uv.lock", "name", "via") == [("idna", ["anyio"]), ("sniffio", ["anyio"])]
    assert of(lock_files.via_chains(installs, edges, most=1), "o/package-lock.json", "name", "via") == [("x", ["a"])]
    assert of(chains, "o/package-lock.json", "name", "via") == [("b", ["a", "x"]), ("x", ["a"])]
