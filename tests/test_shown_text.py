"""Shown text with its map to the html, and private registries."""

from conftest import rows
from weft.operators import registries, shown_text

HTML = '<h1>A &amp;\n  B</h1><p title="t &lt;">x <b> y</b><!-- no --> z&nbsp;&#32;<code>q</code></p><script>if (a<b) "</p>"</script><img alt=\'i\n m\'/>end<br>'


def test_shown_text_and_places(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "a < b & c <"), (5, "<pre>no</pre>yes<style>p{}")], "page_id long, html string")
    pieces = shown_text.shown_pieces(pages)
    texts = {r.page_id: (r.text, r.breaks) for r in shown_text.shown_texts(pieces).collect()}
    body = "\nA & B\n\nx y z  q\n\n\nend\n"
    assert texts[1][0] == body + "\nt <\ni m" and texts[4][0] == "a < b & c <" and texts[5][0] == "\n\nyes\n" and set(texts) == {1, 4, 5}
    assert texts[1][1] == sorted({body.index(" y") + 1, body.index("y z") + 1, body.index("q"), body.index("q") + 1, body.index("end")})
    asked = [(1, i) for i in range(len(body) + 2)]
    found = {r.at: r.html_at for r in shown_text.html_places(pieces, spark.createDataFrame(asked, "page_id long, at long")).collect()}
    for c in "ABxyzq":
        assert HTML[found[body.index(c)]] == c
    assert HTML[found[body.index("&")] :].startswith("&amp;") and HTML[found[body.index("end") + 2]] == "d" and found[len(body) + 1] is None
    assert shown_text.shown_pieces(pages.where("false")).isEmpty()


def test_private_registries(spark):
    files = [
        (".npmrc", "registry=https://npm.corp.example/\n@a:registry=https://u:p@a.corp.example:8443/x\n; registry=https://no.example"),
        ("web/.npmrc", "@a:registry=https://registry.npmjs.org/\n@b:registry=https://b1.example\n@b:registry=https://b2.example"),
        ("srv/requirements.txt", "--extra-index-url https://py.corp.example/simple\n-r x.txt\n--index-url=https://pypi.org/simple"),
        ("pip.conf", "[global]\nindex-url = https://top.example\nextra-index-url = https://py.corp.example/simple"),
        ("null/.npmrc", None),
    ]
    manifests = [("package.json", "npm"), ("web/app/package.json", "npm"), ("srv/pyproject.toml", "pypi"), ("lib/setup.py", "pypi")]
    settings = registries.registry_settings(spark.createDataFrame(files, "file string, text string"))
    got = rows(registries.private_registries(spark.createDataFrame(manifests, "manifest string, ecosystem string"), settings).select("manifest", "scope", "host", "file", "line"))
    assert got == sorted(
        [
            ("package.json", "", "npm.corp.example", ".npmrc", 1),
            ("package.json", "@a", "a.corp.example", ".npmrc", 2),
            ("web/app/package.json", "", "npm.corp.example", ".npmrc", 1),
            ("web/app/package.json", "@b", "b2.example", "web/.npmrc", 3),
            ("srv/pyproject.toml", "+", "py.corp.example", "srv/requirements.txt", 1),
            ("lib/setup.py", "", "top.example", "pip.conf", 2),
            ("lib/setup.py", "+", "py.corp.example", "pip.conf", 3),
        ],
        key=repr,
    )
