"""Adapters as data sources, their shape, filters that reach them; inventories as table functions."""

import pytest
from conftest import rows

from weft.sources import adapters


def test_adapters_read_parts_and_take_filters(spark):
    read = lambda part, options, wanted: [(part, k, f"{options['mark']}{k}") for k in range(5) if "k" not in wanted or k in wanted["k"]]
    adapters.register_adapter(spark, adapters.Adapter("weft_numbers", "part int, k int, v string", lambda options: list(range(int(options["parts"]))), read, ("k",)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("weft_numbers").option("parts", 3).option("mark", "x").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 15
    assert rows(df.where("k = 2 AND v <> 'y'")) == [(0, 2, "x2"), (1, 2, "x2"), (2, 2, "x2")]
    assert df.where("k IN (1, 4) AND part = 0").count() == 2 and df.where("k = 9").isEmpty()
    for wrong, said in ((("Bad-Name", "k int", len, len, ()), "name"), (("a", "k nothing", len, len, ()), "schema"), (("a", "k int", 1, len, ("z",)), "parts: must be callable; keys: no column z")):
        with pytest.raises(ValueError, match=said):
            adapters.register_adapter(spark, adapters.Adapter(*wrong))


def test_inventories(spark):
    files = [("docs/a.md", "# Start here\ntext"), ("api/openapi.json", '{"paths": {"/x": {"get": {"summary": "List"}, "parameters": []}, "/y/{id}": {"delete": {}}}}'), ("web/app/(shop)/orders/[id]/page.tsx", ""), ("web/app/page.tsx", ""), ("msg/en.json", '{"menu": {"a": "Home", "b": {"label": "About"}, "c": 3}}'), ("bad/openapi.json", "{no"), ("null.md", None)]
    settings = [("docs", "glob", "docs/*.md", ".md"), ("api", "openapi", "", "openapi.json"), ("pages", "next-app-router", "", ".tsx"), ("menu", "i18n-registry", "menu", "en.json"), ("odd", "unknown", "", ".md")]
    got = adapters.inventories(spark.createDataFrame(settings, "name string, kind string, setting string, suffix string"), spark.createDataFrame(files, "file string, text string"), spark.createDataFrame([("GET /x", "All of x"), ("GET /x", "Every x")], "id string, label string"))
    assert rows(got) == sorted(
        [("docs", "docs/a.md", "Start here"), ("api", "GET /x", "All of x"), ("api", "DELETE /y/{id}", "DELETE /y/{id}"), ("pages", "/orders/[id]", "/orders/[id]"), ("pages", "/", "/"), ("menu", "a", "Home"), ("menu", "b", "About"), ("menu", "c", "c")],
        key=repr,
    )
