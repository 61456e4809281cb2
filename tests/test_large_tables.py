"""Queries on tables beyond those of the test data, and plans whose tables grow."""

import duckdb
from pyspark.sql import functions as F

from conftest import rows
from weft.operators import graph, imports, infra, joins, routes, signals, source_code, tables
from weft.plans import catalog


def test_candidate_ids_of_five_digits_are_those_of_the_sql(spark, tmp_path):
    part = spark.range(5, 50_100, 5).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        wanted = duck.execute(catalog.ORACLE_SQL["candidate_features"]).fetchall()
    got = catalog.QUERIES["candidate_features"](spark, str(tmp_path))
    assert len(wanted) == 10_019
    assert {tuple(r[:2]) for r in rows(got)} == {r[:2] for r in wanted}


def sends(df):
    """Whether a join of the plan sends a table through the driver."""
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_by_their_texts(spark):
    files = spark.range(24).select(F.concat(F.lit("f"), "id", F.lit(".js")).alias("file"), F.repeat(F.lit("f(a) {\n"), 60_000).alias("text"))
    assert tables.dealt(files).rdd.getNumPartitions() == 10
    plan = source_code.functions_in(source_code.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert tables.dealt(files.where("false")).rdd.getNumPartitions() == 4


def test_beginnings_of_names_are_not_sent(spark):
    files = spark.createDataFrame([("a/openapi.json", '{"paths": {"/x": {"get": {}}}}'), ("docs/a.md", "# A"), ("", None), (None, "")], "file string, text string")
    starts = spark.createDataFrame([("docs/", 1), ("d", 2), ("", 3), (None, 4), ("docs/a.md/b", 5)], "start string, n int")
    met = joins.met_by_start(files, starts, "file", "start")
    assert not sends(met)
    assert rows(met.select("file", "n")) == [("docs/a.md", 1), ("docs/a.md", 2)]
    assert joins.met_by_start(files, starts.where("false"), "file", "start").isEmpty()


def test_tables_that_grow_are_not_sent(spark):
    files = spark.createDataFrame([("s/docker-compose.yml", "services:\n  a:\n    image: b:1\n"), ("k.yaml", "apiVersion: v1\nkind: Secret\nmetadata:\n  name: k\n"), ("a.ts", 'import "./b"\n'), ("b.ts", "f(1)\n"), ("m.tf", 'module "n" {\n  a = 1\n}\n')], "file string, text string")
    paths = infra.yaml_paths(files.where("file LIKE '%.y%ml'"))
    assert not sends(infra.compose_rows(paths)) and not sends(infra.kubernetes_rows(paths)) and not sends(infra.terraform_rows(files))
    assert not sends(imports.resolved_imports(files))
    scripts = files.where("file LIKE '%.ts'")
    assert not sends(signals.signals(scripts, "brace")) and not sends(routes.spring_routes(scripts)) and not sends(routes.rails_routes(scripts))
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long")
    found = graph.strong_components(edges)
    assert not sends(found) and rows(found) == [(1, 1, 2), (2, 1, 2)]
