"""Queries of sources and sinks: each writes files below the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import code_facts, proofs
from weft.operators.tables import shared_folder
from weft.plans.inputs import cte, load
from weft.plans.registry import query
from weft.sources import files, logs


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT 'src' AS folder, 'text' AS format, 1 AS files, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, 1 AS readable FROM customer
    UNION ALL SELECT 'docs', 'text', 1, CAST(sum(strlen(n_name) + 1) AS BIGINT), CASE WHEN sum(strlen(n_name) + 1) <= 300 THEN 1 ELSE 0 END FROM nation"""
)
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of a project and one that is never listed."""
    root = folder(spark)
    customers, nations = table(spark, sf_dir, "customer").select("c_name"), table(spark, sf_dir, "nation").select("n_name")
    customers.coalesce(1).write.text(f"{root}/src/app")
    customers.coalesce(1).write.text(f"{root}/node_modules/x")
    nations.coalesce(1).write.text(f"{root}/docs")
    small = files.list_files(spark, root, most_bytes=300, globs=("docs/**",)).unionByName(files.list_files(spark, root, most_bytes=1 << 40, globs=("src/**",)))
    kept = small.unionByName(files.list_files(spark, root, globs=("node_modules/**",)))
    return kept.groupBy(F.split("path", "/")[0].alias("folder"), files.format_of("path").alias("format")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count("content").alias("readable"))


@query(cte("usage") + ", u AS (SELECT *, coalesce(actor, 'kit') AS who FROM usage) SELECT version, who AS actor, step, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM u GROUP BY ALL")
def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans appended in two goes to a log of JSON lines, with a broken line among them."""
    path = folder(spark)
    tokens = F.struct(F.col("tokens_in").alias("in"), F.col("tokens_out").alias("out"))
    spans = load(spark, sf_dir, "usage").select("id", "at", "version", "run", "step", "sub", "part", "ms", "actor", "model", tokens.alias("tokens"), F.array("page").alias("pages"))
    for half in (0, 1):
        logs.append_usage(spans.where(F.col("id") % 2 == half).drop("id"), path)
    spark.createDataFrame([("not json",), ('{"no": "ms"}',), ("",)], "value string").write.mode("append").text(f"{path}/v=broken")
    return logs.read_usage(spark, path).groupBy("version", "actor", "step").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.sum("tokens.in").alias("tokens_in"))


@query("SELECT 'api' AS source, 'c0ffee' AS \"commit\", CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || p_brand || '/' || p_partkey AS route, p_type AS file FROM part")
def facts_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    items = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_partkey").alias("route"), F.col("p_type").alias("file"))
    files.write_facts(items, path, "api", "weft", "2026-01-01", "c0ffee", "shop")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    return files.read_facts(spark, path, "method:string,route:string,file:string")


@query(cte("usage") + ' SELECT "at", version, step, CAST(ms AS VARCHAR) AS ms, CAST(tokens_in AS VARCHAR) AS tokens_in, page || \' \' || page AS pages FROM usage')
def usage_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    spans = load(spark, sf_dir, "usage").withColumns({"command": F.lit("x"), "phase": F.lit("y"), "pages": F.array("page", "page"), "tokens": F.struct(F.col("tokens_in").alias("in"), F.col("tokens_out").alias("out"), F.col("cache_read").alias("cacheRead"), F.col("cache_write").alias("cacheWrite"))})
    logs.write_csv(logs.usage_report(spans), path, safe=False)
    return spark.read.option("header", "true").option("escape", '"').csv(path).select("at", "version", "step", "ms", "tokens_in", "pages")


@query("""WITH s AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '@' WHEN 3 THEN '"' ELSE '' END || p_name || ', x' AS cell FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN left(cell, 1) IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM s""")
def safe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    sign = F.expr("""CASE p_size % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '@' WHEN 3 THEN '"' ELSE '' END""")
    logs.write_csv(table(spark, sf_dir, "part").select("p_partkey", F.concat(sign, "p_name", F.lit(", x")).alias("cell")), path)
    return spark.read.option("header", "true").option("escape", '"').csv(path)


@query("""WITH r AS (SELECT '1.' || s_nationkey || '.' || s_suppkey AS version, s_suppkey AS total, s_nationkey % 4 AS branch, s_nationkey AS a, s_suppkey AS b FROM supplier)
    SELECT branch, version, total FROM r QUALIFY row_number() OVER (PARTITION BY branch ORDER BY a DESC, b DESC) = 1""")
def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records in files of a hundred, and a broken one; the latest version of each branch."""
    path = folder(spark)
    s = table(spark, sf_dir, "supplier")
    records = s.select(F.concat(F.lit("1."), "s_nationkey", F.lit("."), "s_suppkey").alias("version"), F.lit("2026-01-01").alias("generated"), F.col("s_suppkey").alias("total"))
    listed = records.groupBy(F.floor(F.col("total") / 100)).agg(F.to_json(F.collect_list(F.struct(*records.columns))).alias("value"))
    listed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    found = files.change_records(spark, path)
    branch = F.split_part("version", F.lit("."), F.lit(2)).cast("long") % 4
    return proofs.latest_records(found.withColumn("branch", branch), "branch").select("branch", "version", "total")


@query("""SELECT r_name AS section, dense_rank() OVER (ORDER BY r_regionkey) - 1 AS section_pos, r_name || ' group' AS "group", 0 AS group_pos, n_name AS page, 'Page ' || n_nationkey AS title, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS page_pos
    FROM nation JOIN region ON r_regionkey = n_regionkey""")
def outline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    page = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("id"), F.concat(F.lit("Page "), "n_nationkey").alias("title"))
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias("pages"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    section = F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("id"), F.col("r_name").alias("title"), F.array(F.struct(F.concat("r_name", F.lit(" group")).alias("title"), "pages")).alias("groups"))
    r.agg(F.array_sort(F.collect_list(section)).alias("sections")).write.json(path)
    return files.read_outline(spark, path).withColumns({c: F.col(c).cast("long") for c in ("section_pos", "group_pos", "page_pos")})


@query("SELECT 'p' || p_partkey AS page, CAST(p_size AS VARCHAR) AS version, md5(p_name) AS hash FROM part")
def sync_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync reference for each brand, its pages a map with its keys in order."""
    path = folder(spark)
    state = F.struct(F.concat(F.lit("p"), "p_partkey").alias("key"), F.struct(F.col("p_size").cast("string").alias("version"), F.md5("p_name").alias("hash")).alias("value"))
    maps = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(state)).alias("m"))
    maps.select(F.concat(F.lit('{"version":"1","pages":'), files.canonical_map(F.col("m")), F.lit("}")).alias("value")).write.text(path)
    one_a_line = spark.read.text(path).select(F.from_json("value", "version string, pages map<string,struct<version:string,hash:string>>").alias("s"))
    other = folder(spark)
    one_a_line.select("s.*").write.option("maxRecordsPerFile", 1).json(other)
    return files.read_states(spark, other)


@query("""SELECT o_orderkey AS file, 2 AS line, 'TOKEN_' || o_orderstatus AS name, o_orderpriority || ' #1' AS value FROM orders UNION ALL SELECT o_orderkey, 3, 'HOST', 'h' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 5, 'EMPTY', '' FROM orders""")
def env_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# settings\nexport TOKEN_"), "o_orderstatus", F.lit('="'), "o_orderpriority", F.lit(' #1"\r\nHOST=h'), "o_custkey", F.lit("  # comment\nnot a line\nEMPTY=\n9BAD=1"))
    return files.parse_env(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), text.alias("text")))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), n AS (
    SELECT 'npm' AS ecosystem, 'lib-' || s AS name, '^' || s || '.0.0' AS spec, false AS dev, 'app' || k || '/package.json' AS manifest FROM p WHERE k % 5 = 0
    UNION ALL SELECT 'npm', '@x/dev', '1', true, 'app' || k || '/package.json' FROM p WHERE k % 5 = 0
    UNION ALL SELECT 'pypi', 'pkg.' || s, '>=' || s || ',<99', true, 'requirements-dev' || k || '.txt' FROM p WHERE k % 5 = 1
    UNION ALL SELECT 'cargo', 'crate' || s, '0.' || s, false, 'c' || k || '/Cargo.toml' FROM p WHERE k % 5 = 2
    UNION ALL SELECT 'cargo', 'dev' || s, '1', true, 'c' || k || '/Cargo.toml' FROM p WHERE k % 5 = 2
    UNION ALL SELECT 'go', 'ex.com/m' || s, 'v1.' || s || '.0', false, 'g' || k || '/go.mod' FROM p WHERE k % 5 = 3
    UNION ALL SELECT 'gem', 'gem' || s, NULL, false, 'r' || k || '/Gemfile' FROM p WHERE k % 5 = 4) SELECT * FROM n"""
)
def declared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('app', p_partkey, '/package.json') WHEN 1 THEN concat('requirements-dev', p_partkey, '.txt') WHEN 2 THEN concat('c', p_partkey, '/Cargo.toml') WHEN 3 THEN concat('g', p_partkey, '/go.mod') ELSE concat('r', p_partkey, '/Gemfile') END")
    text = F.expr(
        """CASE p_partkey % 5 WHEN 0 THEN concat('{"dependencies": {"lib-', p_size, '": "^', p_size, '.0.0"}, "devDependencies": {"@x/dev": "1"}, "scripts": {"a": "b"}}')
        WHEN 1 THEN concat('# list\npkg.', p_size, '>=', p_size, ',<99\n-r other.txt') WHEN 2 THEN concat('[package]\nname = "me"\n[dependencies]\ncrate', p_size, ' = { version = "0.', p_size, '" }\n[dev-dependencies]\ndev', p_size, ' = "1"')
        WHEN 3 THEN concat('module me\nrequire (\n\tex.com/m', p_size, ' v1.', p_size, '.0\n)') ELSE concat('source "x"\n  gem "gem', p_size, '"') END"""
    )
    return code_facts.manifests(table(spark, sf_dir, "part").select(file.alias("file"), text.alias("text")))
