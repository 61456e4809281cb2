"""Queries of other tools' files, interface descriptions, schemas and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.file_queries import folder, table
from weft.plans.registry import query
from weft.sources import reports


@query("""SELECT r_name AS id, 'Part ' || r_regionkey AS title, list_sort(list('/' || n_name)) AS routes, 1 AS problems FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def listed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("/"), "n_name"))).alias("routes"))
    one = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.array(F.struct(F.col("r_name").alias("id"), F.concat(F.lit("Part "), "r_regionkey").alias("title"), "routes")).alias("features"))
    one.write.option("maxRecordsPerFile", 1).json(path)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    good, bad = reports.read_features(spark, path)
    return good.crossJoin(F.broadcast(bad.agg(F.count("*").alias("problems"))))  # one row


@query("""SELECT 'S' || s_suppkey AS title, '/s' AS route, z AS n, z * 1.5::DOUBLE AS x, 2.0::DOUBLE AS y, 10.0::DOUBLE AS w, CAST(s_nationkey AS DOUBLE) AS h, s_name AS label FROM supplier, (VALUES (1), (2)) AS v(z)""")
def zone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    zone = lambda n: F.struct(F.lit(n).alias("n"), F.lit(n * 1.5).alias("x"), F.lit(2.0).alias("y"), F.lit(10.0).alias("w"), F.col("s_nationkey").cast("double").alias("h"), F.col("s_name").alias("label"))
    shot = F.struct(F.concat(F.lit("S"), "s_suppkey").alias("title"), F.lit("/s").alias("route"), F.array(zone(1), zone(2)).alias("zones"))
    # A file holds a list of a hundred descriptions.
    table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 100)).agg(F.to_json(F.collect_list(shot)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return reports.read_zones(spark, path)


@query("""SELECT 'leak-' || n_regionkey AS rule, n_name AS file, n_nationkey AS line, 'gitleaks' AS tool FROM nation UNION ALL SELECT 'sem-' || n_regionkey, n_name, n_nationkey + 1, 'semgrep' FROM nation UNION ALL SELECT 'CVE-' || n_nationkey, n_name, NULL, 'osv' FROM nation""")
def tool_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rule = lambda name: F.concat(F.lit(name), "n_regionkey")
    leaks, semgrep, osv = folder(spark), folder(spark), folder(spark)
    n.select(rule("leak-").alias("RuleID"), F.col("n_name").alias("File"), F.col("n_nationkey").alias("StartLine"), F.lit("hunter22").alias("Secret")).write.option("maxRecordsPerFile", 1).json(leaks)
    n.select(F.array(F.struct(rule("sem-").alias("check_id"), F.col("n_name").alias("path"), F.struct((F.col("n_nationkey") + 1).alias("line")).alias("start"))).alias("results")).write.option("maxRecordsPerFile", 1).json(semgrep)
    found = F.struct(F.array(F.struct(F.concat(F.lit("CVE-"), "n_nationkey").alias("id"))).alias("vulnerabilities"))
    n.select(F.array(F.struct(F.struct(F.col("n_name").alias("path")).alias("source"), F.array(found).alias("packages"))).alias("results")).write.option("maxRecordsPerFile", 1).json(osv)
    parts = [reports.read_findings(spark, path, tool).withColumn("tool", F.lit(tool)) for tool, path in (("gitleaks", leaks), ("semgrep", semgrep), ("osv", osv))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS kind, CASE WHEN c_nationkey % 5 = 0 THEN '''=' || c_name ELSE c_name END AS title, 'jira' AS target FROM customer WHERE c_acctbal > 0 UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), c_mktsegment, CASE WHEN c_nationkey % 5 = 0 THEN '=' || c_name ELSE c_name END, 'github' FROM customer WHERE c_acctbal > 0""")
def exported_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    title = F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name"))
    items = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("kind"), title.alias("title"), F.lit(None).cast("string").alias("parent"))
    linked = c.where("c_acctbal <= 0").select(F.col("c_custkey").cast("string").alias("id"))
    jira, github = folder(spark), folder(spark)
    reports.write_backlog(items, linked, jira, "jira")
    reports.write_backlog(items, linked, github, "github")
    one = spark.read.option("header", "true").option("escape", '"').csv(jira).select(F.col("Issue ID").alias("id"), F.col("Issue Type").alias("kind"), F.col("Summary").alias("title"), F.lit("jira").alias("target"))
    return one.unionByName(spark.read.schema("id string, kind string, title string").json(github).withColumn("target", F.lit("github")))


@query("""SELECT p_partkey AS file, 'GET' AS method, '/p/{id}' AS route, 'id' AS name, 'path' AS place, true AS required FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'GET', '/p/{id}', 'q' || p_size, 'query', false FROM part WHERE p_size % 2 = 0""")
def openapi_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"openapi": "3.0", "paths": {"/p/{id}": {"get": {"parameters": [{"name": "id", "in": "path", "required": true}, {"name": "q'), "p_size", F.lit('", "in": "query"}]}, "post": {}}}}'))
    return reports.described_parameters(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.when(F.col("p_size") % 2 == 0, text).when(F.col("p_size") % 4 == 1, '{"paths": {}}').otherwise("broken").alias("text")))


@query("""SELECT p_partkey AS file, 'name' AS field, unnest(['min', 'email']) AS signal, unnest([CAST(p_size AS VARCHAR), NULL]) AS value FROM part UNION ALL SELECT p_partkey, 'age', 'max', CAST(p_size + 1 AS VARCHAR) FROM part""")
def schema_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("x = { name: z.string().min("), "p_size", F.lit(").email(), other: z.any() }\nage: int = Field(le="), F.col("p_size") + 1, F.lit(", title='x')"))
    return reports.schema_signals(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), text.alias("text")))


@query("""SELECT 'm' || p_partkey || '.py' AS file, 'f' || p_size AS name, 2 AS line, 4 AS lines, 4 AS complexity FROM part UNION ALL SELECT 'm' || p_partkey || '.py', 'g', 10, 2, 1 FROM part""")
def function_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("import x\ndef f"), "p_size", F.lit("(a):\n    # if\n    if a and b:\n        return 1\n    for i in a: pass\n\ny = 1 if x else 2\n\nasync def g():\n    return 2\nz = g or f\n"))
    return reports.code_functions(table(spark, sf_dir, "part").select(F.concat(F.lit("m"), "p_partkey", F.lit(".py")).alias("file"), text.alias("text")))


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || '- one' || chr(10) || '- ' || p_brand || ' < 3' || chr(10) || 'end & done' AS text FROM part""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<html><head><title>x</title></head><body><script>if (a<b) {}</script><h1 class='a'>"), "p_name", F.lit("</h1>\n<ul><li>one</li>\n<li><b>"), "p_brand", F.lit("</b> &lt; 3</li></ul><!-- no --><p>end &amp; done</p></body></html>"))
    return table(spark, sf_dir, "part").select("p_partkey", reports.page_text(html).alias("text"))
