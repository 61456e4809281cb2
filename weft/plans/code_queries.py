"""Queries of proofs, backlogs, criteria and code facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import backlog, code_facts, proofs
from weft.plans.inputs import load
from weft.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""WITH p AS (SELECT page_id AS page, 'see src/f' || (page_id % 7) || '.ts:' || (page_id % 50 + 1) || ' and lib/x.py:' || (page_id + 3) || '-' || (page_id + 9) AS text FROM pages)
    SELECT page, 0 AS n, 'src/f' || (page % 7) || '.ts' AS file, page % 50 + 1 AS lo, page % 50 + 1 AS hi FROM p UNION ALL SELECT page, 1, 'lib/x.py', page + 3, page + 9 FROM p"""
)
def proof_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    text = F.concat(F.lit("see src/f"), i % 7, F.lit(".ts:"), i % 50 + 1, F.lit(" and lib/x.py:"), i + 3, F.lit("-"), i + 9)
    return proofs.proof_references(table(spark, sf_dir, "pages").select(i.alias("page"), text.alias("text")))


LINES = """l AS (SELECT doc_id AS file, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    h AS (SELECT file, lang, CAST(line AS BIGINT) AS line, md5(trim(l)) AS hash FROM l)"""


@query(
    f"""WITH {LINES}, p AS (SELECT file, lang, CASE WHEN file % 3 = 0 THEN line ELSE line + 1 END AS line, CASE WHEN file % 11 = 0 THEN md5('gone') ELSE hash END AS hash FROM h WHERE line = 2),
    n AS (SELECT file, hash, list_sort(list_distinct(list(line))) AS lines FROM h WHERE lang <> 'de' GROUP BY ALL),
    j AS (SELECT p.*, n.lines, p.lang <> 'de' AS there FROM p LEFT JOIN n ON n.file = p.file AND n.hash = p.hash),
    s AS (SELECT *, CASE WHEN NOT there THEN 'broken: file deleted' WHEN list_contains(lines, line) THEN 'intact' WHEN lines IS NULL THEN 'broken: text not found' WHEN len(lines) > 1 THEN 'broken: ambiguous' ELSE 'moved' END AS state FROM j)
    SELECT file, line, hash, state, CASE state WHEN 'moved' THEN lines[1] WHEN 'intact' THEN line END AS now FROM s"""
)
def locate_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "docs").select(F.col("doc_id").alias("file"), "text", "lang")
    hashed = proofs.line_hashes(docs.drop("lang")).where("line = 2")
    recorded = hashed.select("file", F.when(F.col("file") % 3 == 0, F.col("line")).otherwise(F.col("line") + 1).alias("line"), F.when(F.col("file") % 11 == 0, F.md5(F.lit("gone"))).otherwise(F.col("hash")).alias("hash"))
    return proofs.locate_proofs(recorded, docs.where("lang <> 'de'").drop("lang"))


@query(
    """WITH r AS (SELECT c_custkey AS file, 'k' || c_nationkey AS key, c_mktsegment AS old FROM customer), l AS (SELECT c_custkey AS file, 'k' || c_nationkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS new FROM customer WHERE c_acctbal > 0)
    SELECT r.file, r.key, old, new FROM r LEFT JOIN l ON l.file = r.file AND l.key = r.key WHERE old IS DISTINCT FROM new AND old IN ('BUILDING', 'MACHINERY')"""
)
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("k"), "c_nationkey").alias("key")
    recorded = c.select(F.col("c_custkey").alias("file"), key, F.col("c_mktsegment").alias("value"))
    now = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("file"), key, F.when(F.col("c_custkey") % 3 == 0, "new").otherwise(F.col("c_mktsegment")).alias("value"))
    cited = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "value string")
    return proofs.label_changes(now, recorded, cited)


@query(
    """WITH j AS (SELECT event_id AS file, '{"a": {"b": "x' || event_id || '", "n": 5}, "c": "' || event_type || '", "k": ' || user_id || '}' AS json FROM events)
    SELECT event_id AS file, 'a.b' AS key, 'x' || event_id AS value FROM events UNION ALL SELECT event_id, 'c', event_type FROM events"""
)
def flat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"a": {"b": "x'), "event_id", F.lit('", "n": 5}, "c": "'), "event_type", F.lit('", "k": '), "user_id", F.lit("}"))
    return proofs.flat_messages(e.select(F.col("event_id").alias("file"), text.alias("json")))


@query(
    """WITH f AS (SELECT p_partkey AS feature, p_brand AS epic, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END END AS a, CASE WHEN p_size % 5 > 0 THEN (p_size % 3)::DOUBLE / (p_size % 5) END AS b, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 2)::DOUBLE / (p_partkey % 7) END AS c FROM part),
    n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s FROM f)
    SELECT feature, epic, CASE WHEN n > 0 THEN CAST(floor(100 * s / n + 0.5) AS BIGINT) END AS score FROM n"""
)
def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.feature_scores(_features(spark, sf_dir))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("feature"), F.col("p_brand").alias("epic"), F.when(p % 4 != 0, p % 3 == 0).alias("conformant"), (F.col("p_size") % 5).alias("stories"), (F.col("p_size") % 3).alias("with_criteria"), (p % 2).alias("answered"), (p % 7).alias("rubrics")
    )


@query(
    "WITH s AS (" + "SELECT epic, score FROM (" + """WITH f AS (SELECT p_partkey AS feature, p_brand AS epic, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END END AS a, CASE WHEN p_size % 5 > 0 THEN (p_size % 3)::DOUBLE / (p_size % 5) END AS b, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 2)::DOUBLE / (p_partkey % 7) END AS c FROM part),
    n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s FROM f)
    SELECT epic, CASE WHEN n > 0 THEN floor(100 * s / n + 0.5) END AS score FROM n)) SELECT epic, CAST(floor(avg(coalesce(score, 0)) + 0.5) AS BIGINT) AS score FROM s GROUP BY 1"""
)
def epic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.epic_scores(backlog.feature_scores(_features(spark, sf_dir)))


@query(
    """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), f AS (SELECT c_custkey, c_nationkey AS epic, coalesce(n, 0) AS n FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE c_acctbal > 0)
    SELECT n_nationkey AS epic, CAST(count(c_custkey) AS INT) AS n_features, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_stories FROM nation LEFT JOIN f ON epic = n_nationkey GROUP BY 1"""
)
def backlog_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").where("c_acctbal > 0"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    found = backlog.hierarchy(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("epic")),
        c.select(F.col("c_custkey").alias("feature"), F.col("c_nationkey").alias("epic")),
        o.select(F.col("o_orderkey").alias("story"), F.col("o_custkey").alias("feature"), (F.col("o_orderkey") % 3).alias("criteria")),
        c.select(F.concat(F.lit("R"), "c_custkey").alias("rule"), F.col("c_custkey").alias("feature")),
    )
    return found.select("epic", F.coalesce(F.size("features"), F.lit(0)).alias("n_features"), "n_stories")


@query(
    """WITH i AS (SELECT s_suppkey AS space, 'written' AS indicator, s_acctbal / 10000 AS value FROM supplier UNION ALL SELECT s_suppkey, 'broken', CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_nationkey END FROM supplier),
    t(level, criterion, indicator, threshold, at_most) AS (VALUES (1, 'written1', 'written', 0.2, false), (2, 'written2', 'written', 0.6, false), (2, 'broken2', 'broken', 10, true), (3, 'home3', 'home', 1, false)),
    c AS (SELECT s.space, t.level, t.criterion, CASE WHEN value IS NULL THEN true WHEN at_most THEN value <= threshold + 1e-9 ELSE value >= threshold - 1e-9 END AS ok FROM (SELECT DISTINCT space FROM i) s CROSS JOIN t LEFT JOIN i ON i.space = s.space AND i.indicator = t.indicator)
    SELECT space, level, criterion, ok FROM c"""
)
def audit_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    indicators = s.select(F.col("s_suppkey").alias("space"), F.lit("written").alias("indicator"), (F.col("s_acctbal") / 10000).alias("value")).unionByName(
        s.select(F.col("s_suppkey").alias("space"), F.lit("broken").alias("indicator"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey").cast("double")).alias("value"))
    )
    rows = [(1, "written1", "written", 0.2, False), (2, "written2", "written", 0.6, False), (2, "broken2", "broken", 10.0, True), (3, "home3", "home", 1.0, False)]
    return backlog.criteria(indicators, spark.createDataFrame(rows, "level int, criterion string, indicator string, threshold double, at_most boolean"))


@query("SELECT p_partkey AS page, CAST(p_size * 100 + 1800 AS BIGINT) AS tokens_in, CAST(floor(0.42 * (p_partkey % 900) + 0.5) AS BIGINT) AS tokens_out, round(((p_size * 100 + 1800) * 3.0 + floor(0.42 * (p_partkey % 900) + 0.5) * 15.0) / 1e6, 8) AS cost FROM part")
def update_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), (F.col("p_size").cast("long") * 100).alias("context_tokens"), (F.col("p_partkey") % 900).alias("max_words"))
    return backlog.update_estimate(pages, 3.0, 15.0).withColumn("cost", F.round("cost", 8))


@query(
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS method, CASE p_partkey % 3 WHEN 0 THEN 'src/a' || p_partkey || '.ts' WHEN 1 THEN 'src/a' || p_partkey || '.py' ELSE 'src/b' || p_partkey || '.py' END AS file FROM part)
    SELECT method, '/p/' || p_partkey AS route, file, 2 AS line, CASE method WHEN 'GET' THEN 'express' WHEN 'POST' THEN 'fastapi' ELSE 'flask' END AS framework FROM f"""
)
def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    file = F.when(p % 3 == 0, F.concat(F.lit("src/a"), p, F.lit(".ts"))).when(p % 3 == 1, F.concat(F.lit("src/a"), p, F.lit(".py"))).otherwise(F.concat(F.lit("src/b"), p, F.lit(".py")))
    text = F.when(p % 3 == 0, F.concat(F.lit("import x\napp.get('/p/"), p, F.lit("', h)"))).when(p % 3 == 1, F.concat(F.lit("x\n@api.post(\"/p/"), p, F.lit('")'))).otherwise(F.concat(F.lit("x\n@bp.route('p/"), p, F.lit("')")))
    return code_facts.routes(table(spark, sf_dir, "part").select(file.alias("file"), text.alias("text")))


@query(
    """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'deploy/prod/app' WHEN 1 THEN 'test.staging' WHEN 2 THEN 'Dev' WHEN 3 THEN 'unknown' ELSE 'qa-live' END AS n FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'development' WHEN 4 THEN 'production' END AS env FROM v"""
)
def environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE event_id % 5 WHEN 0 THEN 'deploy/prod/app' WHEN 1 THEN 'test.staging' WHEN 2 THEN 'Dev' WHEN 3 THEN 'unknown' ELSE 'qa-live' END")
    return table(spark, sf_dir, "events").select("event_id", code_facts.environment_of(name).alias("env"))


@query(
    """WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'reg.io:5000/a/b:1.' || p_size WHEN 1 THEN 'nginx' WHEN 2 THEN 'org/app:v' || p_size || '@sha256:abc123' ELSE 'reg.io:5000/x' END AS image FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'reg.io:5000/a/b' WHEN 1 THEN 'nginx' WHEN 2 THEN 'org/app' ELSE 'reg.io:5000/x' END AS image, (SELECT CASE p_partkey % 4 WHEN 0 THEN '1.' || p.p_size WHEN 2 THEN 'v' || p.p_size END FROM part p WHERE p.p_partkey = i.p_partkey) AS tag FROM i"""
)
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('reg.io:5000/a/b:1.', p_size) WHEN 1 THEN 'nginx' WHEN 2 THEN concat('org/app:v', p_size, '@sha256:abc123') ELSE 'reg.io:5000/x' END")
    repository, tag = code_facts.image_parts(image)
    return table(spark, sf_dir, "part").select("p_partkey", repository.alias("image"), tag.alias("tag"))


@query(
    """WITH i AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'test' ELSE 'edge' END AS env, o_orderpriority || '/' || o_orderstatus AS item FROM orders)
    SELECT env, CASE env WHEN 'production' THEN 3 WHEN 'test' THEN 1 ELSE 9 END AS rank, CAST(count(DISTINCT item) AS INT) AS items FROM i GROUP BY 1"""
)
def deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    env = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'test' ELSE 'edge' END")
    found = code_facts.deployment(o.select(env.alias("env"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("name")))
    return found.select("env", "rank", F.size("items").alias("items"))
