"""Queries of joins, set comparisons, graphs, filters and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import aggregates, filters, graph, joins, state
from weft.plans.inputs import cte, load
from weft.plans.registry import query


@query(
    cte("commits", "quality")
    + """, h AS (SELECT path AS file, count(*) AS commits FROM commits GROUP BY 1)
    SELECT file, commits, CAST(commits * coalesce(nullif(complexity, 0), nullif(CAST(ceil(lines / 50.0) AS BIGINT), 0), 1) AS BIGINT) AS score FROM h JOIN quality USING (file)"""
)
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = aggregates.file_history(load(spark, sf_dir, "commits"), limit=None).select("file", "commits")
    return joins.hotspots(history, load(spark, sf_dir, "quality"))


FOLDED = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
COVERED = f"""WITH t AS (SELECT doc_id, {FOLDED.format('text')} AS t FROM documents),
    m AS (SELECT DISTINCT item_id, item_id % 3 = 0 AS whole, {FOLDED.format('unnest(string_split(text, chr(46)) || [left(text, 4), split_part(text, chr(32), 2)])')} AS m FROM benchmark),
    h AS (SELECT DISTINCT item_id, doc_id FROM m, t WHERE m <> '' AND CASE WHEN NOT contains(t, m) THEN false WHEN NOT whole THEN true ELSE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(m) || '($|[^\\p{{L}}\\p{{N}}])') END),
    c AS (SELECT item_id, min(doc_id) AS first, count(doc_id) AS texts FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN h USING (item_id) GROUP BY 1)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of each benchmark text, its first four characters and its second word, in the whole documents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    spellings = F.concat(F.split("text", r"\."), F.array(F.substring("text", 1, 4), F.split_part("text", F.lit(" "), F.lit(2))))
    items = b.select("item_id", spellings.alias("match"), (F.col("item_id") % 3 == 0).alias("whole"))
    return joins.covered(items, load(spark, sf_dir, "docs"), "item_id", "match", "doc_id", "text", "whole")


@query(COVERED + " SELECT item_id, first, texts FROM c")
def covered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir)


@query(COVERED + " SELECT count(*) AS items, count(*) FILTER (texts > 0) AS covered, CAST(floor(100.0 * count(*) FILTER (texts > 0) / count(*) + 0.5) AS BIGINT) AS share FROM c")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.coverage_totals(_covered(spark, sf_dir))


NORMAL = r"regexp_replace({0}, '\[[^\]/]+\]|\{{[^}}/]+\}}|:[A-Za-z_]\w*', '{{}}', 'g')"
SEGMENTS = "list_filter(string_split(" + NORMAL + ", '/'), lambda x: x <> '')"
WRITTEN = "(VALUES ('/blue/:x'), ('/red/:y/'), ('/api/small/{id}'), ('/nothing/here'), ('/small/:a/ring')) AS v(path)"


@query(
    cte("routes")
    + f""", r AS (SELECT pos, route, {SEGMENTS.format('route')} AS r FROM routes), w AS (SELECT DISTINCT {SEGMENTS.format('path')} AS w FROM {WRITTEN})
    SELECT DISTINCT pos, route FROM r, w WHERE len(w) BETWEEN 1 AND len(r)
        AND len(list_filter(range(1, len(w) + 1), lambda i: NOT (w[i] = r[len(r) - len(w) + i] OR w[i] = '{{}}' OR r[len(r) - len(w) + i] = '{{}}'))) = 0"""
)
def routes_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = spark.createDataFrame([("/blue/:x",), ("/red/:y/",), ("/api/small/{id}",), ("/nothing/here",), ("/small/:a/ring",)], "path string")
    return joins.routes_called(written, load(spark, sf_dir, "routes").select("pos", "route"))


@query(
    cte("routes")
    + f""", n AS (SELECT pos, route AS id, rtrim({NORMAL.format('route')}, '/') AS k FROM routes WHERE method = 'GET'),
    s AS (SELECT rtrim({NORMAL.format("concat('/m', route)")}, '/') AS k, 0 AS rule, pos, id FROM (SELECT pos, route, route AS id FROM routes WHERE method = 'GET')),
    b AS (SELECT * FROM s UNION ALL SELECT k, 1, pos, id FROM n), f AS (SELECT k, id FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY rule, pos, id) = 1),
    q AS (SELECT DISTINCT route FROM routes UNION SELECT DISTINCT '/m' || route FROM routes WHERE route LIKE '/api/%')
    SELECT route, id FROM q LEFT JOIN f ON f.k = rtrim({NORMAL.format('route')}, '/')"""
)
def match_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "routes")
    items = rows.where("method = 'GET'").select(F.col("route").alias("id"), "pos", F.array(F.concat(F.lit("/m"), "route")).alias("match"))
    asked = rows.select("route").union(rows.where("route LIKE '/api/%'").select(F.concat(F.lit("/m"), "route")))
    return joins.match_routes(asked, items)


@query(
    """WITH l AS (SELECT l_partkey AS page, l_suppkey * 5 AS target, CASE WHEN l_linenumber > 1 THEN 'a' || l_linenumber END AS anchor FROM lineitem),
    p AS (SELECT p_partkey AS page FROM part WHERE p_size > 16), a AS (SELECT p_partkey AS page, 'a' || (p_size % 5) AS anchor FROM part)
    SELECT page, target, anchor, 'page' AS kind FROM l WHERE target NOT IN (SELECT page FROM p)
    UNION ALL SELECT page, target, anchor, 'anchor' FROM l WHERE target IN (SELECT page FROM p) AND anchor IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.page = l.target AND a.anchor = l.anchor)
    UNION ALL SELECT page, target, anchor, 'self' FROM l WHERE page = target AND anchor IS NULL"""
)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    links = line.select(F.col("l_partkey").alias("page"), (F.col("l_suppkey") * 5).alias("target"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("a"), "l_linenumber")).alias("anchor"))
    pages = part.where("p_size > 16").select(F.col("p_partkey").alias("page"))
    anchors = part.select(F.col("p_partkey").alias("page"), F.concat(F.lit("a"), F.col("p_size") % 5).alias("anchor"))
    return joins.broken_links(links, pages, anchors)


@query(
    """WITH d AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
    SELECT coalesce(d.k, f.k) AS k, CASE WHEN d.k IS NOT NULL AND f.k IS NOT NULL THEN 'confirmed' WHEN d.k IS NOT NULL THEN 'documents' ELSE 'code' END AS state FROM d FULL JOIN f ON d.k = f.k"""
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    return joins.reconcile(orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), customers.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


MERGED = "{0}_m AS (SELECT k, arg_min(auth, pos) AS auth, arg_min(version, pos) AS version, list_sort(list_distinct(list(column_name))) AS column_name FROM {0} GROUP BY 1)"


@query(cte("before") + ", " + MERGED.format("before") + " SELECT * FROM before_m")
def merge_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.merge_by_key(load(spark, sf_dir, "before"), "k", ("auth", "version"), ("column_name",))


@query(
    cte("before", "after")
    + f""", {MERGED.format("before")}, {MERGED.format("after")},
    j AS (SELECT coalesce(b.k, a.k) AS k, b.k AS bk, a.k AS ak, b.auth AS b1, a.auth AS a1, b.version AS b2, a.version AS a2, array_to_string(b.column_name, ',') AS b3, array_to_string(a.column_name, ',') AS a3
        FROM before_m b FULL JOIN after_m a ON a.k = b.k)
    SELECT k, CASE WHEN ak IS NULL THEN 'removed' ELSE 'added' END AS change, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM j WHERE ak IS NULL OR bk IS NULL
    UNION ALL SELECT k, 'changed', 'auth', b1, a1 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND b1 IS DISTINCT FROM a1
    UNION ALL SELECT k, 'changed', 'version', b2, a2 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND b2 IS DISTINCT FROM a2
    UNION ALL SELECT k, 'changed', 'column_name', b3, a3 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND b3 IS DISTINCT FROM a3"""
)
def diff_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = [joins.merge_by_key(load(spark, sf_dir, x), "k", ("auth", "version"), ("column_name",)) for x in ("before", "after")]
    return joins.diff(*merged, "k", ("auth", "version", "column_name"))


@query(
    """WITH c AS (SELECT p_type || '/' || p_brand || '/' || p_size AS id, 'pg' || p_partkey AS page, p_partkey AS pos, [p_type, p_brand, CAST(p_size AS VARCHAR)] AS s FROM part WHERE p_size <= 25),
    i AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_size || '/' || p_name AS id, [p_type, p_brand, CAST(p_size AS VARCHAR), p_name] AS s FROM part WHERE p_size > 25),
    m AS (SELECT i.id, c.page, c.pos, CASE WHEN i.s[1:3] = c.s THEN 3 WHEN i.s[1:2] = c.s[1:2] THEN 2 WHEN i.s[1] = c.s[1] THEN 1 ELSE 0 END AS common FROM i, c)
    SELECT id, page, CAST(common AS INT) AS common FROM m WHERE common > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY common DESC, pos) = 1"""
)
def suggest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    covered = part.where("p_size <= 25").select(F.concat_ws("/", "p_type", "p_brand", "p_size").alias("id"), F.concat(F.lit("pg"), "p_partkey").alias("page"), F.col("p_partkey").alias("pos"))
    return joins.suggest_page(part.where("p_size > 25").select(F.concat_ws("/", "p_type", "p_brand", "p_size", "p_name").alias("id")), covered)


@query(
    """WITH r AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), i AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O'), c AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12)
    SELECT id, 'new' AS change FROM i WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'removed' FROM r WHERE id NOT IN (SELECT id FROM i) AND id IN (SELECT id FROM c)"""
)
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    ids = lambda status: orders.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"))
    return joins.inventory_changes(ids("F").distinct(), ids("O"), customers.where("c_nationkey < 12").select(F.col("c_custkey").alias("id")))


@query(
    """WITH f AS (SELECT DISTINCT 'src/' || p_type || '/' || p_brand || '/' || p_name || '.ts' AS file FROM part WHERE p_size <= 25),
    p AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name || '.ts' WHEN 1 THEN p_brand || '/' || p_name || '.ts' ELSE 'src/' || p_type || '/' || p_brand || '/' || p_name || '.ts' END AS path FROM part),
    m AS (SELECT path, count(DISTINCT file) AS n, min(file) AS one, bool_or(file = path) AS exact FROM p JOIN f ON file = path OR ends_with(file, '/' || path) GROUP BY 1)
    SELECT path, CASE WHEN exact THEN path WHEN n = 1 THEN one END AS file FROM p LEFT JOIN m USING (path)"""
)
def resolve_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat("p_name", F.lit(".ts"))
    whole = F.concat_ws("/", F.lit("src"), "p_type", "p_brand", name)
    paths = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.concat_ws("/", "p_brand", name)).otherwise(whole)
    return joins.resolve_suffix(part.select(paths.alias("path")), part.where("p_size <= 25").select(whole.alias("file")).distinct())


@query(cte("ranges", "touched") + ", a AS (SELECT DISTINCT * FROM ranges), b AS (SELECT DISTINCT * FROM touched) SELECT a.file, a.lo, a.hi, count(*) AS touches FROM a JOIN b ON a.file = b.file AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlapping(load(spark, sf_dir, "ranges"), load(spark, sf_dir, "touched"), "file")


@query(
    """WITH t AS (SELECT p_brand AS "table", list_sort(list_distinct(list(p_name))) AS columns FROM part WHERE p_size > 12 GROUP BY 1),
    r AS (SELECT DISTINCT p_brand AS a, 'Brand#' || (p_size % 30) AS b FROM part), e AS (SELECT a, b FROM r WHERE a IN (SELECT "table" FROM t) AND b IN (SELECT "table" FROM t)),
    d AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
    SELECT "table", columns, coalesce(degree, 0) AS degree FROM t LEFT JOIN d ON n = "table\""""
)
def erd_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tables = part.where("p_size > 12").select(F.col("p_brand").alias("table"), F.col("p_name").alias("column"))
    return joins.erd_tables(tables, part.select(F.col("p_brand").alias("table"), F.concat(F.lit("Brand#"), F.col("p_size") % 30).alias("target")))


@query("""WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS id FROM documents) SELECT id, list_sort(list(doc_id)) AS pages FROM c GROUP BY 1""")
def rule_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.citations(load(spark, sf_dir, "docs").select(F.col("doc_id").alias("page"), "text"), "[0-9]{3}-[0-9]{4}")


@query("SELECT n_nationkey, n_regionkey, coalesce(CASE WHEN s.name IS NOT NULL THEN s.name END, n_name) AS n_name FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS name FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("n_name"))
    return joins.translated(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", "n_name"), names, ("n_nationkey",), "n_name")


@query(
    """WITH e AS (SELECT c_custkey AS n, [c_mktsegment || c_nationkey] AS routes FROM customer WHERE c_acctbal < 0), c AS (SELECT c_custkey AS pos, [c_mktsegment || c_nationkey, 'r' || c_custkey] AS routes FROM customer WHERE c_acctbal >= 0),
    t AS (SELECT DISTINCT unnest(routes) AS route FROM e), f AS (SELECT * FROM c WHERE NOT list_has_any(routes, (SELECT list(route) FROM t)))
    SELECT n, routes FROM e UNION ALL SELECT (SELECT coalesce(max(n), 0) FROM e) + row_number() OVER (ORDER BY pos), routes FROM f"""
)
def append_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.concat("c_mktsegment", "c_nationkey")
    existing = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("n"), F.array(key).alias("routes"))
    return joins.append_new(existing, c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("pos"), F.array(key, F.concat(F.lit("r"), "c_custkey")).alias("routes")))


#: Edges inside blocks of seven parts: their number grows with the table, and every block has cycles and chains of its own.
BLOCK_EDGES = """e AS (SELECT DISTINCT * FROM (SELECT p_partkey AS src, p_partkey // 7 * 7 + (p_partkey * 3 + p_partkey // 7) % 7 AS dst FROM part
    UNION ALL SELECT p_partkey, p_partkey // 7 * 7 + (p_partkey + 2) % 7 FROM part WHERE p_partkey % 5 = 0))"""
REACH = "r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


def _block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    block = F.floor(k / 7)
    one = part.select(k.alias("src"), (block * 7 + (k * 3 + block) % 7).alias("dst"))
    return one.unionByName(part.where(k % 5 == 0).select(k.alias("src"), (block * 7 + (k + 2) % 7).alias("dst")))


@query(
    f"""WITH RECURSIVE {BLOCK_EDGES.replace("e AS", "every AS", 1)}, e AS (SELECT * FROM every WHERE src <> dst), {REACH},
    b AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src)
    SELECT node, least(min(other), node) AS component, count(DISTINCT other) AS size FROM b GROUP BY node HAVING count(DISTINCT other) > 1"""
)
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(_block_edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {BLOCK_EDGES}, b(node, depth, root) AS (SELECT p_partkey, 0, p_partkey FROM part WHERE p_partkey % 7 IN (0, 3) UNION SELECT e.dst, b.depth + 1, b.root FROM b JOIN e ON b.node = e.src WHERE b.depth < 12)
    SELECT node, CAST(min(depth) AS INT) AS depth, arg_min(root, depth::BIGINT * 1000000000 + root) AS root FROM b GROUP BY node"""
)
def shortest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 7 IN (0, 3)").select(F.col("p_partkey").alias("node"))
    return graph.shortest_depths(roots, _block_edges(spark, sf_dir))


@query(
    """WITH RECURSIVE p AS (SELECT s_suppkey AS a, s_suppkey // 20 * 20 + (s_suppkey * 3 + 5) % 20 AS b FROM supplier WHERE s_acctbal > 0), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS node, least(min(b), a) AS "group" FROM r GROUP BY a"""
)
def topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 0")
    return graph.groups(s.select(F.col("s_suppkey").alias("a"), (F.floor(F.col("s_suppkey") / 20) * 20 + (F.col("s_suppkey") * 3 + 5) % 20).alias("b")))


TREE = "e AS (SELECT DISTINCT p_partkey AS src, CAST(floor(p_partkey / 3.0) AS BIGINT) AS dst FROM part WHERE p_partkey > 0)"


@query(f"WITH RECURSIVE {TREE}, d(node, level) AS (SELECT DISTINCT dst, 0 FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, d.level + 1 FROM d JOIN e ON e.dst = d.node) SELECT node, CAST(max(level) AS INT) AS level FROM d GROUP BY 1")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 0")
    return graph.topological(p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst")))


STATES = "s AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 9 = 4 THEN 'missing' ELSE 'fresh' END AS state FROM part)"


@query(f"WITH RECURSIVE {BLOCK_EDGES}, {REACH}, {STATES} SELECT node, CASE WHEN state = 'fresh' AND node IN (SELECT src FROM r WHERE dst IN (SELECT node FROM s WHERE state <> 'fresh')) THEN 'stale' ELSE state END AS state FROM s")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))
    states = nodes.select("node", F.when(F.col("node") % 9 == 4, "missing").otherwise("fresh").alias("state"))
    return graph.late_states(states, _block_edges(spark, sf_dir))


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(^red )|(ring$)') AND p_name <> 'blue ['")
def exclude_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.exclude(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_name", ["^red ", "ring$", "blue ["])


@query("SELECT p_partkey, p_type || '/' || p_name || '.ts' AS path FROM part WHERE regexp_matches(p_type || '/' || p_name || '.ts', '^(?:.*/)?(?:red|blue)[^/]*\\.ts$')")
def glob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_type", F.lit("/"), "p_name", F.lit(".ts")).alias("path"))
    return part.where(filters.matches_glob("path", "**/{red,blue}*.ts"))


@query("""SELECT c_mktsegment, CASE WHEN regexp_matches(CAST(c_nationkey AS VARCHAR), '^1') THEN c_nationkey END AS c_nationkey, CASE WHEN regexp_matches(c_name, '[02468]$') THEN c_name END AS c_name
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return filters.kept_fields(rows, {"c_nationkey": "^1", "c_name": "[02468]$"}, "c_mktsegment", ("BUILDING", "MACHINERY"))


@query("""SELECT c_name AS value, arg_min(c_mktsegment, c_custkey) AS name FROM (SELECT 'value' || c_nationkey || 'xx' AS c_name, c_mktsegment, c_custkey FROM customer) WHERE regexp_matches(c_mktsegment, '(?i)build|auto') AND length(c_name) >= 9 GROUP BY 1""")
def sensitive_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return filters.sensitive_values(c.select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("value"), "c_nationkey", F.lit("xx")).alias("value"), F.col("c_custkey").alias("pos")), "(?i)build|auto", least=9)


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'private' WHEN p_size % 3 = 0 THEN 'unproven' WHEN p_size % 2 = 0 THEN 'unlisted' ELSE 'sendable' END AS state FROM part")
def package_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", filters.package_state(size % 5 == 0, size % 3 != 0, size % 2 != 0).alias("state"))


@query(
    cte("packages")
    + """, e(entry, ecosystem, name) AS (VALUES ('a', '*', 'pkg-1'), ('a', 'npm', 'pkg-3'), ('a', 'npm', 'pkg-6'), ('a', 'npm', 'pkg-9'), ('b', 'pypi', 'pkg-3'), ('c', 'cargo', 'pkg-2')),
    m AS (SELECT DISTINCT e.entry, e.name FROM e JOIN packages p ON p.name = e.name AND (e.ecosystem = '*' OR e.ecosystem = p.ecosystem)) SELECT entry, list_sort(list(name))[1:3] AS proofs FROM m GROUP BY 1"""
)
def detected_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "*", "pkg-1"), ("a", "npm", "pkg-3"), ("a", "npm", "pkg-6"), ("a", "npm", "pkg-9"), ("b", "pypi", "pkg-3"), ("c", "cargo", "pkg-2")]
    return filters.detected(spark.createDataFrame(rows, "entry string, ecosystem string, name string"), load(spark, sf_dir, "packages"))


@query(
    """WITH i AS (SELECT c_custkey AS id, c_custkey // 10 AS parent FROM customer), l AS (SELECT c_custkey AS id, 'T-' || c_custkey AS ref FROM customer WHERE c_acctbal > 5000)
    SELECT i.id, i.parent, l.ref AS parent_ref FROM i LEFT JOIN l ON l.id = i.parent WHERE i.id NOT IN (SELECT id FROM l)"""
)
def export_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    items = c.select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 10").alias("parent"))
    return filters.to_export(items, c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.concat(F.lit("T-"), "c_custkey").alias("ref")))


@query("""WITH v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'na: none' WHEN 2 THEN 'unknown' WHEN 3 THEN '  ' WHEN 4 THEN 'name' WHEN 5 THEN NULL ELSE 'Unknown - yet' END AS v FROM events)
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'na' WHEN 1 THEN 'na' WHEN 2 THEN 'unknown' WHEN 3 THEN 'missing' WHEN 4 THEN 'answered' WHEN 5 THEN 'missing' ELSE 'unknown' END AS state FROM v""")
def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE event_id % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN 'na: none' WHEN 2 THEN 'unknown' WHEN 3 THEN '  ' WHEN 4 THEN 'name' WHEN 5 THEN NULL ELSE 'Unknown - yet' END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", filters.answer_state(value).alias("state"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'unmarked' WHEN doc_id % 5 = 2 THEN 'stale' ELSE 'current' END AS state FROM documents""")
def translation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.functions.text import content_hash

    docs = load(spark, sf_dir, "docs")
    recorded = F.when(F.col("doc_id") % 5 == 1, F.lit(None)).when(F.col("doc_id") % 5 == 2, "0123456789abcdef").otherwise(content_hash("text"))
    return docs.select("doc_id", state.translation_state(F.col("text"), F.col("doc_id") % 5 != 0, recorded).alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'missing' WHEN event_id % 6 > 1 OR value > 90 THEN 'stale' ELSE 'fresh' END AS state FROM events""")
def facts_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id") % 6
    commit = F.when(n == 0, F.lit(None)).when(n == 2, "old").otherwise("head")
    found, _ = state.facts_state(commit, "head", F.when(n >= 3, "0.9").otherwise("1.0"), "1.0", F.col("value"), 90)
    return e.select("event_id", found.alias("state"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT -o_orderkey - 1, 'N' FROM orders WHERE o_orderstatus = 'P'")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    open_orders = o.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("N"))
    return state.upsert(o, open_orders.unionByName(open_orders.withColumn("o_orderkey", -F.col("o_orderkey") - 1)), "o_orderkey")
