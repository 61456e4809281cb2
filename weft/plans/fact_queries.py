"""Queries of filters, groupings, texts and scanners whose inputs are written into derived texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as fx
from weft.operators import aggregates, backlog, code_facts, filters, graph, ordered, proofs, ranking, state
from weft.operators.numbering import numbered
from weft.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT DISTINCT 'f' || l_partkey AS file, '/r' || l_suppkey AS route, l_returnflag AS kind FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)""")
def facts_of_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("file"), F.concat(F.lit("/r"), "l_suppkey").alias("route"), F.col("l_returnflag").alias("kind"))
    own = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("f"), "p_partkey").alias("file"))
    routes = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.concat(F.lit("/r"), "s_suppkey").alias("route"))
    return filters.facts_for(facts, own, routes)


@query("""WITH s AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'P') AS v, bool_or(contains(lower(o_orderpriority), 'urgent')) AS t FROM orders GROUP BY 1)
    SELECT c_custkey AS feature FROM customer LEFT JOIN s ON k = c_custkey WHERE c_mktsegment = 'BUILDING' AND (c_nationkey = 4 OR coalesce(v, false)) AND (contains(lower(c_name), 'urgent') OR coalesce(t, false))""")
def board_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("feature")).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("title"))).alias("stories"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("feature"), F.col("c_mktsegment").alias("epic"), F.col("c_name").alias("title"), F.when(F.col("c_nationkey") == 4, "P").otherwise("x").alias("version"))
    return backlog.board(c.join(stories, "feature", "left"), epic="BUILDING", version="P", text="Urgent").select("feature")


@query("""WITH q AS (SELECT l_partkey AS file, CASE WHEN count(*) FILTER (l_linenumber < 7) <> 0 THEN count(*) FILTER (l_returnflag = 'R') / count(*) FILTER (l_linenumber < 7) END AS share FROM lineitem GROUP BY 1)
    SELECT file, round(share, 9) AS share, CASE WHEN share <= 0.05 THEN 'A' WHEN share <= 0.2 THEN 'B' WHEN share <= 0.4 THEN 'C' WHEN share <= 0.6 THEN 'D' ELSE 'E' END AS rating FROM q""")
def file_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_linenumber") < 7).alias("b"))
    shares = counted.select("file", aggregates.ratio(F.col("a"), F.col("b")).alias("share"))
    return shares.select("file", F.round("share", 9).alias("share"), aggregates.rating(F.col("share"), (0.05, 0.2, 0.4, 0.6)).alias("rating"))


@query("""WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ') || [p_brand]) AS key, p_partkey AS item FROM part)
    SELECT key, count(*) AS n, min(item) AS first FROM k WHERE key <> '' GROUP BY 1""")
def grouped_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.concat(F.split("p_name", " "), F.array("p_brand", F.lit(""), F.lit(None).cast("string")))
    found = aggregates.group_by_keys(table(spark, sf_dir, "part").select(keys.alias("keys"), F.col("p_partkey").alias("item")), "keys", "item")
    return found.select("key", F.size("items").cast("long").alias("n"), F.col("items")[0].alias("first"))


CODE = """concat('import x\\nSELECT a FROM t WHERE a ', CASE WHEN doc_id % 2 = 0 THEN 'ILIKE %s' ELSE '= 1' END, '\\n', CASE WHEN doc_id % 3 = 0 THEN concat('rows LIMIT ', CAST(doc_id AS STRING)) ELSE '-' END, '\\nq.startsWith(z) || send_mail(z)')"""


@query("""SELECT doc_id AS file, 'search' AS family, 'like' AS signal, 2 AS line FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'pagination', 'limit', 3 FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'search', 'startsWith', 4 FROM documents UNION ALL SELECT doc_id, 'notification', 'email', 4 FROM documents""")
def behaviour_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_facts.behaviours(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.expr(CODE).alias("text")))


@query("SELECT 'search' AS kind UNION ALL SELECT 'notification' UNION ALL SELECT 'list' WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id % 3 = 0)")
def hint_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = code_facts.behaviours(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.expr(CODE).alias("text")))
    typed = spark.createDataFrame([("validation", "type"), ("validation", "optional")], "family string, signal string")
    return code_facts.kinds_of(hints.select("family", "signal").unionByName(typed))


@query(r"""WITH d AS (SELECT doc_id, lang, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b, split_part(text, ' ', 3) AS c FROM documents)
    SELECT doc_id, 0 AS n, NULL AS title, trim(regexp_replace('intro ' || a, '\s+', ' ', 'g')) AS body FROM d UNION ALL SELECT doc_id, 1, trim(regexp_replace('Part ' || lang, '\s+', ' ', 'g')), trim(regexp_replace(b || ' text', '\s+', ' ', 'g')) FROM d
    UNION ALL SELECT doc_id, 2, 'Sub', trim(regexp_replace(c || ' # x', '\s+', ' ', 'g')) FROM d""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    text = F.concat(F.lit("intro "), word(1), F.lit("\n## Part "), "lang", F.lit("\n"), word(2), F.lit("\n text\n### Sub \n"), word(3), F.lit("\n# x"))
    return ordered.sections(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "doc_id", "t")


@query("""WITH s AS (SELECT c_custkey AS node, c_nationkey AS level, c_acctbal < 0 OR c_mktsegment = 'BUILDING' AS wanted FROM customer) SELECT node, row_number() OVER (ORDER BY level, node) AS step FROM s WHERE wanted""")
def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    states = c.select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, "stale").otherwise("fresh").alias("state"))
    return graph.run_plan(states, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node")), c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("level")))


@query("""WITH v AS (SELECT s_suppkey, s_nationkey % 3 AS a, s_suppkey % 5 AS b, s_suppkey % 4 AS pre FROM supplier),
    k AS (SELECT *, a || '.' || b || '.0' || CASE pre WHEN 0 THEN '' WHEN 1 THEN '-alpha.' || s_suppkey WHEN 2 THEN '-alpha' ELSE '-rc.1' END AS version FROM v)
    SELECT s_suppkey, version, row_number() OVER (ORDER BY a, b, CASE pre WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END, CASE WHEN pre = 1 THEN s_suppkey END, s_suppkey) AS place FROM k""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.expr("concat(s_nationkey % 3, '.', s_suppkey % 5, '.0', CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('-alpha.', s_suppkey) WHEN 2 THEN '-alpha' ELSE '-rc.1' END)")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", version.alias("version"))
    placed = numbered(rows.withColumn("key", fx.version_key("version")), ("key", "s_suppkey"), "place")
    return placed.select("s_suppkey", "version", F.col("place").cast("int").alias("place"))


@query(r"SELECT page_id, md5(regexp_replace(html, '<([\p{Lu}\p{Ll}/!?])', '&lt;\1', 'g')) AS inert FROM pages")
def inert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(fx.inert_markup("html")).alias("inert"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N}\p{M}\p{Pc}]', ' ', 'g'), ' '), lambda x: x = 'the')) AS INT) AS n FROM documents")
def whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fx.whole_count("text", "the").alias("n"))


@query("""WITH r AS (SELECT p_partkey, '/' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '/:id' WHEN 1 THEN '/{key}/x' ELSE '' END AS r FROM part)
    SELECT p_partkey, list_sort(list_distinct([r, regexp_replace(r, ':id|\\{key\\}', ':p'), regexp_replace(r, ':id|\\{key\\}', '{p}'), regexp_replace(r, ':id|\\{key\\}', '[p]')])) AS forms FROM r""")
def route_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.expr("concat('/', p_brand, CASE p_partkey % 3 WHEN 0 THEN '/:id' WHEN 1 THEN '/{key}/x' ELSE '' END)")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(fx.route_forms(route)).alias("forms"))


@query(r"""SELECT doc_id, ['Part ' || lang, 'Last ' || source] AS titles FROM documents""")
def heading_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# Top\n## Part "), "lang", F.lit("  \ntext\n```\n## not a title\n```\n#### deep\n###  Last "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", fx.headings(text).alias("titles"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [chr(8203), chr(173)] ELSE [] END AS hidden FROM documents""")
def hidden_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a​b"), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("­"))).otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", fx.hidden_characters(marked).alias("hidden"))


@query("""WITH m AS (SELECT p_partkey AS file, unnest(['title', 'brand.' || p_size, 'nav.' || split_part(p_type, ' ', 1) || '.x']) AS key FROM part) SELECT file, lower(key) AS key FROM m""")
def code_message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    code = F.concat(F.lit("t('title'); x = \"brand."), "p_size", F.lit("\"; y = 'nav."), kind, F.lit(".x'; t(\"title\"); z = 'Not a key'; a.b.c"))
    return proofs.message_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), code.alias("text")))


@query("""SELECT p_partkey AS file, unnest(['/api/items/' || p_size, '/v1/:param/x']) AS path FROM part""")
def code_api_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("get('/api/items/"), "p_size", F.lit("'); get(`/v1/${id}/x`); get('/one'); p = \"/api/items/"), "p_size", F.lit('/"; "a/b"'))
    return proofs.api_paths(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), code.alias("text")))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'old' ELSE 'new' END AS a, CASE WHEN p_size % 3 = 0 THEN 'gone' END AS b, 'c' || p_size AS c FROM part""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = F.expr("map('a', 'old', 'b', 'gone')")
    now = F.expr("map('a', 'new', 'c', concat('c', p_size))")
    cited = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "a"), F.when(F.col("p_size") % 3 == 0, "b"), F.lit("zz")))
    merged = state.merge_labels(recorded, now, cited)
    return table(spark, sf_dir, "part").select("p_partkey", merged.alias("m")).select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("""SELECT CASE p_size % 3 WHEN 0 THEN '/' || p_brand || '/[id]' ELSE '/' || p_brand END AS route, 'app/' || CASE p_size % 3 WHEN 0 THEN '(shop)/' || p_brand || '/[id]' WHEN 1 THEN p_brand || '/@modal' ELSE p_brand END || '/page.tsx' AS file FROM part GROUP BY ALL""")
def page_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.expr("concat('app/', CASE p_size % 3 WHEN 0 THEN concat('(shop)/', p_brand, '/[id]') WHEN 1 THEN concat(p_brand, '/@modal') ELSE p_brand END, '/page.tsx')")
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(file, F.concat(F.lit("app/lib/"), "p_brand", F.lit(".tsx")))).alias("file"))
    return code_facts.screens(rows)


@query("""SELECT 's' || p_partkey || '/Dockerfile' AS file, 1 AS stage, 'node' AS image, CAST(p_size AS VARCHAR) AS tag, CAST([] AS INT[]) AS ports, true AS root, ['NODE_ENV'] AS variables FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 's' || p_partkey || '/Dockerfile', 2, 'reg.io:5000/app', NULL, [80, 8000 + p_size], p_size % 4 = 0, [] FROM part WHERE p_partkey % 2 = 0""")
def image_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# x\nFROM --platform=linux node:"), "p_size", F.lit(" AS build\nENV NODE_ENV=x\nFROM reg.io:5000/app@sha256:ab12\nEXPOSE "), F.col("p_size") + 8000, F.lit("\nEXPOSE 80\nUSER app\nUSER "), F.when(F.col("p_size") % 4 == 0, "root").otherwise("app"))
    file = F.concat(F.lit("s"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "/Dockerfile").otherwise("/notes.md"))
    return code_facts.docker_stages(table(spark, sf_dir, "part").select(file.alias("file"), text.alias("text")))


@query("""WITH p AS (SELECT l_suppkey AS page, l_partkey % 800 AS file, l_linenumber * 10 AS lo, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 5 AS hi, l_returnflag AS s FROM lineitem), t AS (SELECT o_custkey % 800 AS file, o_orderkey % 90 AS lo, o_orderkey % 90 + 3 AS hi FROM orders WHERE o_orderpriority = '1-URGENT'),
    h AS (SELECT page, count(*) AS touched FROM (SELECT DISTINCT page, file, lo, hi FROM p SEMI JOIN t ON p.file = t.file AND p.lo <= t.hi AND t.lo <= p.hi) GROUP BY 1)
    SELECT page, count(*) FILTER (s <> 'N') AS changed, coalesce(any_value(touched), 0) AS touched, count(*) FILTER (s = 'R') AS broken FROM p LEFT JOIN h USING (page) GROUP BY 1""")
def pages_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    lo = (F.col("l_linenumber") * 10).cast("long")
    ranges = line.select(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 800).alias("file"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") % 5).alias("hi"))
    states = line.select(F.col("l_suppkey").alias("page"), F.expr("CASE l_returnflag WHEN 'N' THEN 'intact' WHEN 'R' THEN 'broken: file deleted' ELSE 'moved' END").alias("state"))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 800).alias("file"), (F.col("o_orderkey") % 90).alias("lo"), (F.col("o_orderkey") % 90 + 3).alias("hi"))
    return proofs.page_drift(ranges, o, states)


ENTRY_WORDS = r"""WITH w AS (SELECT item_id AS pos, unnest(regexp_extract_all(trim(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '[\p{L}\p{N}]+')) AS word, generate_subscripts(regexp_extract_all(trim(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')), '[\p{L}\p{N}]+'), 1) AS k FROM benchmark),
    v AS (SELECT word, min(struct_pack(p := pos, k := k)) AS pos FROM w WHERE length(word) >= 3 GROUP BY 1), d AS (SELECT word, pos, damerau_levenshtein('thron', word) AS whole, CASE WHEN length(word) > 5 THEN damerau_levenshtein('thron', left(word, 5)) ELSE 9 END AS start FROM v)
    SELECT word, least(whole, start) AS edits FROM d WHERE least(whole, start) <= 1 ORDER BY least(whole, start), whole > least(whole, start), pos LIMIT 8"""


@query(ENTRY_WORDS)
def closest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts next to one term; at one edit the two distances with swaps agree."""
    entries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("body"))
    return ranking.close_words(ranking.vocabulary(entries, ("body",)), "thron")
