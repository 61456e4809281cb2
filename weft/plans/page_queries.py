"""Queries of pages, values, changes, schemas, traces and checks; texts are derived so that there is something to find and something to leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import values
from weft.operators import changes, checks, pages, ranges, schemas, traces
from weft.plans.inputs import cte, load
from weft.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""SELECT term FROM (VALUES ('the', '\bthe\b'), ('secret', 'SECRET'), ('none', 'zzzzqqq'), ('word', '^\p{Lu}\w+ the')) AS g(term, pattern) WHERE EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, '(?i)' || pattern))""")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    glossary = spark.createDataFrame([("the", r"\bthe\b"), ("secret", "SECRET"), ("none", "zzzzqqq"), ("word", r"^\p{Lu}\w+ the")], "term string, pattern string")
    return pages.glossary_for(glossary, load(spark, sf_dir, "docs"))


@query("""SELECT p_brand AS name, CASE WHEN p_size > 20 THEN '✔' ELSE '—' END AS big, p_size || ', ' || p_partkey AS numbers, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS kind FROM part""")
def facts_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") > 20).alias("big"), F.array(F.col("p_size").cast("long"), F.col("p_partkey")).alias("numbers"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"), F.lit(1).alias("left_out"))
    return pages.facts_table(rows, ("name", "big", "numbers", "kind"))


@query("""WITH c AS (SELECT p_partkey AS card, p_size AS s, p_name AS n FROM part)
    SELECT card, 'trigger' AS rubric, true AS required, 'click ' || n || chr(10) || 'then more' AS value, 'answered' AS state FROM c
    UNION ALL SELECT card, 'rules', true, CASE WHEN s % 3 = 0 THEN 'N/A: none' WHEN s % 3 = 1 THEN '' ELSE 'a' || chr(10) || 'b' END, CASE s % 3 WHEN 0 THEN 'na' WHEN 1 THEN 'missing' ELSE 'answered' END FROM c
    UNION ALL SELECT card, 'notes', false, 'unknown', 'unknown' FROM c WHERE s % 2 = 0""")
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.expr("CASE p_size % 3 WHEN 0 THEN 'Rules: N/A: none' WHEN 1 THEN 'Rules:  ' ELSE 'Rules: a\\nRULES: b' END")
    body = F.concat(F.lit("intro\nOther: x\n**Trigger**: click "), "p_name", F.lit("\nthen more\n"), rules, F.when(F.col("p_size") % 2 == 0, "\r\nNotes: unknown").otherwise("\nNotes:"))
    rubrics = spark.createDataFrame([("trigger", "Trigger", True), ("rules", "Rules", True), ("notes", "Notes", False)], "rubric string, label string, required boolean")
    return pages.card_rubrics(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("card"), body.alias("body")), rubrics)


@query("""SELECT p_partkey, ['Title ' || p_name, p_brand || ' < 5 & more', p_type || ' ' || p_size] AS lines FROM part""")
def story_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<h2>Title <b>"), "p_name", F.lit("</b></h2>\n<p></p><ul><li>"), "p_brand", F.lit("  &lt; 5 &amp; more</li></ul><table><tr><td>"), "p_type", F.lit("</td><td>"), "p_size", F.lit("</td></tr></table><br>"))
    return table(spark, sf_dir, "part").select("p_partkey", pages.plain_lines(text).alias("lines"))


@query("""SELECT p_partkey, p_name || ' é € ' || chr(65 + p_size % 26) || ' &unknown; <' AS text FROM part""")
def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" &eacute; &#x20AC; &#"), F.col("p_size") % 26 + 65, F.lit("; &unknown; &lt;"))
    return table(spark, sf_dir, "part").select("p_partkey", pages.decode_references(text).alias("text"))


@query("""SELECT p_partkey, '<mark>' || CASE WHEN p_size % 2 = 0 THEN 'Order' ELSE 'ORDER' END || '</mark> &lt;b&gt; <mark>ordersize</mark> a&amp;p amp ' || p_size AS shown FROM part""")
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "Order").otherwise("ORDER"), F.lit(" <b> ordersize a&p amp "), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", pages.marked(text, ["order", "size"]).alias("shown"))


TEMPLATE = [("guide", 0, ["Overview", "Aperçu"], True), ("guide", 1, ["Steps"], True), ("guide", 2, ["See also"], False), ("card", 0, ["Goal"], True)]
PAGES = """p AS (SELECT p_partkey AS page, CASE p_size % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'card' ELSE 'none' END AS t, p_size % 3 = 0 AS over, p_size % 2 = 0 AS steps, p_size % 5 = 0 AS also FROM part)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.expr("CASE p_size % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'card' ELSE 'none' END")
    titles = F.array_compact(F.array(F.when(F.col("p_size") % 3 == 0, "APERCU  of it"), F.when(F.col("p_size") % 2 == 0, "Steps to take"), F.when(F.col("p_size") % 5 == 0, "see Also"), F.lit("More goals")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), template.alias("template"), titles.alias("headings"), F.concat(F.lit("some `code` words <b>and</b> "), "p_name").alias("text"))


def _template(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATE, "template string, at int, labels array<string>, required boolean")


@query(f"WITH {PAGES} SELECT page, list_filter([CASE WHEN t = 'guide' AND over THEN 0 END, CASE WHEN t = 'guide' AND steps THEN 1 END, CASE WHEN t = 'guide' AND also THEN 2 END]::INT[], lambda x: x IS NOT NULL) AS present FROM p")
def present_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_sections(_pages(spark, sf_dir), _template(spark))


@query(f"""WITH {PAGES}, q AS (SELECT page, t, CASE WHEN t = 'guide' THEN over::INT + steps::INT + also::INT ELSE 0 END AS n, steps FROM p)
    SELECT page, t <> 'none' AS known, CASE t WHEN 'guide' THEN 3 WHEN 'card' THEN 1 ELSE 0 END AS sections, n AS present, CASE WHEN t = 'guide' AND NOT steps THEN ['Steps'] WHEN t = 'card' THEN ['Goal'] ELSE [] END AS missing, t = 'guide' AND steps AS conformant, round(CASE t WHEN 'guide' THEN n / 3 ELSE 0 END, 9) AS completeness, 5 AS words FROM q""")
def analysed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.analyse_pages(_pages(spark, sf_dir).withColumn("text", F.lit("some `code` words <b>and</b> two more")), _template(spark)).withColumn("completeness", F.round("completeness", 9))


@query("""SELECT p_partkey, 'Part ' || p_name || ' has ' || p_size || ' {kept}' || CASE WHEN p_size = 1 THEN ' piece' ELSE ' pieces' END AS en, CASE WHEN p_size < 2 THEN 'pièce' ELSE 'pièces' END AS fr FROM part""")
def filled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pages.filled(F.lit("Part {name} has {n} {kept} {word}"), {"name": F.col("p_name"), "n": F.col("p_size"), "word": pages.plural(F.col("p_size"), F.lit("piece"), F.lit("pieces"))})
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("en"), pages.plural(F.col("p_size"), F.lit("pièce"), F.lit("pièces"), "fr").alias("fr"))


@query("""SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS en, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') AS de FROM orders""")
def grouped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", pages.grouped_number(n).alias("en"), pages.grouped_number(n, "de").alias("de"))


@query("""SELECT p_brand AS page, string_agg(p_name, chr(10) ORDER BY p_name) AS text FROM part WHERE p_size > 10 GROUP BY 1""")
def planned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.planned_text(table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), (F.col("p_size") <= 10).alias("draft"), F.col("p_name").alias("text")))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN true ELSE false END AS edited FROM part""")
def edited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.functions.text import content_hash

    whole = F.concat("p_name", F.lit("\r\nline\n\n"))
    recorded = F.when(F.col("p_size") % 4 == 0, content_hash(whole)).when(F.col("p_size") % 4 == 1, content_hash(F.concat("p_name", F.lit("\nline")))).when(F.col("p_size") % 4 == 3, content_hash(F.concat("p_name", F.lit("other"))))
    return table(spark, sf_dir, "part").select("p_partkey", pages.is_edited(recorded, whole).alias("edited"))


@query("""SELECT o_orderkey AS page, o_orderstatus AS version FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def pages_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    written = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("page"))
    return pages.version_behind(o.select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("version")), written, "F")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'host' || s_nationkey || '.com:' || CASE WHEN s_nationkey = 443 THEN '' ELSE CAST(8000 + s_nationkey AS VARCHAR) END WHEN 1 THEN 'loopback:3000' WHEN 2 THEN 'loopback:' WHEN 3 THEN 'a.b:' END AS app FROM supplier""")
def application_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("CASE s_suppkey % 5 WHEN 0 THEN concat('https://me@Host', s_nationkey, '.com.:', 8000 + s_nationkey, '/x?y') WHEN 1 THEN 'http://127.0.0.1:3000' WHEN 2 THEN 'HTTP://localhost:80/a' WHEN 3 THEN 'https://a.b:443#z' ELSE 'ftp://x.y' END")
    return table(spark, sf_dir, "supplier").select("s_suppkey", values.application_key(url).alias("app"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'https://j.example/browse/ABC-' || p_partkey WHEN 1 THEN 'https://github.com/o/r' || p_size || '/issues/' || p_partkey END AS url FROM part""")
def ticket_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.expr("CASE p_size % 4 WHEN 0 THEN concat('ABC-', p_partkey) WHEN 1 THEN concat('o/r', p_size, '#', p_partkey) WHEN 2 THEN concat('ADO#', p_partkey) ELSE 'no ticket' END")
    return table(spark, sf_dir, "part").select("p_partkey", values.ticket_url(ref, {"jira": "https://j.example/browse/{id}", "github": "https://github.com/{repo}/issues/{id}", "azure": "http://insecure/{id}"}).alias("url"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'pagination' WHEN 1 THEN 'pagination' WHEN 2 THEN 'sort' WHEN 3 THEN 'search' ELSE 'filter' END AS family, CASE event_id % 5 WHEN 0 THEN 'pageSize' WHEN 1 THEN 'cursor' ELSE 'param' END AS signal FROM events""")
def parameter_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE event_id % 5 WHEN 0 THEN 'Per_Page' WHEN 1 THEN 'after' WHEN 2 THEN 'ORDERBY' WHEN 3 THEN 'q' ELSE event_type END")
    return table(spark, sf_dir, "events").select("event_id", values.parameter_role(name).alias("r")).select("event_id", "r.family", "r.signal")


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'desc' WHEN 3 THEN '*/5 * * * *' END AS kept FROM events""")
def safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE event_id % 7 WHEN 0 THEN cast(event_id AS string) WHEN 1 THEN ' DESC ' WHEN 2 THEN 'desc' WHEN 3 THEN '*/5 * * * *' WHEN 4 THEN '123456789' WHEN 5 THEN repeat('7 ', 150) ELSE '12' END")
    family, field = F.expr("CASE event_id % 7 WHEN 1 THEN 'sort' WHEN 3 THEN 'schedule' ELSE 'x' END"), F.expr("CASE event_id % 7 WHEN 6 THEN 'api_key' ELSE event_type END")
    return table(spark, sf_dir, "events").select("event_id", values.safe_value(value, family, field).alias("kept"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'MIT OR Apache-2.0' END AS licence FROM part""")
def licence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, many = F.expr("CASE p_size % 3 WHEN 0 THEN ' MIT ' WHEN 1 THEN '' END"), F.expr("CASE p_size % 3 WHEN 1 THEN array('MIT', null, 'Apache-2.0') WHEN 2 THEN array() END")
    return table(spark, sf_dir, "part").select("p_partkey", values.licence_name(one, many.cast("array<string>")).alias("licence"))


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN '123456789' ELSE 'p' || p_partkey END AS t FROM part)
    SELECT p_partkey, CAST(xor(4294967295, list_reduce(flatten(list_transform(range(1, length(t) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii(t[i]) >> j) & 1))),
        lambda c, bit: xor(c >> 1, xor(c & 1, bit) * 3988292384), 4294967295)) AS BIGINT) AS crc FROM t""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of a text of each part, bit by bit in SQL; 123456789 is the published check value."""
    text = F.when(F.col("p_partkey") % 50 == 0, "123456789").otherwise(F.concat(F.lit("p"), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", values.checksum(text).alias("crc"))


@query("""SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 6""")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    b = n.select(F.col("n_regionkey"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))
    return n.join(b, "n_regionkey").where("n_nationkey < k").select(F.col("n_name").alias("a"), "b", values.edits("n_name", "b", 6).alias("d")).where("d >= 0")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['id', 'slug'] WHEN 1 THEN ['key'] ELSE [] END AS names FROM part""")
def route_parameter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = F.expr("concat('/', p_brand, CASE p_partkey % 3 WHEN 0 THEN '/:id/x/[...slug]' WHEN 1 THEN '/{key}' ELSE '' END)")
    return table(spark, sf_dir, "part").select("p_partkey", values.route_parameters(route).alias("names"))


@query("""SELECT l_orderkey, l_linenumber, round(100.0 * greatest(l_partkey % 90 - 10, 0) / 200, 2) AS x, round(100.0 * (least(l_partkey % 90 - 10 + 150, 200) - greatest(l_partkey % 90 - 10, 0)) / 200, 2) AS w, 12.5::DOUBLE AS y, 25.0::DOUBLE AS h FROM lineitem""")
def zone_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = values.zone_share(F.col("l_partkey") % 90 - 10, F.lit(10), F.lit(150), F.lit(20), F.lit(200), F.lit(80))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", z.alias("z")).select("l_orderkey", "l_linenumber", "z.x", "z.y", "z.w", "z.h")


@query("""SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'https://x.y/cdn-cgi/challenge-platform/…' ELSE 'https://x.y/' || p_type END AS request FROM part""")
def blocked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://x.y/cdn-cgi/challenge-platform/h/"), "p_partkey")).otherwise(F.concat(F.lit("https://x.y/"), "p_type", F.lit("?k="), "p_partkey"))
    return table(spark, sf_dir, "part").select(values.blocked_request(url).alias("request")).distinct()


@query("""WITH r AS (SELECT s_suppkey AS k, s_nationkey % 4 AS a, s_suppkey % 7 AS b FROM supplier)
    SELECT k, a = 1 AND b >= 2 AS caret, a = 0 AND b = 3 AS zero, a = 2 AND b = 1 AS tilde, (a = 1 AND b > 3) OR a = 3 AS either, (a = 1 AND b >= 1) OR (a = 2 AND b <= 1) AS span, a = 1 AND b = 2 AS pre, CASE WHEN k % 2 = 0 THEN '1.0.0-rc.' || k ELSE '1.2.' || (k + 1) END AS low FROM r""")
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.col("s_nationkey") % 4, F.lit("."), F.col("s_suppkey") % 7, F.lit(".1"))
    test = lambda r: ranges.satisfies(version, F.lit(r))
    key = F.col("s_suppkey").cast("string")
    own = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(">=1.0.0-rc."), key)).otherwise(F.concat(F.lit(">1.2."), key, F.lit(" || 2")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), test("^1.2.0").alias("caret"), test("^0.3.1").alias("zero"), test("~2.1").alias("tilde"), test(">=1.4 <2 || 3.x").alias("either"), test("1.1.0 - 2.1").alias("span"), test(">1.2.1-beta <1.2.2").alias("pre"), ranges.min_version(own).alias("low"))


SNAPSHOT = """b AS (SELECT k, arg_min(auth, pos) AS auth, arg_min(version, pos) AS version FROM before GROUP BY k), a AS (SELECT k, arg_min(auth, pos) AS auth, arg_min(version, pos) AS version FROM after GROUP BY k)"""


@query(cte("before", "after") + f""", {SNAPSHOT}, f AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS gone, b.k IS NULL AS new, a.auth IS DISTINCT FROM b.auth AS x, a.version IS DISTINCT FROM b.version AS y FROM b FULL JOIN a ON a.k = b.k)
    SELECT 'api' AS source, count(*) FILTER (new) AS added, count(*) FILTER (gone) AS removed, count(*) FILTER (x AND NOT gone AND NOT new) AS changed, count(*) FILTER (new OR gone OR x) AS total FROM f
    UNION ALL SELECT 'db', count(*) FILTER (new), count(*) FILTER (gone), count(*) FILTER (x AND NOT gone AND NOT new) + count(*) FILTER (y AND NOT gone AND NOT new), count(*) FILTER (new OR gone) + count(*) FILTER (x AND NOT gone AND NOT new) + count(*) FILTER (y AND NOT gone AND NOT new) FROM f""")
def changes_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = lambda name: load(spark, sf_dir, name).groupBy("k").agg(F.min_by("auth", "pos").alias("auth"), F.min_by("version", "pos").alias("version"))
    before, after = once("before"), once("after")
    found = changes.diff_sources({"api": before, "db": before}, {"api": after, "db": after}, {"api": ("k", ("auth",)), "db": ("k", ("auth", "version"))})
    return changes.totals(found)


@query("""WITH b AS (SELECT DISTINCT p_brand || ' ⇄ ' || p_partkey % 97 AS k FROM part WHERE p_size > 5), a AS (SELECT DISTINCT p_brand || ' ⇄ ' || p_partkey % 97 AS k FROM part WHERE p_size < 44)
    SELECT k, 'added' AS change FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'removed' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def changed_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = F.array("p_brand", (F.col("p_partkey") % 97).cast("string")).alias("cycle")
    part = table(spark, sf_dir, "part")
    return changes.cycle_changes(part.where("p_size > 5").select(cycle), part.where("p_size < 44").select(cycle))


@query("""SELECT 'tests' AS k, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS before, (SELECT count(*) FROM orders) AS after""")
def changed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return changes.count_change(o.where("o_orderstatus = 'F'"), o, "tests").unionByName(changes.count_change(o, o, "same"))


@query("""SELECT 't' || p_partkey AS "table", ['id', 'name', 'price'] AS columns, CASE WHEN p_size % 3 = 0 THEN ['brand'] ELSE [] END AS "references", 'db/' || p_partkey || '.sql' AS file, p_size % 2 = 0 AS rls, CASE WHEN p_size % 2 = 0 THEN ['own_rows'] ELSE [] END AS policies FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'm' || p_partkey, ['id', 'owner_id'], ['users'], 'app/' || p_partkey || '.py', false, [] FROM part WHERE p_partkey % 2 = 1""")
def declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    sql = F.concat(F.lit('-- x\ncreate table if not exists "t'), k, F.lit('" (\n "id" int primary key,\n name varchar(20, 2),\n price numeric(10,2)'), F.when(F.col("p_size") % 3 == 0, " REFERENCES brand(id)").otherwise(""), F.lit(",\n CONSTRAINT c CHECK (price > (0))\n);\n"))
    sql = F.concat(sql, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ALTER TABLE t"), k, F.lit(" ENABLE ROW LEVEL SECURITY;\nCREATE POLICY own_rows ON t"), k, F.lit(" USING (true);"))).otherwise(""))
    py = F.concat(F.lit("class Base:\n    pass\n\nclass M(Base):\n    __tablename__ = 'm"), k, F.lit("'\n    id = Column(Integer)\n    owner_id: Mapped[int] = mapped_column(ForeignKey('users.id'))\n    def x(self): pass\n"))
    even = k % 2 == 0
    rows = table(spark, sf_dir, "part").select(F.when(even, F.concat(F.lit("db/"), k, F.lit(".sql"))).otherwise(F.concat(F.lit("app/"), k, F.lit(".py"))).alias("file"), F.when(even, sql).otherwise(py).alias("text"))
    return schemas.declared_tables(rows)


@query("""SELECT 'd' || p_partkey || CASE p_size % 3 WHEN 0 THEN '/AGENTS.md' ELSE '/.cursor/rules/a.mdc' END AS file, 3 AS lines, 4 AS words, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS hidden FROM part WHERE p_size % 3 < 2""")
def instruction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE p_size % 3 WHEN 0 THEN '/AGENTS.md' WHEN 1 THEN '/.cursor/rules/a.mdc' ELSE '/README.md' END")
    text = F.concat(F.lit("Do it\r\n\nnot"), F.when(F.col("p_size") % 2 == 0, "​").otherwise(""), F.lit(" that"))
    return schemas.agent_files(table(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_partkey", name).alias("file"), text.alias("text")))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 3 AS s FROM part)
    SELECT 'src/a' || k || '/main.ts' AS src, 'src/a' || k || '/util/index.ts' AS dst FROM p WHERE s = 0 UNION ALL SELECT 'src/a' || k || '/main.ts', 'src/shared.js' FROM p WHERE s = 0
    UNION ALL SELECT 'pkg/a' || k || '/main.py', 'pkg/a' || k || '/models.py' FROM p WHERE s = 1 UNION ALL SELECT 'pkg/a' || k || '/main.py', 'pkg/core.py' FROM p WHERE s = 1""")
def imported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size") % 3
    ts = "import x from './util'\nexport { y } from \"../shared.js\"\nimport z from 'react'\nconst q = require('./missing')"
    py = "from .models import A\nfrom ..core import b\nfrom os import path\nimport json"
    parts = table(spark, sf_dir, "part")
    file = lambda name, text: F.struct(name.alias("file"), F.lit(text).alias("text"))
    in_src, in_pkg = (lambda end, top=top: F.concat(F.lit(f"{top}/a"), k, F.lit(end)) for top in ("src", "pkg"))
    rows = parts.where(s == 0).select(F.explode(F.array(file(in_src("/main.ts"), ts), file(in_src("/util/index.ts"), "export {}"))).alias("f"))
    rows = rows.unionByName(parts.where(s == 1).select(F.explode(F.array(file(in_pkg("/main.py"), py), file(in_pkg("/models.py"), ""))).alias("f")))
    return schemas.import_edges(rows.select("f.*").unionByName(spark.createDataFrame([("src/shared.js", ""), ("pkg/core.py", "")], "file string, text string")))


@query("""WITH a AS (SELECT CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/' || p_brand || '/:id' AS route, 'f' || p_partkey AS file FROM part)
    SELECT DISTINCT r_name AS feature, method, route, file FROM region JOIN a ON (route = '/Brand#1' || r_regionkey || '/:id' AND method = 'GET') OR route = '/Brand#2' || r_regionkey || '/:id'""")
def feature_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    api = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), "p_brand", F.lit("/:id")).alias("route"), F.concat(F.lit("f"), "p_partkey").alias("file"))
    wanted = F.array(F.concat(F.lit("get  /Brand#1"), "r_regionkey", F.lit("/{key}/")), F.concat(F.lit("/Brand#2"), "r_regionkey", F.lit("/[slug]")))
    return traces.handlers(table(spark, sf_dir, "region").select(F.col("r_name").alias("feature"), wanted.alias("api")), api)


@query("""WITH d AS (SELECT DISTINCT 'lib-' || p_size AS name, p_brand AS file FROM part), i AS (SELECT DISTINCT 'Aws' || p_type AS type, 'reg.io/img' || p_size || ':1' AS image, p_brand AS file FROM part), e AS (SELECT DISTINCT 'SET_' || p_size AS name, p_brand AS file FROM part),
    x AS (SELECT 'one' AS id, 'dependencies' AS source, name AS what, file FROM d WHERE name IN ('lib-7') OR starts_with(name, 'lib-1') UNION SELECT 'one', 'infra', image, file FROM i WHERE image = 'reg.io/img3:1' UNION SELECT 'two', 'infra', type, file FROM i WHERE contains(lower(type), 'steel') UNION SELECT 'two', 'env', name, file FROM e WHERE starts_with(name, 'SET_2'))
    SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY what, file) <= 5""")
def technology_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tech = spark.createDataFrame([("one", ["lib-7", "lib-1*"], ["REG.io/img3"], [], []), ("two", ["none"], [], ["steel"], ["SET_2"])], "id string, packages array<string>, images array<string>, infra array<string>, env array<string>")
    part = table(spark, sf_dir, "part")
    named = lambda prefix: part.select(F.concat(F.lit(prefix), "p_size").alias("name"), F.col("p_brand").alias("file")).distinct()
    infra = part.select(F.concat(F.lit("Aws"), "p_type").alias("type"), F.concat(F.lit("reg.io/img"), "p_size", F.lit(":1")).alias("image"), F.col("p_brand").alias("file")).distinct()
    return traces.traces(tech, named("lib-"), infra, named("SET_"))


@query(cte("packages") + """ SELECT name, direct, CASE WHEN NOT direct THEN 'root>' || name END AS via FROM packages""")
def packages_with_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "packages").select("name", "direct")
    chains = own.select("name", F.array(F.lit("root"), "name").alias("via"))
    return traces.with_via(own, chains).select("name", "direct", F.array_join("via", ">").alias("via"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS f, l_partkey * 37 % 5000 AS p FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS f, l_orderkey * 11 % 5000 AS p FROM lineitem WHERE l_linenumber = 7)
    SELECT f AS file, p AS place FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.f = a.f AND b.p BETWEEN a.p AND a.p + 40) UNION SELECT f, p FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.f = b.f AND a.p BETWEEN b.p + 1 AND b.p + 40)""")
def nearby_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    one = line.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") * 37 % 5000).alias("place"))
    two = line.where("l_linenumber = 7").select(F.col("l_suppkey").alias("file"), (F.col("l_orderkey") * 11 % 5000).alias("place"))
    return traces.nearby(one, two, "file", 40)


@query("""SELECT p_type AS rule, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'info' ELSE 'odd' END AS severity, p_partkey AS file, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 9 END AS rank FROM part ORDER BY rank, rule, file LIMIT 10""")
def worst_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.expr("CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'info' ELSE 'odd' END")
    return traces.health_risks(table(spark, sf_dir, "part").select(F.col("p_type").alias("rule"), severity.alias("severity"), F.col("p_partkey").alias("file")), 10)


@query("""WITH h AS (SELECT DISTINCT p_type AS family, 'app/' || lower(p_brand) || '/' || split_part(p_name, ' ', 1) || '.tsx' AS file FROM part)
    SELECT DISTINCT c.segment, family FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS segment FROM part) c JOIN h ON contains(file, '/' || lower(segment) || '.tsx') UNION SELECT 'Brand#11', family FROM h WHERE starts_with(file, 'app/brand#22/') UNION SELECT 'brand#33', family FROM h WHERE starts_with(file, 'app/brand#33/')""")
def candidate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    hints = part.select(F.col("p_type").alias("family"), F.concat(F.lit("app/"), F.lower("p_brand"), F.lit("/"), word, F.lit(".tsx")).alias("file")).distinct()
    segments = part.select(word.alias("segment")).distinct().unionByName(spark.createDataFrame([("brand#33",)], "segment string"))
    handled = hints.where("file LIKE 'app/brand#22/%'").select(F.lit("Brand#11").alias("segment"), "file").distinct()
    return traces.candidate_kinds(segments, hints, handled)


@query("""SELECT c_mktsegment AS topic, c_custkey AS page, c_nationkey AS space, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_nationkey % 3 = 0 THEN 25 - c_nationkey ELSE 1000000 END, c_custkey) AS place FROM customer""")
def topics_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0")
    return traces.topic_order(c.select(F.col("c_mktsegment").alias("topic"), F.col("c_custkey").alias("page"), F.col("c_nationkey").alias("space"), F.col("c_custkey").alias("n")), n.select(F.col("n_nationkey").alias("space"), (25 - F.col("n_nationkey")).alias("rank")))


@query("""WITH RECURSIVE p(preset, name) AS (SELECT n_regionkey, 100 + n_nationkey FROM nation UNION ALL SELECT 50, 1 UNION ALL SELECT 50, 2 UNION ALL SELECT 2, 50 UNION ALL SELECT 51, 3),
    r(name) AS (SELECT unnest([50, 104]) UNION SELECT p.name FROM r JOIN p ON p.preset = r.name) SELECT name FROM r WHERE name NOT IN (SELECT preset FROM p)""")
def presets_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("preset"), (F.col("n_nationkey") + 100).alias("name"))
    nested = spark.createDataFrame([(50, 1), (50, 2), (2, 50), (51, 3)], "preset int, name int")
    return traces.expanded_presets(own.unionByName(nested), spark.createDataFrame([(50,), (104,)], "name int"))


@query("""WITH s AS (SELECT o_custkey AS page, o_orderstatus AS file, 'proof' AS kind FROM orders UNION SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'X' END, 'route' FROM customer) SELECT page, file, list_sort(list(kind)) AS kinds FROM s GROUP BY ALL""")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderstatus").alias("file"))
    route = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("X").alias("file"))
    return traces.dependencies_of_pages({"proof": proof, "route": route})


@query("""SELECT n_name AS space, n_regionkey AS profile, CASE WHEN n_nationkey % 4 = 0 THEN n_name || '/home' ELSE r_name END AS home FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 4""")
def space_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "nation").select(F.col("n_name").alias("space"), F.col("n_regionkey").alias("profile"), F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit("/home"))).alias("home"))
    return traces.spaces(declared, table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("profile"), F.col("r_name").alias("home")))


@query("""SELECT DISTINCT 'container' AS kind, 'web' AS name FROM part WHERE p_size IN (3, 9) UNION SELECT 'external', 'mail' FROM part WHERE starts_with(p_type, 'SMALL') UNION SELECT 'external', 'pay' FROM part WHERE starts_with(p_type, 'none')""")
def system_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    frameworks = spark.createDataFrame([("3", "web"), ("9", "web"), ("900", "api")], "name string, container string")
    services = spark.createDataFrame([("SMALL", "mail"), ("none", "pay")], "prefix string, system string")
    return traces.system_model(part.select(F.col("p_size").cast("string").alias("name")), part.select(F.col("p_type").alias("name")), frameworks, services)


FIELDS = (checks.Field("name", "string", required=True, pattern="^[a-z]"), checks.Field("size", "integer", least=1, most=40), checks.Field("mode", "string", one_of=("app", "none"), default="app"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
    SELECT k, 'size' AS path, 'maximum' AS error, NULL AS hint FROM p WHERE s > 40 AND k % 6 < 5 UNION ALL SELECT k, 'name', 'missing', NULL FROM p WHERE k % 6 = 1 UNION ALL SELECT k, 'mode', 'enum', NULL FROM p WHERE k % 6 = 2
    UNION ALL SELECT k, 'nmae', 'unknown', 'name' FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 'other', 'unknown', NULL FROM p WHERE k % 6 = 3 UNION ALL SELECT k, 'name', 'type', NULL FROM p WHERE k % 6 = 4 UNION ALL SELECT k, '', 'invalid', NULL FROM p WHERE k % 6 = 5""")
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.expr("""CASE p_partkey % 6 WHEN 5 THEN '{broken' ELSE concat('{', CASE p_partkey % 6 WHEN 1 THEN '' WHEN 4 THEN '"name": 5, ' ELSE '"name": "x", ' END, CASE p_partkey % 6 WHEN 2 THEN '"mode": "web", ' WHEN 3 THEN '"nmae": 1, "other": [], ' ELSE '"mode": "none", ' END, '"size": ', p_size, '}') END""")
    return checks.errors(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), json.alias("j")), FIELDS, "k", "j")


@query("""SELECT p_partkey AS k, 'n' || p_size AS name, '7' AS size, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'app' END AS mode FROM part""")
def settings_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.expr("""concat('{"name": "n', p_size, '", "size": 3', CASE WHEN p_size % 2 = 0 THEN ', "mode": "none"' ELSE '' END, '}')""")
    return checks.completed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), json.alias("j")), FIELDS, "j", {"size": "7"})
