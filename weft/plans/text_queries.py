"""Queries of text functions, scanners and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as fx
from weft.operators import ordered, ranking, scanners
from weft.plans.inputs import cte, load
from weft.plans.registry import query

FOLD = "trim(translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "docs")


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded, md5(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS spaced FROM documents")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(fx.fold("text")).alias("folded"), F.md5(fx.fold_space("text")).alias("spaced"))


@query(
    f"""WITH s AS (SELECT doc_id, substring(regexp_replace(regexp_replace({FOLD.format('string_split(text, chr(10))[1]')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS s FROM documents)
    SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM s"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fx.slug(F.split("text", "\n")[0]).alias("slug"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM documents")
def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(fx.escape_html("text")).alias("escaped"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]+', ' ', 'g'))) AS line FROM documents")
def one_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(fx.one_line("text")).alias("line"))


@query(
    r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS plain FROM pages"""
)
def plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(fx.plain_text("html")).alias("plain"))


@query("SELECT doc_id, substring(sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), 1, 16) AS hash, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fx.content_hash("text").alias("hash"), fx.token_estimate("text").alias("tokens"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[0-9]{3}-[0-9]{4}|[0-9a-f]{40}', '••••••••', 'gi')) AS masked FROM documents")
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(fx.mask("text", ["[0-9a-f]{40}", "[0-9]{3}-[0-9]{4}"])).alias("masked"))


@query(r"SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(url, 'https?://([^\s/?#""''<>]{1,512})', 1), lambda x: lower(x)))) AS hosts FROM pages")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fx.hosts("url").alias("hosts"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\p{L}\p{N}]+')) AS INT) AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fx.word_count("text").alias("words"))


@query(
    cte("packages")
    + """ SELECT pos, CAST(CASE WHEN version IS NULL OR latest IS NULL THEN NULL ELSE greatest(0, CAST(split_part(latest, '.', 1) AS INT) - CAST(split_part(version, '.', 1) AS INT)) END AS INT) AS behind FROM packages"""
)
def majors_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "packages").select("pos", F.when(F.col("version").isNotNull() & F.col("latest").isNotNull(), fx.majors_behind("version", "latest")).alias("behind"))


@query(
    cte("routes")
    + r""", n AS (SELECT pos, regexp_replace(route, '\[[^\]/]+\]|\{[^}/]+\}|:[A-Za-z_]\w*', '{}', 'g') AS r FROM routes) SELECT pos, CASE WHEN length(r) > 1 THEN regexp_replace(r, '/+$', '') ELSE r END AS normal FROM n"""
)
def normal_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "routes").select("pos", fx.normal_route("route").alias("normal"))


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ADO#' || event_id WHEN 1 THEN 'acme/app#' || event_id WHEN 2 THEN 'ABC-' || event_id ELSE 'none' END AS t FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'azure' WHEN 1 THEN 'github' WHEN 2 THEN 'jira' END AS kind FROM t"""
)
def ticket_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.expr("CASE event_id % 4 WHEN 0 THEN concat('ADO#', event_id) WHEN 1 THEN concat('acme/app#', event_id) WHEN 2 THEN concat('ABC-', event_id) ELSE 'none' END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fx.ticket(ref).alias("kind"))


@query("SELECT doc_id, regexp_replace('https://u' || doc_id || ':p@' || source || '.example/x y@z', '(://)[^/\\s@]+@', '\\1', 'g') AS url, regexp_replace(source || '/v ' || doc_id || '.json', '[^\\w.+-]', '_', 'g') AS file FROM documents")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://u"), "doc_id", F.lit(":p@"), "source", F.lit(".example/x y@z"))
    return docs(spark, sf_dir).select("doc_id", fx.strip_credentials(url).alias("url"), fx.safe_filename(F.concat("source", F.lit("/v "), "doc_id", F.lit(".json"))).alias("file"))


LUMINANCE = "(CASE WHEN {0} / 255.0::DOUBLE <= 0.03928 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


@query(
    f"""WITH l AS (SELECT p_partkey, 0.2126 * {LUMINANCE.format('(p_partkey % 256)')} + 0.7152 * {LUMINANCE.format('(p_size * 5)')} + 0.0722 * {LUMINANCE.format('(p_partkey % 97)')} AS l FROM part)
    SELECT p_partkey, round(1.05 / (l + 0.05), 6) AS contrast FROM l"""
)
def contrast_with_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5).alias("g"), (F.col("p_partkey") % 97).alias("b"))
    return part.select("p_partkey", F.round(fx.contrast(fx.luminance("r", "g", "b"), F.lit(1.0)), 6).alias("contrast"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search entries, every third one a whole page."""
    own = docs(spark, sf_dir)
    title = F.split(F.lower("text"), "\n")[0]
    return own.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 != 0, F.lit("h")).alias("anchor"), title.alias("title"), F.lower("source").alias("page"), F.lower("text").alias("body"))


HIT = r"CASE WHEN regexp_matches({0}, '(?:^|[^\p{{L}}\p{{N}}]){1}') THEN 2 WHEN contains({0}, '{1}') THEN 1 ELSE 0 END"
ENTRY = "e AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 <> 0 THEN 'h' END AS anchor, string_split(lower(text), chr(10))[1] AS title, lower(source) AS page, lower(text) AS body FROM documents)"


def _score(word: str) -> str:
    title, page, body = HIT.format("title", word), HIT.format("page", word), HIT.format("body", word)
    return (
        f"(CASE {title} WHEN 2 THEN 12 WHEN 1 THEN 8 ELSE 0 END + CASE {page} WHEN 2 THEN 4 WHEN 1 THEN 3 ELSE 0 END"
        f" + least(4, len(string_split(body, '{word}')) - 1) + CASE WHEN {body} = 2 THEN 1 ELSE 0 END)"
    )


@query(f"WITH {ENTRY} SELECT pos, CAST(CASE WHEN anchor IS NULL THEN 2 ELSE 0 END + {_score('ther')} + {_score('with')} AS BIGINT) AS score FROM e WHERE contains(concat_ws(' ', title, page, body), 'ther') AND contains(concat_ws(' ', title, page, body), 'with')")
def search_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(entries(spark, sf_dir), {"ther": ["ther"], "with": ["with"]})


@query(f"WITH {ENTRY}, f AS (SELECT pos, page AS space, CAST({_score('with')} AS BIGINT) AS score FROM e WHERE contains(body, 'with')) SELECT pos, space, score FROM f ORDER BY CASE space WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, score DESC, pos LIMIT 24")
def search_by_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries(spark, sf_dir).where(F.contains("body", F.lit("with"))).select("pos", F.col("page").alias("space"), fx.term_score("title", "page", "body", "with").cast("long").alias("score"))
    return ranking.first_in_space(found, {"src3": 0, "src1": 1})


@query(
    """WITH t AS (SELECT DISTINCT p_brand AS template, CAST(substring(p_brand, 7) AS INT) AS pos, p_name AS heading FROM part WHERE p_size <= 10), z AS (SELECT template, count(*) AS size, min(pos) AS pos FROM t GROUP BY 1),
    p AS (SELECT DISTINCT l_suppkey AS page, p_name AS heading FROM lineitem JOIN part ON p_partkey = l_partkey),
    h AS (SELECT page, template, count(*) AS hits FROM p JOIN t USING (heading) GROUP BY ALL)
    SELECT page, template, hits FROM h JOIN z USING (template) WHERE hits * 2 >= size QUALIFY row_number() OVER (PARTITION BY page ORDER BY hits / size DESC, pos) = 1"""
)
def guess_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    templates = part.where("p_size <= 10").select(F.col("p_brand").alias("template"), F.substring("p_brand", 7, 9).cast("int").alias("pos"), F.col("p_name").alias("heading")).distinct()
    pages = line.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("page")).agg(F.collect_set("p_name").alias("headings"))
    return ranking.guess_template(pages, templates)


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, min(p_partkey) AS pos FROM part GROUP BY 1), k AS (SELECT DISTINCT substring(p_name, 1, 3) || substring(p_name, 5) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS key FROM part),
    u AS (SELECT key FROM k WHERE key NOT IN (SELECT name FROM n)), d AS (SELECT key, name, pos, levenshtein(key, name) AS d FROM u, n)
    SELECT u.key, m.name AS suggestion FROM u LEFT JOIN (SELECT key, name FROM d WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, pos, name) = 1) m ON m.key = u.key"""
)
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    keys = part.select(F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("")).alias("key"))
    return ranking.did_you_mean(keys, known)


#: Lines of code, each with what the rules find in it, as (line, rule, severity, category).
PLANTED = (
    ("res.redirect(\n  safe(req.query.next))\nredirect('/home'); req.query.x", ((1, "redirect.open", "medium", "A01:2021"),)),
    ("requests.get(u, verify=False)\nverify = Falsehood\nagent({ rejectUnauthorized: false })", ((1, "tls.disabled", "high", "A02:2021"), (3, "tls.disabled", "high", "A02:2021"))),
    ("el.innerHTML = x\nel.innerHTML == y", ((1, "xss.innerHTML", "medium", "A03:2021"),)),
    ("<p dangerouslySetInnerHTML={{ __html:\n  DOMPurify.sanitize(x) }} />", ((1, "xss.dangerouslySetInnerHTML", "low", "A03:2021"),)),
    ("eval(x)\nmy.eval(y)\n/a/g.exec(z)\nnew  Function(q)", ((1, "code.eval", "high", "A03:2021"), (4, "code.eval", "high", "A03:2021"))),
    ("require('child_process')\ncp.execSync (c)\n/a/g.exec(z)", ((2, "code.eval", "high", "A03:2021"),)),
    ("q = f'SELECT {x}'\n\n\ndb.execute(q)\n\n\n\n\ndb.execute(z)", ((4, "sql.concat", "high", "A03:2021"),)),
    ("cors({ origin: '*',\n credentials: true })", ((1, "cors.wildcardCredentials", "high", "A05:2021"),)),
    ("allow_credentials=True\nx\nallow_origins=['*']", ((1, "cors.wildcardCredentials", "high", "A05:2021"),)),
    ("DEBUG = True\ndebug: true\nDEBUG = Truest", ((1, "debug.enabled", "low", "A05:2021"), (2, "debug.enabled", "low", "A05:2021"))),
    ("decode(t, options={'verify_signature': False})\nalgorithms=['HS256',\n 'none']", ((1, "jwt.noVerify", "high", "A07:2021"), (2, "jwt.noVerify", "high", "A07:2021"))),
    ("secret_name = 'abcdefgh1'\npassword: \"********\"\ntoken = 'changeme'\napi-key = '****' + key.slice(4)\napiKey = 'short'", ((1, "secret.default", "medium", "A07:2021"),)),
    ("app.post('/api/login', h)\n" + " " * 210 + "\napp.post('/signin', throttle, h)\n", ((1, "auth.noRateLimit", "info", "A07:2021"),)),
    ("nothing = here", ()),
)
FOUND = ", ".join(f"({i}, {line}, '{rule}', '{severity}', '{category}')" for i, (_, found) in enumerate(PLANTED) for line, rule, severity, category in found)


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
    n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM d), f(k, line, rule, severity, category) AS (VALUES {FOUND})
    SELECT doc_id, CAST(line AS INT) AS line, 'secret.default' AS rule, 'medium' AS severity, 'A07:2021' AS category FROM l
    WHERE regexp_matches(x, '(?i)\\b(?:admin[a-z_]*|password\\w*|passwd\\w*|secret[a-z_]*|api[_-]?key\\w*|token\\w*)\\s*[:=]\\s*(?:"[^"\\n]{{8,}}"|''[^''\\n]{{8,}}''|`[^`\\n]{{8,}}`)')
    UNION SELECT doc_id, CAST(n + line AS INT), rule, severity, category FROM n JOIN f ON k = doc_id % {len(PLANTED)}"""
)
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with lines of code after it."""
    code = F.element_at(F.array(*[F.lit(text) for text, _ in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    own = docs(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), code).alias("text"))
    return scanners.scan(own, scanners.SECURITY_RULES, key="doc_id")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 OR p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 6 = 0 THEN 'role' ELSE 'user' END WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE 'none' END AS access FROM part"""
)
def guard_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    guards = F.array_compact(F.array(F.when(F.col("p_partkey") % 6 == 0, "requireAdmin"), F.when(F.col("p_size") % 4 == 0, "requireLogin"), F.when(F.col("p_partkey") % 5 == 0, "guard")))
    return part.select("p_partkey", scanners.strongest_guard(guards).alias("access"))


@query(
    r"""WITH w AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}+#]+', '  ', 'g') || ' ' AS w FROM documents),
    m AS (SELECT doc_id, trim(replace(unnest(regexp_extract_all(w, ' (the  er  of|of  the|the  er|er  of  the|with|the|of) ')), '  ', ' ')) AS run FROM w),
    n(name, run) AS (VALUES ('A', 'the'), ('B', 'of the'), ('C', 'with'), ('D', 'the er'), ('E', 'er of the'), ('F', 'the er of'), ('G', 'of'))
    SELECT doc_id, name, count(*) AS n FROM m JOIN n USING (run) GROUP BY ALL"""
)
def technology_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = {"A": "the", "B": "of the", "C": "with", "D": "the er", "E": "er of the", "F": "the er of", "G": "of"}
    names = spark.createDataFrame([(name, run.split()) for name, run in runs.items()], "name string, words array<string>")
    return scanners.mentions(docs(spark, sf_dir), names)


@query(
    r"""WITH p AS (SELECT page_id, 'diff' || chr(10) || '@@ -1,' || (page_id % 9 + 1) || ' +' || (page_id * 3 + 1) || ',' || (page_id % 5) || ' @@' || chr(10) || '+x' || chr(10) || '@@ -7 +' || (page_id + 40) || ' @@' AS patch FROM pages)
    SELECT page_id, page_id * 3 + 1 AS lo, page_id * 3 + page_id % 5 AS hi FROM p WHERE page_id % 5 > 0 UNION ALL SELECT page_id, page_id + 40, page_id + 40 FROM p"""
)
def touched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    patch = F.concat(F.lit("diff\n@@ -1,"), i % 9 + 1, F.lit(" +"), i * 3 + 1, F.lit(","), i % 5, F.lit(" @@\n+x\n@@ -7 +"), i + 40, F.lit(" @@"))
    return ordered.touched_lines(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", patch.alias("patch")), "page_id", "patch")
