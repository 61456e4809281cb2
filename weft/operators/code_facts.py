"""Facts read from code and configuration by rules on lines: routes, behaviours, images, manifests.

The rules are tables: a format is a row of patterns, not a parser. They read the
declarations that stand on one line; composed prefixes and nested blocks are left to
the tools of each language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RouteRule:
    """Lines of files that ``files`` matches declare a route: the groups of its method and its path (0: any method)."""

    framework: str
    files: str
    pattern: str
    method: int
    path: int


ROUTE_RULES = (
    RouteRule("express", r"\.(?:js|mjs|ts)$", r"\b(?:app|router)\.(get|post|put|patch|delete|all)\(\s*[\"'`](/[^\"'`]*)[\"'`]", 1, 2),
    RouteRule("fastapi", r"\.py$", r"^\s*@\w+\.(get|post|put|patch|delete)\(\s*[\"']([^\"']*)[\"']", 1, 2),
    RouteRule("flask", r"\.py$", r"^\s*@\w+\.(route)\(\s*[\"']([^\"']*)[\"']", 0, 2),
    RouteRule("nestjs", r"\.ts$", r"^\s*@(Get|Post|Put|Patch|Delete)\(\s*[\"'`]([^\"'`]*)[\"'`]", 1, 2),
    RouteRule("spring", r"\.(?:java|kt)$", r"@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"", 1, 2),
    RouteRule("aspnet", r"\.cs$", r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]*)\"", 1, 2),
    RouteRule("go", r"\.go$", r"\.(GET|POST|PUT|PATCH|DELETE)\(\s*\"(/[^\"]*)\"", 1, 2),
    RouteRule("laravel", r"\.php$", r"\bRoute::(get|post|put|patch|delete)\(\s*[\"']([^\"']*)[\"']", 1, 2),
    RouteRule("rails", r"\.rb$", r"^\s*(get|post|put|patch|delete)\s+[\"']([^\"']*)[\"']", 1, 2),
    RouteRule("actix", r"\.rs$", r"#\[(get|post|put|patch|delete)\(\s*\"([^\"]*)\"", 1, 2),
)


def code_lines(files: DataFrame) -> DataFrame:
    """file, line, l of every line."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "l"))
    return lines.select("file", (F.col("at") + 1).alias("line"), "l")


def routes(files: DataFrame, rules: tuple[RouteRule, ...] = ROUTE_RULES) -> DataFrame:
    """method, route, file, line, framework of the routes that code declares (J14): one pass over the lines."""

    def found(r: RouteRule) -> Column:
        method = F.upper(F.regexp_extract("l", r.pattern, r.method)) if r.method else F.lit("ANY")
        path = F.regexp_extract("l", r.pattern, r.path)
        named = F.struct(
            F.when(method == "ALL", "ANY").otherwise(method).alias("method"), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("route"), F.lit(r.framework).alias("framework")
        )
        return F.when(F.col("file").rlike(r.files) & F.col("l").rlike(r.pattern), named)

    rows = code_lines(files).select("file", "line", F.explode(F.array_compact(F.array(*map(found, rules)))).alias("r"))
    return rows.select("r.method", "r.route", "file", "line", "r.framework")


def screens(files: DataFrame) -> DataFrame:
    """route, file: pages of folder routers (J15); groups and slots are dropped."""
    app = F.regexp_extract("file", r"(?:^|/)app/(.*?)/?page\.(?:tsx|jsx|js)$", 1)
    is_app = F.col("file").rlike(r"(?:^|/)app/(?:.*/)?page\.(?:tsx|jsx|js)$")
    parts = F.filter(F.split(app, "/"), lambda x: (x != "") & ~x.rlike(r"^\(|^@"))
    return files.where(is_app).select(F.concat(F.lit("/"), F.array_join(parts, "/")).alias("route"), "file").distinct()


#: family, signal, pattern; the vocabulary is fixed, the patterns are this package's own.
SIGNALS = (
    ("search", "like", r"(?i)\bI?LIKE\b\s*[\"'%:$?(]"),
    ("search", "contains", r"\.(?:includes|contains)\("),
    ("search", "startsWith", r"\.(?:startsWith|startswith)\("),
    ("search", "endsWith", r"\.(?:endsWith|endswith)\("),
    ("search", "fullText", r"(?i)\bto_tsvector\b|\bMATCH\s*\([^)]*\)\s*AGAINST\b"),
    ("filter", "in", r"(?i)\bWHERE\b[^\n]*\bIN\s*\("),
    ("filter", "range", r"(?i)\bBETWEEN\b[^\n]{1,80}\bAND\b"),
    ("sort", "orderBy", r"(?i)\bORDER\s+BY\b|\.(?:orderBy|order_by)\("),
    ("pagination", "limit", r"(?i)\bLIMIT\s+[\d:$?{]|\.limit\("),
    ("pagination", "offset", r"(?i)\bOFFSET\s+[\d:$?{]|\.offset\("),
    ("trigger", "debounce", r"\bdebounce\("),
    ("validation", "required", r"\brequired\b\s*[:=(]|@NotNull\b|@IsNotEmpty\("),
    ("validation", "email", r"\.email\(|@IsEmail\(|\bEmailStr\b"),
    ("validation", "max", r"\.max\(\s*\d|@Max\(|max_length\s*="),
    ("validation", "min", r"\.min\(\s*\d|@Min\(|min_length\s*="),
    ("schedule", "cron", r"[\"'](?:[\d*/,-]+\s+){4}[\d*/,-]+[\"']"),
    ("notification", "email", r"(?i)\bsend_?mail\("),
    ("export", "csv", r"(?i)\btext/csv\b|\bto_csv\("),
)
#: Kinds of card by family.
KINDS = {"search": "search", "filter": "search", "sort": "list", "pagination": "list", "trigger": "form", "values": "form", "validation": "form", "scope": "access", "export": "export", "import": "import", "notification": "notification", "schedule": "job"}


def behaviours(files: DataFrame, most: int | None = None) -> DataFrame:
    """family, signal, file, line: hints of behaviour, each once (J08, J09). A report that shows only its first rows gives ``most``."""
    each = F.array_compact(F.array(*[F.when(F.col("l").rlike(p), F.struct(F.lit(f).alias("family"), F.lit(s).alias("signal"))) for f, s, p in SIGNALS]))
    rows = code_lines(files).select("file", "line", F.explode(each).alias("b")).select("b.family", "b.signal", "file", "line").distinct()
    return rows if most is None else rows.orderBy("file", "line", "family", "signal").limit(most)


def kinds_of(hints: DataFrame) -> DataFrame:
    """Kinds of card that the hints point to (D31); validation that only names a type or an option doesn't count."""
    kind = F.lit(None).cast("string")
    for family, name in KINDS.items():
        kind = F.when(F.col("family") == family, name).otherwise(kind)
    real = ~((F.col("family") == "validation") & F.col("signal").isin("type", "optional"))
    return hints.where(real).select(kind.alias("kind")).where("kind IS NOT NULL").distinct()


def image_parts(image: Column) -> tuple[Column, Column]:
    """(repository, tag) of an image reference (H42): a digest is no tag, a port no tag either."""
    plain = F.regexp_replace(image, "@sha256:[0-9a-f]+$", "")
    tag = F.regexp_extract(plain, r":([\w][\w.-]*)$", 1)
    return F.regexp_replace(plain, r":[\w][\w.-]*$", ""), F.when(tag != "", tag)


def docker_stages(files: DataFrame) -> DataFrame:
    """file, stage, image, tag, ports, root, variables: one row for each FROM of a Dockerfile.

    Lines carry the number of the FROM above them; a stage runs as root until it names another user.
    """
    from pyspark.sql import Window

    lines = code_lines(files.where(F.col("file").rlike(r"(?:^|/)Dockerfile(?:\.[\w-]+)?$|\.Dockerfile$")))
    is_from = F.col("l").rlike(r"(?i)^\s*FROM\s+\S+")
    staged = lines.withColumn("stage", F.sum(F.when(is_from, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line"))).where("stage > 0")
    image = F.when(is_from, F.regexp_extract("l", r"(?i)^\s*FROM\s+(?:--platform=\S+\s+)?(\S+)", 1))
    port = F.regexp_extract("l", r"(?i)^\s*EXPOSE\s+(\d+)", 1)
    name = F.regexp_extract("l", r"(?i)^\s*(?:ENV|ARG)\s+([A-Za-z_]\w*)", 1)
    user = F.regexp_extract("l", r"(?i)^\s*USER\s+(\S+)", 1)
    grouped = staged.groupBy("file", "stage").agg(
        F.max(image).alias("from_"),
        F.array_sort(F.collect_set(F.when(port != "", port.cast("int")))).alias("ports"),
        F.array_sort(F.collect_set(F.when(name != "", name))).alias("variables"),
        F.max_by(user, F.when(user != "", F.col("line"))).alias("user"),
    )
    repository, tag = image_parts(F.col("from_"))
    return grouped.select("file", F.col("stage").cast("int").alias("stage"), repository.alias("image"), tag.alias("tag"), "ports", F.coalesce(F.col("user").isin("root", "0"), F.lit(True)).alias("root"), "variables")


#: Words of names and the environments they mean.
ENVIRONMENTS = {"prod": "production", "production": "production", "live": "production", "staging": "staging", "stage": "staging", "preprod": "staging", "uat": "staging", "test": "test", "qa": "test", "dev": "development", "development": "development", "local": "development"}


def environment_of(name: Column) -> Column:
    """The environment that a name means (H41): the last known word of its path."""
    words = F.reverse(F.split(F.lower(name), r"[^a-z]+"))
    table = F.create_map(*[F.lit(x) for pair in ENVIRONMENTS.items() for x in pair])
    return F.get(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()), F.lit(0))


def deployment(infra: DataFrame) -> DataFrame:
    """env, rank, items (kind, name): infrastructure by environment, production last (C22). ``infra``: env, kind, name."""
    rank = F.coalesce(*[F.when(F.col("env") == e, r) for r, e in enumerate(("development", "test", "staging", "production"))], F.lit(9))
    return infra.groupBy("env").agg(F.array_sort(F.collect_set(F.struct("kind", "name"))).alias("items")).select("env", rank.alias("rank"), "items")


def manifests(files: DataFrame) -> DataFrame:
    """ecosystem, name, spec, dev, manifest: declared packages of npm, pypi, go, cargo, gem and composer files.

    JSON manifests are read as maps; the others line by line, TOML and go.mod with the
    table or block that a line stands in carried down from its head.
    """
    from pyspark.sql import Window

    base = F.regexp_extract("file", r"([^/]+)$", 1)
    npm = files.where(base.isin("package.json", "composer.json")).select("file", F.when(base == "package.json", "npm").otherwise("composer").alias("ecosystem"), "text")
    groups = (("dependencies", False), ("devDependencies", True), ("require", False), ("require-dev", True))

    def entries(group: str, dev: bool) -> Column:
        found = F.coalesce(F.from_json(F.get_json_object("text", f"$['{group}']"), "map<string,string>"), F.create_map().cast("map<string,string>"))
        return F.transform(F.map_entries(found), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(dev).alias("dev")))

    maps = F.concat(*[entries(g, d) for g, d in groups])
    out = npm.select("ecosystem", F.explode(maps).alias("d"), F.col("file").alias("manifest")).select("ecosystem", "d.name", "d.spec", "d.dev", "manifest")
    out = out.where("NOT (ecosystem = 'composer' AND (name = 'php' OR name LIKE 'ext-%'))")

    lines = code_lines(files.where(base.rlike(r"^(?:requirements[\w.-]*\.txt|Cargo\.toml|go\.mod|Gemfile)$"))).withColumn("base", base)
    head = F.when(F.col("l").rlike(r"^\s*\["), F.regexp_extract("l", r"^\s*\[+([^\]]+)\]", 1)).when(F.col("l").rlike(r"^require\s*\("), F.lit("require")).when(F.col("l").rlike(r"^\)"), F.lit(""))
    lines = lines.withColumn("head", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("line")), F.lit("")))

    def take(where: Column, ecosystem: str, pattern: str, dev: Column) -> DataFrame:
        rows = lines.where(where & F.col("l").rlike(pattern))
        spec = F.regexp_extract("l", pattern, 2)
        return rows.select(F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("l", pattern, 1).alias("name"), F.when(spec != "", spec).alias("spec"), dev.alias("dev"), F.col("file").alias("manifest"))

    no = F.lit(False)
    out = out.unionByName(take(F.col("base").startswith("requirements"), "pypi", r"^([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*((?:[=<>!~]=?=?\s*[^\s;#,]+(?:\s*,\s*)?)*)", F.col("base").rlike("dev|test")))
    out = out.unionByName(take((F.col("base") == "Cargo.toml") & F.col("head").rlike("dependencies$"), "cargo", r"^([\w-]+)\s*=\s*(?:\{[^}]*version\s*=\s*)?\"([^\"]*)\"", F.col("head").rlike("^dev-")))
    out = out.unionByName(take((F.col("base") == "go.mod") & ((F.col("head") == "require") | F.col("l").rlike("^require ")), "go", r"^(?:require\s+|\s+)([\w./~-]+\.[\w./~-]+)\s+(v\S+)", no))
    return out.unionByName(take(F.col("base") == "Gemfile", "gem", r"^\s*gem\s+[\"']([\w-]+)[\"'](?:\s*,\s*[\"']([^\"']+)[\"'])?", no))
