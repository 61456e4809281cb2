"""Files of other tools and for them: features, zones, findings, backlogs, interface descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.logs import write_csv

#: Columns of an export by target.
TARGETS = {"azure": ("ID", "Work Item Type", "Title", "Parent"), "jira": ("Issue ID", "Issue Type", "Summary", "Parent ID"), "github": ("id", "kind", "title", "parent"), "gitlab": ("id", "kind", "title", "parent"), "json": ("id", "kind", "title", "parent")}


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, title, routes; file and problem of files that aren't a list of features)."""
    schema = "features array<struct<id:string,title:string,routes:array<string>>>, _broken string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", "true").json(path).withColumn("file", F.input_file_name())
    good = rows.where("features IS NOT NULL").select(F.explode("features").alias("f")).select("f.*").where("id IS NOT NULL")
    return good, rows.where("features IS NULL").select("file", F.lit("not a list of features").alias("problem"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """title, route, n, x, y, w, h, label: the zones of every screenshot's description."""
    schema = "file string, title string, route string, width int, height int, version string, zones array<struct<n:int,x:double,y:double,w:double,h:double,label:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.select("title", "route", F.explode("zones").alias("z")).select("title", "route", "z.*")


def read_findings(spark: SparkSession, path: str, tool: str, most: int | None = None) -> DataFrame:
    """rule, file, line of a tool's report (A32): gitleaks, semgrep or osv. Only these fields are read, never a finding's text; a report that can't be read gives none."""
    read = lambda schema: spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    if tool == "gitleaks":
        out = read("RuleID string, File string, StartLine int").select(F.col("RuleID").alias("rule"), F.col("File").alias("file"), F.col("StartLine").alias("line"))
    elif tool == "semgrep":
        rows = read("results array<struct<check_id:string,path:string,start:struct<line:int>>>")
        out = rows.select(F.explode("results").alias("r")).select(F.col("r.check_id").alias("rule"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line"))
    elif tool == "osv":
        rows = read("results array<struct<source:struct<path:string>,packages:array<struct<vulnerabilities:array<struct<id:string>>>>>>")
        found = rows.select(F.explode("results").alias("r")).select(F.col("r.source.path").alias("file"), F.explode("r.packages").alias("p")).select("file", F.explode("p.vulnerabilities").alias("v"))
        out = found.select(F.col("v.id").alias("rule"), "file", F.lit(None).cast("int").alias("line"))
    else:
        raise ValueError(f"no such tool: {tool}")
    out = out.where("rule IS NOT NULL").distinct()
    return out if most is None else out.orderBy("file", "line", "rule").limit(most)


def write_backlog(items: DataFrame, linked: DataFrame, path: str, target: str) -> None:
    """Items that the target doesn't have yet, in its columns (A31, L06): CSV for azure and jira, JSON lines for the others. ``items``: id, kind, title, parent; ``linked``: id."""
    names = TARGETS[target]
    fresh = items.join(linked.select("id"), "id", "left_anti").select(*[F.col(c).alias(n) for c, n in zip(("id", "kind", "title", "parent"), names)])
    if target in ("azure", "jira"):
        write_csv(fresh, path)
    else:
        fresh.write.mode("overwrite").json(path)


def described_parameters(files: DataFrame) -> DataFrame:
    """file, method, route, name, place, required of the parameters that OpenAPI descriptions list."""
    methods = "get put post delete patch".split()
    parameter = "struct<name:string,`in`:string,required:boolean>"
    operation = f"struct<parameters:array<{parameter}>>"
    schema = f"openapi string, paths map<string,struct<{','.join(f'{m}:{operation}' for m in methods)}>>"
    rows = files.select("file", F.from_json("text", schema).alias("d")).where("d.openapi IS NOT NULL").select("file", F.explode("d.paths").alias("route", "o"))
    each = F.array(*[F.struct(F.lit(m.upper()).alias("method"), F.col(f"o.{m}.parameters").alias("ps")) for m in methods])
    listed = rows.select("file", "route", F.explode(each).alias("e")).select("file", "route", "e.method", F.explode("e.ps").alias("p"))
    return listed.select("file", "method", "route", "p.name", F.col("p.in").alias("place"), F.coalesce("p.required", F.lit(False)).alias("required"))


def schema_signals(files: DataFrame) -> DataFrame:
    """file, field, signal, value: bounds that validation schemas put on a field (J12), as ``name: z.string().min(3)``, ``@Length(max=9) name`` and ``name: str = Field(max_length=9)``."""
    chain = r"\b(\w+)\s*:\s*z\.\w+\(\)((?:\.\w+\([^()]*\))+)"
    calls = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(f"({chain})"), F.lit(1))).alias("s")).select("file", F.regexp_extract("s", chain, 1).alias("field"), F.regexp_extract("s", chain, 2).alias("c"))
    call = r"\.(min|max|length|email|url|regex|optional)\(([^()]*)\)"
    zod = calls.select("file", "field", F.explode(F.regexp_extract_all("c", F.lit(f"({call})"), F.lit(1))).alias("x")).select("file", "field", F.regexp_extract("x", call, 1).alias("signal"), F.nullif(F.regexp_extract("x", call, 2), F.lit("")).alias("value"))
    pydantic = r"\b(\w+)\s*:\s*[\w\[\], |]+=\s*Field\(([^()]*)\)"
    fields = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(f"({pydantic})"), F.lit(1))).alias("s")).select("file", F.regexp_extract("s", pydantic, 1).alias("field"), F.regexp_extract("s", pydantic, 2).alias("c"))
    named = r"\b(min_length|max_length|ge|le|gt|lt|pattern)\s*=\s*([^,]+)"
    names = F.create_map(*[F.lit(x) for pair in {"min_length": "min", "max_length": "max", "ge": "min", "le": "max", "gt": "min", "lt": "max", "pattern": "regex"}.items() for x in pair])
    own = fields.select("file", "field", F.explode(F.regexp_extract_all("c", F.lit(f"({named})"), F.lit(1))).alias("x")).select("file", "field", names[F.regexp_extract("x", named, 1)].alias("signal"), F.trim(F.regexp_extract("x", named, 2)).alias("value"))
    return zod.unionByName(own).distinct()


def code_functions(files: DataFrame) -> DataFrame:
    """file, name, line, lines, complexity of the functions of Python files (J19): one and its branches.

    A function goes from its ``def`` to the next line that is indented no deeper; lines
    carry the number of the ``def`` above them, so nested functions count apart from what surrounds them.
    """
    from pyspark.sql import Window

    own = files.where(F.col("file").endswith(".py"))
    lines = own.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "l")).where(~F.col("l").rlike(r"^\s*(?:#|$)"))
    depth = F.length(F.regexp_extract("l", r"^\s*", 0))
    is_def = F.col("l").rlike(r"^\s*(?:async\s+)?def\s+\w+")
    by_place = Window.partitionBy("file").orderBy("at")
    marked = lines.withColumn("depth", depth).withColumn("head", F.when(is_def, F.struct(F.col("at").alias("at"), depth.alias("depth"), F.regexp_extract("l", r"def\s+(\w+)", 1).alias("name"))))
    carried = marked.withColumn("h", F.last("head", ignorenulls=True).over(by_place)).where("h IS NOT NULL")
    # A line at the head's depth or less ends it; what follows belongs to no function until the next one.
    ended = F.max(F.when((F.col("at") > F.col("h.at")) & (F.col("depth") <= F.col("h.depth")), 1).otherwise(0)).over(Window.partitionBy("file", "h.at").orderBy("at"))
    body = carried.withColumn("ended", ended).where("ended = 0")
    branches = F.regexp_count("l", F.lit(r"\b(?:if|elif|for|while|except|and|or|case)\b"))
    out = body.groupBy("file", "h").agg(F.count("*").alias("lines"), (F.sum(branches) + 1).alias("complexity"))
    return out.select("file", "h.name", (F.col("h.at") + 1).alias("line"), "lines", "complexity")


def page_text(html: Column) -> Column:
    """Text of an HTML page with headings as # and items as - (H12); head, scripts and styles left out, what is left of markup inert."""
    out = F.regexp_replace(html, r"(?is)<(head|script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{level}\b[^<>]*>\s*", "\n" + "#" * level + " ")
    out = F.regexp_replace(out, r"(?i)<li\b[^<>]*>\s*", "\n- ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|h[1-6]|ul|ol|table|tr|section|article|br|nav|footer|header)\b[^<>]*>", "\n")
    out = F.regexp_replace(out, r"<[A-Za-z/!][^<>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" *\n *", "\n"), r"\n{2,}", "\n"), F.lit(" \n"))
