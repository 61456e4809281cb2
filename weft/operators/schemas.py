"""Database tables that code declares, in SQL and in SQLAlchemy models; instruction files; imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import hidden_characters

#: Words that begin a constraint instead of a column.
NOT_A_COLUMN = r"(?i)^(?:constraint|primary|foreign|unique|check|exclude|like|key|index)$"


def _sorted_others(found: Column, own: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != own)))


def sql_tables(files: DataFrame) -> DataFrame:
    """table, columns, references, file of CREATE TABLE statements (A36). Commas inside parentheses don't part columns."""
    head = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?\"?(\w+)\"?\s*\((.*?)\)\s*;"
    statements = F.regexp_extract_all("text", F.lit(r"(?is)(create\s+table\s+(?:if\s+not\s+exists\s+)?\"?\w+\"?\s*\(.*?\)\s*;)"), F.lit(1))
    rows = files.where(F.col("file").endswith(".sql")).select("file", F.explode(statements).alias("s"))
    name, body = F.regexp_extract("s", head, 1), F.regexp_extract("s", head, 2)
    flat = F.regexp_replace(F.regexp_replace(body, r"\([^()]*\)", " "), r"\([^()]*\)", " ")
    columns = F.filter(F.transform(F.split(flat, ","), lambda c: F.replace(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")[0], F.lit('"'), F.lit(""))), lambda c: (c != "") & ~c.rlike(NOT_A_COLUMN))
    references = F.regexp_extract_all(body, F.lit(r"(?i)\breferences\s+\"?(\w+)"), F.lit(1))
    return rows.select(name.alias("table"), columns.alias("columns"), _sorted_others(references, name).alias("references"), "file")


def row_security(files: DataFrame) -> DataFrame:
    """table, rls, policies of the row security that SQL files switch on."""
    own = files.where(F.col("file").endswith(".sql"))
    on = own.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?i)alter\s+table\s+\"?(\w+)\"?\s+enable\s+row\s+level\s+security"), F.lit(1))).alias("table"), F.lit(None).cast("string").alias("policy"))
    policy = r"(?i)create\s+policy\s+\"?([\w-]+)\"?\s+on\s+\"?(\w+)"
    made = own.select(F.explode(F.regexp_extract_all("text", F.lit(policy.replace("(?i)", "(?i)(") + ")"), F.lit(1))).alias("s")).select(F.regexp_extract("s", policy, 2).alias("table"), F.regexp_extract("s", policy, 1).alias("policy"))
    both = on.unionByName(made)
    return both.groupBy("table").agg(F.bool_or(F.col("policy").isNull()).alias("rls"), F.array_sort(F.collect_set("policy")).alias("policies"))


def model_tables(files: DataFrame) -> DataFrame:
    """table, columns, references, file of SQLAlchemy classes with a table name."""
    classes = F.split("text", r"(?m)^(?=class\s+\w+)")
    rows = files.where(F.col("file").endswith(".py") & F.contains("text", F.lit("__tablename__"))).select("file", F.explode(classes).alias("c"))
    name = F.regexp_extract("c", r"__tablename__\s*=\s*[\"']([^\"']+)[\"']", 1)
    columns = F.regexp_extract_all("c", F.lit(r"(?m)^\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:db\.|sa\.)?(?:Column|mapped_column)\("), F.lit(1))
    references = F.regexp_extract_all("c", F.lit(r"ForeignKey\(\s*[\"'](?:\w+\.)*?(\w+)\.\w+[\"']"), F.lit(1))
    return rows.where(name != "").select(name.alias("table"), columns.alias("columns"), _sorted_others(references, name).alias("references"), "file")


def declared_tables(files: DataFrame) -> DataFrame:
    """Tables of models and of SQL files, with their row security."""
    every = model_tables(files).unionByName(sql_tables(files))
    return every.join(row_security(files), "table", "left").select("table", "columns", "references", "file", F.coalesce("rls", F.lit(False)).alias("rls"), F.coalesce("policies", F.array().cast("array<string>")).alias("policies"))


#: Names of files that instruct agents.
AGENT_FILES = r"(?:^|/)(?:AGENTS|CLAUDE|GEMINI)\.md$|(?:^|/)\.cursorrules$|(?:^|/)\.github/copilot-instructions\.md$|(?:^|/)\.cursor/rules/[^/]+\.mdc?$"


def agent_files(files: DataFrame) -> DataFrame:
    """file, lines, words, hidden (number of invisible characters) of instruction files."""
    own = files.where(F.col("file").rlike(AGENT_FILES))
    return own.select("file", F.size(F.split("text", "\r?\n")).alias("lines"), F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.size(hidden_characters("text")).alias("hidden"))


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst: files that a file imports by a relative path (G12). ``files``: file, text.

    Specifiers are resolved by joins: as written, with an extension, or as the index
    or __init__ of a folder; the first that exists counts.
    """
    folder = F.regexp_replace("file", r"[^/]*$", "")
    js = F.regexp_extract_all("text", F.lit(r"(?:\bfrom|\bimport|\brequire\()\s*\(?\s*[\"'](\.{1,2}/[^\"']+)[\"']"), F.lit(1))
    code = files.where(F.col("file").rlike(r"\.(?:js|jsx|mjs|cjs|ts|tsx|vue)$")).select(F.col("file").alias("src"), folder.alias("folder"), F.explode(F.array_distinct(js)).alias("spec"))
    py = F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+(\.+[\w.]*)\s+import\b"), F.lit(1))
    dots = F.length(F.regexp_extract("m", r"^\.+", 0))
    python = files.where(F.col("file").endswith(".py")).select(F.col("file").alias("src"), folder.alias("folder"), F.explode(F.array_distinct(py)).alias("m"))
    python = python.select("src", "folder", F.concat(F.lit("./"), F.repeat(F.lit("../"), dots - 1), F.replace(F.regexp_replace("m", r"^\.+", ""), F.lit("."), F.lit("/"))).alias("spec"))
    steps = F.filter(F.split(F.concat("folder", "spec"), "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x))))
    plain = code.unionByName(python).select("src", F.array_join(walked, "/").alias("base"))
    endings = ["", *(f".{x}" for x in ("ts", "tsx", "js", "jsx", "mjs", "vue", "py")), *(f"/index.{x}" for x in ("ts", "tsx", "js", "jsx", "mjs")), "/__init__.py"]
    tried = plain.select("src", "base", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in endings])).alias("rank", "dst"))
    found = tried.join(files.select(F.col("file").alias("dst")), "dst", "left_semi").groupBy("src", "base").agg(F.min_by("dst", "rank").alias("dst"))
    return found.where("src <> dst").select("src", "dst").distinct()
