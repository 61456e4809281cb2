"""Files of a project: listings, bounded reads, facts envelopes, outlines and settings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.filters import matches_glob

#: Folders that are never listed.
SKIPPED = ("node_modules", ".git", "dist", "build", "__pycache__", "vendor", "coverage", ".next", "target")
#: Extension to format.
FORMATS = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf", "json": "json", "csv": "csv",
    "drawio": "diagram", "puml": "diagram", "plantuml": "diagram", "mmd": "diagram", "mermaid": "diagram", "xml": "diagram",
}


def list_files(spark: SparkSession, root: str, most_bytes: int = 512_000, globs: tuple[str, ...] = ()) -> DataFrame:
    """path (below ``root``), length, content of readable files (A01, A03, A27): skipped folders left out, larger files with null content.

    The length filter reaches the scan; content is only read where it is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^.*?" + "\\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + "\\E/", "")
    rows = files.select(below.alias("path"), "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    rows = rows.where(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", "\\.") for x in SKIPPED) + ")/"))
    return rows.where(matches_glob("path", *globs)) if globs else rows


def file_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file and text, file and reason): what can't be read is told apart, as unknown isn't empty."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    state = F.when(F.col("content").isNull(), "too large").when(text.isNull(), "not UTF-8")
    rows = files.select(F.col("path").alias("file"), text.alias("text"), state.alias("reason"))
    return rows.where("reason IS NULL").select("file", "text"), rows.where("reason IS NOT NULL").select("file", "reason")


def format_of(path: Column | str) -> Column:
    """Format by extension, null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for e, f in FORMATS.items():
        out = F.when(extension == e, f).otherwise(out)
    return out


def read_facts(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Items of facts envelopes with their source and commit (A04); broken files give none."""
    schema = f"source string, generator string, generated string, `commit` string, app string, items array<struct<{item_schema}>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.select("source", "commit", F.explode("items").alias("i")).select("source", "commit", "i.*")


def write_facts(items: DataFrame, path: str, source: str, generator: str, generated: str, commit: str, app: str) -> None:
    """One envelope for each partition of ``items``, so that no task gathers all of them."""
    head = {"source": source, "generator": generator, "generated": generated, "commit": commit, "app": app}
    parts = items.select(F.struct(*items.columns).alias("i")).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("i").alias("items"))
    parts.select(*[F.lit(v).alias(k) for k, v in head.items()], "items").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """section, group and page of an outline with their places."""
    schema = "sections array<struct<id:string,title:string,groups:array<struct<title:string,pages:array<struct<id:string,title:string>>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    sections = rows.select(F.posexplode("sections").alias("section_pos", "s"))
    groups = sections.select("section_pos", F.col("s.id").alias("section"), F.posexplode("s.groups").alias("group_pos", "g"))
    return groups.select("section", "section_pos", F.col("g.title").alias("group"), "group_pos", F.posexplode("g.pages").alias("page_pos", "p")).select(
        "section", "section_pos", "group", "group_pos", F.col("p.id").alias("page"), F.col("p.title").alias("title"), "page_pos"
    )


def canonical_map(entries: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """page, version, hash of a sync reference, whose pages are a map."""
    schema = "version string, pages map<string,struct<version:string,hash:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(F.explode("pages").alias("page", "s")).select("page", "s.version", "s.hash")


def change_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of what changed, one for each version; broken ones are left out."""
    rows = spark.read.schema("version string, generated string, total long").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.where("version IS NOT NULL")


def parse_env(files: DataFrame) -> DataFrame:
    """file, line, name, value of dotenv files (A29): export, quotes and comments as usual."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "l"))
    m = lambda i: F.regexp_extract("l", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^#]*?))\s*(?:#.*)?$", i)
    return lines.where(m(1) != "").select("file", (F.col("at") + 1).alias("line"), m(1).alias("name"), F.concat(m(2), m(3), m(4)).alias("value"))


def dumped(value: object) -> str:
    """Compact JSON with sorted keys, for small settings on the driver."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
