"""Append-only logs: usage spans as JSON lines, commit logs as text, CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One span a line. Absent fields are null.
USAGE_SCHEMA = (
    "at string, version string, run string, command string, phase string, actor string, step string, sub string, part string, ms long, model string, "
    "tokens struct<`in`:long,out:long,cacheRead:long,cacheWrite:long>, pages array<string>"
)
USAGE_COLUMNS = ("at", "version", "run", "command", "phase", "actor", "step", "sub", "part", "ms", "model")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Spans of every file below ``path`` (A06). Blank and broken lines, and spans without a number of ms, are left out."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_usage(lines)


def parse_usage(lines: DataFrame) -> DataFrame:
    """The spans of lines of text; works on a stream as on a table."""
    span = F.from_json("value", USAGE_SCHEMA, {"mode": "PERMISSIVE"})
    return lines.select(span.alias("s")).where("s.ms IS NOT NULL").select("s.*")


def append_usage(spans: DataFrame, path: str) -> None:
    """Adds spans to the log, one folder for each version (A07, K01); the actor is the kit where none is named."""
    spans.withColumn("actor", F.coalesce("actor", F.lit("kit"))).withColumn("v", F.col("version")).write.mode("append").partitionBy("v").json(path)


def usage_report(spans: DataFrame) -> DataFrame:
    """Sixteen flat columns, tokens taken apart and pages joined by spaces."""
    tokens = [F.col(f"tokens.{t}").alias(n) for t, n in (("in", "tokens_in"), ("out", "tokens_out"), ("cacheRead", "tokens_cache_read"), ("cacheWrite", "tokens_cache_write"))]
    return spans.select(*USAGE_COLUMNS, *tokens, F.array_join("pages", " ").alias("pages"))


def safe_cell(cell: Column) -> Column:
    """Text that a spreadsheet takes as text: a leading formula sign gets an apostrophe."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(rows: DataFrame, path: str, safe: bool = True) -> None:
    """CSV with a header; with ``safe`` every cell is quoted and none starts a formula."""
    out = rows.select(*[(safe_cell(F.col(c)) if safe else F.col(c)).alias(c) for c in rows.columns])
    out.write.mode("overwrite").option("header", "true").option("quoteAll", str(safe).lower()).option("escape", '"').csv(path)


def parse_numstat(lines: DataFrame, log: str = "log", pos: str = "pos", text: str = "value") -> DataFrame:
    """hash, author, date, path, added, deleted of a commit log (A10): header lines start with @@, a hyphen counts as 0.

    ``lines`` has the log that a line belongs to and its place in it; headers are
    carried to the lines below, one log at a time.
    """
    header = F.when(F.col(text).startswith("@@"), F.split(F.substr(text, F.lit(3)), "\t"))
    carried = lines.withColumn("h", F.last(header, ignorenulls=True).over(Window.partitionBy(log).orderBy(pos)))
    fields = F.split(text, "\t")
    number = lambda i: F.coalesce(F.get(fields, i).try_cast("long"), F.lit(0))
    rows = carried.where(~F.col(text).startswith("@@") & (F.size(fields) == 3) & F.col("h").isNotNull())
    return rows.select(
        F.get("h", F.lit(0)).alias("hash"), F.get("h", F.lit(1)).alias("author"), F.get("h", F.lit(2)).alias("date"), F.get(fields, F.lit(2)).alias("path"), number(F.lit(0)).alias("added"), number(F.lit(1)).alias("deleted")
    )
