"""Operators on ordered rows: carried values, islands, budgets, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.numbering import numbered

from weft.functions.text import token_estimate


def top_per_group(rows: DataFrame, key: str, order: tuple[Column, ...], most: int) -> DataFrame:
    """The first rows of each key, with how many more there are (E01). The partial limit runs before the shuffle of the rows."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    return first.join(sizes, key).withColumn("more", F.greatest(F.lit(0), F.col("size") - most)).drop("size")


def first_per_key(rows: DataFrame, key: str, order: tuple[Column, ...]) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def carry_heading(lines: DataFrame, key: str, line: str, heading: str) -> DataFrame:
    """Every line with the latest heading at or above it."""
    return lines.withColumn(heading, F.last(heading, ignorenulls=True).over(Window.partitionBy(key).orderBy(line)))


def merge_ranges(ranges: DataFrame, key: str, around: int = 0, total: Column | None = None) -> DataFrame:
    """Ranges widened by ``around`` and merged where they touch or overlap (E03): key, lo, hi.

    Gaps and islands: a range starts an island when it begins more than one after the
    largest end so far.
    """
    high = F.col("hi") + around
    wide = ranges.select(key, F.greatest(F.lit(1), F.col("lo") - around).alias("lo"), (F.least(total, high) if total is not None else high).alias("hi"))
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = wide.withColumn("new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return islands.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def fit_budget(parts: DataFrame, budget: int, kinds: tuple[str, ...] = ("digest", "shared", "excerpt", "facts", "labels")) -> DataFrame:
    """Parts with cut: dropped kind by kind until the rest fits the budget.

    ``parts``: doc, pos, kind, text, cut_line, priority. Shared parts go longest first,
    excerpts farthest first, others in order. A part is cut while what is saved before
    it doesn't suffice, which is a running sum over the document's parts.
    """
    saved = token_estimate("text") - token_estimate("cut_line")
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    order = F.when(F.col("kind") == "shared", -F.length("text")).when(F.col("kind") == "excerpt", -F.coalesce("priority", F.lit(0))).otherwise(F.lit(0))
    whole = parts.withColumn("need", F.sum(token_estimate("text")).over(Window.partitionBy("doc")) - budget).withColumn("r", rank).withColumn("o", order)
    before = Window.partitionBy("doc").orderBy("r", "o", "pos").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.coalesce(F.sum(F.when(F.col("r") > 0, saved).otherwise(0)).over(before), F.lit(0))
    return whole.withColumn("cut", (F.col("r") > 0) & (gain < F.col("need"))).drop("need", "r", "o")


def near_lines(first: DataFrame, second: DataFrame, key: str, within: int) -> DataFrame:
    """Lines of ``first`` with one of ``second`` at most ``within`` away (E06): one merged pass over each key's lines."""
    marked = first.select(key, "line", F.lit(True).alias("own")).unionByName(second.select(key, "line", F.lit(False).alias("own")))
    w = Window.partitionBy(key).orderBy("line").rangeBetween(-within, within)
    return marked.withColumn("near", F.count_if(~F.col("own")).over(w)).where("own AND near > 0").select(key, "line").distinct()


def sections(pages: DataFrame, page: str, text: str, most: int = 4000) -> DataFrame:
    """A page entry and one for each second or third level heading, with its text cut to ``most``."""
    pieces = F.split(text, r"(?m)^(?=#{2,3} )")
    rows = pages.select(page, F.posexplode(pieces).alias("n", "piece"))
    title = F.when(F.col("n") > 0, F.trim(F.regexp_extract("piece", r"^#{2,3} +([^\n]*)", 1)))
    body = F.when(F.col("n") > 0, F.regexp_replace("piece", r"^#{2,3} [^\n]*\n?", "")).otherwise(F.col("piece"))
    return rows.select(page, "n", title.alias("title"), F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, most).alias("body"))


def touched_lines(patches: DataFrame, key: str, patch: str) -> DataFrame:
    """The lines that each hunk of a patch touches (E10): key, lo, hi."""
    found = F.regexp_extract_all(patch, F.lit(r"(?m)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"), F.lit(1))
    rows = patches.select(key, F.explode(found).alias("h")).withColumn("lo", F.split("h", ",")[0].cast("long")).withColumn("n", F.coalesce(F.get(F.split("h", ","), F.lit(1)).cast("long"), F.lit(1)))
    return rows.where("n > 0").select(key, "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))


def reading_order(toc: DataFrame) -> DataFrame:
    """Pages in outline order, numbered (E11). ``toc``: section, section_pos, group_pos, page_pos, page."""
    order = ("section_pos", "group_pos", "page_pos", "page")
    return numbered(toc.select(*order), order, "n").select("page", "n")
