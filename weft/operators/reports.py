"""Small report operators: tests of files, freshness counts, counterparts and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import col

#: What counts as one test of a source file, unless a caller says otherwise.
TEST_CALL = r"(?m)^\s*(?:it|test)(?:\.[a-z]+)*\s*\(|^\s*(?:async )?def test_"


def tests_per_file(files: DataFrame, pattern: str = TEST_CALL) -> DataFrame:
    """Files (file, text) that hold test calls, with how many: file, tests long (D16). Null texts have none."""
    counted = files.select("file", F.regexp_count("text", F.lit(pattern)).cast("long").alias("tests"))
    return counted.where("tests > 0")


def facts_summary(states: DataFrame, *keys: str) -> DataFrame:
    """How many facts files there are and how many of them are stale, for each of ``keys``."""
    return states.groupBy(*keys).agg(F.count("*").alias("files"), F.count_if(F.col("state") == "stale").alias("stale"))


def counterpart_targets(rows: DataFrame, key: str, values: str) -> DataFrame:
    """One row for each counterpart of an array of ``page`` or ``page~anchor``: key, page, anchor or null."""
    target = rows.select(key, F.explode(values).alias("v")).select(key, F.split("v", "~", 2).alias("v"))
    return target.select(key, F.get("v", F.lit(0)).alias("page"), F.get("v", F.lit(1)).alias("anchor"))


def site_date(text: Column | str) -> Column:
    """A date of the form 2026-01-31 in its long form; null for any other text."""
    known = F.when(col(text).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd")))
    return F.date_format(known, "d MMMM yyyy")
