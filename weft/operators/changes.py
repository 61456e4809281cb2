"""Snapshots of facts held against each other, source by source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.joins import diff


def cycle_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """k, change of import cycles that came or went (G02). Both: cycle (array of files)."""
    key = lambda rows: rows.select(F.array_join("cycle", " ⇄ ").alias("k")).distinct()
    old, new = key(before), key(after)
    return new.join(old, "k", "left_anti").withColumn("change", F.lit("added")).unionByName(old.join(new, "k", "left_anti").withColumn("change", F.lit("removed")))


def count_change(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """k, before, after: one row when the number of rows differs."""
    both = before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after")))  # one row each
    return both.where("before <> after").select(F.lit(name).alias("k"), "before", "after")


def diff_sources(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """source, k, change, field, before, after: what changed in every source (G01). ``keys``: source to (key, compared fields)."""
    out = None
    for source, (key, fields) in keys.items():
        own = diff(before[source], after[source], key, fields).withColumnRenamed(key, "k")
        own = own.select(F.lit(source).alias("source"), *[F.col(c).cast("string").alias(c) for c in own.columns])
        out = own if out is None else out.unionByName(own)
    return out


def totals(changes: DataFrame) -> DataFrame:
    """source, added, removed, changed, and their sum."""
    n = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
    return changes.groupBy("source").agg(n("added"), n("removed"), n("changed"), F.count("*").alias("total"))
