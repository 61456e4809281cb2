"""States of facts and translations between two runs, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import content_hash


def translation_state(source_text: Column, exists: Column, recorded: Column) -> Column:
    """missing, unmarked, current or stale."""
    return F.when(~exists, "missing").when(recorded.isNull(), "unmarked").when(recorded == content_hash(source_text), "current").otherwise("stale")


def facts_state(commit: Column, head: str, version: Column, kit: str, age_days: Column, most_days: int) -> tuple[Column, Column]:
    """(state, reasons): missing without a commit, stale for another commit, another version or its age, else fresh."""
    reasons = F.array_compact(F.array(F.when(commit != head, "commit"), F.when(version != kit, "version"), F.when(age_days > most_days, "age")))
    return F.when(commit.isNull(), "missing").when(F.size(reasons) > 0, "stale").otherwise("fresh"), reasons


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Current rows with those of the same key replaced, and new ones added."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes.select(*current.columns))


def merge_labels(recorded: Column, now: Column, cited: Column) -> Column:
    """A map of labels: the recorded value stays while its key is still cited, others are as they are now."""
    return F.map_filter(F.map_zip_with(recorded, now, lambda k, old, new: F.when(old.isNotNull() & F.array_contains(cited, k), old).otherwise(new)), lambda k, v: v.isNotNull())
