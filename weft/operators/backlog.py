"""Epics, features and stories: hierarchy, scores and board filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import rounded
from weft.operators.aggregates import depth_score


def hierarchy(epics: DataFrame, features: DataFrame, stories: DataFrame, rules: DataFrame) -> DataFrame:
    """epic, features (feature, stories, rules), n_stories.

    ``epics``: epic; ``features``: feature, epic; ``stories``: story, feature, criteria;
    ``rules``: rule, feature. Stories and rules are grouped before they meet features, so
    neither multiplies the other.
    """
    s = stories.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("story", "criteria"))).alias("stories"))
    r = rules.groupBy("feature").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    own = features.join(s, "feature", "left").join(r, "feature", "left")
    no_stories, no_rules = F.array().cast(s.schema["stories"].dataType), F.array().cast("array<string>")
    own = own.select("epic", F.struct("feature", F.coalesce("stories", no_stories).alias("stories"), F.coalesce("rules", no_rules).alias("rules")).alias("f"))
    grouped = own.groupBy("epic").agg(F.array_sort(F.collect_list("f")).alias("features"), F.sum(F.size("f.stories")).alias("n_stories"))
    return epics.join(grouped, "epic", "left").select("epic", "features", F.coalesce("n_stories", F.lit(0)).alias("n_stories"))


def feature_scores(features: DataFrame) -> DataFrame:
    """feature, epic, score: the mean of what applies.

    ``features``: feature, epic, conformant, stories, with_criteria, answered, rubrics.
    """
    part = lambda n, total: F.when(F.col(total) > 0, F.col(n) / F.col(total))
    parts = F.array(F.col("conformant").cast("double"), part("with_criteria", "stories"), part("answered", "rubrics"))
    return features.select("feature", "epic", depth_score(parts).alias("score"))


def epic_scores(scores: DataFrame) -> DataFrame:
    """Rounded mean of an epic's features, a missing score being 0."""
    return scores.groupBy("epic").agg(rounded(F.avg(F.coalesce("score", F.lit(0)))).alias("score"))


def depth_level(score: Column) -> Column:
    """low below 40, fair below 75, else good."""
    return F.when(score < 40, "low").when(score < 75, "fair").otherwise("good")


def board(features: DataFrame, epic: str | None = None, version: str | None = None, text: str | None = None) -> DataFrame:
    """Features that every given filter keeps (B10). ``features``: feature, epic, title, version, stories (array of version, title)."""
    out = features
    if epic is not None:
        out = out.where(F.col("epic") == epic)
    if version is not None:
        out = out.where((F.col("version") == version) | F.exists("stories", lambda s: s["version"] == version))
    if text:
        words = text.lower()
        out = out.where(F.contains(F.lower("feature"), F.lit(words)) | F.contains(F.lower("title"), F.lit(words)) | F.exists("stories", lambda s: F.contains(F.lower(s["title"]), F.lit(words))))
    return out


def update_estimate(pages: DataFrame, price_in: float | None, price_out: float | None) -> DataFrame:
    """page, tokens_in, tokens_out, cost: what rewriting a page takes (D22); without a price the cost is null.

    ``pages``: page, context_tokens, max_words.
    """
    used, made = F.col("context_tokens") + 1800, rounded(0.42 * F.col("max_words"))
    cost = F.lit(None).cast("double") if price_in is None or price_out is None else (used * price_in + made * price_out) / 1e6
    return pages.select("page", used.alias("tokens_in"), made.alias("tokens_out"), cost.alias("cost"))


def criteria(indicators: DataFrame, thresholds: DataFrame) -> DataFrame:
    """space, level, criterion, ok: indicators held against thresholds.

    ``indicators``: space, indicator, value (null: doesn't apply); ``thresholds``: level,
    criterion, indicator, threshold, at_most. A criterion without an indicator row holds.
    """
    spaces = indicators.select("space").distinct()
    every = spaces.crossJoin(thresholds)
    held = every.join(indicators, ["space", "indicator"], "left")
    ok = F.when(F.col("value").isNull(), True).when(F.col("at_most"), F.col("value") <= F.col("threshold") + 1e-9).otherwise(F.col("value") >= F.col("threshold") - 1e-9)
    return held.select("space", "level", "criterion", ok.alias("ok"))
