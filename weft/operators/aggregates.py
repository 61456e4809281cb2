"""Grouped summaries: usage, history, quality, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import rounded
from weft.operators.numbering import numbered

#: Key expressions of a usage summary, with their defaults.
USAGE_KEYS = {
    "step": F.expr,
    "version": F.col,
    "command": F.col,
    "phase": F.col,
    "model": lambda c: F.coalesce(F.col(c), F.lit("—")),
    "page": lambda c: F.coalesce(F.col(c), F.lit("—")),
    "actor": lambda c: F.coalesce(F.col(c), F.lit("kit")),
}
TOKENS = "coalesce(tokens_in, 0) + coalesce(tokens_out, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0)"


def usage_rollup(usage: DataFrame, by: str = "step") -> DataFrame:
    """key, parent, nested, ms, tokens, n, share: time by ``by``.

    Spans inside a command count under their own key, and their share is one of their
    step. Other groupings take the commands' own spans only. One shuffle: the parents'
    sums are a window over the few grouped rows.
    """
    spans = usage.withColumn("tokens", F.expr(TOKENS))
    if by != "step":
        out = spans.where("sub IS NULL").groupBy(USAGE_KEYS[by](by).alias("key")).agg(F.sum("ms").alias("ms"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        total = F.sum("ms").over(Window.partitionBy())
        return out.select("key", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("nested"), "ms", "tokens", "n", rounded(100 * F.col("ms") / total).alias("share"))
    grouped = spans.groupBy("step", F.col("sub").isNotNull().alias("nested"), F.when(F.col("sub").isNotNull(), F.coalesce("part", "sub")).alias("inner")).agg(
        F.sum("ms").alias("ms"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")
    )
    whole = F.sum(F.when(~F.col("nested"), F.col("ms"))).over(Window.partitionBy())
    own = F.sum(F.when(~F.col("nested"), F.col("ms"))).over(Window.partitionBy("step"))
    base = F.when(F.col("nested"), own).otherwise(whole)
    return grouped.select(
        F.when(F.col("nested"), F.concat_ws(" › ", "step", "inner")).otherwise(F.col("step")).alias("key"),
        F.when(F.col("nested"), F.col("step")).alias("parent"),
        "nested",
        "ms",
        "tokens",
        "n",
        F.coalesce(rounded(100 * F.col("ms") / base), F.lit(0)).alias("share"),
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """ms of the commands' own spans, all tokens, number of runs."""
    return usage.agg(F.sum(F.when(F.col("sub").isNull(), F.col("ms"))).alias("ms"), F.sum(F.expr(TOKENS)).alias("tokens"), F.count_distinct("run").alias("runs"))


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by model from prices a million tokens; a cached read costs a tenth and a write a quarter more where unpriced.

    ``prices``: model, input, output, cache_read, cache_write. A model without a price costs null.
    """
    sums = usage.where("model IS NOT NULL").groupBy("model").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_write")])
    p = prices.select("model", "input", "output", F.col("cache_read").alias("p_read"), F.col("cache_write").alias("p_write"))
    read, write = F.coalesce("p_read", F.col("input") * 0.1), F.coalesce("p_write", F.col("input") * 1.25)
    cost = (F.col("tokens_in") * F.col("input") + F.col("tokens_out") * F.col("output") + F.col("cache_read") * read + F.col("cache_write") * write) / 1e6
    return sums.join(p, "model", "left").select("model", "tokens_in", "tokens_out", F.round(cost, 8).alias("cost"))


def file_history(commits: DataFrame, tracked: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Commits, churn, authors, owner, its share and last date of each file (D03). A report that shows only its top gives ``limit``."""
    rows = commits if tracked is None else commits.join(tracked.select("path").distinct(), "path", "left_semi")
    by_author = rows.groupBy("path", "author").agg(F.count("*").alias("n"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.max("date").alias("last"))
    files = by_author.groupBy("path").agg(
        F.sum("n").alias("commits"),
        F.sum("churn").alias("churn"),
        F.count("*").alias("authors"),
        F.min(F.struct((-F.col("n")).alias("n"), "author")).alias("first"),
        F.max("last").alias("last"),
    )
    out = files.select(
        F.col("path").alias("file"), "commits", "churn", "authors", F.col("first.author").alias("owner"), rounded(-F.col("first.n") * 100 / F.col("commits")).alias("owner_share"), F.substring("last", 1, 10).alias("last")
    )
    return out if limit is None else out.orderBy(F.desc("commits"), F.desc("churn"), "file").limit(limit)


def bus_factor(commits: DataFrame) -> DataFrame:
    """The fewest authors with half of the commits or more (D04): bus_factor long, authors long, commits long."""
    each = commits.select("hash", "author").distinct().groupBy("author").agg(F.count("*").alias("n"))
    # Authors of the same number of commits are one row: of N commits there are at most about the root of 2 N such numbers.
    alike = each.groupBy("n").agg(F.count("*").alias("authors"))
    before = F.coalesce(F.sum(F.col("n") * F.col("authors")).over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("n") * F.col("authors")).over(Window.partitionBy())
    needed = F.greatest(F.lit(0), F.least(F.col("authors"), F.ceil((total / 2 - before) / F.col("n")))).cast("long")
    marked = alike.select("n", "authors", needed.alias("needed"))
    return marked.agg(F.coalesce(F.sum("needed"), F.lit(0)).alias("bus_factor"), F.coalesce(F.sum("authors"), F.lit(0)).alias("authors"), F.sum(F.col("n") * F.col("authors")).alias("commits"))


def ratio(n: Column, total: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(total != 0, n / total)


def rating(value: Column, thresholds: tuple[float, ...]) -> Column:
    """A to E: the first threshold that isn't exceeded."""
    out = F.lit("E")
    for grade, at in reversed(list(zip("ABCD", thresholds))):
        out = F.when(value <= at, grade).otherwise(out)
    return out


def quality_summary(quality: DataFrame, thresholds: tuple[float, ...] = (0.03, 0.05, 0.1, 0.2)) -> DataFrame:
    """Sums, ratios to three places and ratings over the files."""
    sums = quality.agg(
        F.count("*").alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("functions").alias("functions"),
        F.max("longest").alias("longest"),
        F.max("complexity").alias("complexity"),
        F.sum("duplicated").alias("duplicated"),
        F.sum("todo").alias("todo"),
        F.count_if(F.col("complexity") > 20).alias("complex_files"),
    )
    duplicated = ratio(F.col("duplicated"), F.col("lines"))
    complex_ = ratio(F.col("complex_files"), F.col("files"))
    return sums.select(
        "*", F.round(duplicated, 3).alias("duplication"), rating(duplicated, thresholds).alias("duplication_rating"), F.round(complex_, 3).alias("complexity_ratio"), rating(complex_, thresholds).alias("complexity_rating")
    )


def duplicate_lines(files: DataFrame, window: int = 6, least: int = 4) -> DataFrame:
    """file, eligible, duplicated: lines in a run of ``window`` that occurs twice or more.

    ``files``: file, text. Lines are trimmed and inner white space collapsed; shorter
    ones than ``least`` don't count. Runs are counted by their hash with partial sums,
    and each file's lines stay together.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: F.length(x) >= least)
    kept = files.select("file", lines.alias("lines"))
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(1), F.size("lines") - (window - 1))).otherwise(F.array().cast("array<int>"))
    runs = kept.select("file", F.posexplode(F.transform(starts, lambda i: F.sha1(F.array_join(F.slice("lines", i, F.lit(window)), "\n")))).alias("at", "hash"))
    often = runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    marked = runs.join(often, "hash", "left_semi").groupBy("file").agg(F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + (window - 1)))))).cast("long").alias("duplicated"))
    sizes = kept.select("file", F.size("lines").cast("long").alias("eligible"))
    return sizes.join(marked, "file", "left").select("file", "eligible", F.coalesce("duplicated", F.lit(0)).alias("duplicated"))


def level_of(criteria: DataFrame, key: str) -> DataFrame:
    """The highest level whose criteria, and those below, all hold (D10). ``criteria``: key, level, ok."""
    return criteria.groupBy(key).agg((F.coalesce(F.min(F.when(~F.col("ok"), F.col("level"))), F.lit(5)) - 1).cast("int").alias("level"))


def meets(value: Column, threshold: float, at_most: bool = False) -> Column:
    """A criterion: null counts as not applicable and holds."""
    return F.coalesce(value <= threshold + 1e-9 if at_most else value >= threshold - 1e-9, F.lit(True))


def depth_score(parts: Column) -> Column:
    """Rounded mean of the parts that apply, times 100."""
    known = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, rounded(100 * F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))


def group_by_keys(rows: DataFrame, keys: str, item: str) -> DataFrame:
    """Rows grouped under each of their keys; empty keys are dropped."""
    return rows.select(F.explode(keys).alias("key"), item).where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.array_sort(F.collect_set(item)).alias("items"))


def share_of_lines(files: DataFrame, by: str) -> DataFrame:
    """Files, lines and the share of all lines for each value of ``by``."""
    out = files.groupBy(by).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    return out.withColumn("share", rounded(100 * F.col("lines") / F.sum("lines").over(Window.partitionBy())))


def names_with_places(rows: DataFrame) -> DataFrame:
    """name, places (distinct and sorted), example: where a name is read (D17). ``rows``: name, place, example."""
    return rows.groupBy("name").agg(F.array_sort(F.collect_set("place")).alias("places"), F.bool_or("example").alias("example"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_out, fan_in over distinct edges without loops (D18): one pass over both ends."""
    distinct = edges.where("src <> dst").select("src", "dst").distinct()
    ends = distinct.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.out").alias("fan_out"), F.sum(1 - F.col("e.out")).alias("fan_in"))


def count_states(rows: DataFrame, by: str, state: str, states: tuple[str, ...]) -> DataFrame:
    """One column for each state."""
    return rows.groupBy(by).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states])


def candidate_groups(items: DataFrame) -> DataFrame:
    """Inventory ids grouped by their first segment, numbered in the order of their first row.

    ``items``: id, pos. Segments are numbered by range, in no single task.
    """
    bare = F.regexp_replace("id", "^[A-Z]+ ", "")
    segment = F.coalesce(F.get(F.filter(F.split(bare, "/"), lambda x: (x != "") & ~x.rlike(r"^[:{\[]")), F.lit(0)), F.lit("home"))
    is_api, is_route = F.col("id").rlike("^[A-Z]+ /"), F.col("id").startswith("/")
    grouped = items.groupBy(segment.alias("segment")).agg(
        F.array_sort(F.collect_set(F.when(is_route, F.col("id")))).alias("routes"),
        F.array_sort(F.collect_set(F.when(is_api, F.col("id")))).alias("api"),
        F.array_sort(F.collect_set(F.when(~is_api & ~is_route, F.col("id")))).alias("keys"),
        F.min("pos").alias("first"),
    )
    placed = numbered(grouped, ("first", "segment"), "number")
    return placed.select(F.concat(F.lit("F-"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(4), F.length(F.col("number").cast("string"))), F.lit("0"))).alias("id"), "segment", "routes", "api", "keys")
