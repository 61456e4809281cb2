"""What points from one fact to others: handlers of a feature, traces of a technology, chains of packages, nearby places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import normal_route
from weft.operators.joins import met_by_part, met_by_start


def handlers(features: DataFrame, api: DataFrame) -> DataFrame:
    """feature, method, route, file: the handlers of what a feature lists as ``METHOD /path`` or as a path of any method.

    ``features``: feature, api (array); ``api``: method, route, file.
    """
    one = features.select("feature", F.explode("api").alias("a")).withColumn("p", F.split(F.trim("a"), r"\s+", 2))
    wanted = one.select("feature", F.when(F.size("p") > 1, F.upper(F.col("p")[0])).alias("m"), normal_route(F.when(F.size("p") > 1, F.get("p", F.lit(1))).otherwise(F.col("p")[0])).alias("k"))
    met = wanted.distinct().join(api.withColumn("k", normal_route("route")), "k").where("m IS NULL OR m = method")
    return met.select("feature", "method", "route", "file").distinct()


def traces(technologies: DataFrame, dependencies: DataFrame, infra: DataFrame, env: DataFrame, most: int = 5) -> DataFrame:
    """id, source, what, file: where a technology shows in the code, the first ``most`` of each source.

    ``technologies``: id, packages, images, infra, env (arrays): a package name that ends in a
    star, and every env name, is a beginning; infra is a part of a resource's type. Exact names meet by equality, as do
    beginnings, and parts by runs of characters, with the distinct names. ``dependencies``: name, file; ``infra``:
    type, image, file; ``env``: name, file.
    """
    t = lambda c: technologies.select("id", F.explode(c).alias("p")).distinct()
    packages = t("packages")
    exact = packages.where(~F.col("p").endswith("*")).join(dependencies.withColumnRenamed("name", "p"), "p").select("id", F.lit("dependencies").alias("source"), F.col("p").alias("what"), "file")
    starts = packages.where(F.col("p").endswith("*")).select("id", F.regexp_replace("p", r"\*$", "").alias("p"))

    def by_names(rows: DataFrame, column: str, patterns: DataFrame, meet, source: str) -> DataFrame:
        met = meet(rows.select(F.col(column).alias("what")), patterns, "what", "p").select("id", "what").distinct()
        return met.join(rows.withColumnRenamed(column, "what"), "what").select("id", F.lit(source).alias("source"), "what", "file")

    image = F.lower(F.regexp_replace("image", r"(?:@sha256:.*|:[\w.-]+)$", ""))
    images = infra.where("image IS NOT NULL").select(image.alias("k"), F.col("image").alias("what"), "file").join(t("images").select("id", F.lower("p").alias("k")), "k").select("id", F.lit("infra").alias("source"), "what", "file")
    parts = [
        exact,
        by_names(dependencies, "name", starts, met_by_start, "dependencies"),
        images,
        by_names(infra.select("type", "file"), "type", t("infra"), met_by_part, "infra"),
        by_names(env, "name", t("env"), met_by_start, "env"),
    ]
    every = reduce(DataFrame.unionByName, parts).distinct()
    place = F.row_number().over(Window.partitionBy("id", "source").orderBy("what", "file"))
    return every.withColumn("n", place).where(F.col("n") <= most).drop("n")


def with_via(packages: DataFrame, chains: DataFrame) -> DataFrame:
    """Packages with the chain that brings in those that aren't direct (G05). ``packages``: name, direct; ``chains``: name, via (array)."""
    own = chains.groupBy("name").agg(F.min("via").alias("via"))
    return packages.join(own, "name", "left").select(*packages.columns, F.when(~F.col("direct"), F.col("via")).alias("via"))


def nearby(first: DataFrame, second: DataFrame, key: str, within: int) -> DataFrame:
    """key, place: places of ``first`` with one of ``second`` at or after them, and of ``second`` with one of ``first`` after them, ``within`` characters away.

    One ordered pass over the places of each key.
    """
    rows = first.select(key, "place", F.lit(0).alias("side")).unionByName(second.select(key, "place", F.lit(1).alias("side"))).distinct()
    ahead = Window.partitionBy(key).orderBy("place")
    other = F.max(F.when(F.col("side") == 1, 1).otherwise(0)).over(ahead.rangeBetween(0, within)), F.max(F.when(F.col("side") == 0, 1).otherwise(0)).over(ahead.rangeBetween(1, within))
    marked = rows.withColumn("seconds", other[0]).withColumn("firsts", other[1])
    return marked.where("(side = 0 AND seconds = 1) OR (side = 1 AND firsts = 1)").select(key, "place").distinct()


def health_risks(risks: DataFrame, most: int | None = None) -> DataFrame:
    """Risks by severity, then rule and file (D23). ``risks``: rule, severity, file. A report that shows only its top gives ``most``."""
    rank = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("severity")).cast("int")
    out = risks.withColumn("rank", F.when(rank > 0, rank).otherwise(9))
    return out if most is None else out.orderBy("rank", "rule", "file").limit(most)


def candidate_kinds(candidates: DataFrame, hints: DataFrame, handled: DataFrame) -> DataFrame:
    """segment, family: families of hints in files of a candidate's segment or in handlers of its routes.

    ``candidates``: segment; ``hints``: family, file; ``handled``: segment, file.
    """
    parts = hints.select("family", "file", F.explode(F.split(F.lower("file"), "/")).alias("part"))
    named = parts.select("family", F.explode(F.array_distinct(F.array("part", F.split("part", r"\.")[0]))).alias("k"))
    own = candidates.select("segment", F.lower("segment").alias("k")).join(named, "k").select("segment", "family")
    return own.unionByName(handled.join(hints, "file").select("segment", "family")).distinct()


def topic_order(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """page, space, place inside its topic (F08): by the rank of its space, unranked ones last, then by the site's order."""
    ranked = pages.join(ranks, "space", "left")
    order = Window.partitionBy("topic").orderBy(F.coalesce("rank", F.lit(1 << 30)), "n")
    return ranked.select("topic", "page", "space", F.row_number().over(order).alias("place"))


def expanded_presets(presets: DataFrame, names: DataFrame) -> DataFrame:
    """name: what presets stand for, however deep they nest; cycles end where they begin (G09). ``presets``: preset, name."""
    from weft.operators.graph import shortest_depths

    reached = shortest_depths(names.select(F.col("name").alias("node")), presets.select(F.col("preset").alias("src"), F.col("name").alias("dst")))
    return reached.select(F.col("node").alias("name")).join(presets.select(F.col("preset").alias("name")).distinct(), "name", "left_anti").distinct()


def dependencies_of_pages(sources: dict[str, DataFrame]) -> DataFrame:
    """page, file, kinds: what a page depends on, by every source that says so (C23). Each source: page, file."""
    every = reduce(DataFrame.unionByName, [rows.select("page", "file", F.lit(kind).alias("kind")) for kind, rows in sources.items()])
    return every.groupBy("page", "file").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def spaces(declared: DataFrame, profiles: DataFrame) -> DataFrame:
    """space, profile, home: a declared space with its profile's values where it has none of its own."""
    own = profiles.select("profile", F.col("home").alias("default_home"))
    return declared.join(own, "profile", "left").select("space", "profile", F.coalesce("home", "default_home").alias("home"))


def system_model(packages: DataFrame, env: DataFrame, frameworks: DataFrame, services: DataFrame) -> DataFrame:
    """kind, name: containers that packages show and outside systems that settings show.

    ``frameworks``: name, container (joined by equality); ``services``: prefix, system; distinct names meet their beginnings by equality.
    """
    containers = packages.select("name").distinct().join(frameworks, "name").select(F.lit("container").alias("kind"), F.col("container").alias("name")).distinct()
    outside = met_by_start(env, services, "name", "prefix").select(F.lit("external").alias("kind"), F.col("system").alias("name")).distinct()
    return containers.unionByName(outside)
