"""Structured entries: nested objects held against a nested schema, every error with its full path.

Objects are taken apart level by level with ``variant_explode``, all entries at once, until no object or list is left. What they hold meets the schema by
equality of patterns, in which a list's place is written [].
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.tables import saved

KINDS = ("string", "number", "boolean", "object", "array", "null")


def entry_nodes(entries: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, path, pattern, kind, value of everything inside the entries, the entry itself with an empty path; value is null for objects and lists.

    Texts that are no JSON give no rows. There is one round for each level of nesting.
    """
    spark = entries.sparkSession
    told = lambda v: F.schema_of_variant(v)
    kind = lambda s: F.when(F.startswith(s, F.lit("OBJECT")), "object").when(F.startswith(s, F.lit("ARRAY")), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    level = entries.select(F.col(key).alias("key"), F.lit("").alias("path"), F.lit("").alias("pattern"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    every = None
    while True:
        typed = level.withColumn("kind", kind(told("v")))
        value = F.when(~F.col("kind").isin("object", "array"), F.try_variant_get("v", "$", "string"))
        now = saved(typed.select("key", "path", "pattern", "kind", value.alias("value"), F.to_json("v").alias("json")))
        if now.isEmpty():
            break
        nodes = now.drop("json")
        every = nodes if every is None else every.unionByName(nodes)
        inner = now.where("kind IN ('object', 'array')").select("key", "path", "pattern", F.parse_json("json").alias("v"))
        deeper = spark.sql("SELECT f.key AS entry, f.path, f.pattern, e.pos, e.key AS name, e.value FROM {f} f, LATERAL variant_explode(f.v) e", f=inner)
        dot = F.when(F.col("path") == "", "").otherwise(".")
        step = lambda c, item: F.concat(c, F.when(F.col("name").isNull(), item).otherwise(F.concat(dot, "name")))
        level = deeper.select(F.col("entry").alias("key"), step(F.col("path"), F.concat(F.lit("["), "pos", F.lit("]"))).alias("path"), step(F.col("pattern"), F.lit("[]")).alias("pattern"), F.col("value").alias("v"))
    if every is None:
        every = now.drop("json")
    return every.withColumnRenamed("key", key)


def entry_errors(entries: DataFrame, schema: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, path, problem: what of the entries the schema refuses.

    ``schema``: pattern, kind, required, choices (array or null); the entry itself has an empty pattern. Problems: not JSON, unknown (nothing inside
    an unknown object is told apart), kind, choice, missing (a required name of an object that is there). A null counts as absent.
    """
    nodes = saved(entry_nodes(entries, key, text))
    rules = schema.select("pattern", F.col("kind").alias("wanted"), "required", "choices")
    met = nodes.join(rules, "pattern", "left")
    parent = lambda c: F.regexp_replace(c, r"(?:(?:^|\.)[^.\[\]]+|\[\d*\])$", "")
    known = rules.select("pattern").distinct()
    tops = met.where("wanted IS NULL AND pattern <> ''").withColumn("above", parent(F.col("pattern"))).join(known.withColumnRenamed("pattern", "above"), "above", "left_semi")
    unknown = tops.select(key, "path", F.lit("unknown").alias("problem"))
    there = met.where("wanted IS NOT NULL AND kind <> 'null'")
    wrong = there.where("kind <> wanted").select(key, "path", F.lit("kind").alias("problem"))
    choice = there.where("kind = wanted AND choices IS NOT NULL AND NOT array_contains(choices, value)").select(key, "path", F.lit("choice").alias("problem"))
    needed = rules.where("required AND pattern <> ''").select(parent(F.col("pattern")).alias("pattern"), F.regexp_extract("pattern", r"([^.\[\]]+)$", 1).alias("name")).where("name <> ''")
    objects = nodes.where("kind = 'object'").join(needed, "pattern").select(key, F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "name").alias("path"))
    missing = objects.join(nodes.where("kind <> 'null'").select(key, "path"), [key, "path"], "left_anti").select(key, "path", F.lit("missing").alias("problem"))
    broken = entries.where(F.try_parse_json(text).isNull()).select(key, F.lit("").alias("path"), F.lit("not JSON").alias("problem"))
    return broken.unionByName(unknown).unionByName(wrong).unionByName(choice).unionByName(missing).distinct()
