"""Rows held against declared rules: types, bounds, lists, defaults and near misses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a field of a JSON row must be. ``kind``: string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = False
    one_of: tuple[str, ...] = ()
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    default: str | None = None


def _kind_of(raw: Column, value: Column) -> Column:
    t = F.trim(raw)
    return (
        F.when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?\d+$"), "integer").when(t.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "number").when(t.startswith('"'), "string")
    )


def errors(rows: DataFrame, fields: tuple[Field, ...], key: str, json: str, most_edits: int = 2) -> DataFrame:
    """key, path, error, hint: what a JSON object per row breaks.

    error is invalid, missing, type, enum, pattern, minimum, maximum or unknown. An unknown name has the
    declared name within ``most_edits`` edits as its hint, the nearest and then the first. Null and
    unreadable objects are invalid; an empty one only misses its required fields.
    """
    # A value's own text tells its type: a variant keeps numbers and quoted numbers apart.
    parsed = F.try_parse_json(F.col(json))
    own = rows.select(key, parsed.alias("v")).select(key, "v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.json_object_keys(F.to_json("v"))).alias("names"))
    bad = own.where("names IS NULL").select(key, F.lit("").alias("path"), F.lit("invalid").alias("error"), F.lit(None).cast("string").alias("hint"))

    def broken(f: Field) -> Column:
        raw = F.to_json(F.try_variant_get("v", f"$.{f.name}", "variant"))
        value = F.try_variant_get("v", f"$.{f.name}", "string")
        kind = _kind_of(raw, value)
        there = F.array_contains("names", f.name) & raw.isNotNull() & (raw != "null")
        right = kind.isin("integer", "number") if f.kind == "number" else kind == f.kind
        found = F.when(~there, F.lit("missing") if f.required else F.lit(None)).when(~F.coalesce(right, F.lit(False)), "type")
        if f.one_of:
            found = found.when(~value.isin(*f.one_of), "enum")
        if f.pattern:
            found = found.when(~value.rlike(f.pattern), "pattern")
        if f.least is not None:
            found = found.when(value.try_cast("double") < f.least, "minimum")
        if f.most is not None:
            found = found.when(value.try_cast("double") > f.most, "maximum")
        return F.struct(F.lit(f.name).alias("path"), found.alias("error"), F.lit(None).cast("string").alias("hint"))

    known = F.array(*[F.lit(f.name) for f in fields])

    def unknown(name: Column) -> Column:
        tried = F.transform(known, lambda k, i: F.struct(F.levenshtein(name, k).alias("d"), i.alias("i"), k.alias("k")))
        near = F.array_min(F.filter(tried, lambda x: x["d"] <= most_edits))
        return F.struct(name.alias("path"), F.lit("unknown").alias("error"), near["k"].alias("hint"))

    every = F.concat(F.array(*[broken(f) for f in fields]), F.transform(F.filter("names", lambda n: ~F.array_contains(known, n)), unknown))
    return bad.unionByName(own.where("names IS NOT NULL").select(key, F.explode(every).alias("e")).select(key, "e.path", "e.error", "e.hint").where("error IS NOT NULL"))


def completed(rows: DataFrame, fields: tuple[Field, ...], json: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """The rows with one text column for each field: an override, else the value, else the default."""
    over = overrides or {}
    value = lambda f: F.lit(over[f.name]) if f.name in over else F.coalesce(F.get_json_object(json, f"$.{f.name}"), F.lit(f.default))
    return rows.select(*[c for c in rows.columns if c != json], *[value(f).alias(f.name) for f in fields])
