"""Predicates and projections over fact rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import version_key


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a path glob (B01): ``**/``, ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, depth = "", 0
    for token in re.findall(r"\*\*/|\*\*|\*|\?|\{|\}|,|[^*?{},]+", glob):
        if token == "{":
            depth += 1
            out += "(?:"
        elif token == "}" and depth:
            depth -= 1
            out += ")"
        elif token == "," and depth:
            out += "|"
        else:
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"^{out}$"


def matches_glob(path: Column | str, *globs: str) -> Column:
    """Whether a path matches one of the globs."""
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def exclude(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose id no pattern matches; a pattern that isn't a regular expression counts as the id itself."""
    good, plain = [], []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            plain.append(p)
    out = rows
    if good:
        out = out.where(~F.col(column).rlike("|".join(f"(?:{p})" for p in good)))
    return out.where(~F.col(column).isin(plain)) if plain else out


def once_per_package(packages: DataFrame) -> DataFrame:
    """One row for each package: the first with an exact version, else the first."""
    return packages.groupBy("ecosystem", "name").agg(F.min_by(F.struct("version", "manifest", "pos"), F.struct(F.col("version").isNull(), "pos")).alias("r")).select("ecosystem", "name", "r.version", "r.manifest", "r.pos")


def facts_for(facts: DataFrame, files: DataFrame, routes: DataFrame) -> DataFrame:
    """Facts of the files or of the routes, each once."""
    of_file = facts.join(files.select("file").distinct(), "file", "left_semi")
    return of_file.unionByName(facts.join(routes.select("route").distinct(), "route", "left_semi")).distinct()


def since(rows: DataFrame, version: str, column: str = "version") -> DataFrame:
    """Rows at ``version`` or later."""
    return rows.where(version_key(column) >= version_key(F.lit(version)))


def kept_fields(rows: DataFrame, rules: dict[str, str], kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of known kinds; a field that its pattern doesn't match is dropped, here null."""
    fields = [F.when(F.col(c).cast("string").rlike(p), F.col(c)).alias(c) for c, p in rules.items()]
    return rows.where(F.col(kind).isin(*kinds)).select(kind, *fields)


def sensitive_values(settings: DataFrame, names: str, excluded: tuple[str, ...] = (), least: int = 7) -> DataFrame:
    """The first name of each value that a sensitive name holds (B09). ``settings``: name, value, pos."""
    rows = settings.where(F.col("name").rlike(names) & (F.length("value") >= least))
    rows = rows.where(~F.col("name").isin(*excluded)) if excluded else rows
    return rows.groupBy("value").agg(F.min_by("name", "pos").alias("name"))


def package_state(private: Column, proven: Column, listed: Column) -> Column:
    """Why a package isn't asked about, or that it may be."""
    return F.when(private, "private").when(~proven, "unproven").when(~listed, "unlisted").otherwise("sendable")


def detected(evidence: DataFrame, packages: DataFrame) -> DataFrame:
    """entry, proofs: up to three packages that show an entry (B12). ``evidence``: entry, ecosystem (or *), name."""
    p = packages.select("ecosystem", "name").distinct()
    exact = evidence.where("ecosystem <> '*'").join(p, ["ecosystem", "name"]).select("entry", "name")
    any_ = evidence.where("ecosystem = '*'").select("entry", "name").join(p.select("name").distinct(), "name").select("entry", "name")
    return exact.unionByName(any_).groupBy("entry").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("proofs"))


def to_export(items: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows that a tool doesn't have yet; children of one it has point to its reference (B13). ``items``: id, parent; ``linked``: id, ref."""
    fresh = items.join(linked.select("id"), "id", "left_anti")
    return fresh.join(linked.select(F.col("id").alias("parent"), F.col("ref").alias("parent_ref")), "parent", "left").select("id", "parent", "parent_ref")


def answer_state(value: Column) -> Column:
    """na and unknown only when the word stands alone or before a separator, else answered; empty is missing."""
    v = F.lower(F.trim(value))
    return F.when(F.coalesce(v, F.lit("")) == "", "missing").when(v.rlike(r"^(n/?a|not applicable)(?:$|\s*[:,;.–-])"), "na").when(v.rlike(r"^unknown(?:$|\s*[:,;.–-])"), "unknown").otherwise("answered")
