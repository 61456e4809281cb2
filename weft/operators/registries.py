"""Private registries: settings along the folders above a manifest, of which the nearest counts for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hosts of the public registries.
PUBLIC = ("registry.npmjs.org", "registry.yarnpkg.com", "pypi.org", "files.pythonhosted.org", "test.pypi.org")


def registry_settings(files: DataFrame) -> DataFrame:
    """folder, ecosystem, scope, host, file, line of every registry that npm and pip settings name; scope is empty for the default one, and ``+`` marks an extra index.

    npm: .npmrc and .yarnrc; pip: pip.conf, pip.ini and options in requirements files. Comments are none; what isn't an
    address has no host. Credentials in an address are not kept.
    """
    lines = files.where("text IS NOT NULL").select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "l")).where(~F.col("l").rlike(r"^\s*[#;]"))
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    npm = r"^\s*\"?(@[^:\s\"]+)?:?registry\"?\s*[=\s]\s*\"?([^\s\"]+)"
    pip = r"^\s*(?:--)?(extra-)?index-url\s*[=\s]\s*(\S+)"
    rows = [
        lines.where(base.isin(".npmrc", ".yarnrc") & F.col("l").rlike(npm)).select("file", "at", F.lit("npm").alias("ecosystem"), F.regexp_extract("l", npm, 1).alias("scope"), F.regexp_extract("l", npm, 2).alias("url")),
        lines.where((base.isin("pip.conf", "pip.ini") | base.rlike(r"^requirements[\w.-]*\.txt$")) & F.col("l").rlike(pip)).select(
            "file", "at", F.lit("pypi").alias("ecosystem"), F.when(F.regexp_extract("l", pip, 1) != "", F.concat(F.lit("+"), F.lower(F.regexp_extract("l", pip, 2)))).otherwise("").alias("scope"), F.regexp_extract("l", pip, 2).alias("url")
        ),
    ]
    found = reduce(DataFrame.unionByName, rows)
    host = F.lower(F.regexp_extract("url", r"^(?:https?:)?//(?:[^/@\s]*@)?([^/:\s]+)", 1))
    scope = F.when(F.startswith("scope", F.lit("+")), F.lit("+")).otherwise(F.col("scope"))
    return found.select(F.regexp_replace("file", r"/?[^/]+$", "").alias("folder"), "ecosystem", scope.alias("scope"), F.nullif(host, F.lit("")).alias("host"), "file", (F.col("at") + 1).cast("int").alias("line"))


def private_registries(manifests: DataFrame, settings: DataFrame) -> DataFrame:
    """manifest, ecosystem, scope, host, file, line: the private registries that count for a manifest, each with its proof.

    ``manifests``: manifest, ecosystem. For each scope the setting of the nearest folder above counts, in a folder the last line; a nearer public one thus
    lifts a private one above. Extra indexes add up: each host of them counts once, by its nearest proof.
    """
    parts = F.filter(F.split(F.regexp_replace("manifest", r"/?[^/]+$", ""), "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    tried = manifests.select("manifest", "ecosystem", F.posexplode(above).alias("far", "folder"))
    met = tried.join(settings.where("host IS NOT NULL"), ["folder", "ecosystem"])
    # Of one folder the last file and line count.
    rank = F.struct("far", F.negative("line"), "file")
    key = F.when(F.col("scope") == "+", F.concat(F.lit("+"), "host")).otherwise(F.col("scope"))
    best = met.groupBy("manifest", "ecosystem", key.alias("key")).agg(F.min_by(F.struct("scope", "host", "file", "line"), rank).alias("s"))
    return best.select("manifest", "ecosystem", "s.*").where(~F.col("host").isin(*PUBLIC))
