"""Lock files: what is installed where, which install a dependency means, and the chain that brings a package in.

Formats differ in how a dependency names its install: npm looks for the nearest folder above that
holds the name, yarn writes the very range, the others the name (and a version where there are several). Each
is one equality join between dependencies and the keys that they may mean, of which the nearest counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.tables import saved

_MAP = "map<string,string>"
#: What an entry of package-lock holds that is read here. A nested object is kept as its text.
NPM_ENTRY = f"struct<version:string,name:string,dependencies:{_MAP},optionalDependencies:{_MAP},devDependencies:{_MAP},dev:boolean,link:boolean>"
NPM_V1 = "struct<version:string,requires:string,dependencies:string,dev:boolean>"
INSTALLS = ("manifest", "ecosystem", "key", "name", "version", "dev", "direct")
BESIDE = r"[^/]+$"


def _names(c: Column | str) -> Column:
    return F.coalesce(F.map_keys(F.col(c) if isinstance(c, str) else c), F.array().cast("array<string>"))


def _above(key: Column) -> Column:
    """The folders in which npm looks, the nearest first: the install's own, those around it, the root."""
    parts = F.split(key, "(?:^|/)node_modules/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.ltrim(F.array_join(F.slice(parts, 1, k), "/node_modules/"), F.lit("/")))


def _npm(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Installs of package-lock.json v1 to v3, and their dependencies: manifest, src, name."""
    own = files.where(F.col("file").rlike(r"(?:^|/)(?:package-lock|npm-shrinkwrap)\.json$"))
    packages = F.from_json(F.get_json_object("text", "$.packages"), f"map<string,{NPM_ENTRY}>")
    new = own.select(F.col("file").alias("manifest"), F.explode(packages).alias("key", "e"))
    roots = saved(new.where("key = ''").select("manifest", F.explode(F.array(F.struct(F.lit(False).alias("dev"), F.concat(_names("e.dependencies"), _names("e.optionalDependencies")).alias("names")), F.struct(F.lit(True).alias("dev"), _names("e.devDependencies").alias("names")))).alias("r")).select("manifest", "r.dev", F.explode("r.names").alias("name")))
    name = F.regexp_extract("key", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    placed = new.where(F.col("key").rlike("(?:^|/)node_modules/") & ~F.coalesce("e.link", F.lit(False)))
    installs = placed.select("manifest", "key", name.alias("name"), "e.version", F.coalesce("e.dev", F.lit(False)).alias("dev"))
    needs = placed.select("manifest", F.col("key").alias("src"), F.explode(F.concat(_names("e.dependencies"), _names("e.optionalDependencies"))).alias("name"))
    # Version 1 nests installs in installs; a round reads one level of all files.
    old = own.where(F.get_json_object("text", "$.packages").isNull()).select(F.col("file").alias("manifest"), F.lit("").alias("around"), F.get_json_object("text", "$.dependencies").alias("text"))
    levels = []
    while True:
        level = old.where("text IS NOT NULL").select("manifest", "around", F.explode(F.from_json("text", f"map<string,{NPM_V1}>")).alias("name", "e"))
        level = saved(level.select("manifest", F.concat("around", F.when(F.col("around") == "", "").otherwise("/"), F.lit("node_modules/"), "name").alias("key"), "name", "e.version", F.coalesce("e.dev", F.lit(False)).alias("dev"), "e.requires", "e.dependencies"))
        if level.isEmpty():
            break
        levels.append(level)
        old = level.select("manifest", F.col("key").alias("around"), F.col("dependencies").alias("text"))
    if levels:
        nested = reduce(DataFrame.unionByName, levels)
        installs = installs.unionByName(nested.select(installs.columns))
        needs = needs.unionByName(nested.select("manifest", F.col("key").alias("src"), F.explode(_names(F.from_json("requires", _MAP))).alias("name")))
    # Without a root entry, the manifest beside the lock declares what is direct.
    beside = files.where(F.col("file").rlike(r"(?:^|/)package\.json$")).select(F.regexp_replace("file", BESIDE, "").alias("folder"), "text")
    told = lambda *groups: reduce(lambda a, b: F.concat(a, b), [_names(F.from_json(F.get_json_object("text", f"$.{g}"), _MAP)) for g in groups])
    declared = beside.select("folder", F.explode(told("dependencies", "optionalDependencies", "devDependencies")).alias("name")).distinct()
    bare = installs.select("manifest").distinct().join(roots.select("manifest").distinct(), "manifest", "left_anti").withColumn("folder", F.regexp_replace("manifest", BESIDE, ""))
    direct = roots.select("manifest", "name").unionByName(bare.join(declared, "folder").select("manifest", "name")).distinct().withColumn("top", F.concat(F.lit("node_modules/"), "name"))
    known = installs.join(direct.select("manifest", F.col("top").alias("key"), F.lit(True).alias("direct")), ["manifest", "key"], "left")
    return known.select("manifest", F.lit("npm").alias("ecosystem"), "key", "name", "version", "dev", F.coalesce("direct", F.lit(False)).alias("direct")), needs


def _npm_edges(installs: DataFrame, needs: DataFrame) -> DataFrame:
    """Each dependency with the nearest install above it."""
    tried = needs.select("manifest", "src", "name", F.posexplode(_above(F.col("src"))).alias("far", "folder"))
    tried = tried.withColumn("key", F.concat("folder", F.when(F.col("folder") == "", "").otherwise("/"), F.lit("node_modules/"), "name"))
    hit = tried.join(installs.select("manifest", "key"), ["manifest", "key"])
    return hit.groupBy("manifest", "src", "name").agg(F.min_by("key", "far").alias("dst")).select("manifest", "src", "dst")


def _blocks(files: DataFrame, pattern: str, head: str) -> DataFrame:
    """manifest, block, at, l: lines of the files, numbered by the heads before them."""
    lines = files.where(F.col("file").rlike(pattern)).select(F.col("file").alias("manifest"), F.posexplode(F.split("text", "\r?\n")).alias("at", "l"))
    block = F.count_if(F.col("l").rlike(head)).over(Window.partitionBy("manifest").orderBy("at"))
    return lines.select("manifest", block.alias("block"), "at", "l").where("block > 0")


def _yarn(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Installs and edges of yarn.lock: a block answers the ranges of its head."""
    lines = _blocks(files, r"(?:^|/)yarn\.lock$", r"^[^\s#].*:\s*$")
    section = F.last(F.when(F.col("l").rlike(r"^ {2}\S"), F.trim("l")), True).over(Window.partitionBy("manifest", "block").orderBy("at"))
    lines = saved(lines.withColumn("section", section))
    heads = lines.where(F.col("l").rlike(r"^\S")).select("manifest", "block", F.explode(F.split(F.regexp_replace("l", r":\s*$", ""), r",\s*")).alias("spec"))
    heads = heads.select("manifest", "block", F.regexp_replace("spec", "^\"|\"$", "").alias("spec")).where("spec <> '__metadata'")
    name = F.regexp_extract("spec", r"^(@?[^@]+)@", 1)
    version = lines.where(F.col("l").rlike(r"^ {2}version:?\s")).select("manifest", "block", F.regexp_extract("l", r"version:?\s+\"?([^\"\s]+)", 1).alias("version"))
    key = F.concat("name", F.lit("@"), "version")
    installs = heads.select("manifest", "block", name.alias("name")).groupBy("manifest", "block").agg(F.min("name").alias("name")).join(version, ["manifest", "block"]).withColumn("key", key)
    needs = lines.where(F.col("l").rlike(r"^ {4}\S") & F.col("section").rlike("^(?:dependencies|optionalDependencies):")).select("manifest", "block", F.regexp_extract("l", r"^ {4}\"?((?:@[^/\"]+/)?[^@\s\":]+)\"?:?\s+\"?([^\"]*)", 1).alias("dep"), F.regexp_extract("l", r"^ {4}\"?((?:@[^/\"]+/)?[^@\s\":]+)\"?:?\s+\"?([^\"]*)", 2).alias("range"))
    wanted = needs.withColumn("spec", F.concat("dep", F.lit("@"), "range")).join(heads.withColumnRenamed("block", "to"), ["manifest", "spec"])
    keys = installs.select("manifest", "block", "key")
    edges = wanted.join(keys.withColumnRenamed("key", "src"), ["manifest", "block"]).join(keys.select("manifest", F.col("block").alias("to"), F.col("key").alias("dst")), ["manifest", "to"]).select("manifest", "src", "dst").distinct()
    beside = files.where(F.col("file").rlike(r"(?:^|/)package\.json$")).select(F.regexp_replace("file", BESIDE, "").alias("folder"), "text")
    groups = lambda g: F.coalesce(F.from_json(F.get_json_object("text", f"$.{g}"), _MAP), F.create_map().cast(_MAP))
    specs = lambda g: F.transform(F.map_entries(groups(g)), lambda e: F.struct(F.concat(e["key"], F.lit("@"), e["value"]).alias("spec"), F.lit(g == "devDependencies").alias("dev")))
    declared = beside.select("folder", F.explode(F.concat(*map(specs, ("dependencies", "optionalDependencies", "devDependencies")))).alias("d")).select("folder", "d.*")
    berry = declared.unionByName(declared.withColumn("spec", F.regexp_replace("spec", "(?<=.)@", "@npm:")))
    direct = heads.withColumn("folder", F.regexp_replace("manifest", BESIDE, "")).join(berry, ["folder", "spec"]).groupBy("manifest", "block").agg(F.min("dev").alias("dev"))
    known = installs.join(direct, ["manifest", "block"], "left")
    return known.select("manifest", F.lit("npm").alias("ecosystem"), "key", "name", "version", F.coalesce("dev", F.lit(False)).alias("dev"), F.col("dev").isNotNull().alias("direct")).distinct(), edges


def _toml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Installs and edges of poetry.lock, uv.lock and Cargo.lock: blocks of packages with the names that they need."""
    lines = _blocks(files, r"(?:^|/)(?:poetry|uv|Cargo)\.lock$", r"^\[\[package\]\]")
    # A list may run over several lines; what opened it holds until a table or another key begins.
    opened = F.when(F.col("l").rlike(r"^\["), F.regexp_extract("l", r"^\[+([^\]]+)\]", 1)).when(F.col("l").rlike(r"^[\w-]+\s*="), F.regexp_extract("l", r"^([\w-]+)", 1))
    table = F.last(F.when(F.col("l").rlike(r"^\["), F.regexp_extract("l", r"^\[+([^\]]+)\]", 1)), True)
    by_block = Window.partitionBy("manifest", "block").orderBy("at")
    lines = saved(lines.select("*", F.last(opened, True).over(by_block).alias("opened"), table.over(by_block).alias("table")))
    named = F.regexp_extract("l", r"^(?:name|version)\s*=\s*\"([^\"]*)\"", 1)
    heads = lines.where("table = 'package'").groupBy("manifest", "block").agg(F.max(F.when(F.startswith("l", F.lit("name ")), named)).alias("name"), F.max(F.when(F.startswith("l", F.lit("version ")), named)).alias("version"), F.max(F.col("l").rlike(r"^source = \{ (?:virtual|editable)")).alias("is_root")).where("name IS NOT NULL")
    cargo = F.endswith("manifest", F.lit("Cargo.lock"))
    plain = lambda c: F.when(cargo, c).otherwise(F.regexp_replace(F.lower(c), "[-_.]+", "-"))
    key = F.concat_ws("@", plain(F.col("name")), F.col("version"))
    # Cargo's own packages have no source; they and uv's virtual ones are the project itself.
    sourced = lines.where(F.startswith("l", F.lit("source "))).select("manifest", "block").distinct().withColumn("sourced", F.lit(True))
    heads = saved(heads.join(sourced, ["manifest", "block"], "left").select("manifest", "block", "name", "version", key.alias("key"), F.when(cargo, F.col("sourced").isNull()).otherwise(F.col("is_root")).alias("is_root")))
    inner = lines.where("opened = 'dependencies' AND table = 'package'").select("manifest", "block", F.explode(F.regexp_extract_all("l", F.lit(r"(?:name = )?\"([^\"]+)\"(?:, version = \"[^\"]*\")?"), F.lit(1))).alias("need"))
    poetry = lines.where("table IN ('package.dependencies')").where(F.col("l").rlike(r"^[\"\w].*=")).select("manifest", "block", F.regexp_extract("l", r"^\"?([\w.-]+)\"?\s*=", 1).alias("need"))
    needs = inner.where(~F.endswith("manifest", F.lit("poetry.lock"))).unionByName(poetry).where("need <> ''")
    needs = needs.select("manifest", "block", plain(F.split("need", " ")[0]).alias("dep"), F.get(F.split("need", " "), F.lit(1)).alias("exact"))
    targets = heads.select("manifest", plain(F.col("name")).alias("dep"), F.col("version").alias("own"), F.col("key").alias("dst"))
    edges = needs.join(targets, ["manifest", "dep"]).where("exact IS NULL OR exact = own").join(heads.select("manifest", "block", F.col("key").alias("src"), "is_root"), ["manifest", "block"])
    direct = edges.where("is_root").select("manifest", F.col("dst").alias("key"), F.lit(True).alias("direct")).distinct()
    ecosystem = F.when(cargo, "cargo").otherwise("pypi")
    installs = heads.where("NOT is_root").join(direct, ["manifest", "key"], "left")
    return installs.select("manifest", ecosystem.alias("ecosystem"), "key", "name", "version", F.lit(False).alias("dev"), F.coalesce("direct", F.lit(False)).alias("direct")), edges.where("NOT is_root").select("manifest", "src", "dst").distinct()


def locked_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(installs, edges) of all lock files among ``files`` (file, text).

    Installs: manifest, ecosystem, key, name, version, dev, direct; edges: manifest, src, dst (keys). npm's key is
    the folder of an install, that of the others name@version. Texts that can't be read give no rows.
    """
    npm, needs = _npm(files)
    npm = saved(npm)
    yarn, yarn_edges = _yarn(files)
    toml, toml_edges = _toml(files)
    installs = npm.unionByName(yarn).unionByName(toml).select(*INSTALLS)
    return saved(installs), saved(_npm_edges(npm, needs).unionByName(yarn_edges).unionByName(toml_edges))


def via_chains(installs: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """manifest, name, via (array): the shortest chain of names from a direct package down to a parent of each other one; of equal chains the least.

    A report keeps chains of up to ``most`` names; what lies deeper has none. Each name is reached once, so cycles end.
    """
    names = installs.select("manifest", "key", "name")
    steps = edges.join(names.withColumnRenamed("key", "src").withColumnRenamed("name", "a"), ["manifest", "src"]).join(names.withColumnRenamed("key", "dst").withColumnRenamed("name", "b"), ["manifest", "dst"]).select("manifest", "a", "b").where("a <> b").distinct()
    steps = saved(steps)
    frontier = saved(installs.where("direct").select("manifest", "name", F.array().cast("array<string>").alias("via")).distinct())
    seen = frontier
    for _ in range(most):
        reached = frontier.join(steps.withColumnRenamed("a", "name"), ["manifest", "name"]).groupBy("manifest", "b").agg(F.min(F.concat("via", F.array("name"))).alias("via")).withColumnRenamed("b", "name")
        frontier = saved(reached.join(seen.select("manifest", "name"), ["manifest", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select(seen.columns))
    return seen.where(F.size("via") > 0)
