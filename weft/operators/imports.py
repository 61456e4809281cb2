"""The import graph: specifiers of a file resolved to files by ranked candidates.

Every specifier becomes a list of paths that it may mean, best first; one equality join with the files that
there are and a minimum by rank keep the first that exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.source_code import COMMENTS, STRINGS, STYLES
from weft.operators.tables import dealt, unsent

#: What may be added to a path, best first; a .js specifier of TypeScript means the .ts file beside it.
ENDINGS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs")
SCRIPTS = r"\.(?:js|jsx|mjs|cjs|ts|tsx|vue)$"


def normal_path(path: Column) -> Column:
    """A path without empty and dot segments; two dots take the segment before away, and stay where there is none."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(walked, "/")


def _folder(file: Column | str) -> Column:
    return F.regexp_replace(file, r"[^/]*$", "")


def script_specifiers(text: Column) -> Column:
    """Distinct specifiers of import, export … from, require and import(): strings of code that one of these words stands before."""
    cut = F.regexp_extract_all(text, F.lit("(?s)" + STYLES["brace"]), F.lit(0))
    told = F.filter(cut, lambda t: ~t.rlike(COMMENTS["brace"]))
    at = lambda i: F.coalesce(F.get(told, i), F.lit(""))
    spec = lambda t, i: F.when(t.rlike(r"^[\"'][^\"'\n]+[\"']$") & (at(i - 1).rlike(r"\b(?:from|import)\s*$") | ((at(i - 1) == "(") & at(i - 2).rlike(r"\b(?:require|import)\s*$"))), F.substr(t, F.lit(2), F.length(t) - 2))
    return F.array_distinct(F.array_compact(F.transform(told, spec)))


def python_modules(text: Column) -> Column:
    """(module, name) of import and from … import lines outside strings and comments; name is null for a plain import."""
    cut = F.regexp_extract_all(text, F.lit("(?s)" + STYLES["hash"]), F.lit(0))
    code = F.array_join(F.filter(cut, lambda t: ~t.rlike(COMMENTS["hash"]) & ~t.rlike(STRINGS["hash"])), "")
    lines = F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*(?:from[ \t]+[.\w]+[ \t]+import[ \t]*(?:\([^)]*\)|[^\n(]*)|import[ \t]+[^\n]+)"), F.lit(0))
    none = F.lit(None).cast("string")
    named = lambda l: F.transform(
        F.filter(F.split(F.regexp_replace(F.regexp_extract(l, r"(?s)\bimport[ \t]*(.*)$", 1), r"[()\s]+", " "), ","), lambda x: F.trim(x) != ""),
        lambda x: F.when(l.rlike(r"^[ \t]*from"), F.struct(F.regexp_extract(l, r"from[ \t]+([.\w]+)", 1).alias("module"), F.regexp_extract(x, r"([\w*]+)", 1).alias("name"))).otherwise(F.struct(F.regexp_extract(x, r"([\w.]+)", 1).alias("module"), none.alias("name"))),
    )
    return F.array_distinct(F.flatten(F.transform(lines, named)))


def resolved_imports(files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """src, dst: files that a file imports. ``files``: file, text; ``aliases``: prefix (a first segment with its slash, as "~/") and target folder.

    Scripts: relative and aliased specifiers, with the endings of ENDINGS; Python: relative modules, and absolute ones from the
    nearest folder around the file that holds them. A name that is a module of a package counts before the package itself.
    What no file answers is left out, a file's import of itself too. Null texts import nothing.
    """
    known = files.select(F.col("file").alias("dst"))
    files = dealt(files.select("file", "text"))
    scripts = files.where(F.col("file").rlike(SCRIPTS)).select(F.col("file").alias("src"), F.explode(script_specifiers(F.col("text"))).alias("spec"))
    bases = scripts.where(F.col("spec").rlike(r"^\.{1,2}(?:/|$)")).select("src", F.concat(_folder("src"), "spec").alias("base"))
    if aliases is not None:
        named = scripts.withColumn("prefix", F.regexp_extract("spec", "^[^/.][^/]*/|^/", 0)).join(unsent(aliases), "prefix")
        bases = bases.unionByName(named.select("src", F.concat("target", F.lit("/"), F.substr("spec", F.length("prefix") + 1)).alias("base")))
    base = normal_path(F.col("base"))
    typed = F.when(F.col("base").rlike(r"\.[cm]?jsx?$"), F.array(F.regexp_replace("base", r"\.([cm]?)js(x?)$", ".$1ts$2"))).otherwise(F.array().cast("array<string>"))
    tried = bases.select("src", base.alias("base")).select("src", F.col("base").alias("key"), F.posexplode(F.concat(F.array(F.concat("base", F.lit(ENDINGS[0]))), typed, F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS[1:]]))).alias("rank", "dst"))

    modules = files.where(F.col("file").rlike(r"\.pyi?$")).select(F.col("file").alias("src"), F.explode(python_modules(F.col("text"))).alias("m")).select("src", "m.module", "m.name")
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    path = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    above = F.filter(F.split(_folder("src"), "/"), lambda x: x != "")
    # Folders where a module may begin: that of the dots, or every folder around the file, the nearest first, and src below the top.
    around = F.concat(F.transform(F.sequence(F.size(above), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(above, 1, k), "/")), F.array(F.lit("src")))
    roots = F.when(dots > 0, F.array(F.array_join(F.slice(above, 1, F.greatest(F.lit(0), F.size(above) - dots + 1)), "/"))).otherwise(around)
    placed = modules.select("src", "module", "name", path.alias("path"), F.explode(roots).alias("root"), roots.alias("roots"))
    placed = placed.select("src", "module", "name", F.array_position("roots", F.col("root")).alias("far"), normal_path(F.concat_ws("/", "root", "path")).alias("base"))
    inner = F.when(F.col("name").isNotNull() & (F.col("name") != "*"), F.array(F.concat("base", F.lit("/"), "name", F.lit(".py")), F.concat("base", F.lit("/"), "name", F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>"))
    own = F.array(F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))
    python = placed.select("src", F.concat_ws(" ", "module", "name").alias("key"), "far", F.posexplode(F.concat(inner, own)).alias("rank", "dst"))
    python = python.select("src", "key", (F.col("far") * 4 + F.col("rank")).cast("int").alias("rank"), F.ltrim(F.col("dst"), F.lit("/")).alias("dst"))

    found = tried.unionByName(python).join(unsent(known), "dst", "left_semi").groupBy("src", "key").agg(F.min_by("dst", "rank").alias("dst"))
    return found.where("src <> dst").select("src", "dst").distinct()
