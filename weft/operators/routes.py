"""Routes whose paths are composed: routers that include routers, modules that include modules, classes and nested blocks.

Each framework gives nodes, edges with the prefix that they add, and endpoints at nodes. A route is
the product of every path from a root to its node (``graph.labelled_paths``) with the endpoint's own path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.graph import labelled_paths
from weft.operators.source_code import arguments, calls, tokens
from weft.operators.tables import dealt, saved, unsent

#: Methods of decorators, of Spring's annotations and of Rails' routes.
DECORATORS = "get|post|put|patch|delete|head|options|websocket"
MAPPINGS = "Get|Post|Put|Patch|Delete|Request"
VERBS = "get|post|put|patch|delete"
#: The routes of resources, as (action, method, path); :m stands for the member.
RESOURCES = (("index", "GET", ""), ("create", "POST", ""), ("new", "GET", "/new"), ("edit", "GET", ":m/edit"), ("show", "GET", ":m"), ("update", "PATCH", ":m"), ("update", "PUT", ":m"), ("destroy", "DELETE", ":m"))


def joined_route(*parts: Column) -> Column:
    """Parts as one route: one slash in front and between, none at the end unless the last part has one and a path."""
    return F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", *parts)), "/{2,}", "/")


def _node(file: Column | str, name: Column | str) -> Column:
    return F.concat_ws("\n", file, name)


def _argument(args: DataFrame, key: str | None = None, n: int | None = None) -> DataFrame:
    """file, call, and the value and text of one argument: by name, or by place."""
    rows = args.where(F.col("key") == key) if key else args.where((F.col("n") == n) & F.col("key").isNull())
    return rows.select("file", "call", "value", "text")


def _composed(endpoints: DataFrame, declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints (node, …) with ``label`` for every path to their node. Nodes that nothing includes are roots; ``declared``: node, label."""
    nodes = declared.unionByName(endpoints.select("node", F.lit("").alias("label"))).groupBy("node").agg(F.max("label").alias("label"))
    own = edges.join(unsent(nodes.select(F.col("node").alias("dst"), F.col("label").alias("own"))), "dst").select("src", "dst", F.concat("label", F.lit("/"), "own").alias("label"))
    roots = nodes.join(unsent(own.select(F.col("dst").alias("node")).distinct()), "node", "left_anti")
    return endpoints.join(unsent(labelled_paths(roots, own)), "node")


def fastapi_routes(files: DataFrame) -> DataFrame:
    """method, route, file, line of FastAPI's decorators, under the prefixes of their router and of all inclusions of it.

    ``include_router(m.x)`` means the router x of the one file m.py or m/__init__.py, ``include_router(x)`` that of its own file or else of the one file
    that declares x; with several such files an inclusion says nothing. A router that includes itself ends there. What stands in comments and strings is none.
    """
    found = saved(tokens(files, "hash"))
    every, args = saved(calls(found)), saved(arguments(found))
    prefix = _argument(args, key="prefix").select("file", "call", F.col("value").alias("prefix"))
    routers = every.where(F.col("name").rlike(r"(?:^|\.)(?:APIRouter|FastAPI)$")).withColumn("var", F.regexp_extract("head", r"(\w+)\s*(?::\s*[\w.]+\s*)?=\s*(?:\w+\.)?(?:APIRouter|FastAPI)\s*$", 1)).where("var <> ''")
    declared = saved(routers.join(unsent(prefix), ["file", "call"], "left").select("file", "var", F.coalesce("prefix", F.lit("")).alias("label")).distinct())
    module = F.regexp_extract("file", r"([^/]+?)(?:/__init__)?\.py$", 1)
    named = declared.select("file", "var", module.alias("module"))
    only = lambda rows, *k: rows.groupBy(*k).agg(F.min("file").alias("to"), F.count_distinct("file").alias("files")).where("files = 1").drop("files")
    mounts = every.where(F.col("name").rlike(r"\.include_router$")).withColumn("owner", F.regexp_extract("name", r"(\w+)\.include_router$", 1))
    target = _argument(args, n=0).select("file", "call", F.regexp_extract("text", r"(?:^|\.)(\w+)\.\w+$", 1).alias("module"), F.regexp_extract("text", r"(\w+)$", 1).alias("var"))
    mounts = mounts.join(unsent(target), ["file", "call"]).join(unsent(prefix), ["file", "call"], "left").select("file", "owner", "module", "var", F.coalesce("prefix", F.lit("")).alias("label"))
    bare, dotted = mounts.where("module = ''").drop("module"), mounts.where("module <> ''")
    here = bare.join(unsent(named.select("file", "var")), ["file", "var"], "left_semi").withColumn("to", F.col("file"))
    there = bare.join(unsent(named.select("file", "var")), ["file", "var"], "left_anti").join(unsent(only(named, "var")), "var")
    other = dotted.join(unsent(only(named, "module", "var")), ["module", "var"])
    edges = here.unionByName(there.select(here.columns)).unionByName(other.select(here.columns)).select(_node("file", "owner").alias("src"), _node("to", "var").alias("dst"), "label")
    path = _argument(args, n=0).select("file", "call", F.coalesce("value", F.lit("")).alias("path"))
    ends = every.where(F.col("name").rlike(rf"^@\w+\.(?:{DECORATORS})$")).join(unsent(path), ["file", "call"])
    verb = F.regexp_extract("name", r"\.(\w+)$", 1)
    ends = ends.select(_node("file", F.regexp_extract("name", r"@(\w+)\.", 1)).alias("node"), F.when(verb == "websocket", "WS").otherwise(F.upper(verb)).alias("method"), "path", "file", "line")
    composed = _composed(ends, declared.select(_node("file", "var").alias("node"), "label"), edges)
    route = F.regexp_replace(joined_route(F.col("label"), F.col("path")), "(.)/$", "$1")
    return composed.select("method", route.alias("route"), "file", "line").distinct()


def django_routes(files: DataFrame) -> DataFrame:
    """method, route, file, line of path, re_path and url in Django's urls modules, composed through include.

    ``include("a.b.urls")`` means the file whose path ends in a/b/urls.py; the shortest such path counts. A pattern stays as
    it is written but for its anchors. Methods are ANY, since a view decides them.
    """
    found = saved(tokens(files, "hash"))
    every, args = saved(calls(found).where(F.col("name").rlike(r"^(?:path|re_path|url|include)$"))), saved(arguments(found))
    first = _argument(args, n=0).select("file", "call", F.col("value").alias("pattern"))
    # An included module is written as "a.b.urls", alone or first in a tuple.
    tuples = found.where("kind = 'open' AND token = '(' AND n = 0 AND head IS NULL").select("file", F.col("parent").alias("call"), F.col("i").alias("inner"))
    paired = tuples.join(unsent(first.where("pattern IS NOT NULL").withColumnRenamed("call", "inner")), ["file", "inner"]).select("file", "call", "pattern")
    inner = every.where("name = 'include'").join(unsent(first.where("pattern IS NOT NULL").unionByName(paired)), ["file", "call"]).select("file", F.col("parent").alias("call"), F.concat(F.lit("/"), F.translate("pattern", ".", "/"), F.lit(".py")).alias("module"))
    entries = every.where("name <> 'include'").join(unsent(first), ["file", "call"]).where("pattern IS NOT NULL").withColumn("pattern", F.regexp_replace("pattern", r"^\^|\$$", ""))
    # Every ending of a file's path is a name that it may be included by.
    folders = F.split(F.concat(F.lit("/"), "file"), "/")
    endings = files.select("file", F.explode(F.sequence(F.lit(1), F.size(folders) - 1)).alias("k"), folders.alias("p")).select(F.col("file").alias("to"), F.concat(F.lit("/"), F.array_join(F.slice("p", F.size("p") - F.col("k") + 1, F.col("k")), "/")).alias("module"))
    nearest = endings.groupBy("module").agg(F.min_by("to", F.struct(F.length("to"), "to")).alias("to"))
    edges = entries.join(unsent(inner), ["file", "call"]).join(unsent(nearest), "module").select(F.col("file").alias("src"), F.col("to").alias("dst"), F.col("pattern").alias("label"))
    ends = entries.join(unsent(inner.select("file", "call")), ["file", "call"], "left_anti").select(F.col("file").alias("node"), F.lit("ANY").alias("method"), F.col("pattern").alias("path"), "file", "line")
    roots = entries.select(F.col("file").alias("node"), F.lit("").alias("label")).distinct()
    return _composed(ends, roots, edges).select("method", joined_route(F.col("label"), F.col("path")).alias("route"), "file", "line").distinct()


def spring_routes(files: DataFrame) -> DataFrame:
    """method, route, file, line of the mapping annotations of controllers, under the paths of their own class.

    A class takes the mapping that stands between the end before it and its brace; nested classes don't take that of the
    class around them. Several paths, of a class or of a method, are a route each; without ``method`` a request mapping answers ANY.
    """
    level = Window.partitionBy("file", "level", F.coalesce("parent", F.lit(-1))).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    # The next brace of the same level tells whether an annotation belongs to a class or to a member; a field ends before it.
    ends = F.when((F.col("token") == "{"), F.struct("i", "head")).when((F.col("kind") == "code") & F.contains("token", F.lit(";")), F.struct(F.lit(-1).alias("i"), F.lit("").alias("head")))
    found = saved(tokens(files, "brace").select("*", F.last(ends, True).over(level).alias("next")))
    is_class = F.coalesce(F.col("next.head").rlike(r"\b(?:class|interface|record)\s+\w+"), F.lit(False))
    a_call = found.where(F.col("head").rlike(rf"@(?:{MAPPINGS})Mapping\s*$") & (F.col("token") == "(")).select("file", F.col("i").alias("call"), F.regexp_extract("head", rf"@({MAPPINGS})Mapping\s*$", 1).alias("kind"), "line", "parent", is_class.alias("on_class"), F.col("next.i").alias("next"))
    a_call = saved(a_call)
    args = arguments(found.join(unsent(a_call.select("file", F.col("call").alias("parent"))), ["file", "parent"], "left_semi"))
    given = args.where("key IS NULL OR key IN ('value', 'path')")
    # One path, or those of a list in braces, whose strings sit one bracket further in.
    lists = found.where("kind = 'open' AND token IN ('{', '[', '(')").select("file", F.col("parent").alias("call"), F.col("i").alias("inner"))
    strings = found.where("kind = 'string'").select("file", F.col("parent").alias("inner"), F.expr("substring(token, 2, length(token) - 2)").alias("value"))
    listed = a_call.select("file", "call").join(unsent(lists), ["file", "call"]).join(unsent(strings), ["file", "inner"]).select("file", "call", "value")
    paths = given.where("value IS NOT NULL").select("file", "call", "value").unionByName(listed).distinct()
    verbs = args.where("key = 'method'").select("file", "call", F.regexp_extract("text", r"(?:RequestMethod\.)?(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|TRACE)\b", 1).alias("verb"))
    known = a_call.join(unsent(paths), ["file", "call"], "left").join(unsent(verbs), ["file", "call"], "left").select("file", "line", "kind", "parent", "on_class", "next", F.coalesce("value", F.lit("")).alias("path"), "verb")
    # An annotation without parentheses ends where its method's name begins.
    bare = found.where(F.col("kind") == "code").select("file", "line", "parent", "token").where(F.col("token").rlike(rf"@(?:{MAPPINGS})Mapping\s+[^\s(]"))
    bare = bare.select("file", F.explode(F.regexp_extract_all("token", F.lit(rf"(?s)^(.*)@(?:{MAPPINGS})Mapping\s+[^\s(]"), F.lit(1))).alias("above"), "line", "parent", "token")
    bare = bare.select("file", (F.col("line") + F.length("above") - F.length(F.translate("above", "\n", ""))).cast("int").alias("line"), F.regexp_extract("token", rf"@({MAPPINGS})Mapping\s+[^\s(]", 1).alias("kind"), "parent")
    members = known.where("NOT on_class").drop("on_class", "next").unionByName(bare.select("*", F.lit("").alias("path"), F.lit(None).cast("string").alias("verb")))
    classes = known.where("on_class").select("file", F.col("next").alias("parent"), F.col("path").alias("label"))
    bodies = found.where("token = '{'").where(F.col("head").rlike(r"\bclass\s+\w+")).select("file", F.col("i").alias("parent"))
    routes = members.join(unsent(bodies), ["file", "parent"]).join(unsent(classes), ["file", "parent"], "left")
    method = F.when(F.col("kind") != "Request", F.upper("kind")).otherwise(F.coalesce(F.nullif("verb", F.lit("")), F.lit("ANY")))
    route = F.regexp_replace(joined_route(F.coalesce("label", F.lit("")), F.col("path")), "(.)/$", "$1")
    return routes.select(method.alias("method"), route.alias("route"), "file", "line").distinct()


def rails_routes(files: DataFrame) -> DataFrame:
    """method, route, file, line of Rails' routes: verbs, root, resources and resource, under namespaces, scopes and resources around them.

    Blocks are lines that end in ``do`` up to their ``end``. ``only`` and ``except`` choose among the actions of resources; member and
    collection blocks add to the member's and to the collection's path. Comment lines are none.
    """
    lines = dealt(files.select("file", "text")).select("file", F.posexplode(F.split("text", "\r?\n")).alias("i", "l")).select("file", "i", F.trim(F.regexp_replace("l", r"(?<![\"'\w])#.*$", "")).alias("l"))
    opens, closes = F.col("l").rlike(r"\bdo(?:\s*\|[^|]*\|)?$|^(?:if|unless|case|begin|def|class|module)\b"), F.col("l") == "end"
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0))
    leveled = lines.select("*", opens.alias("opens"), depth.alias("level")).where("l <> '' AND l <> 'end'")
    here, above = F.struct("level", F.lit(None).cast("int").alias("scope")), F.struct((F.col("level") + 1).alias("level"), F.col("i").alias("scope"))
    placed = leveled.select("file", "i", "l", F.explode(F.when(F.col("opens"), F.array(here, above)).otherwise(F.array(here))).alias("s"))
    around = Window.partitionBy("file", "s.level").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.select("file", "i", "l", F.last("s.scope", True).over(around).alias("parent"), F.col("s.scope").isNull().alias("own")).where("own").drop("own")
    word = F.regexp_extract("l", r"^([a-z]+)\b", 1)
    name = F.regexp_extract("l", r"^[a-z]+[ (]+[:\"']([^\"',\s)]*)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract("l", r"\bpath:\s*[\"']([^\"']*)", 1), F.lit("")), name)
    one = F.regexp_replace(F.regexp_replace(name, "ies$", "y"), "(?<!s)s$", "")
    key = F.coalesce(F.nullif(F.regexp_extract("l", r"\bparam:\s*:(\w+)", 1), F.lit("")), F.lit("id"))
    rows = saved(rows.select("file", "i", "l", "parent", word.alias("word"), name.alias("name"), path.alias("path"), one.alias("one"), key.alias("key")))
    label = (
        F.when(F.col("word") == "namespace", F.concat(F.lit("/"), "path"))
        .when(F.col("word") == "scope", F.concat(F.lit("/"), F.when(F.col("l").rlike(r"^scope[ (]+(?:[:\"']|.*\bpath:)"), F.col("path")).otherwise(F.lit(""))))
        .when(F.col("word") == "resources", F.concat(F.lit("/"), "path", F.lit("/:"), "one", F.lit("_"), "key"))
        .when(F.col("word") == "resource", F.concat(F.lit("/"), "path"))
        .otherwise(F.lit(""))
    )
    edges = rows.where("parent IS NOT NULL").select(_node("file", F.col("parent").cast("string")).alias("src"), _node("file", F.col("i").cast("string")).alias("dst"), label.alias("label"))
    tops = rows.where("parent IS NULL").select(_node("file", F.col("i").cast("string")).alias("node"), label.alias("label"))
    # The path above a line is that of the block around it; member and collection are blocks that change the last part.
    above = labelled_paths(tops, edges.join(unsent(rows.select(_node("file", F.col("parent").cast("string")).alias("src")).distinct()), "src", "left_semi"))
    blocks = rows.select("file", F.col("i").alias("parent"), F.col("word").alias("block"), F.col("parent").alias("outer"), F.col("key").alias("block_key"))
    outer = rows.select("file", F.col("i").alias("outer"), F.col("key").alias("outer_key"), F.col("word").alias("outer_word"))
    at = rows.join(unsent(blocks), ["file", "parent"], "left").join(unsent(outer), ["file", "outer"], "left").withColumn("node", _node("file", F.col("parent").cast("string"))).join(unsent(above), "node", "left")
    base = F.coalesce("label", F.lit(""))
    collected = F.regexp_replace(base, r"/:\w+$", "")
    on = F.when(F.col("block") == "resources", F.regexp_extract("l", r"\bon:\s*:(member|collection)\b", 1))
    own_key = F.coalesce("block_key", F.lit("id"))
    base = F.when(on == "collection", collected).when(on == "member", F.concat(collected, F.lit("/:"), own_key)).when((F.col("block") == "collection") & (F.col("outer_word") == "resources"), collected).when((F.col("block") == "member") & (F.col("outer_word") == "resources"), F.concat(collected, F.lit("/:"), "outer_key")).otherwise(base)
    at = at.withColumn("base", base)
    listed = lambda k: F.regexp_extract_all(F.regexp_extract("l", rf"\b{k}:\s*(\[[^\]]*\]|%i[\[(][^\])]*[\])]|:\w+)", 1), F.lit(r"\b[a-z]\w*"), F.lit(0))
    only, other = F.filter(listed("only"), lambda x: x != "i"), F.filter(listed("except"), lambda x: x != "i")
    every = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(m).alias("method"), F.lit(p).alias("tail")) for a, m, p in RESOURCES])
    chosen = F.filter(every, lambda r: ((F.size(only) == 0) | F.array_contains(only, r["action"])) & ~F.array_contains(other, r["action"]))
    plural = at.where("word IN ('resources', 'resource')").withColumn("r", F.explode(chosen)).where("word = 'resources' OR r.action <> 'index'")
    member = F.when(F.col("word") == "resources", F.concat(F.lit("/:"), "key")).otherwise(F.lit(""))
    plural = plural.select(F.col("r.method").alias("method"), joined_route("base", "path", F.replace(F.col("r.tail"), F.lit(":m"), member)).alias("route"), "file", "i")
    single = at.where(F.col("word").rlike(f"^(?:{VERBS}|root)$")).select(
        F.when(F.col("word") == "root", "GET").otherwise(F.upper("word")).alias("method"), joined_route("base", F.when(F.col("word") == "root", "").otherwise(F.col("name"))).alias("route"), "file", "i"
    )
    return plural.unionByName(single).select("method", F.regexp_replace("route", "(.)/$", "$1").alias("route"), "file", (F.col("i") + 1).cast("int").alias("line")).distinct()
