"""Nested infrastructure formats as rows: indented lines become paths, blocks of braces become declarations.

An indented line belongs to the last line before it that is indented less. Indents are few in a file, so a
line stands once for every deeper indent, and the parent is a last value of a window; the path is the product of the
keys above (``graph.labelled_paths``). Rules are conditions on paths. No values are kept but images, ports and replicas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.code_facts import image_parts
from weft.operators.graph import labelled_paths
from weft.operators.source_code import tokens
from weft.operators.tables import dealt, saved, unsent

KEY = r"^([\w./-]+|\"[^\"]*\"|'[^']*')\s*:(?:\s+(.*))?$"
#: Kinds of rows by the keys of compose files and by the kinds of manifests; where a manifest has its pod.
COMPOSE = {"services": ("workload", "compose-service"), "volumes": ("volume", "compose-volume"), "networks": ("volume", "compose-network"), "secrets": ("secret", "compose-secret"), "configs": ("config", "compose-config")}
MANIFESTS = {
    "workload": "Deployment StatefulSet DaemonSet ReplicaSet Pod DeploymentConfig",
    "job": "Job CronJob",
    "service": "Service",
    "ingress": "Ingress Route",
    "config": "ConfigMap",
    "secret": "Secret",
}
BLOCKS = {"resource": "resource", "data": "resource", "module": "module", "provider": "provider", "variable": "variable", "output": "output"}
ROWS = ("kind", "type", "name", "file", "line", "image", "tag", "ports", "replicas", "variables")


def yaml_paths(files: DataFrame) -> DataFrame:
    """file, doc, node, parent, line, path, key, value: the keys and list items of indented files.

    ``path`` has the keys from the top, each with a dot before it, and [] for a list item; a document ends at a line of three
    dashes. Values lose their quotes and comments; flow lists and block texts are kept as they are written. Blank and comment lines give no rows.
    """
    lines = dealt(files.where("text IS NOT NULL").select("file", "text")).select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "raw"))
    doc = F.count_if(F.col("raw").rlike(r"^---(?:\s|$)")).over(Window.partitionBy("file").orderBy("at"))
    lines = lines.select("file", doc.cast("int").alias("doc"), (F.col("at") + 1).cast("int").alias("line"), F.regexp_replace("raw", r"(?:^|\s)#.*$", "").alias("raw")).where(~F.col("raw").rlike(r"^\s*$|^---|^\.\.\.|^\s*%"))
    indent = F.length(F.regexp_extract("raw", "^ *", 0))
    body = F.trim("raw")
    dash = F.length(F.regexp_extract(body, r"^-\s+", 0))
    # An item and the key that it begins with are two rows, the key indented further. An item stands half a step behind a key, since a list may begin where its key does.
    item = F.struct((indent * 2 + 1).alias("indent"), F.lit(0).alias("sub"), F.lit("[]").alias("key"), F.when(~F.substr(body, dash + 1).rlike(KEY), F.substr(body, F.greatest(dash, F.lit(1)) + 1)).alias("value"))
    named = lambda text, deeper: F.struct(((indent + deeper) * 2).alias("indent"), F.lit(1).alias("sub"), F.regexp_extract(text, KEY, 1).alias("key"), F.nullif(F.regexp_extract(text, KEY, 2), F.lit("")).alias("value"))
    is_item = body.rlike(r"^-(?:\s|$)")
    inner = F.substr(body, dash + 1)
    both = F.when(is_item & inner.rlike(KEY), F.array(item, named(inner, dash))).when(is_item, F.array(item)).when(body.rlike(KEY), F.array(named(body, F.lit(0))))
    rows = lines.select("file", "doc", "line", F.explode(both).alias("r")).select("file", "doc", "line", "r.*")
    unquoted = lambda c: F.regexp_replace(F.trim(c), r"^([\"'])(.*)\1$", "$2")
    rows = rows.select("file", "doc", "line", "sub", "indent", unquoted("key").alias("key"), unquoted("value").alias("value"), (F.col("line") * 2 + F.col("sub")).alias("node"))
    rows = rows.withColumn("indents", F.collect_set("indent").over(Window.partitionBy("file", "doc")))
    deeper = F.filter("indents", lambda x: x > F.col("indent"))
    none = F.lit(None).cast("int")
    placed = rows.select("*", F.explode(F.concat(F.array(F.struct(F.col("indent").alias("level"), none.alias("scope"))), F.transform(deeper, lambda x: F.struct(x.alias("level"), F.col("node").alias("scope"))))).alias("s"))
    above = Window.partitionBy("file", "doc", "s.level").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.select("file", "doc", "line", "node", "key", "value", F.last("s.scope", True).over(above).alias("parent"), F.col("s.scope").isNull().alias("own")).where("own")
    found = saved(found.drop("own"))
    named_node = lambda n: F.concat_ws("\n", "file", "doc", n)
    label = F.concat(F.lit("."), "key")
    tops = found.where("parent IS NULL").select(named_node("node").alias("node"), label.alias("label"))
    edges = found.where("parent IS NOT NULL").select(named_node("parent").alias("src"), named_node("node").alias("dst"), label.alias("label"))
    paths = labelled_paths(tops, edges).withColumnRenamed("label", "path").withColumnRenamed("node", "id")
    return found.withColumn("id", named_node("node")).join(unsent(paths), "id").select("file", "doc", "node", "parent", "line", "path", "key", "value")


def _row(df: DataFrame, **given) -> DataFrame:
    """``df`` with the columns of ROWS, null where they aren't given."""
    types = {"line": "int", "ports": "array<string>", "replicas": "string", "variables": "array<string>"}
    return df.select(*[(given[c] if c in given else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in ROWS])


def _listed(rows: DataFrame, pattern: str, group: int, value, keys: tuple[str, ...]) -> DataFrame:
    """keys and an array of the values at paths that match; ``group`` of the path is the name they belong to."""
    own = rows.where(F.col("path").rlike(pattern)).withColumn("name", F.regexp_extract("path", pattern, group) if group else F.lit(""))
    return own.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("found"))


def compose_rows(paths: DataFrame) -> DataFrame:
    """Rows of compose files: services with image, ports (of the container), replicas and names of variables; volumes, networks, secrets and configs by name."""
    rows = paths.where(F.col("file").rlike(r"(?i)(?:^|/)(?:docker-)?compose(?:[.-][\w.-]{0,60})?\.ya?ml$"))
    rows = rows.join(unsent(rows.where("path = '.services'").select("file").distinct()), "file", "left_semi")
    top = rows.where(F.col("path").rlike(r"^\.(?:services|volumes|networks|secrets|configs)\.[^.]+$") & (F.col("key") != "<<")).withColumn("group", F.regexp_extract("path", r"^\.(\w+)\.", 1))
    table = F.create_map(*[F.lit(x) for k, (kind, kind_type) in COMPOSE.items() for x in (k, f"{kind} {kind_type}")])
    top = top.withColumn("told", F.split(F.element_at(table, F.col("group")), " ")).select("file", F.col("key").alias("name"), "line", "group", F.col("told")[0].alias("kind"), F.col("told")[1].alias("type"))
    one = lambda tail, name: rows.where(F.col("path").rlike(rf"^\.services\.[^.]+\.{tail}$")).select("file", F.lit("services").alias("group"), F.regexp_extract("path", r"^\.services\.([^.]+)", 1).alias("name"), F.col("value").alias(name))
    port = F.regexp_extract("value", r"(\d+)(?:-\d+)?(?:/\w+)?$", 1)
    keys = ("file", "name")
    ports = _listed(rows, r"^\.services\.([^.]+)\.ports\.(?:\[\]|\[\]\.target)$", 1, F.nullif(port, F.lit("")), keys).withColumnRenamed("found", "ports")
    names = F.when(F.col("key") == "[]", F.regexp_extract("value", r"^\s*([A-Za-z_]\w*)", 1)).otherwise(F.col("key"))
    variables = _listed(rows, r"^\.services\.([^.]+)\.environment\.[^.]+$", 1, names, keys).withColumnRenamed("found", "variables")
    met = top.join(unsent(one("image", "ref")), ["file", "group", "name"], "left").join(unsent(one(r"deploy\.replicas", "replicas")), ["file", "group", "name"], "left")
    served = lambda c: F.when(F.col("group") == "services", F.coalesce(c, F.array().cast("array<string>")))
    met = met.join(unsent(ports), list(keys), "left").join(unsent(variables), list(keys), "left")
    image, tag = image_parts(F.col("ref"))
    return _row(met, kind=F.col("kind"), type=F.col("type"), name=F.col("name"), file=F.col("file"), line=F.col("line"), image=image, tag=tag, ports=served("ports"), replicas=F.col("replicas"), variables=served("variables"))


def kubernetes_rows(paths: DataFrame) -> DataFrame:
    """Rows of manifests: workloads and jobs with replicas, an image for each container with its ports and names of variables, services, ingresses, configs and secrets by name."""
    rows = paths.where(F.col("file").rlike(r"(?i)\.ya?ml$"))
    at = lambda path, name: rows.where(F.col("path") == path).groupBy("file", "doc").agg(F.min_by("value", "line").alias(name), F.min("line").alias(f"{name}_line"))
    docs = at(".apiVersion", "api").join(unsent(at(".kind", "type")), ["file", "doc"]).join(unsent(at(".metadata.name", "name")), ["file", "doc"], "left").join(unsent(at(".spec.replicas", "replicas").drop("replicas_line")), ["file", "doc"], "left")
    table = F.create_map(*[F.lit(x) for kind, types in MANIFESTS.items() for t in types.split() for x in (t, kind)])
    docs = saved(docs.withColumn("kind", F.try_element_at(table, F.col("type"))).where("kind IS NOT NULL"))
    objects = _row(docs, kind=F.col("kind"), type=F.col("type"), name=F.col("name"), file=F.col("file"), line=F.col("type_line"), replicas=F.when(F.col("kind") == "workload", F.col("replicas")))
    # Containers are list items: their name, image, ports and variables have the item, or one of its keys, as parent.
    item = rows.where(F.col("path").rlike(r"\.(?:containers|initContainers)\.\[\]$")).select("file", "doc", F.col("node").alias("item"))
    item = item.join(unsent(docs.where("kind IN ('workload', 'job')").select("file", "doc")), ["file", "doc"], "left_semi")
    keys = rows.select("file", "doc", "node", F.col("parent").alias("item"), "line", F.col("key").alias("field"), "value")
    own = saved(item.join(unsent(keys), ["file", "doc", "item"]))
    value = lambda field, name: own.where(F.col("field") == field).select("file", "doc", "item", F.col("value").alias(name), F.col("line").alias(f"{name}_line"))
    below = rows.select("file", "doc", F.col("node").alias("entry"), F.col("parent").alias("node"))
    entries = own.where("field IN ('ports', 'env')").select("file", "doc", "item", "node", "field").join(unsent(below), ["file", "doc", "node"])
    leaves = rows.where("key IN ('containerPort', 'name')").select("file", "doc", F.col("parent").alias("entry"), "key", F.col("value").alias("v"))
    held = entries.join(unsent(leaves), ["file", "doc", "entry"]).groupBy("file", "doc", "item").agg(
        F.array_sort(F.collect_set(F.when((F.col("field") == "ports") & (F.col("key") == "containerPort"), F.col("v")))).alias("ports"), F.array_sort(F.collect_set(F.when((F.col("field") == "env") & (F.col("key") == "name"), F.col("v")))).alias("variables")
    )
    none = F.array().cast("array<string>")
    images = value("image", "ref").join(unsent(value("name", "name").drop("name_line")), ["file", "doc", "item"], "left").join(unsent(held), ["file", "doc", "item"], "left")
    image, tag = image_parts(F.col("ref"))
    containers = _row(images, kind=F.lit("image"), type=F.lit("container"), name=F.col("name"), file=F.col("file"), line=F.col("ref_line"), image=image, tag=tag, ports=F.coalesce("ports", none), variables=F.coalesce("variables", none))
    return objects.unionByName(containers)


def terraform_rows(files: DataFrame) -> DataFrame:
    """Rows of .tf files: resources and data sources, modules with the names of their inputs, providers, variables and outputs at the top level."""
    found = tokens(files.where(F.col("file").rlike(r"\.tf$")), "hash").where("kind <> 'comment'")
    order = Window.partitionBy("file").orderBy("i")
    ahead = lambda k: F.struct(F.lead("kind", k).over(order).alias("kind"), F.lead("token", k).over(order).alias("token"), F.lead("i", k).over(order).alias("i"))
    word = F.regexp_extract("token", rf"(?:^|\n)\s*({'|'.join(BLOCKS)})\s+$", 1)
    # What follows is looked up before the tokens are written, while each file is in one task, and kept behind a block's first word.
    first_word = F.when((F.col("level") == 0) & (F.col("kind") == "code"), F.nullif(word, F.lit("")))
    found = found.select("*", first_word.alias("word"), *[ahead(k).alias(f"t{k}") for k in range(1, 5)])
    found = saved(found.select("file", "kind", "token", "line", "parent", "word", F.when(F.col("word").isNotNull(), F.struct("t1", "t2", "t3", "t4")).alias("t")))
    heads = found.where("word IS NOT NULL AND t.t1.kind = 'string'").select("*", "t.*")
    heads = heads.withColumn("line", (F.col("line") + F.length("token") - F.length(F.translate("token", "\n", ""))).cast("int"))
    first, second = F.trim("t1.token", F.lit('"')), F.when(F.col("t3.kind") == "string", F.trim("t3.token", F.lit('"')))
    two = F.col("word").isin("resource", "data")
    # The opening brace is the next but one token after the last name.
    body = F.when(two, F.lit(None).cast("int")).when(F.col("t2.token") == "{", F.col("t2.i")).otherwise(F.col("t3.i"))
    table = F.create_map(*[F.lit(x) for pair in BLOCKS.items() for x in pair])
    rows = heads.where(~two | second.isNotNull()).select(
        F.element_at(table, F.col("word")).alias("kind"), F.when(F.col("word") == "data", F.concat(F.lit("data."), first)).when(two, first).otherwise(F.col("word")).alias("type"), F.when(two, second).otherwise(first).alias("name"), "file", "line", "word", body.alias("call")
    )
    inside = found.where("kind IN ('code')").select("file", F.col("parent").alias("call"), F.explode(F.regexp_extract_all("token", F.lit(r"(?m)(?:^|\n)[ \t]*([A-Za-z_][\w-]*)[ \t]*=(?!=)"), F.lit(1))).alias("input"))
    inputs = inside.where(~F.col("input").isin("source", "version", "providers", "count", "for_each", "depends_on")).groupBy("file", "call").agg(F.array_sort(F.collect_set("input")).alias("variables"))
    rows = rows.join(unsent(inputs), ["file", "call"], "left")
    return _row(rows, kind=F.col("kind"), type=F.col("type"), name=F.col("name"), file=F.col("file"), line=F.col("line"), variables=F.when(F.col("word") == "module", F.coalesce("variables", F.array().cast("array<string>"))))


def infra_rows(files: DataFrame) -> DataFrame:
    """kind, type, name, file, line, image, tag, ports, replicas, variables of compose files, Kubernetes manifests and Terraform. ``files``: file, text."""
    paths = saved(yaml_paths(files.where(F.col("file").rlike(r"(?i)\.ya?ml$"))))
    return reduce(DataFrame.unionByName, [compose_rows(paths), kubernetes_rows(paths), terraform_rows(files)])
