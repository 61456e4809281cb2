"""Queries over source code: functions, signals with values and composed routes, in files written from the tables."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import entries, imports, infra, lock_files, registries, routes, shown_text, signals, source_code
from weft.operators.tables import shared_folder
from weft.plans.registry import query
from weft.sources import adapters


def _files(spark: SparkSession, sf_dir: str, table: str, file: str, text: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(file).alias("file"), F.expr(text).alias("text"))


@query(
    """WITH p AS (SELECT p_partkey, p_size % 5 + 1 AS d FROM part), f AS (SELECT p_partkey, d, unnest(range(1, d + 1)) AS j FROM p)
    SELECT 'src/p' || p_partkey || '.js' AS file, CAST(2 * j - 1 AS INT) AS start, CAST(2 * d + 2 * (d - j + 1) AS INT) AS "end", CAST(1 + 2 * (d - j + 1) AS BIGINT) AS complexity FROM f"""
)
def brace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions inside functions, with braces in comments and strings, as deep as the part's size says."""
    text = r"""concat(array_join(transform(sequence(1, p_size % 5 + 1), j -> concat('function f', j, '(a) { // function no() {\n if (a || "}") {\n')), ''), repeat(' }\n}\n', p_size % 5 + 1))"""
    return source_code.functions_in(source_code.tokens(_files(spark, sf_dir, "part", "concat('src/p', p_partkey, '.js')", text)))


@query(
    """WITH p AS (SELECT 'src/p' || p_partkey || '.py' AS file, p_partkey AS k, p_size AS z FROM part)
    SELECT family, signal, field, value, via, file, CAST(line AS INT) AS line FROM (
      SELECT file, 'pagination' AS family, 'page' AS signal, 'page' AS field, CAST(z AS VARCHAR) AS value, 'fastapi' AS via, 1 AS line FROM p
      UNION ALL SELECT file, 'validation', 'min', 'page', '1', 'pydantic', 1 FROM p
      UNION ALL SELECT file, 'search', 'contains', 'name', NULL, 'django', 2 FROM p UNION ALL SELECT file, 'search', 'caseInsensitive', 'name', NULL, 'django', 2 FROM p
      UNION ALL SELECT file, 'sort', 'orderBy', 'c' || k % 4, CASE WHEN k % 2 = 0 THEN 'desc' ELSE 'asc' END, 'django', 2 FROM p
      UNION ALL SELECT file, 'pagination', 'pageSize', NULL, CAST(k % 90 + 1 AS VARCHAR), 'django', 5 FROM p
      UNION ALL SELECT file, 'filter', 'param', 'token', NULL, 'query', 6 FROM p)"""
)
def python_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of Python calls with fields and values; those in comments and strings are none, and a token has no value."""
    text = r"""concat('def f(page: int = Query(', p_size, ', ge=1)):\n    x = T.objects.filter(name__icontains=q).order_by("', if(p_partkey % 2 = 0, '-', ''), 'c', p_partkey % 4, '")\n',
        '    # y = T.objects.filter(a__in=b)\n    s = "Paginator(x, 9)"\n    p = Paginator(x, ', p_partkey % 90 + 1, ')\n    k = request.args.get("token", 12)\n')"""
    return signals.signals(_files(spark, sf_dir, "part", "concat('src/p', p_partkey, '.py')", text), "hash")


@query(
    """WITH p AS (SELECT 'src/p' || p_partkey || '.ts' AS file, p_partkey AS k, p_size AS z FROM part)
    SELECT family, signal, field, value, via, file, CAST(line AS INT) AS line FROM (
      SELECT file, 'validation' AS family, 'min' AS signal, 'name' AS field, CAST(z AS VARCHAR) AS value, 'schema' AS via, 1 AS line FROM p UNION ALL SELECT file, 'validation', 'email', 'mail', NULL, 'schema', 1 FROM p
      UNION ALL SELECT file, 'search', 'contains', 'title', NULL, 'prisma', 2 FROM p UNION ALL SELECT file, 'sort', 'orderBy', 'at', CASE WHEN k % 2 = 0 THEN 'desc' ELSE 'asc' END, 'prisma', 2 FROM p
      UNION ALL SELECT file, 'pagination', 'limit', NULL, CAST(k AS VARCHAR), 'prisma', 2 FROM p UNION ALL SELECT file, 'trigger', 'debounce', NULL, CAST(z * 10 AS VARCHAR), 'javascript', 3 FROM p)"""
)
def script_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of TypeScript calls and nested objects with fields and values."""
    text = r"""concat('const s = z.object({ name: z.string().min(', p_size, '), mail: z.string().email() });\nawait db.order.findMany({ where: { title: { contains: q } }, orderBy: { at: "', if(p_partkey % 2 = 0, 'desc', 'asc'), '" }, take: ', p_partkey, ' });\n',
        'useDebounce(v, ', p_size * 10, '); // debounce(v, 1)\nconst t = `cron.schedule("* * * * *", f)`;\n')"""
    return signals.signals(_files(spark, sf_dir, "part", "concat('src/p', p_partkey, '.ts')", text), "brace")


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS c, s_suppkey // 3 AS p, '/p' || s_suppkey % 4 || '/s' || s_suppkey % 7 AS step FROM supplier WHERE s_suppkey > 2
        UNION ALL SELECT s_suppkey, s_suppkey // 3, '/s' || s_suppkey % 7 FROM supplier WHERE s_suppkey > 2 AND s_suppkey % 5 = 0),
    r AS (SELECT s_suppkey AS k, '/s' || s_suppkey % 7 AS label FROM supplier WHERE s_suppkey <= 2 UNION ALL SELECT c, label || step FROM r JOIN e ON e.p = r.k)
    SELECT DISTINCT 'GET' AS method, label || '/i' || k % 3 || '/{id}' AS route, 'pkg/m' || k || '.py' AS file, CAST(3 AS INT) AS line FROM r"""
)
def fastapi_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router for each supplier, included by that of a third of its number, every fifth a second time without a prefix."""
    include = r"""concat('router.include_router(m', c, '.router, prefix="/p', c % 4, '")\n', if(c % 5 = 0, concat('router.include_router(\n  m', c, '.router,  # again\n)\n'), ''))"""
    text = rf"""concat('router = APIRouter(prefix="/s', s_suppkey % 7, '", dependencies=[Depends(user)])\n# router.include_router(m1.router)\n@router.get("/i', s_suppkey % 3, '/{{id}}")\ndef f(): pass\n',
        array_join(transform(filter(sequence(s_suppkey * 3, s_suppkey * 3 + 2), c -> c > 2), c -> {include}), ''))"""
    return routes.fastapi_routes(_files(spark, sf_dir, "supplier", "concat('pkg/m', s_suppkey, '.py')", text))


@query(
    """WITH RECURSIVE r AS (SELECT s_suppkey AS k, '/' AS label FROM supplier WHERE s_suppkey <= 2 UNION ALL SELECT s_suppkey, label || 'a' || s_suppkey % 6 || '/' FROM r JOIN supplier ON s_suppkey // 3 = k AND s_suppkey > 2)
    SELECT 'ANY' AS method, label || '<int:pk>/' AS route, 'site/a' || k || '/urls.py' AS file, CAST(2 AS INT) AS line FROM r UNION ALL SELECT 'ANY', label || 'list', 'site/a' || k || '/urls.py', 3 FROM r"""
)
def django_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A urls module for each supplier, included by that of a third of its number."""
    text = r"""concat('urlpatterns = [\n  path("<int:pk>/", v.detail),  # path("no", v)\n  re_path(r"^list$", v.list),\n', array_join(transform(filter(sequence(s_suppkey * 3, s_suppkey * 3 + 2), c -> c > 2),
        c -> if(c % 2 = 0, concat('  path("a', c % 6, '/", include("a', c, '.urls")),\n'), concat('  path("a', c % 6, '/", include(("a', c, '.urls", "x"))),\n'))), ''), ']\n')"""
    return routes.django_routes(_files(spark, sf_dir, "supplier", "concat('site/a', s_suppkey, '/urls.py')", text))


@query(
    """WITH p AS (SELECT 'src/C' || p_partkey || '.java' AS file, p_partkey AS k, unnest(CASE p_partkey % 3 WHEN 0 THEN ['/b' || p_size] WHEN 1 THEN ['/x', '/y' || p_size] ELSE [''] END) AS b FROM part)
    SELECT method, route, file, CAST(line AS INT) AS line FROM (
      SELECT 'GET' AS method, b || '/one/{id}' AS route, file, 4 AS line FROM p UNION ALL SELECT 'POST', CASE WHEN b = '' THEN '/' ELSE b END, file, 6 FROM p
      UNION ALL SELECT 'PUT', b || '/r' || k % 9, file, 8 FROM p UNION ALL SELECT DISTINCT 'GET', '/nested', file, 11 FROM p)"""
)
def spring_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A controller for each part: one path, several or none at its class, and a class inside it."""
    own = r"""CASE p_partkey % 3 WHEN 0 THEN concat('@RequestMapping("/b', p_size, '")') WHEN 1 THEN concat('@RequestMapping(path = {"/x", "/y', p_size, '"})') ELSE '// @RequestMapping("/no")' END"""
    text = rf"""concat('@RestController\n', {own}, '\npublic class C {{\n  @GetMapping("/one/{{id}}")\n  int a() {{ return 1; }}\n  @PostMapping\n  public void b() {{}}\n  @RequestMapping(value = "/r', p_partkey % 9, '", method = RequestMethod.PUT)\n  void c() {{}}\n',
        '  static class N {{\n    @GetMapping("/nested") int d() {{ return 2; }}\n  }}\n}}\n')"""
    return routes.spring_routes(_files(spark, sf_dir, "part", "concat('src/C', p_partkey, '.java')", text))


@query(
    """WITH p AS (SELECT 'a' || p_partkey || '/config/routes.rb' AS file, p_partkey AS k, p_size % 4 AS d FROM part), n AS (SELECT file, k, d, array_to_string(list_transform(range(1, d + 1), lambda j: '/n' || j), '') AS base FROM p)
    SELECT method, route, file, CAST(line AS INT) AS line FROM (
      SELECT 'GET' AS method, base || '/orders' AS route, file, d + 2 AS line FROM n UNION ALL SELECT 'GET', base || '/orders/:id', file, d + 2 FROM n
      UNION ALL SELECT 'POST', base || '/orders/:id/cancel', file, d + 4 FROM n UNION ALL SELECT 'GET', base || '/orders/:order_id/lines/:id', file, d + 6 FROM n UNION ALL SELECT 'DELETE', base || '/orders/:order_id/lines/:id', file, d + 6 FROM n
      UNION ALL SELECT 'GET', base || '/orders/late', file, d + 7 FROM n UNION ALL SELECT 'GET', base || '/ping' || k % 5, file, d + 9 FROM n)"""
)
def rails_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes for each part, under as many namespaces as its size says."""
    text = r"""concat('Rails.application.routes.draw do\n', array_join(transform(filter(sequence(1, 4), j -> j <= p_size % 4), j -> concat('namespace :n', j, ' do\n')), ''),
        'resources :orders, only: [:index, :show] do\n  member do\n    post "cancel"\n  end\n  resources :lines, only: %i[show destroy]\n  get :late, on: :collection # get "no"\nend\nget "ping', p_partkey % 5, '", to: "a#b"\n', repeat('end\n', p_size % 4), 'end\n')"""
    return routes.rails_routes(_files(spark, sf_dir, "part", "concat('a', p_partkey, '/config/routes.rb')", text))


#: A lock of each supplier: a chain of packages as deep as its number says, every second of which has its own copy of x.
LOCK = r"""concat('{"lockfileVersion":3,"packages":{"":{"dependencies":{"p0":"*"}},"node_modules/x":{"version":"1.', s_suppkey, '"}', array_join(transform(sequence(0, s_suppkey % 4), i -> concat(
    ',"node_modules/p', i, '":{"version":"1.0.', i, '","dependencies":{"x":"*"', if(i < s_suppkey % 4, concat(',"p', i + 1, '":"*"'), ''), '}}', if(i % 2 = 0, concat(',"node_modules/p', i, '/node_modules/x":{"version":"2.', i, '"}'), ''))), ''), '}}')"""
CHAIN = "WITH s AS (SELECT 'a' || s_suppkey || '/package-lock.json' AS manifest, s_suppkey AS k, s_suppkey % 4 AS d FROM supplier), p AS (SELECT manifest, k, d, unnest(range(0, d + 1)) AS i FROM s)"


def _locks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return lock_files.locked_packages(_files(spark, sf_dir, "supplier", "concat('a', s_suppkey, '/package-lock.json')", LOCK))


@query(
    CHAIN
    + """ SELECT manifest, 'npm' AS ecosystem, key, name, version, false AS dev, direct FROM (
      SELECT manifest, 'node_modules/p' || i AS key, 'p' || i AS name, '1.0.' || i AS version, i = 0 AS direct FROM p UNION ALL SELECT manifest, 'node_modules/x', 'x', '1.' || k, false FROM s
      UNION ALL SELECT manifest, 'node_modules/p' || i || '/node_modules/x', 'x', '2.' || i, false FROM p WHERE i % 2 = 0)"""
)
def locked_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locks(spark, sf_dir)[0]


@query(
    CHAIN
    + """ SELECT manifest, 'node_modules/p' || i AS src, 'node_modules/p' || (i + 1) AS dst FROM p WHERE i < d
    UNION ALL SELECT manifest, 'node_modules/p' || i, CASE WHEN i % 2 = 0 THEN 'node_modules/p' || i || '/node_modules/x' ELSE 'node_modules/x' END FROM p"""
)
def locked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locks(spark, sf_dir)[1]


@query(
    CHAIN
    + """ SELECT manifest, 'p' || i AS name, list_transform(range(0, i), lambda j: 'p' || j) AS via FROM p WHERE i > 0 UNION ALL SELECT manifest, 'x', ['p0'] FROM s"""
)
def locked_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lock_files.via_chains(*_locks(spark, sf_dir))


@query(
    """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END AS n FROM part), e AS (SELECT k, n FROM p WHERE n IN (SELECT k FROM p))
    SELECT 'src/m' || k || '/index.ts' AS src, 'src/m' || n || '/index.ts' AS dst FROM e UNION ALL SELECT 'app/q' || k || '.py', 'app/q' || n || '.py' FROM e"""
)
def project_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of each part that import the next one of a ring of five, through an alias, a package and an index file."""
    after = "if(p_partkey % 5 = 4, p_partkey - 4, p_partkey + 1)"
    script = _files(spark, sf_dir, "part", "concat('src/m', p_partkey, '/index.ts')", rf"""concat('import React from "react"\nimport {{ a }} from "~/m', {after}, '"\n// import b from "~/m1"\nconst s = "from \'~/m1\'"\n')""")
    module = _files(spark, sf_dir, "part", "concat('app/q', p_partkey, '.py')", rf"""concat('import os\nfrom app import (  # names\n  q', {after}, ' as n,\n)\n', repeat('"', 3), '\nimport q1\n', repeat('"', 3), '\n')""")
    return imports.resolved_imports(script.unionByName(module), spark.createDataFrame([("~/", "src")], "prefix string, target string"))


@query(
    """WITH s AS (SELECT 's' || s_suppkey || '/docker-compose.yml' AS file, s_suppkey AS k FROM supplier)
    SELECT kind, type, name, file, CAST(line AS INT) AS line, image, tag, ports, replicas, variables FROM (
      SELECT 'workload' AS kind, 'compose-service' AS type, 'web' AS name, file, 3 AS line, 'r.io:5000/web' AS image, '1.' || k AS tag, ['80', CAST(9000 + k % 7 AS VARCHAR)] AS ports, CAST(k % 4 AS VARCHAR) AS replicas, ['KEY', 'MODE'] AS variables FROM s
      UNION ALL SELECT 'workload', 'compose-service', 'db' || k % 3, file, 14, NULL, NULL, [], NULL, ['PASS'] FROM s UNION ALL SELECT 'volume', 'compose-volume', 'data', file, 19, NULL, NULL, NULL, NULL, NULL FROM s)"""
)
def compose_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and volumes of a compose file of each supplier."""
    text = r"""concat('# services\nservices:\n  web:\n    image: "r.io:5000/web:1.', s_suppkey, '"  # pinned\n    ports:\n      - "8080:80"\n      - target: ', 9000 + s_suppkey % 7, '\n    environment:\n    - KEY=x\n    - MODE\n    deploy:\n      replicas: ', s_suppkey % 4,
        '\n\n  db', s_suppkey % 3, ':\n    build: .\n    environment:\n      PASS: "image: no"\nvolumes:\n  data:\n    driver: local\n')"""
    return infra.compose_rows(infra.yaml_paths(_files(spark, sf_dir, "supplier", "concat('s', s_suppkey, '/docker-compose.yml')", text)))


@query(
    """WITH s AS (SELECT 'k/' || s_suppkey || '.yaml' AS file, s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' ELSE 'CronJob' END AS type FROM supplier)
    SELECT kind, type, name, file, CAST(line AS INT) AS line, image, tag, ports, replicas, variables FROM (
      SELECT CASE WHEN type = 'CronJob' THEN 'job' ELSE 'workload' END AS kind, type, 'w' || k AS name, file, 2 AS line, NULL AS image, NULL AS tag, NULL::VARCHAR[] AS ports, CASE WHEN type <> 'CronJob' THEN CAST(k % 5 AS VARCHAR) END AS replicas, NULL::VARCHAR[] AS variables FROM s
      UNION ALL SELECT 'image', 'container', 'app', file, 11, 'app', '2.' || k, [CAST(8000 + k % 9 AS VARCHAR)], NULL, ['TOKEN'] FROM s UNION ALL SELECT 'secret', 'Secret', 'key' || k, file, 20, NULL, NULL, NULL, NULL, NULL FROM s)"""
)
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workloads, their images and secrets of manifests of each supplier."""
    text = r"""concat('apiVersion: v1\nkind: ', CASE s_suppkey % 3 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'StatefulSet' ELSE 'CronJob' END, '\nmetadata:\n  name: w', s_suppkey, '\nspec:\n  replicas: ', s_suppkey % 5,
        '\n  template:\n    spec:\n      containers:\n      - name: app\n        image: app:2.', s_suppkey, '\n        ports:\n        - containerPort: ', 8000 + s_suppkey % 9, '\n        env:\n        - name: TOKEN\n          value: "x"\n---\n# a secret\napiVersion: v1\nkind: Secret\nmetadata: # named\n  name: key', s_suppkey, '\ndata:\n  kind: Service\n')"""
    return infra.kubernetes_rows(infra.yaml_paths(_files(spark, sf_dir, "supplier", "concat('k/', s_suppkey, '.yaml')", text)))


@query(
    """WITH p AS (SELECT 'm' || p_partkey || '/main.tf' AS file, p_partkey AS k FROM part)
    SELECT kind, type, name, file, CAST(line AS INT) AS line, NULL AS image, NULL AS tag, NULL::VARCHAR[] AS ports, NULL AS replicas, variables FROM (
      SELECT 'resource' AS kind, 'aws_b' || k % 5 AS type, 'r' || k AS name, file, 2 AS line, NULL AS variables FROM p UNION ALL SELECT 'resource', 'data.aws_ami', 'img', file, 6, NULL FROM p
      UNION ALL SELECT 'module', 'module', 'net', file, 7, ['cidr', 'zone' || k % 3] FROM p UNION ALL SELECT 'variable', 'variable', 'v' || k, file, 12, NULL FROM p)"""
)
def terraform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a Terraform file of each part."""
    text = r"""concat('# resource "aws_no" "no" {}\nresource "aws_b', p_partkey % 5, '" "r', p_partkey, '" {\n  bucket = "resource {"\n  tags = { a = 1 }\n}\ndata "aws_ami" "img" {}\nmodule "net" {\n  source = "./net"\n  cidr = "10.0.0.0/8"\n  zone', p_partkey % 3, ' = ["a"]\n}\nvariable "v', p_partkey, '" {}\n')"""
    return infra.terraform_rows(_files(spark, sf_dir, "part", "concat('m', p_partkey, '/main.tf')", text))


def _spans_of(part: str, options: dict, wanted: dict) -> list[tuple]:
    """The spans of one file; only those of the events that are asked for are read in full."""
    rows = (json.loads(line) for line in Path(part).read_text(encoding="utf-8").splitlines())
    return [(r["event"], r["kind"], r["user"]) for r in rows if "kind" not in wanted or r["kind"] in wanted["kind"]]


#: A project's own log format, read file by file; a query's choice of kinds reaches the reader.
SPAN_ADAPTER = adapters.Adapter("weft_spans", "event long, kind string, user long", lambda options: sorted(str(p) for p in Path(options["path"]).rglob("part-*")), _spans_of, ("kind",))


@query("SELECT event_id AS event, event_type AS kind, user_id AS user FROM events WHERE event_type IN ('click', 'purchase')")
def adapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, written as a project's log below the shared folder and read through its adapter, with two kinds asked for."""
    path = f"{shared_folder(spark).removeprefix('file://')}/spans-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("event"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")).write.json(path)
    adapters.register_adapter(spark, SPAN_ADAPTER)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("weft_spans").option("path", path).load().where(F.col("kind").isin("click", "purchase"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_brand, p_size FROM part)
    SELECT name, id, CASE WHEN id = 'GET /brand/Brand#11' THEN 'The first' ELSE coalesce(label, id) END AS label FROM (
      SELECT DISTINCT 'api' AS name, 'GET /brand/' || p_brand AS id, 'Parts of ' || p_brand AS label FROM p UNION SELECT 'pages', '/shop/p' || k || '/[id]', NULL FROM p UNION SELECT 'docs', 'docs/' || k || '.md', 'Part ' || p_size FROM p
      UNION SELECT 'words', 'w' || k, 'Word ' || k FROM p)"""
)
def inventory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories of files of each part: operations, pages, documents and messages, with an alias."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    each = lambda file, text: part.select(F.expr(file).alias("file"), F.expr(text).alias("text"))
    files = each("concat(p_partkey, '/openapi.json')", """concat('{"paths": {"/brand/', p_brand, '": {"get": {"summary": "Parts of ', p_brand, '"}, "x": {}}}}')""")
    files = files.unionByName(each("concat('web/app/(g)/shop/p', p_partkey, '/[id]/page.tsx')", "''")).unionByName(each("concat('docs/', p_partkey, '.md')", r"concat('text\n# Part ', p_size, '\n')"))
    files = files.unionByName(each("concat('m', p_partkey, '/en.json')", """concat('{"menu": {"w', p_partkey, '": {"label": "Word ', p_partkey, '"}}}')"""))
    settings = [("api", "openapi", "", "openapi.json"), ("pages", "next-app-router", "", "page.tsx"), ("docs", "glob", "docs/*.md", ".md"), ("words", "i18n-registry", "menu", "en.json")]
    return adapters.inventories(spark.createDataFrame(settings, "name string, kind string, setting string, suffix string"), files, spark.createDataFrame([("GET /brand/Brand#11", "The first")], "id string, label string"))


SHOWN_HTML = r"""concat('<p title="t">Part <b>', p_partkey, '</b>&amp;<i>x</i>  y</p><script>if (a<b) "</p>"</script>')"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_text.shown_pieces(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(SHOWN_HTML).alias("html")), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT p_partkey, chr(10) || 'Part ' || k || '&x y' || repeat(chr(10), 4) || 't' AS text, [6::BIGINT, 6 + length(k), 7 + length(k), 8 + length(k)] AS breaks FROM p""")
def shown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a page of each part shows, and where its words may end."""
    return shown_text.shown_texts(_pieces(spark, sf_dir), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, length(CAST(p_partkey AS VARCHAR)) AS n FROM part)
    SELECT p_partkey, CAST(5 + n AS BIGINT) AS "at", CAST(20 + n AS BIGINT) AS html_at FROM p UNION ALL SELECT p_partkey, 6 + n, 25 + n FROM p UNION ALL SELECT p_partkey, 8 + n, 38 + n FROM p""")
def shown_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the shown text in the html: the last digit of a number, a reference, a blank."""
    n = F.length(F.col("p_partkey").cast("string"))
    places = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.explode(F.array(*[(n + k).cast("long") for k in (5, 6, 8)])).alias("at"))
    return shown_text.html_places(_pieces(spark, sf_dir), places, "p_partkey")


@query("""WITH s AS (SELECT s_suppkey AS k, 'f' || s_suppkey || '/web/package.json' AS manifest, 'f' || s_suppkey || '/.npmrc' AS file FROM supplier)
    SELECT manifest, 'npm' AS ecosystem, '' AS scope, 'npm' || k || '.corp.example' AS host, file, CAST(2 AS INT) AS line FROM s UNION ALL SELECT manifest, 'npm', '@a', 'a.corp.example', file, 3 FROM s WHERE k % 2 = 1""")
def private_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries of each supplier's package; every second folder lifts the scope of the one above it."""
    upper = _files(spark, sf_dir, "supplier", "concat('f', s_suppkey, '/.npmrc')", r"concat('; mine\nregistry=https://u:p@npm', s_suppkey, '.corp.example/\n@a:registry=https://a.corp.example:8443/x\n')")
    lower = _files(spark, sf_dir, "supplier", "concat('f', s_suppkey, '/web/.npmrc')", "if(s_suppkey % 2 = 0, '@a:registry=https://registry.npmjs.org/', '# none')")
    manifests = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr("concat('f', s_suppkey, '/web/package.json')").alias("manifest"), F.lit("npm").alias("ecosystem"))
    return registries.private_registries(manifests, registries.registry_settings(upper.unionByName(lower)))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size AS z FROM part)
    SELECT id, 'steps[0].action' AS path, 'choice' AS problem FROM p WHERE id % 3 = 1 UNION ALL SELECT id, 'steps[1].to.x', 'missing' FROM p WHERE id % 4 = 2 UNION ALL SELECT id, 'width', 'kind' FROM p WHERE z % 5 = 0
    UNION ALL SELECT id, 'more' || z % 3, 'unknown' FROM p WHERE z % 7 = 3"""
)
def entry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of each part held against a nested schema."""
    text = r"""concat('{"title": "p', p_partkey, '", "width": ', if(p_size % 5 = 0, concat('"', p_size, '"'), cast(p_size AS string)), if(p_size % 7 = 3, concat(', "more', p_size % 3, '": {"a": [1]}'), ''), ', "steps": [{"action": "', if(p_partkey % 3 = 1, 'jump', 'click'),
        '"}, {"action": "fill", "to": {', if(p_partkey % 4 = 2, '', '"x": 1.5'), '}}]}')"""
    schema = [("", "object", True, None), ("title", "string", True, None), ("width", "number", False, None), ("steps", "array", True, None), ("steps[]", "object", False, None), ("steps[].action", "string", True, ["click", "fill"]), ("steps[].to", "object", False, None), ("steps[].to.x", "number", True, None)]
    plans = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr(text).alias("text"))
    return entries.entry_errors(plans, spark.createDataFrame(schema, "pattern string, kind string, required boolean, choices array<string>"))
