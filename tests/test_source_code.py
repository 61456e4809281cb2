"""Tokens, functions, calls, signals and composed routes on planted sources, with nulls, empty files and unclosed brackets."""

from pyspark.sql import functions as F

from weft.operators import graph, routes, signals, source_code
from conftest import rows

FILES = "file string, text string"
JS = """// function no() {
function a(x, y) {
  if (x && y) { return "} function z() {"; }
  const f = async (q) => {
    for (const i of q) { g(i); }
  };
  return /[{(]/.test(x) ? 1 : 2;
}
class K {
  async run({ a, b }): Promise<void> { while (a?.b ?? c) {} }
  get v() { return `}${1}` }
}
describe("x", function () { it(); });
const o = function* gen() {
"""
JAVA = "class A extends B {\n  @GetMapping(\"/x\")\n  public int f(List<String> a) throws IOException {\n    try (var r = open()) { if (a) {} } catch (E e) {}\n    Runnable r = new Runnable() { public void run() { } };\n  }\n}\n"
GO = "package p\nfunc (r *T) Name(a int) (int, error) {\n  if x := f(a); x > 0 && y {\n    return 1\n  }\n  go func() { g() }()\n}\nfunc Plain() error { return nil }\n"


def test_tokens_are_the_whole_text_and_match_their_brackets(spark):
    files = spark.createDataFrame([("a.js", JS), ("A.java", JAVA), ("m.go", GO), ("n.js", None), ("e.js", ""), ("u.js", ")}(["), ("l.js", "/*" + "*x" * 40000 + '*/"' + "\\\\a" * 40000)], FILES)
    found = source_code.tokens(files)
    texts = {r.file: r.text for r in found.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "token"))).getField("token"), "").alias("text")).collect()}
    assert texts == {r.file: r.text for r in files.collect() if r.text}
    unclosed = found.where("file = 'u.js' AND kind = 'open'").select("token", "close", "level").orderBy("i")
    assert [tuple(r) for r in unclosed.collect()] == [("(", None, -2), ("[", None, -1)]


def test_functions_of_brace_languages(spark):
    files = spark.createDataFrame([("a.js", JS), ("A.java", JAVA), ("m.go", GO), ("n.js", None), ("e.js", "")], FILES)
    assert rows(source_code.functions_in(source_code.tokens(files))) == [
        ("A.java", 3, 6, 3),
        ("A.java", 5, 5, 1),
        ("a.js", 10, 10, 3),  # the second mark of ?? counts
        ("a.js", 11, 11, 1),
        ("a.js", 13, 13, 1),
        ("a.js", 14, 15, 1),
        ("a.js", 2, 8, 5),
        ("a.js", 4, 6, 2),
        ("m.go", 2, 7, 3),
        ("m.go", 6, 6, 1),
        ("m.go", 8, 8, 1),
    ]
    assert source_code.functions_in(source_code.tokens(files.where("false"))).isEmpty()


def test_arguments(spark):
    text = 'router = APIRouter(prefix="/o", deps=[Depends(auth)])  # APIRouter(no)\nf("a, b", x(1, 2), key = \'v\', """doc, s""")'
    found = source_code.tokens(spark.createDataFrame([("a.py", text)], FILES), "hash")
    named = source_code.calls(found).select("file", "call", "name").join(source_code.arguments(found), ["file", "call"])
    assert rows(named.select("name", "n", "key", "value", "text")) == sorted(
        [
            ("APIRouter", 0, "prefix", "/o", 'prefix="/o"'),
            ("APIRouter", 1, "deps", None, "deps=[]"),
            ("Depends", 0, None, None, "auth"),
            ("f", 0, None, "a, b", '"a, b"'),
            ("f", 1, None, None, "x()"),
            ("f", 2, "key", "v", "key = 'v'"),
            ("f", 3, None, None, '"""doc, s"""'),
            ("x", 0, None, None, "1"),
            ("x", 1, None, None, "2"),
        ],
        key=repr,
    )


def test_signals_have_fields_and_values(spark):
    py = """def f(page: int = Query(1, ge=1), q: str = Query(None, max_length=80)):
    x = Order.objects.filter(name__icontains=q, price__gte=3).order_by("-created", "name")[:9]
    # y = z.filter(a__in=b)
    s = "Paginator(x, 9)"
    User.email.ilike(f"%{q}%"); db.query(X).limit(20).offset(n)
    token = request.args.get("token", 12)
"""
    got = rows(signals.signals(spark.createDataFrame([("a.py", py), ("b.py", None)], FILES), "hash").select("line", "family", "signal", "field", "value", "via"))
    assert got == sorted(
        [
            (1, "pagination", "page", "page", "1", "fastapi"),
            (1, "search", "param", "q", None, "fastapi"),
            (1, "validation", "min", "page", "1", "pydantic"),
            (1, "validation", "max", "q", "80", "pydantic"),
            (2, "search", "contains", "name", None, "django"),
            (2, "search", "caseInsensitive", "name", None, "django"),
            (2, "filter", "range", "price", "3", "django"),
            (2, "sort", "orderBy", "created", "desc", "django"),
            (2, "sort", "orderBy", "name", "asc", "django"),
            (5, "search", "contains", "email", None, "sqlalchemy"),
            (5, "search", "caseInsensitive", "email", None, "sqlalchemy"),
            (5, "pagination", "limit", None, "20", "python"),
            (5, "pagination", "offset", None, None, "python"),
            (6, "filter", "param", "token", None, "query"),
        ],
        key=repr,
    )
    ts = 'const s = z.object({ name: z.string().min(3).max(20) });\nawait p.o.findMany({ where: { t: { contains: q } }, orderBy: { at: "desc" }, take: 10 });\nuseDebounce(v, 300); // debounce(v, 1)\ncron.schedule("*/5 * * * *", run);\nclass D { @Min(5) age: number }\n'
    got = rows(signals.signals(spark.createDataFrame([("a.ts", ts)], FILES), "brace").select("line", "family", "signal", "field", "value"))
    assert got == sorted(
        [
            (1, "validation", "min", "name", "3"),
            (1, "validation", "max", "name", "20"),
            (2, "search", "contains", "t", None),
            (2, "sort", "orderBy", "at", "desc"),
            (2, "pagination", "limit", None, "10"),
            (3, "trigger", "debounce", None, "300"),
            (4, "schedule", "cron", None, "*/5 * * * *"),
            (5, "validation", "min", None, "5"),
        ],
        key=repr,
    )


def test_composed_routes(spark):
    fastapi = [
        ("main.py", 'app = FastAPI()\napi = APIRouter(prefix="/api")\napp.include_router(api, prefix="/v1")\napi.include_router(orders.router, prefix="/shop")\napp.include_router(orders.router)\n# app.include_router(orders.router, prefix="/no")\n@app.get("/health")\ndef h(): pass\n'),
        ("api/orders.py", 'router = APIRouter(\n  prefix="/orders",  # c\n  dependencies=[Depends(auth)])\nrouter.include_router(router, prefix="/loop")\n@router.get("/{id}")\ndef one(): ...\n@router.websocket("/ws")\ndef ws(): ...\n'),
        ("none.py", None),
    ]
    got = rows(routes.fastapi_routes(spark.createDataFrame(fastapi, FILES)).select("method", "route", "line"))
    # orders is its own root no longer: it includes itself, and nothing else may be its root.
    assert got == sorted([("GET", "/health", 7), ("GET", "/orders/{id}", 5), ("WS", "/orders/ws", 7), ("GET", "/v1/api/shop/orders/{id}", 5), ("WS", "/v1/api/shop/orders/ws", 7)], key=repr)
    django = [("site/urls.py", 'urlpatterns = [\n path("shop/", include("orders.urls")),\n path("x/", include(("orders.urls", "o"))),\n re_path(r"^about/$", v.a),\n]\n'), ("orders/urls.py", 'urlpatterns = [path("<int:pk>/", v.d), # path("no", v)\n path("", v.l)]')]
    assert rows(routes.django_routes(spark.createDataFrame(django, FILES)).select("route", "line")) == sorted([("/about/", 4), ("/shop/", 2), ("/shop/<int:pk>/", 1), ("/x/", 2), ("/x/<int:pk>/", 1)], key=repr)
    spring = '@RestController\n@RequestMapping({"/a", "/b"})\npublic class A {\n  @Autowired\n  private X x;\n  @GetMapping("/x")\n  int f() { return 1; }\n  @PostMapping\n  void p() {}\n  // @GetMapping("/no")\n  @DeleteMapping(path = {"/d"}) void d() {}\n  static class N {\n    @RequestMapping("/n") int n() { return 2; }\n  }\n}\n'
    assert rows(routes.spring_routes(spark.createDataFrame([("A.java", spring)], FILES)).select("method", "route", "line")) == sorted(
        [("ANY", "/n", 13), ("DELETE", "/a/d", 11), ("DELETE", "/b/d", 11), ("GET", "/a/x", 6), ("GET", "/b/x", 6), ("POST", "/a", 8), ("POST", "/b", 8)], key=repr
    )
    rails = 'Rails.application.routes.draw do\n  root "h#i"\n  namespace :admin do\n    resources :orders, only: [:index, :show] do\n      member do\n        post "cancel"\n      end\n      get :late, on: :collection\n      resources :lines, except: %i[new edit destroy update create]\n    end\n  end\n  scope "/v1" do\n    resource :profile, only: :show\n    get "ping", to: "x#y"\n  end\nend\n'
    want = [("GET", "/", 2), ("GET", "/admin/orders", 4), ("GET", "/admin/orders/:id", 4), ("POST", "/admin/orders/:id/cancel", 6), ("GET", "/admin/orders/late", 8), ("GET", "/admin/orders/:order_id/lines", 9), ("GET", "/admin/orders/:order_id/lines/:id", 9)]
    want += [("GET", "/v1/profile", 13), ("GET", "/v1/ping", 14)]
    assert rows(routes.rails_routes(spark.createDataFrame([("config/routes.rb", rails)], FILES)).select("method", "route", "line")) == sorted(want, key=repr)


def test_labelled_paths_end_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "1"), ("b", "c", "2"), ("a", "c", "3"), ("c", "a", "4"), ("c", "c", "5"), (None, "a", "6")], "src string, dst string, label string")
    roots = spark.createDataFrame([("a", "r")], "node string, label string")
    assert rows(graph.labelled_paths(roots, edges)) == [("a", "r"), ("b", "r1"), ("c", "r12"), ("c", "r3")]
    assert graph.labelled_paths(roots.where("false"), edges).isEmpty()
