"""Behaviour signals with their fields and values, read from calls and their arguments.

A rule is a row: which calls or keys it reads, and where its field and its value stand. Calls in strings and comments are none,
since the tokens come from ``source_code``. Values pass ``safe_value``, so nothing secret or long is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.values import parameter_role, safe_value
from weft.operators.source_code import arguments, calls, tokens
from weft.operators.tables import saved, unsent

NUMBER = r"^\s*(-?[0-9][0-9_]{0,11})\s*$"


@dataclass(frozen=True)
class CallRule:
    """Calls whose name ``name`` matches. field: "owner" (the name before the last), "key" (what the call is given to), "0" (its first argument), or none.

    value: the place of the argument that holds it ("0", "1"), or a fixed text after an equals sign.
    """

    style: str
    via: str
    name: str
    family: str
    signal: str
    field: str = ""
    value: str = ""


@dataclass(frozen=True)
class KeyRule:
    """Arguments that ``key`` names, in calls that ``of`` matches or in brackets that stand behind it. field: "key" of what the call is given to, "name" (the group of ``key``), or none."""

    style: str
    via: str
    key: str
    family: str
    signal: str
    of: str = ""
    field: str = ""


def _zod(name: str, signal: str, value: str = "") -> CallRule:
    return CallRule("brace", "schema", rf"\.{name}$", "validation", signal, "key", value)


#: The vocabulary (families, signals, ways) is fixed; names of calls are those of the libraries.
CALL_RULES = (
    *[CallRule("hash", "sqlalchemy", rf"\.{n}$", f, s, "owner") for n, f, s in (("ilike", "search", "contains"), ("like", "search", "like"), ("icontains", "search", "contains"), ("in_", "filter", "in"), ("between", "filter", "range"), ("regexp_match", "search", "regex"))],
    *[CallRule("hash", "sqlalchemy", rf"\.{n}$", "search", "caseInsensitive", "owner") for n in ("ilike", "icontains")],
    *[CallRule("hash", "python", rf"\.{n}$", "pagination", n, "", "0") for n in ("limit", "offset")],
    CallRule("hash", "django", r"(?:^|\.)Paginator$", "pagination", "pageSize", "", "1"),
    CallRule("hash", "celery", r"(?:^|\.)crontab$", "schedule", "cron"),
    CallRule("hash", "python", r"(?:^|\.)(?:send_mail|EmailMessage|sendmail)$", "notification", "email"),
    CallRule("hash", "python", r"(?:^|\.)csv\.(?:writer|DictWriter)$|\.to_csv$", "export", "csv"),
    CallRule("hash", "python", r"\.to_excel$|^(?:openpyxl\.)?Workbook$", "export", "spreadsheet"),
    *[_zod(n, s, v) for n, s, v in (("min", "min", "0"), ("max", "max", "0"), ("length", "length", "0"), ("email", "email", ""), ("url", "url", ""), ("uuid", "uuid", ""), ("int", "integer", ""), ("positive", "positive", ""), ("optional", "optional", ""), ("default", "default", "0"))],
    CallRule("brace", "javascript", r"(?:^|\.)(?:debounce|useDebounce)$", "trigger", "debounce", "", "1"),
    *[CallRule("brace", "sql", rf"\.{n}$", "pagination", s, "", "0") for n, s in (("limit", "limit"), ("take", "limit"), ("offset", "offset"), ("skip", "offset"))],
    *[CallRule("brace", "javascript", rf"\.{n}$", "search", s, "owner") for n, s in (("includes", "contains"), ("startsWith", "startsWith"), ("endsWith", "endsWith"))],
    CallRule("brace", "node-cron", r"(?:^|\.)cron\.schedule$", "schedule", "cron", "", "0"),
    CallRule("brace", "javascript", r"(?:^|\.)setInterval$", "schedule", "interval", "", "1"),
    CallRule("brace", "javascript", r"\.sendMail$", "notification", "email"),
    *[CallRule("brace", "class-validator", rf"^@{n}$", "validation", s, "", v) for n, s, v in (("Min", "min", "0"), ("Max", "max", "0"), ("MinLength", "min", "0"), ("MaxLength", "max", "0"), ("IsEmail", "email", ""), ("IsNotEmpty", "required", ""), ("IsOptional", "optional", ""), ("IsInt", "integer", ""))],
)
_LOOKUPS = {"contains": "contains", "icontains": "contains", "startswith": "startsWith", "istartswith": "startsWith", "endswith": "endsWith", "iendswith": "endsWith", "regex": "regex", "iregex": "regex", "search": "fullText", "trigram_similar": "fuzzy"}
_CALLS = r"(?:^|\.)(?:filter|exclude|get|Q|annotate)$"
_PRISMA = r"\b(?:where|AND|OR|NOT|\w+)\s*:\s*$"
KEY_RULES = (
    *[KeyRule("hash", "django", rf"^(\w+?)__{n}$", "search", s, _CALLS, "name") for n, s in _LOOKUPS.items()],
    *[KeyRule("hash", "django", rf"^(\w+?)__{n}$", "search", "caseInsensitive", _CALLS, "name") for n in _LOOKUPS if n[0] == "i"],
    KeyRule("hash", "django", r"^(\w+?)__in$", "filter", "in", _CALLS, "name"),
    KeyRule("hash", "django", r"^(\w+?)__(?:range|[gl]te?)$", "filter", "range", _CALLS, "name"),
    *[KeyRule("hash", "pydantic", rf"^{n}$", "validation", s, r"(?:^|\.)(?:Field|Query|Path|Body|constr|conint)$", "key") for n, s in (("min_length", "min"), ("ge", "min"), ("gt", "min"), ("max_length", "max"), ("le", "max"), ("lt", "max"), ("pattern", "pattern"), ("regex", "pattern"))],
    KeyRule("hash", "celery", r"^schedule$", "schedule", "interval"),
    *[KeyRule("brace", "prisma", rf"^{n}$", "search", n, _PRISMA, "around") for n in ("contains", "startsWith", "endsWith")],
    *[KeyRule("brace", "prisma", rf"^{n}$", "filter", s, _PRISMA, "around") for n, s in (("equals", "equals"), ("not", "not"), ("in", "in"), ("gte", "range"), ("lte", "range"))],
    *[KeyRule("brace", "prisma", rf"^{n}$", "pagination", s, r"\.find(?:Many|First)$") for n, s in (("take", "limit"), ("skip", "offset"), ("cursor", "cursor"))],
)


def _texted(text: Column, value: Column) -> Column:
    """A string's content, or a number without separators."""
    return F.coalesce(value, F.nullif(F.translate(F.regexp_extract(text, NUMBER, 1), "_", ""), F.lit("")))


def signals(files: DataFrame, style: str) -> DataFrame:
    """family, signal, field, value, via, file, line: each signal once. ``style`` is that of all ``files``: "hash" for Python, "brace" for JavaScript and TypeScript.

    Besides the rules: orders (``order_by("-x")``, ``orderBy: { x: "desc" }``), and parameters of requests (``Query(…)``,
    ``args.get("q", 1)``, ``searchParams.get("q")``), whose family is that of their name.
    """
    found = saved(tokens(files, style))
    every, args = saved(calls(found)), saved(arguments(found))
    keys = args.select("file", F.col("call").alias("parent"), "n", F.col("key").alias("given_to"))
    place = lambda n: args.where(F.col("n") == n).select("file", "call", _texted(F.col("text"), F.col("value")).alias(f"a{n}"))
    # A call is given to the key of the argument that it stands in, or to the name before the equals sign.
    assigned = F.nullif(F.regexp_extract("head", r"(\w+)\s*(?::[^=(){}]{0,80})?=\s*[\w.]+\s*$", 1), F.lit(""))
    told = every.join(unsent(keys), ["file", "parent", "n"], "left").join(unsent(place(0)), ["file", "call"], "left").join(unsent(place(1)), ["file", "call"], "left")
    owner = F.nullif(F.regexp_extract("name", r"(\w+)\.\w+$", 1), F.lit(""))
    told = saved(told.select("file", "call", "name", "head", "line", F.coalesce("given_to", assigned).alias("given_to"), "a0", "a1", owner.alias("owner")))
    none = F.lit(None).cast("string")
    shaped = lambda family, signal, field, value, via: F.struct(F.lit(family).alias("family") if isinstance(family, str) else family.alias("family"), F.lit(signal).alias("signal") if isinstance(signal, str) else signal.alias("signal"), field.alias("field"), value.alias("value"), F.lit(via).alias("via"))
    fields = {"owner": F.col("owner"), "key": F.col("given_to"), "0": F.col("a0"), "": none}
    values = {"0": F.col("a0"), "1": F.col("a1"), "": none}
    by_call = [F.when(F.col("name").rlike(r.name), shaped(r.family, r.signal, fields[r.field], values[r.value], r.via)) for r in CALL_RULES if r.style == style]
    own = told.select("file", "line", F.explode(F.array_compact(F.array(*by_call))).alias("s"))
    # Arguments by key, in a call by its name or in braces by what stands before them.
    brackets = found.where("kind = 'open'").select("file", F.col("i").alias("call"), F.col("line"), F.col("parent").alias("outer"), F.col("n").alias("outer_n"), F.regexp_replace(F.coalesce("head", F.lit("")), r"\s+$", "").alias("before"))
    around = keys.select("file", F.col("parent").alias("outer"), F.col("n").alias("outer_n"), F.col("given_to").alias("around"))
    named = args.where("key IS NOT NULL").join(unsent(brackets), ["file", "call"]).join(unsent(around), ["file", "outer", "outer_n"], "left")
    # Braces that are the only argument of a call count as its keys.
    wrap = every.select("file", F.col("call").alias("outer"), F.col("name").alias("outer_name"))
    named = named.join(unsent(wrap), ["file", "outer"], "left").join(unsent(told.select("file", "call", "name", "given_to")), ["file", "call"], "left")
    of = F.coalesce("name", F.when(F.col("before") == "", F.col("outer_name")), "before")
    value = _texted(F.regexp_replace("text", r"^[\"']?[\w-]+[\"']?\s*(?:=>|[=:])", ""), F.col("value"))
    group = lambda r: F.regexp_extract("key", r.key, 1) if r.field == "name" else {"key": F.col("given_to"), "around": F.col("around"), "": none}[r.field]
    by_key = [F.when(F.col("key").rlike(r.key) & (of.rlike(r.of) if r.of else F.lit(True)), shaped(r.family, r.signal, group(r), value, r.via)) for r in KEY_RULES if r.style == style]
    keyed = named.select("file", "line", F.explode(F.array_compact(F.array(*by_key))).alias("s"))
    # Orders: a name with a sign in front, or a key with its direction.
    ordered = args.where("key IS NULL AND value IS NOT NULL").join(unsent(told.where(F.col("name").rlike(r"\.order_?[bB]y$")).select("file", "call", "line")), ["file", "call"])
    orders = ordered.select("file", "line", shaped("sort", "orderBy", F.regexp_replace("value", "^-", ""), F.when(F.startswith("value", F.lit("-")), "desc").otherwise("asc"), "django" if style == "hash" else "sql").alias("s"))
    directed = named.where(F.col("before").rlike(r"\border(?:By)?\s*:$") & F.lower(F.coalesce("value", F.lit(""))).isin("asc", "desc")).select("file", "line", shaped("sort", "orderBy", F.col("key"), F.lower("value"), "prisma").alias("s"))
    # Parameters of requests.
    asks = F.when(F.col("name").rlike(r"(?:^|\.)Query$"), F.struct(F.col("given_to").alias("p"), F.col("a0").alias("v"), F.lit("fastapi").alias("via"))).when(
        F.col("name").rlike(r"(?:\bargs|\bGET|query_params|searchParams)\.get$"), F.struct(F.col("a0").alias("p"), F.col("a1").alias("v"), F.lit("query").alias("via"))
    )
    asked = told.withColumn("q", asks).where("q.p IS NOT NULL").withColumn("role", parameter_role(F.col("q.p")))
    params = asked.select("file", "line", F.struct(F.col("role.family").alias("family"), F.col("role.signal").alias("signal"), F.col("q.p").alias("field"), F.col("q.v").alias("value"), F.col("q.via").alias("via")).alias("s"))
    rows = reduce(DataFrame.unionByName, [own, keyed, orders, directed, params])
    kept = safe_value(F.col("s.value"), F.col("s.family"), F.col("s.field"))
    return rows.select("s.family", "s.signal", "s.field", kept.alias("value"), "s.via", "file", "line").distinct()
