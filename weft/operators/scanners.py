"""Rules over lines of text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.tables import saved


@dataclass(frozen=True)
class Rule:
    """A finding at each match of ``pattern``, which has no groups of its own; severity low where ``lowered`` follows it within 200 characters.

    ``needs``: of each of these lists, the text in lower case must hold one literal; only then is ``pattern`` looked for.
    With ``near``, the lines of ``pattern`` count that have a line of all of ``near`` at most four lines away.
    """

    name: str
    severity: str
    category: str
    needs: tuple[tuple[str, ...], ...]
    pattern: str
    lowered: str | None = None
    near: tuple[str, ...] = ()


# Patterns are put together from these parts. Names, severities, categories, windows and words that a rule looks for are fixed values.


def any_of(*found: str) -> str:
    return f"(?:{'|'.join(found)})"


def call(*names: str, gap: str = r"\s*") -> str:
    """A call of one of ``names``, up to its parenthesis."""
    return rf"\b{any_of(*names)}{gap}\("


def given(name: str, signs: str, value: str) -> str:
    """``name``, one of ``signs`` and ``value``, a whole word each."""
    return rf"\b{name}\s*[{signs}]\s*{value}\b"


def text_of(value: str) -> str:
    """``value`` in quotes."""
    return rf"""["']{value}["']"""


def within(pattern: str, least: int, most: int) -> str:
    """A place with ``pattern`` so many characters ahead."""
    return rf"(?=(?s:.{{{least},{most}}}?)(?:{pattern}))"


def far_from(words: tuple[str, ...], reach: int) -> str:
    """A place without any of ``words`` in so many characters on either side."""
    return "".join(rf"(?<!(?i:{w})(?s:.{{0,{reach - len(w)}}}))(?!(?s:.{{0,{reach - len(w)}}}?)(?i:{w}))" for w in words)


def argument(pattern: str, reach: int = 1000, depth: int = 3) -> str:
    """``pattern`` in what follows an opening parenthesis, before it is closed; calls inside may be open ``depth - 1`` deep."""
    flat = r"[^()]"
    closed = any_of(flat, rf"\({any_of(flat, rf'{chr(92)}({flat}*{chr(92)})')}*\)") + f"{{0,{reach}}}?"
    ahead = closed
    for _ in range(depth - 1):
        ahead = rf"{closed}(?:\({ahead})?"
    return f"(?={ahead}{any_of(*pattern) if isinstance(pattern, tuple) else pattern})"


WILD = text_of(r"\*")
HEADER = "Access-Control-Allow-"
ORIGIN = "(?i:" + any_of(rf"\borigin\s*[:=]\s*{WILD}", rf"{HEADER}Origin[\"']?\s*,\s*{WILD}", rf"allow_origins\s*=\s*\[\s*{WILD}") + ")"
CREDENTIALS = "(?i:" + any_of(given("credentials", ":=", "true"), r"allow_credentials\s*=\s*true\b", rf"{HEADER}Credentials[\"']?\s*,\s*{text_of('true')}") + ")"
CLEANED = f"(?i:{call('sanitize[a-z0-9_]*', 'dompurify[.]sanitize')})"
READS = (r"\breq(?:uest)?[.](?:args|GET|query)\b", r"searchParams[.]get\(", r"query_params(?:\[|[.]get\()")
LIMIT_HINTS = ("rate_limit", "rate-limit", "ratelimit", "throttle", "limiter")
SIGN_IN = ("login", "signin", "sign-in", "authorize")
VERBS = ("get", "post", "put", "patch", "delete", "route")
#: Words of eight letters or more that are no secret.
COMMON = ("password", "secretkey", "administrator", "username", "changeme", "placeholder", "undefined", "temporary", "required", "optional")
#: Names of what is kept secret, with what may follow them in one word.
SECRET_NAMES = ("admin[a-z_]*", r"passw(?:or)?d\w*", "secret[a-z_]*", "api[-_]?key\\w*", "token\\w*")
CUT_OUT = "[.]" + any_of("slice", "substring", "substr") + r"\("


def _secret(q: str) -> str:
    """A quoted value of eight characters or more, neither masked nor common nor cut out of a variable."""
    plain = f"[^{q}\\n]"
    masked, common = r"[xX*•]+", f"(?i:{any_of(*COMMON)})"
    cut = rf"{plain}*\$\{{(?:[^$}}]|\$(?!\{{))*{CUT_OUT}"
    return f"{q}(?!{any_of(masked, common)}{q})(?!{cut}){plain}{{8,}}{q}"


SECURITY_RULES = (
    Rule("redirect.open", "medium", "A01:2021", (("redirect",), ("req", "params")), call("res[.]redirect", "NextResponse[.]redirect", "RedirectResponse", "redirect", gap="") + argument(READS)),
    Rule(
        "tls.disabled", "high", "A02:2021", (("verify", "rejectunauthorized", "node_tls_reject"),), any_of(given("verify", "=", "False"), given("rejectUnauthorized", ":", "false"), "NODE_TLS_REJECT_UNAUTHORIZED")
    ),
    Rule("xss.dangerouslySetInnerHTML", "medium", "A03:2021", (("dangerouslysetinnerhtml",),), "dangerouslySetInnerHTML", lowered=CLEANED),
    Rule("xss.innerHTML", "medium", "A03:2021", ((".innerhtml",),), r"[.]innerHTML\s*=(?!=)", lowered=CLEANED),
    Rule("code.eval", "high", "A03:2021", (("eval", "exec", "function"),), any_of(r"(?<![\w.$])" + any_of("eval", "exec") + r"\s*\(", r"\bnew\s+Function\s*\(")),
    Rule("code.eval", "high", "A03:2021", (("child_process",), (".exec",)), r"(?<!/[dgimsuyv]{0,8})[.]exec(?:Sync)?\s*\("),
    Rule(
        "sql.concat",
        "high",
        "A03:2021",
        (("select", "insert", "update", "delete"), ("execute", "query", "raw", "text")),
        call("execute", "query", "raw", "text"),
        near=(rf"(?i)\b{any_of('delete', 'insert', 'select', 'update')}\b", any_of(r"\$\{", r"\bf[\"']", r"[\"'`]\s*\+", r"\+\s*[\"'`]")),
    ),
    Rule("cors.wildcardCredentials", "high", "A05:2021", (("origin",), ("credentials",)), any_of(f"(?={ORIGIN}){within(CREDENTIALS, 0, 400)}", f"(?={CREDENTIALS}){within(ORIGIN, 1, 400)}")),
    Rule("debug.enabled", "low", "A05:2021", (("debug",),), any_of(given("DEBUG", "=", "True"), given("debug", ":=", "[Tt]rue"))),
    Rule("jwt.noVerify", "high", "A07:2021", (("verify_signature", "algorithms"),), "(?i:" + any_of(r"verify_signature[\"']?\s*[:=]\s*False\b", rf"algorithms\s*[:=]\s*\[[^\]]{{0,200}}{text_of('none')}") + ")"),
    Rule(
        "secret.default",
        "medium",
        "A07:2021",
        (("admin", "passw", "secret", "api", "token"), (":", "=")),
        rf"(?i:\b{any_of(*SECRET_NAMES)}\s*[:=]\s*){any_of(*map(_secret, (chr(34), chr(39), chr(96))))}(?!\s*\+\s*[\w.]+{CUT_OUT})",
    ),
    Rule(
        "auth.noRateLimit",
        "info",
        "A07:2021",
        (SIGN_IN, tuple(f"{v}(" for v in VERBS)),
        rf"(?=(?i:{call(*VERBS, gap='')})){far_from(LIMIT_HINTS, 200)}(?i:{call(*VERBS, gap='')}\s*[\"'`](?=[^\"'`]*?{any_of(*SIGN_IN)})[^\"'`]*[\"'`])",
    ),
)
#: Marks that are put before a match: as it is, and lowered.
PLAIN, LOWERED = "\u0001", "\u0002"


def scan(files: DataFrame, rules: tuple[Rule, ...], key: str = "file", text: str = "text") -> DataFrame:
    """file, line, rule, severity, category: one row for each line and rule that meet.

    A rule reads the whole text, so a match or its window may pass a line's end; the
    first match of a line decides its severity. Only texts that a rule matches are split into lines. Null texts give no rows.
    """
    t = F.col("t")

    def lines_of(r: Rule) -> Column:
        place = lambda lines, holds: F.filter(F.transform(lines, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())
        if r.near:
            lines = F.split(t, "\n")
            build = place(lines, lambda x: x.rlike(r.near[0]) & x.rlike(r.near[1]))
            calls = place(lines, lambda x: x.rlike(r.pattern))
            near = F.filter(calls, lambda c: F.exists(build, lambda b: F.abs(b - c) <= 4))
            return F.transform(near, lambda i: F.struct((i + 1).alias("line"), F.lit(r.severity).alias("severity")))
        marks = F.regexp_replace(t, f"((?={r.pattern}){within(r.lowered, 0, 199)})", LOWERED + "$1") if r.lowered else t
        marks = F.regexp_replace(marks, f"(?<!{LOWERED})((?:{r.pattern}))", PLAIN + "$1")
        first = lambda x: F.regexp_extract(x, f"[{PLAIN}{LOWERED}]", 0)
        hits = F.transform(F.split(marks, "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.when(first(x) == LOWERED, "low").when(first(x) == PLAIN, r.severity).alias("severity")))
        return F.filter(hits, lambda h: h["severity"].isNotNull())

    def found(r: Rule) -> Column:
        holds = F.lit(True)
        for literals in r.needs:
            holds = holds & reduce(or_, [F.contains("low", F.lit(x)) for x in literals])
        holds = holds & (F.lit(True) if r.near else t.rlike(r.pattern))
        named = F.transform(lines_of(r), lambda h: F.struct(h["line"].alias("line"), F.lit(r.name).alias("rule"), h["severity"].alias("severity"), F.lit(r.category).alias("category")))
        return F.when(holds, named).otherwise(F.array().cast("array<struct<line:int,rule:string,severity:string,category:string>>"))

    read = files.where(F.col(text).isNotNull()).select(key, F.translate(text, PLAIN + LOWERED, "  ").alias("t"), F.lower(text).alias("low"))
    rows = read.select(key, F.explode(F.concat(*map(found, rules))).alias("f"))
    return rows.select(key, "f.line", "f.rule", "f.severity", "f.category").distinct()


def strongest_guard(guards: Column) -> Column:
    """none, unknown, user or role: the strongest guard of a route."""
    level = lambda g: F.when(g.rlike("(?i)role|admin|permission"), 3).when(g.rlike("(?i)auth|login|user|session"), 2).when(g.isNotNull(), 1).otherwise(0)
    most = F.aggregate(F.coalesce(guards, F.array().cast("array<string>")), F.lit(0), lambda a, g: F.greatest(a, level(g)))
    return F.element_at(F.array(*map(F.lit, ("none", "unknown", "user", "role"))), most + 1)


#: Names that one pattern may hold; a longer list is joined by the names' first words.
MOST_NAMES = 20_000


@F.pandas_udf(T.ArrayType(T.StringType()))
def _leftmost(lists: pd.Series) -> pd.Series:
    """Of (place, minus length, run) in order, the runs that begin where no earlier one reaches."""

    def kept(found: list) -> list[str]:
        out, end = [], 0
        for x in found:
            if x["at"] >= end:
                out.append(x["run"])
                end = x["at"] - x["less"]
        return out

    return lists.map(kept)


def _joined_runs(texts: DataFrame, listed: DataFrame, key: str, words: Column) -> DataFrame:
    """key, run of every mention, by a join of the words of the texts with the first words of the names."""
    first = listed.select(F.split_part("run", F.lit(" "), F.lit(1)).alias("word"), "run", "n_words")
    placed = texts.select(key, F.split(F.trim(words), " ").alias("words")).select(key, "words", F.monotonically_increasing_id().alias("row"))
    placed = saved(placed)
    begun = placed.select("row", F.posexplode("words").alias("at", "word")).join(first, "word")
    held = begun.join(placed.select("row", "words"), "row").where(F.array_join(F.slice("words", F.col("at") + 1, F.col("n_words")), " ") == F.col("run"))
    each = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n_words")).alias("less"), "run"))).alias("found"))
    return placed.select(key, "row").join(each, "row").select(key, F.explode(_leftmost("found")).alias("run"))


def mentions(texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, name, n: names found word for word, from left to right; at each word the longest name counts, and its words aren't read again.

    ``names`` (name, words: array of lower-case words): a catalogue of up to
    MOST_NAMES rows becomes one pattern, so a text is read once, inside its row; a longer one is joined by first words.
    Of names of the same words the smallest counts. Names without words and null texts
    give no rows.
    """
    listed = names.where(F.size("words") > 0).groupBy(F.array_join("words", " ").alias("run"), F.size("words").alias("n_words")).agg(F.min("name").alias("name"))
    runs = [r.run for r in listed.orderBy(F.desc("n_words"), F.desc(F.length("run")), "run").limit(MOST_NAMES + 1).select("run").collect()]
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+#]+", " ")
    if len(runs) > MOST_NAMES:
        found = _joined_runs(texts.where(F.col(text).isNotNull()), listed, key, words).groupBy(key, "run").agg(F.count("*").alias("n"))
        return found.join(listed.select("run", "name"), "run").select(key, "name", "n")
    escaped = [re.sub(r"([^\w ])", r"\\\1", run) for run in runs]
    pattern = rf"(?<![^ ])(?:{'|'.join(escaped)})(?![^ ])" if runs else r"(?!)"
    found = texts.select(key, F.explode(F.regexp_extract_all(words, F.lit(pattern), F.lit(0))).alias("run")).groupBy(key, "run").agg(F.count("*").alias("n"))
    return found.join(listed.select("run", "name"), "run").select(key, "name", "n")
