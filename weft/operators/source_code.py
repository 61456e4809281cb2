"""Source code as rows: tokens with their brackets, calls with their arguments, functions.

One pattern of a style cuts a text into tokens that together are the whole text, so strings and
comments can't be taken for code. Depth, lines and enclosing brackets are window sums and last values over the tokens
of a file; all windows share one shuffle by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.tables import dealt


def _string(q: str) -> str:
    return rf"{q}(?:[^{q}\\\n]|\\.)*+{q}?"


def _long_string(q: str) -> str:
    return rf"{q * 3}[^{q}\\]*+(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*+)*+(?:{q * 3})?"


_REGEX = r"(?<=(?:[=(,:\[!&|?{};>]|\breturn|\btypeof|\bcase)\s{0,20})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_BRACKET = r"[()\[\]{},]"
#: Tokens by style: comments, strings, brackets and commas, and runs of anything else. Loops are possessive, so long tokens need no deep stack.
STYLES = {
    "brace": "|".join([r"//[^\n]*+", r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?", _string('"'), _string("'"), r"`(?:[^`\\]|\\.)*+`?", _REGEX, _BRACKET, r"[^\"'`/()\[\]{},]++", "."]),
    "hash": "|".join([r"#[^\n]*+", _long_string('"'), _long_string("'"), _string('"'), _string("'"), _BRACKET, r"[^\"'#()\[\]{},]++", "."]),
}
COMMENTS = {"brace": r"^(?://|/\*)", "hash": "^#"}
STRINGS = {"brace": r"^(?:[\"'`]|/.)", "hash": "^[\"']"}
#: What counts as a branch (a question mark unless it is optional chaining or coalescing), and the words that no function is named.
BRANCH = r"\bif\b|\bfor\b|\bwhile\b|\bcase\b|\bcatch\b|\bexcept\b|\belif\b|&&|\|\||\band\b|\bor\b|\?(?![.?])"
CONTROL = "if|for|while|switch|catch|else|do|function|return|new|typeof|delete|void|throw|class|try|finally|case|in|of|instanceof|export|import|yield|await|synchronized|using|lock|foreach"


def tokens(files: DataFrame, style: str = "brace", file: str = "file", text: str = "text") -> DataFrame:
    """file, i, token, kind, line, level, parent, n, close, head of every token of every file.

    kind: code, string, comment, comma, open or close. ``level`` counts the brackets around a token, a
    bracket itself sits at the level it opens from. ``parent`` is the i of the bracket around it, ``close`` that of an opening
    bracket's end (null where it has none), ``n`` the commas before the token inside its parent, ``head`` the code before an opening bracket. ``line`` is that of the token's first character.
    Null texts give no rows; a bracket that closes nothing lowers the level below zero and matches nothing.
    """
    cut = dealt(files.where(F.col(text).isNotNull()).select(file, text), file, text).select(F.col(file).alias("file"), F.posexplode(F.regexp_extract_all(text, F.lit("(?s)" + STYLES[style]), F.lit(0))).alias("i", "token"))
    token = F.col("token")
    kind = (
        F.when(token.isin("(", "[", "{"), "open")
        .when(token.isin(")", "]", "}"), "close")
        .when(token == ",", "comma")
        .when(token.rlike(COMMENTS[style]), "comment")
        .when(token.rlike(STRINGS[style]), "string")
        .otherwise("code")
    )
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("token") - F.length(F.translate("token", "\n", ""))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    read = F.when(F.col("kind") != "comment", F.struct("kind", "token"))
    own = cut.withColumn("kind", kind).select(
        "*",
        (F.coalesce(F.sum(lines).over(before), F.lit(0)) + 1).cast("int").alias("line"),
        (F.coalesce(F.sum(step).over(before), F.lit(0)) - (F.col("kind") == "close").cast("int")).cast("int").alias("level"),
        F.last(read, True).over(before).alias("last"),
    )
    # A bracket stands among its neighbours and opens the level above: two rows, so that each level finds its brackets by itself.
    here, above = F.struct("level", F.lit(None).cast("int").alias("scope")), F.struct((F.col("level") + 1).alias("level"), F.col("i").alias("scope"))
    placed = own.select("*", F.explode(F.when(F.col("kind") == "open", F.array(here, above)).otherwise(F.array(here))).alias("s"))
    level = Window.partitionBy("file", "s.level")
    past = level.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ahead = level.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.select(
        "*",
        F.last("s.scope", True).over(past).alias("parent"),
        F.sum((F.col("kind") == "comma").cast("int")).over(level.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)).alias("commas"),
        F.when(F.col("kind") == "open", F.last(F.when(F.col("kind") == "close", F.col("i")), True).over(ahead)).alias("close"),
    ).where("s.scope IS NULL")
    head = F.when((F.col("kind") == "open") & (F.col("last.kind") == "code"), F.col("last.token"))
    parent = F.when(F.col("level") > 0, F.col("parent"))
    # Commas of a level are counted from the first token of the parent on.
    first = F.min(F.coalesce("commas", F.lit(0))).over(Window.partitionBy("file", "level", "parent"))
    return found.select("file", "i", "token", "kind", "line", "level", parent.alias("parent"), "close", head.alias("head"), "commas").select(
        "file", "i", "token", "kind", "line", "level", "parent", (F.coalesce("commas", F.lit(0)) - first).cast("int").alias("n"), "close", "head"
    )


def calls(found: DataFrame) -> DataFrame:
    """file, call, name, head, line, level, parent, n, close: every parenthesis that a dotted name stands before (one that begins with a dot goes on a call before it); ``found`` is what ``tokens`` returns."""
    name = F.regexp_extract("head", r"((?:@|\.\s*)?[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*$", 1)
    return found.where("kind = 'open' AND token = '('").select("file", F.col("i").alias("call"), F.translate(name, " \n\t", "").alias("name"), "head", "line", "level", "parent", "n", "close").where("name <> ''")


def arguments(found: DataFrame) -> DataFrame:
    """file, call, n, key, value, text: the arguments inside every bracket (``call``), brackets inside them shown empty.

    ``key`` is the name that an argument is given by (=, : or =>), ``value`` its string without quotes where it is one string, ``text`` what stands there.
    """
    parts = found.where("parent IS NOT NULL AND kind NOT IN ('comment', 'comma')").select("file", F.col("parent").alias("call"), "i", "token", "n")
    joined = parts.groupBy("file", "call", "n").agg(F.trim(F.array_join(F.array_sort(F.collect_list(F.struct("i", "token"))).getField("token"), ""), F.lit(" \t\r\n")).alias("text")).where("text <> ''")
    key = F.regexp_extract("text", r"^[\"']?([A-Za-z_][\w-]*)[\"']?\s*(?:=>|[=:](?![=:]))", 1)
    value = F.regexp_extract("text", r"(?s)^(?:[\"']?[A-Za-z_][\w-]*[\"']?\s*(?:=>|[=:])\s*)?[rbfuRBFU]{0,2}([\"'`])(.*)\1$", 2)
    quoted = F.col("text").rlike(r"(?s)^(?:[\"']?[A-Za-z_][\w-]*[\"']?\s*(?:=>|[=:])\s*)?[rbfuRBFU]{0,2}(?:\"[^\"]*\"|'[^']*'|`[^`]*`)$")
    return joined.select("file", "call", "n", F.nullif(key, F.lit("")).alias("key"), F.when(quoted, value).alias("value"), "text")


def functions_in(found: DataFrame) -> DataFrame:
    """file, start, end, complexity: functions of brace languages, nested ones apart.

    A function is a block behind the parentheses of a name that is no word of control, of ``function``, of an arrow
    function given to a name, or of Go's ``func`` with its results. Its complexity is one more than the branches
    between its braces, those of nested functions and of comments included. A block without an end reaches to the last line.
    """
    by_file = Window.partitionBy("file").orderBy("i")
    counted = found.select("*", F.coalesce(F.sum(F.regexp_count("token", F.lit(BRANCH))).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("branches"))
    last = Window.partitionBy("file")
    counted = counted.select("*", F.max(F.col("line") + F.length("token") - F.length(F.translate("token", "\n", ""))).over(last).alias("last_line"), F.max("branches").over(last).alias("all_branches"))
    pair = Window.partitionBy("file", "level").orderBy("i")
    b = counted.where("kind IN ('open', 'close')").select("*", F.lag("head").over(pair).alias("opener"))
    # What stands before the parentheses that end right before a bracket, and before those that end right before these.
    for name in ("callee", "receiver", "first"):
        b = b.select("*", F.when(F.lag("token").over(by_file) == ")", F.coalesce(F.lag("opener").over(by_file), F.lit(""))).alias(name))
        b = b.withColumn("opener", F.lag(name).over(pair))
    b = b.select("*", F.lead(F.struct("line", "branches", "kind")).over(pair).alias("till"))
    callee, after = F.col("callee"), F.coalesce("head", F.lit(""))
    word = F.regexp_extract("callee", r"([\w$]+)\s*$", 1)
    is_go = F.endswith("file", F.lit(".go"))
    go = is_go & after.rlike(r"^[\s\w.*]*$") & F.concat_ws(" ", "callee", "receiver", "first").rlike(r"\bfunc\b")
    arrow = after.rlike(r"^\s*(?::[^{;=]{1,200})?=>\s*$") & callee.rlike(r"\b(?:const|let|var)\s+[\w$]+\s*=\s*(?:async\s*)?$")
    plain = after.rlike(r"^\s*(?::[^{;=]{1,200}|throws\s[\w\s.]+)?$") & (callee.rlike(r"\bfunction\s*\*?\s*$") | ((word != "") & ~word.rlike(f"^(?:{CONTROL})$") & ~callee.rlike(r"\bnew\s+[\w$.<>]+\s*$")))
    block = b.where((F.col("token") == "{") & callee.isNotNull() & F.when(is_go, go).otherwise(arrow | plain))
    ended = F.col("close").isNotNull()
    return block.select(
        "file",
        F.col("line").alias("start"),
        F.when(ended, F.col("till.line")).otherwise(F.col("last_line")).cast("int").alias("end"),
        (1 + F.when(ended, F.col("till.branches")).otherwise(F.col("all_branches")) - F.col("branches")).cast("long").alias("complexity"),
    )

