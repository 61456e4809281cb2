"""Text functions as Column expressions, all of them inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that plain text decodes, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Accented letters of Latin-1 and what they fold to.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(text: Column | str) -> Column:
    """Lower case without the accents of Latin-1, trimmed."""
    return F.trim(F.translate(F.lower(col(text)), *ACCENTS))


def fold_space(text: Column | str) -> Column:
    """Lower case with every run of white space as one space."""
    return F.lower(F.regexp_replace(F.replace(col(text), F.lit(" "), F.lit(" ")), r"\s+", " "))


def slug(text: Column | str, most: int = 60, default: str = "section") -> Column:
    """Folded, anything but a-z and 0-9 as single hyphens, cut to ``most``."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)
    return F.when(cut == "", default).otherwise(cut)


def escape_html(text: Column | str) -> Column:
    """The ampersand, both angle brackets and the double quote."""
    out = col(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def one_line(text: Column | str) -> Column:
    """Runs of control characters as one space."""
    return F.trim(F.regexp_replace(col(text), "[\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]+", " "))


def plain_text(html: Column | str) -> Column:
    """Text without tags, common entities decoded, white space collapsed."""
    out = F.regexp_replace(col(html), r"(?s)<svg\b.*?</svg>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def inert_markup(text: Column | str) -> Column:
    """An angle bracket that could open markup is escaped."""
    return F.regexp_replace(col(text), r"<(?=[\p{Lu}\p{Ll}/!?])", "&lt;")


def whole_count(text: Column | str, word: str) -> Column:
    """Occurrences of a word that no word character touches."""
    around = r"[\p{L}\p{N}\p{M}\p{Pc}]"
    return F.regexp_count(col(text), F.lit(rf"(?<!{around})\Q{word}\E(?!{around})"))


def hit(text: Column | str, term: str) -> Column:
    """0 absent, 1 inside a word, 2 at the start of one."""
    return F.when(col(text).rlike(rf"(?<![\p{{L}}\p{{N}}])\Q{term}\E"), 2).when(F.contains(col(text), F.lit(term)), 1).otherwise(0)


def occurrences(text: Column | str, term: str) -> Column:
    """Occurrences up to four, overlapping ones included, one more when one of those starts a word."""
    count = F.least(F.regexp_count(col(text), F.lit(rf"(?=\Q{term}\E)")), F.lit(4))
    return count + F.when(hit(text, term) == 2, 1).otherwise(0)


def term_score(title: Column | str, page: Column | str, text: Column | str, term: str) -> Column:
    """Title first, then the page's title, then the text."""
    in_title, in_page = hit(title, term), hit(page, term)
    return F.when(in_title == 2, 12).when(in_title == 1, 8).otherwise(0) + F.when(in_page == 2, 4).when(in_page == 1, 3).otherwise(0) + occurrences(text, term)


def content_hash(text: Column | str) -> Column:
    """First 16 hex digits of SHA-256, without a byte order mark and with line feeds only."""
    return F.substring(F.sha2(F.regexp_replace(F.regexp_replace(col(text), "^﻿", ""), "\r\n?", "\n"), 256), 1, 16)


def mask(text: Column | str, patterns: list[str]) -> Column:
    """Every match of a pattern as eight dots (H25, H26); longer patterns are tried first."""
    return F.regexp_replace(col(text), "(?i)" + "|".join(sorted(patterns, key=len, reverse=True)), "••••••••") if patterns else col(text)


def hosts(text: Column | str) -> Column:
    """Distinct hosts of the web addresses in a text, lower case, sorted."""
    found = F.regexp_extract_all(col(text), F.lit(r"https?://([^\s/?#\"'<>]{1,512})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")))))


def route_forms(route: Column | str) -> Column:
    """Spellings that a route can have in a text."""
    r = col(route)
    anonymous = [F.regexp_replace(r, r"\[[^\]/]+\]|\{[^}/]+\}|:[A-Za-z_]\w*", x) for x in (":p", "{p}", "[p]")]
    return F.array_distinct(F.array(r, *anonymous))


def normal_route(route: Column | str) -> Column:
    """Parameters of any spelling as {}, no slash at the end."""
    r = F.regexp_replace(col(route), r"\[[^\]/]+\]|\{[^}/]+\}|:[A-Za-z_]\w*", "{}")
    return F.when(F.length(r) > 1, F.regexp_replace(r, "/+$", "")).otherwise(r)


def ticket(text: Column | str) -> Column:
    """Kind of a ticket reference: azure (ADO#n), github (owner/repo#n), jira (KEY-n), else null."""
    t = col(text)
    return F.when(t.rlike("^ADO#[0-9]+$"), "azure").when(t.rlike(r"^[\w.-]+/[\w.-]+#[0-9]+$"), "github").when(t.rlike("^[A-Z][A-Z0-9]+-[0-9]+$"), "jira")


def word_count(text: Column | str) -> Column:
    """Words of prose: fenced code, inline code and markup left out."""
    prose = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), r"(?s)```.*?```", " "), "`[^`]*`", " "), "<[^>]*>", " ")
    return F.regexp_count(prose, F.lit(r"[\p{L}\p{N}]+"))


def headings(text: Column | str) -> Column:
    """Titles of second and third level headings outside fences."""
    unfenced = F.regexp_replace(col(text), r"(?s)(?:^|\n)```.*?\n```", "\n")
    return F.transform(F.regexp_extract_all(unfenced, F.lit(r"(?m)^#{2,3} +(.+?)\s*$"), F.lit(1)), lambda x: F.trim(x))


def hidden_characters(text: Column | str) -> Column:
    """Invisible characters of a text, in order."""
    return F.regexp_extract_all(col(text), F.lit("([​-‏‪-‮⁠-⁤﻿­])"), F.lit(1))


def strip_credentials(text: Column | str) -> Column:
    """User and password taken out of addresses."""
    return F.regexp_replace(col(text), r"(://)[^/\s@]+@", "$1")


def safe_filename(name: Column | str) -> Column:
    """Anything but word characters, dot, plus and hyphen as an underscore."""
    return F.regexp_replace(col(name), r"[^\w.+-]", "_")


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(col(text)) / 4).cast("long")


def majors_behind(current: Column | str, latest: Column | str) -> Column:
    """Major versions between two, 0 at least, null when one has none."""
    major = lambda x: F.expr("try_cast(nullif(regexp_extract({0}, '^[^0-9]*([0-9]+)', 1), '') as int)".format(x))
    behind = major(latest) - major(current)
    return F.when(behind < 0, 0).otherwise(behind)


def version_key(version: Column | str) -> Column:
    """A struct that sorts versions: numbers by value, a pre-release before its release, other texts last."""
    v = F.regexp_replace(col(version), r"\+.*$", "")
    number = lambda i: F.expr("0") + F.coalesce(F.regexp_extract(v, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?$", i).try_cast("long"), F.lit(0))
    known = v.rlike(r"^v?\d+(?:\.\d+){0,2}(?:-[0-9A-Za-z.-]+)?$")
    pre = F.regexp_extract(v, r"^v?\d+(?:\.\d+){0,2}-([0-9A-Za-z.-]+)$", 1)
    parts = F.transform(
        F.split(pre, r"\."),
        lambda p: F.struct((~p.rlike("^[0-9]+$")).alias("text"), F.when(p.rlike("^[0-9]+$"), p.cast("long")).otherwise(0).alias("number"), F.when(p.rlike("^[0-9]+$"), "").otherwise(p).alias("name")),
    )
    none = F.array().cast("array<struct<text:boolean,number:bigint,name:string>>")
    return F.struct(
        (~known).alias("other"),
        *[F.when(known, number(i)).otherwise(0).alias(f"n{i}") for i in (1, 2, 3)],
        (known & (pre == "")).alias("release"),
        F.when(pre == "", none).otherwise(parts).alias("pre"),
        F.when(known, "").otherwise(col(version)).alias("name"),
    )


def luminance(red: Column | str, green: Column | str, blue: Column | str) -> Column:
    """Relative luminance of an sRGB colour given in 0 to 255."""
    linear = lambda x: F.when(col(x) / 255 <= 0.03928, col(x) / 255 / 12.92).otherwise(F.pow((col(x) / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * linear(red) + 0.7152 * linear(green) + 0.0722 * linear(blue)


def contrast(first: Column, second: Column) -> Column:
    """WCAG contrast of two luminances."""
    return (F.greatest(first, second) + 0.05) / (F.least(first, second) + 0.05)


def rounded(x: Column) -> Column:
    """To a whole number, halves upwards."""
    return F.floor(x + 0.5).cast("long")
