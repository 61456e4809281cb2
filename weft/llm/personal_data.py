"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, colons,
schemes and words that announce an identifier. A local parser belongs to each kind of anchor: it expands the
anchor to the left and to the right, validates what it found and remembers how far it has read, so every
character is read a bounded number of times. The four base kinds equal their patterns, leftmost
and without overlaps; what the other parsers find is added beside them.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds: other spellings of addresses, names and passwords in URLs, numbers behind a scheme, accounts and identity numbers.
ADDED = ("mail", "login", "tel", "ip6", "account", "identity")

#: The classes and lengths of the base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
DIALLED = re.compile(r"[\x20().0-9-]++")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: Parsers of the added kinds. All start at their anchor and read a bounded stretch or a class of characters.
WIDE_DOMAIN = re.compile(r"(?:[^\W_]|-){1,63}+(?:\.(?:[^\W_]|-){1,63}+){0,8}\.[^\W\d_]{2,24}+(?!\w)")
SPOKEN_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}", re.IGNORECASE)
ENCODED = re.compile(r"[A-Za-z0-9._+-]{1,64}+%40[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}")
USERINFO = re.compile(r"[^\s/?#@:\"'<>]{1,128}+:[^\s/?#@\"'<>]{1,256}+(?=@[A-Za-z0-9\[])")
NUMBER = re.compile(r"[0-9(][\x20().0-9-]{5,24}[0-9]")
HEX_COLON = frozenset("0123456789abcdefABCDEF:.")
LEAD = re.compile(r"(?:\x20?(?:number|num|no\.?|nr\.?|id|code))?[\x20\t]{0,3}(?:[:=#]|is)?[\x20\t]{0,3}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}+(?![0-9])")
PASSPORT = re.compile(r"(?=[A-Z0-9]*[0-9]{5})[A-Z0-9]{7,10}+(?![A-Za-z0-9])")

#: Words that announce an identifier, and the parser that reads what follows.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "passport"}
AT_WORDS = ("[at]", "(at)", "{at}")
SCHEMES = ("mailto:", "tel:", "://")

SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
FOUND = T.StructType().add("base", T.ArrayType(SPAN)).add("added", T.ArrayType(SPAN))


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton: every anchor with its name and its length. Words stand in the three usual cases."""
    found = ahocorasick.Automaton()
    words = {"@": "at", "+": "plus", ":": "colon"} | dict.fromkeys("0123456789", "digit") | dict.fromkeys(AT_WORDS, "spoken") | {x: x for x in SCHEMES} | CUES
    for word, name in words.items():
        for spelling in {word, word.upper(), word.capitalize(), word.title()}:
            found.add_word(spelling, (name, len(spelling)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """The check sum of card numbers: from the right, every second digit counts twice, without its tens."""
    total = 0
    for i, x in enumerate(reversed(digits)):
        value = int(x) << (i & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    """The check sum of account numbers: letters as 10 to 35, the first four signs last, modulo 97."""
    return 15 <= len(value) <= 34 and int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1


def _left(text: str, at: int, least: int, chars: frozenset[str]) -> int:
    """Start of the run of ``chars`` that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``: everything of the class before it, at least two labels after it."""
    start = _left(text, at, least, LOCAL)
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _wide_email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """An address with letters of any script: up to 64 characters before the sign, a domain that ends in letters."""
    start, floor = at, max(least, at - 64)
    while start > floor and (text[start - 1] in LOCAL or text[start - 1].isalnum()):
        start -= 1
    if start == at or (start and start == at - 64 and text[start - 1].isalnum()):
        return None
    domain = WIDE_DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _spoken_email(text: str, start: int, end: int) -> tuple[int, int] | None:
    """``name [at] host [dot] tld``: the words of both sides, each at most one space away."""
    before = start - 1 if start and text[start - 1] == " " else start
    first = _left(text, before, max(0, before - 64), LOCAL)
    domain = SPOKEN_DOMAIN.match(text, end)
    return (first, domain.end()) if domain and first < before else None


def _phone(text: str, at: int) -> tuple[int, int, bool] | None:
    """What the phone pattern matches at a plus sign: (start, end, whether it has as many digits as it needs)."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    run = DIALLED.match(text, at + 2)
    body = run[0].rstrip(" ().-") if run else ""
    if len(body) < 2:
        return None
    n = 1 + sum(map(body.count, "0123456789"))
    return at, at + 2 + len(body), PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]


def _ip6(text: str, at: int, least: int) -> tuple[int, int, bool]:
    """The run of hexadecimal digits, colons and points around a colon: (start, end, whether it is an address of version 6 with borders on both sides)."""
    start = _left(text, at, max(least, at - 46), HEX_COLON)
    end, top = at, min(len(text), at + 46)
    while end < top and text[end] in HEX_COLON:
        end += 1
    end = start + len(text[start:end].rstrip("."))
    if end - start > 45 or text.count(":", start, end) < 3 or (start and (text[start - 1].isalnum() or text[start - 1] == ":")) or (end < len(text) and text[end].isalnum()):
        return start, end, False
    try:
        found = ipaddress.IPv6Address(text[start:end])
    except ValueError:
        return start, end, False
    return start, end, not (found.is_unspecified or found.is_loopback)


def _identifier(text: str, at: int, parser: str) -> tuple[str, int, int] | None:
    """(kind, start, end) of the number that a cue ending at ``at`` announces."""
    start = LEAD.match(text, at).end()
    if start == at:
        return None
    if parser == "iban":
        found = IBAN.match(text, start)
        # The longest reading that holds its check sum: words in capitals may follow the number.
        for end in range(found.end(), found.start() + 14, -1) if found else ():
            if (end == len(text) or not text[end].isalnum()) and iban_ok(text[found.start() : end].replace(" ", "")):
                return "account", found.start(), end
        return None
    if parser == "ssn":
        found = SSN.match(text, start)
        good = found and found[1] not in ("000", "666") and found[1] < "900" and found[2] != "00" and found[3] != "0000"
        return ("identity", *found.span()) if good else None
    found = (ACCOUNT if parser == "account" else PASSPORT).match(text, start)
    return ("account" if parser == "account" else "identity", *found.span()) if found else None


def base_and_rest(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans that overlap nothing before them), both by start and then kind."""
    base: list[tuple[str, int, int]] = []
    rest: list[tuple[str, int, int]] = []
    mail = wide = ip = card = six = 0  # how far each parser has read
    for last, (name, size) in anchors().iter(text):
        at = last - size + 1
        if name == "digit":
            if at >= ip:
                found = DOTTED.match(text, at)
                ip = found.end()
                parts = found[0].split(".")
                if len(parts) == 4 and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") < 256 for x in parts):
                    base.append(("ip", at, ip))
            if at >= card:
                found = GROUPED.match(text, at)
                card = found.end()
                if card - at >= CARD_DIGITS[0]:
                    digits = found[0].replace(" ", "").replace("-", "")
                    if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                        base.append(("card", at, card))
        elif name == "at":
            found = _email(text, at, mail)
            if found:
                mail = wide = found[1]
                base.append(("email", *found))
            elif found := _wide_email(text, at, max(mail, wide)):
                wide = found[1]
                rest.append(("mail", *found))
        elif name == "plus":
            found = _phone(text, at)
            if found and found[2]:
                base.append(("phone", *found[:2]))
        elif name == "colon":
            if at >= six:
                found = _ip6(text, at, six)
                six = max(found[1], last + 1)
                if found[2]:
                    rest.append(("ip6", *found[:2]))
        elif name == "spoken":
            if found := _spoken_email(text, at, last + 1):
                rest.append(("mail", *found))
        elif name == "mailto:":
            if found := ENCODED.match(text, last + 1):
                rest.append(("mail", *found.span()))
        elif name == "tel:":
            found = NUMBER.match(text, last + 1)
            if found and 7 <= sum(x in DIGITS for x in found[0]) <= PHONE_DIGITS[1]:
                rest.append(("tel", *found.span()))
        elif name == "://":
            if found := USERINFO.match(text, last + 1):
                rest.append(("login", *found.span()))
        # A cue is a word of its own.
        elif not (at and text[at - 1].isalnum()) and (found := _identifier(text, last + 1, name)):
            rest.append(found)
    base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    starts, furthest = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
    kept, end = [], 0
    for kind, s, e in sorted(set(rest), key=lambda x: (x[1], ADDED.index(x[0]), x[2])):
        before = bisect_left(starts, e)
        if s >= end and (not before or furthest[before - 1] <= s):
            kept.append((kind, s, e))
            end = e
    return base, kept


@F.pandas_udf(FOUND)
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    named = lambda spans: [dict(zip(("kind", "start", "end"), x)) for x in spans]
    for texts in batches:
        found = [base_and_rest(t) if t else ((), ()) for t in texts]
        yield pd.DataFrame({"base": [named(b) for b, _ in found], "added": [named(a) for _, a in found]})


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and all (arrays of kind, start, end; code points, end exclusive) of every whole text.

    ``base`` holds the four base kinds by start, then kind; ``all`` holds them and the added kinds.
    Added spans overlap neither base spans nor each other. Null and empty texts have no spans. Repeated
    rows give repeated results, null ids stay, other columns aren't read, an empty table gives no rows.
    """
    rank = F.array(*map(F.lit, KINDS + ADDED))
    both = F.transform(
        F.array_sort(F.transform(F.concat("found.base", "found.added"), lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    found = docs.select(F.col(id_col).alias("id"), _spans(F.col(text_col)).alias("found"))
    return found.select(F.col("id").alias(id_col), F.col("found.base").alias("base"), both.alias("all"))


def mask_text(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with every span replaced by its kind in ``mark``; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in sorted([y for x in base_and_rest(text) for y in x], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mark.format(kind.upper())]
        at = max(at, e)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([mask_text(t) for t in texts], dtype=object)


def masked(text: Column) -> Column:
    """``text`` without personal data: each span is replaced by its kind in brackets. Null stays null."""
    return _masked(text)
