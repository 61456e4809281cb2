"""Secret scans with corpus-wide ownership frequency.

Candidates are found text by text. Their hashes are then aggregated over the whole
corpus by distinct repositories and distinct owners: a value that several owners or
many repositories carry is a copied example, a value that one owner carries in few
repositories is treated as live. Only values that look live add spans to those of
the three base patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.shared import stash

KINDS = ("assign", "access", "hex")
#: The base patterns, each with the least length that its value has.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: A text without one of these, in any case, has no assignment.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Private keys: the header, the end, what separates the characters of a body, and the stretch that counts as one without an end.
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
KEY_FILLER = re.compile(r"\\[nr]|[^A-Za-z0-9+/=]")
KEY_STRETCH = re.compile(r"(?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*(?:(?:\s|\\[nr])*[A-Za-z0-9+/]+={1,2})?")
#: Shapes that only count when the corpus shows one owner for the value.
EXTRA = re.compile(
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})"
    r"|(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"
)
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]|xxxx|1234567", re.IGNORECASE)

SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
CANDIDATE = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("hash", "string").add("strong", "boolean")
FOUND = T.StructType().add("base", T.ArrayType(SPAN)).add("candidates", T.ArrayType(CANDIDATE))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns, by start and then by kind."""
    found = []
    if (":" in text or "=" in text) and any(x in low for low in [text.lower()] for x in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def is_strong(value: str) -> bool:
    """Random-looking: letters and digits mixed, high entropy, and no word that marks an example."""
    return entropy(value) >= 3.0 and any(x.isdigit() for x in value) and any(x.isalpha() for x in value) and not PLACEHOLDER.search(value)


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def key_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of private keys, up to their END line, or as far as the text looks like a body where it is missing.

    The body is what tells keys apart, however its lines are wrapped. A header without one has its own line instead.
    """
    begins = list(KEY_BEGIN.finditer(text)) if "PRIVATE KEY" in text else []
    found = []
    for m, limit in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        last = KEY_END.search(text, m.end(), limit)
        body_end, end = last.span() if last else [KEY_STRETCH.match(text, m.end(), limit).end()] * 2
        found.append((m.start(), end, KEY_FILLER.sub("", text[m.end() : body_end]) or m[0]))
    return found


def extra_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of the extra shapes: whole private keys, and strong values between them."""
    keys = key_spans(text)
    found = list(keys)
    for at, limit in zip([0, *(e for _, e, _ in keys)], [*(s for s, _, _ in keys), len(text)]):
        found += [(at + m.start(), at + m.end(), m[0]) for m in EXTRA.finditer(text[at:limit]) if is_strong(m[0])]
    return sorted(found)


def scan_text(text: str | None) -> tuple[list, list]:
    """(base spans, candidates with hashes) of one text. Candidates hold the base values and the extra shapes."""
    if not text:
        return [], []
    base = base_spans(text)
    candidates = [(k, s, e, _digest(v), is_strong(v)) for k, s, e, v in base]
    # Base spans come by start, so one overlaps when the furthest end of those that start before it does.
    starts, furthest = [s for _, s, _, _ in base], list(accumulate((e for _, _, e, _ in base), max))
    for s, e, v in extra_spans(text):
        # A key counts even where a base pattern meets its header ("secret: -----BEGIN").
        before = bisect_left(starts, e)
        if text.startswith("-----BEGIN", s) or not before or furthest[before - 1] <= s:
            candidates.append(("extra", s, e, _digest(v), True))
    return [x[:3] for x in base], candidates


@F.pandas_udf(FOUND)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [scan_text(t) for t in texts]
        yield pd.DataFrame(
            {
                "base": [[dict(zip(("kind", "start", "end"), x)) for x in b] for b, _ in found],
                "candidates": [[dict(zip(("kind", "start", "end", "hash", "strong"), x)) for x in c] for _, c in found],
            }
        )


def _scanned(docs: DataFrame, row: Column, id_col: str, text_col: str, owner_col: str, repo_col: str | None) -> DataFrame:
    """uid, row, repo, owner, base, candidates of every row, written once so that uid stays the same."""
    rows = docs.select(
        row.alias("row"),
        F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        _scan(F.col(text_col)).alias("found"),
    )
    return stash(rows.select("row", "repo", "owner", "found.*").withColumn("uid", F.monotonically_increasing_id()), "secrets")


def _judged(scanned: DataFrame, max_owners: int, example_owners: int, max_repos: int, example_repos: int) -> DataFrame:
    """uid, added (live spans of the extra shapes), n_live, n_example of the rows that hold candidates."""
    seen = scanned.where(F.size("candidates") > 0).select("uid", "repo", "owner", F.explode("candidates").alias("c"))
    # Ownership counts: rows are made distinct by value and owner, and by value and repository, before a value's rows meet.
    owners = stash(seen.groupBy("c.hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos")), "owners")
    judged = seen.select("uid", F.col("c.hash").alias("hash"), "c").join(owners, "hash")
    live = F.col("c.strong") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    return judged.groupBy("uid").agg(
        F.collect_list(F.when(live & (F.col("c.kind") == "extra"), F.struct("c.kind", "c.start", "c.end"))).alias("added"),
        F.count_if(live).alias("n_live"),
        F.count_if(example).alias("n_example"),
    )


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 1, example_owners: int = 3, max_repos: int = 10, example_repos: int = 30
) -> DataFrame:
    """Secrets of every whole text: id, base and all (arrays of kind, start, end), n_live long, n_example long.

    ``owner_col`` names who a row belongs to and ``repo_col`` the repository (the
    row's id where there is none). A candidate is live when it looks random and at
    most ``max_owners`` owners carry it in at most ``max_repos`` repositories, an
    example when ``example_owners`` owners or ``example_repos`` repositories or more
    do. Base spans always stay; live candidates of the extra shapes are added.

    Null and empty texts have no spans. A null owner counts as one owner of its own.
    Repeated rows give repeated results; they count as one repository. Other columns
    of ``docs`` are not read, so their names can't clash. An empty table gives no rows.
    """
    scanned = _scanned(docs, F.col(id_col), id_col, text_col, owner_col, repo_col)
    added = _judged(scanned, max_owners, example_owners, max_repos, example_repos)
    rank = lambda x: F.when(x["kind"] == "extra", 9).otherwise(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int"))
    by_start = lambda xs: F.transform(
        F.array_sort(F.transform(xs, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    none = F.array().cast(T.ArrayType(SPAN))
    return (
        scanned.select("uid", "row", "base")
        .join(added, "uid", "left")
        .select(
            F.col("row").alias(id_col),
            "base",
            by_start(F.concat("base", F.coalesce("added", none))).alias("all"),
            F.coalesce("n_live", F.lit(0)).alias("n_live"),
            F.coalesce("n_example", F.lit(0)).alias("n_example"),
        )
    )


@F.pandas_udf(T.StringType())
def _redact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, added in batches:
        yield pd.Series([redact_text(t, added=[(x["start"], x["end"]) for x in a] if a is not None else ()) for t, a in zip(texts, added)], dtype=object)


def redact_text(text: str | None, mark: str = "[SECRET]", added: Iterable[tuple[int, int]] = ()) -> str | None:
    """The text with every base span and every one of ``added`` replaced by ``mark``; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for s, e in sorted([*((s, e) for _, s, e, _ in base_spans(text)), *added]):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_col: str | None = None, max_owners: int = 1, example_owners: int = 3, max_repos: int = 10, example_repos: int = 30
) -> DataFrame:
    """``docs`` with the spans that ``find_secrets`` calls "all" replaced in ``text_col``: base secrets and live extra ones.

    Every row and column stays. Null texts stay null. Only rows with a candidate of
    the extra shapes meet the verdicts in a join; the others are rewritten in place.
    """
    scanned = _scanned(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), id_col, text_col, owner_col, repo_col)
    added = _judged(scanned, max_owners, example_owners, max_repos, example_repos).where(F.size("added") > 0).select("uid", "added")
    extra = F.exists("candidates", lambda c: c["kind"] == "extra")
    met = scanned.where(extra).select("uid", "row").join(added, "uid", "left").select("row", "added")
    rows = met.unionByName(scanned.where(~extra).select("row", F.lit(None).cast(T.ArrayType(SPAN)).alias("added")))
    text = F.col("row").getField(text_col)
    return rows.select(*[(_redact(text, "added") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
