"""Version ranges as npm writes them, tested and bounded row by row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A version or its first parts. A part has no leading zero; labels and build data follow a third part only.
NUMBER = r"(0|[1-9][0-9]*|[xX*])"
LABELS = r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
PART = re.compile(rf"v?{NUMBER}(?:\.{NUMBER}(?:\.{NUMBER}(?:-({LABELS}))?(?:\+{LABELS})?)?)?")
SIGN = re.compile(r"~>|[<>]=|[~^<>=]|")
PADDED = re.compile(r"0[0-9]+")
#: A release comes after all of its pre-releases; the least of these has no label.
RELEASE = ((1,),)
LEAST = ((0,),)
START = (0, 0, 0, LEAST)
NOTHING = ((float("inf"),), None)


def order_of(pre: str | None) -> tuple:
    """Sorts pre-releases: numbers before words, fewer parts first."""
    return ((0, *((0, int(x), "") if x.isdigit() else (1, 0, x) for x in pre.split("."))),) if pre else RELEASE


def parts_of(text: str) -> tuple[tuple[int, ...], str | None] | None:
    """(the numbers before the first x, the pre-release of a whole version); None for what is no version."""
    m = PART.fullmatch(text)
    if not m or any(PADDED.fullmatch(x) for x in (m[4] or "").split(".")):
        return None
    given = [x if x and x not in "xX*" else None for x in m.group(1, 2, 3)]
    known = next((i for i, x in enumerate(given) if x is None), 3)
    return tuple(map(int, given[:known])), m[4] if known == 3 else None


def bounds(comparator: str) -> tuple[tuple, tuple | None, tuple | None] | None:
    """(lowest version, first version above, numbers of a pre-release that it names) of one comparator; None for what is none."""
    sign = SIGN.match(comparator)[0]
    read = parts_of(comparator[len(sign) :])
    if not read:
        return None
    given, pre = read
    known = len(given)
    if not known:
        return (*NOTHING, None) if sign in ("<", ">") else (START, None, None)
    low = (*given, *[0] * (3 - known))
    exact, names = (*low, order_of(pre)), low if pre else None
    floor = START if exact == (0, 0, 0, RELEASE) else exact

    def below(at: int) -> tuple:
        """Below the version that is one higher at part ``at``, and below its pre-releases."""
        return (*low[:at], low[at] + 1, *[0] * (2 - at), LEAST)

    after = below(known - 1) if known < 3 else (*exact, 0)
    if sign == "^":
        return floor, below(next((i for i in range(known) if low[i]), known - 1)), names
    if sign.startswith("~"):
        return floor, below(min(1, known - 1)), names
    if sign == ">":
        return after if known == 3 else (*after[:3], RELEASE), None, names
    if sign == ">=":
        return floor, None, names
    if sign == "<":
        return START, exact if known == 3 else (*low, LEAST), names
    if sign == "<=":
        return START, after, names
    return exact if known == 3 else floor, after, names


def alternatives(text: str | None) -> list[list[tuple]] | None:
    """Comparators of each alternative; None for what is no range."""
    out = []
    for part in (text or "").split("||"):
        words = part.split()
        if len(words) == 3 and words[1] == "-":
            if SIGN.match(words[0])[0] or SIGN.match(words[2])[0]:
                return None
            words = [f">={words[0]}", f"<={words[2]}"]
        found = [bounds(w) for w in re.sub(r"(?<![^\s])(~>|[<>]=|[~^<>=])\s+", r"\1", " ".join(words)).split() or ["*"]]
        if None in found:
            return None
        out.append(found)
    # One alternative without bounds makes the range one that allows any release.
    if any(all(low == START and high is None and not names for low, high, names in every) for every in out):
        return [[(START, None, None)]]
    return out


def allows(every: list[tuple], own: tuple) -> bool:
    """Whether all comparators hold; a pre-release must be of numbers that one of them names with a pre-release."""
    return all(low <= own and (high is None or own < high) for low, high, _ in every) and (own[3] == RELEASE or any(names == own[:3] for _, _, names in every))


def version_of(text: str | None) -> tuple | None:
    """A whole version as it sorts."""
    read = parts_of((text or "").strip())
    return (*read[0], order_of(read[1])) if read and len(read[0]) == 3 else None


def is_within(version: str | None, text: str | None) -> bool | None:
    """Whether a version meets a range; null where one of the two can't be read."""
    own, ranges = version_of(version), alternatives(text)
    return None if own is None or ranges is None else any(allows(every, own) for every in ranges)


def lowest(text: str | None) -> str | None:
    """The lowest version that a range allows: a release, or a pre-release that one of its bounds names; null for none."""
    ranges = alternatives(text) or []
    zero = (0, 0, 0, order_of("0"))
    found = [own for own in ((0, 0, 0, RELEASE), zero) if any(allows(every, own) for every in ranges)][:1]
    for every in ranges if not found else ():
        low = max(b[0] for b in every)
        if len(low) == 5:  # above a release comes its next patch, above a pre-release the same with one more label
            low = (*low[:2], low[2] + 1, RELEASE) if low[3] == RELEASE else (*low[:3], ((*low[3][0], (0, 0, "")),))
        if len(low) == 4 and allows(every, low):
            found.append(low)
    if not found:
        return None
    *numbers, pre = min(found)
    labels = ".".join(x or str(n) for _, n, x in pre[0][1:])
    return ".".join(map(str, numbers)) + (f"-{labels}" if labels else "")


@F.pandas_udf(T.BooleanType())
def satisfies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Range test (H02); null where one of the two can't be read."""
    for versions, ranges in batches:
        yield pd.Series([is_within(v, r) for v, r in zip(versions, ranges)], dtype=object)


@F.pandas_udf(T.StringType())
def min_version(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lowest version of a range."""
    for ranges in batches:
        yield pd.Series([lowest(r) for r in ranges], dtype=object)
