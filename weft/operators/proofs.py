"""Cited lines of code and what became of them; keys and paths that code mentions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half of a surrogate pair: JSON can escape one, no column can hold it.
LONE = re.compile("[\ud800-\udfff]")

PROOF = r"([\w./-]+\.[A-Za-z]{1,5}):(\d+)(?:-(\d+))?"


def proof_references(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, n, file, lo, hi: every file:line or file:line-line of a page, in order."""
    found = pages.select(page, F.posexplode(F.regexp_extract_all(text, F.lit(PROOF), F.lit(0))).alias("n", "ref"))
    part = lambda i: F.regexp_extract("ref", PROOF, i)
    lo = part(2).cast("long")
    return found.select(page, "n", part(1).alias("file"), lo.alias("lo"), F.when(part(3) == "", lo).otherwise(part(3).cast("long")).alias("hi"))


def line_hashes(files: DataFrame) -> DataFrame:
    """file, line, hash of every line, white space at its ends aside."""
    lines = files.select("file", F.posexplode(F.split("text", "\r?\n")).alias("at", "l"))
    return lines.select("file", (F.col("at") + 1).cast("long").alias("line"), F.md5(F.trim("l")).alias("hash"))


def locate_proofs(proofs: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, hash, state, now: where a recorded line stands today.

    intact where it was; moved where its text stands on one other line; broken when the
    file is gone, the text isn't found, or it stands on several lines. ``proofs``: file,
    line, hash. Lines meet proofs by (file, hash), so a file's lines are hashed once.
    """
    now = line_hashes(files)
    there = files.select("file").distinct().withColumn("there", F.lit(True))
    found = now.join(proofs.select("file", "hash").distinct(), ["file", "hash"], "left_semi").groupBy("file", "hash").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    placed = proofs.join(there, "file", "left").join(found, ["file", "hash"], "left")
    n = F.coalesce(F.size("lines"), F.lit(0))
    state = (
        F.when(F.col("there").isNull(), "broken: file deleted")
        .when(F.coalesce(F.array_contains("lines", F.col("line")), F.lit(False)), "intact")
        .when(F.col("lines").isNull(), "broken: text not found")
        .when(n > 1, "broken: ambiguous")
        .otherwise("moved")
    )
    out = placed.withColumn("state", state)
    return out.select("file", "line", "hash", "state", F.when(F.col("state") == "moved", F.get("lines", F.lit(0))).when(F.col("state") == "intact", F.col("line")).alias("now"))


def page_drift(proofs: DataFrame, touched: DataFrame, states: DataFrame) -> DataFrame:
    """page, changed, touched, broken: how far each page's proofs have drifted.

    ``proofs``: page, file, lo, hi; ``touched``: file, lo, hi; ``states``: page, state.
    A range counts once, however many touched ranges it meets.
    """
    from weft.operators.joins import overlapping

    met = overlapping(proofs.select("file", "lo", "hi"), touched, "file").select("file", "lo", "hi")
    hit = proofs.join(met, ["file", "lo", "hi"], "left_semi").groupBy("page").agg(F.count_distinct("file", "lo", "hi").alias("touched"))
    counts = states.groupBy("page").agg(F.count_if(F.col("state") != "intact").alias("changed"), F.count_if(F.col("state").startswith("broken")).alias("broken"))
    return counts.join(hit, "page", "left").select("page", "changed", F.coalesce("touched", F.lit(0)).alias("touched"), "broken")


def label_changes(labels: DataFrame, recorded: DataFrame, cited: DataFrame) -> DataFrame:
    """file, key, old, new: labels that changed while a page still cites the old value (C17)."""
    both = recorded.withColumnRenamed("value", "old").join(labels.withColumnRenamed("value", "new"), ["file", "key"], "left")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).join(cited.select(F.col("value").alias("old")).distinct(), "old", "left_semi").select("file", "key", "old", "new")


def message_keys(code: DataFrame) -> DataFrame:
    """file, key: dotted literals and t("key") calls, each once a file."""
    calls = F.regexp_extract_all("text", F.lit(r"\bt\(\s*[\"']([\w.-]+)[\"']"), F.lit(1))
    dotted = F.regexp_extract_all("text", F.lit(r"[\"']([a-z][\w-]*(?:\.[\w-]+)+)[\"']"), F.lit(1))
    return code.select("file", F.explode(F.array_distinct(F.concat(calls, dotted))).alias("key"))


def api_paths(code: DataFrame) -> DataFrame:
    """file, path: literals of two segments or more that begin with a slash, ${…} as a parameter."""
    found = F.regexp_extract_all("text", F.lit(r"[\"'`](/[\w${}.\[\]:-]+(?:/[\w${}.\[\]:-]+)+)/?[\"'`?]"), F.lit(1))
    return code.select("file", F.explode(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\$\{[^}]*\}", ":param")))).alias("path"))


def _flat(text: str | None) -> list[dict[str, str]]:
    """Dotted key and value of every string leaf; nothing where the text is not valid JSON. Of equal keys the last one stays."""
    try:
        # Numbers are left out, so floats will do: they have no limit of digits.
        root = json.loads(text or "null", parse_int=float, parse_constant=_refuse)
    except ValueError:
        return []
    out, open_ = {}, [("", iter(root.items()))] if isinstance(root, dict) else []
    while open_:
        prefix, items = open_[-1]
        for name, value in items:
            key = f"{prefix}.{name}" if prefix else name
            if isinstance(value, str):
                out[key] = value
            elif isinstance(value, dict):
                open_.append((key, iter(value.items())))
                break
        else:
            open_.pop()
    return [{"key": LONE.sub("\ufffd", k), "value": LONE.sub("\ufffd", v)} for k, v in out.items()]


def _refuse(name: str) -> None:
    raise ValueError(name)


@F.pandas_udf(T.ArrayType(T.StructType().add("key", "string").add("value", "string")))
def _flat_messages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_flat(t) for t in texts], dtype=object)


def flat_messages(messages: DataFrame) -> DataFrame:
    """file, key, value: nested objects of strings as dotted keys (I01), at any depth.

    ``messages``: file, json. Values that aren't text are left out; strings stay as they
    are, whatever they look like.
    """
    return messages.select("file", F.explode(_flat_messages("json")).alias("m")).select("file", "m.key", "m.value")


def latest_records(records: DataFrame, key: str) -> DataFrame:
    """The record of the latest version for each key."""
    from weft.functions.text import version_key

    return records.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(version_key("version").desc()))).where("_r = 1").drop("_r")
