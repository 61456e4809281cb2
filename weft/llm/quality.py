"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded labelled sample, every path from a root becomes
a conjunctive rule, a lasso logistic regression keeps the few rules that matter, and
those are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.shared import stash

#: Statistics of one text, in this order.
STATS = (
    "log_chars",
    "log_words",
    "word_length",
    "upper_words",
    "short_words",
    "repeated_next",
    "distinct_words",
    "digits",
    "symbols",
    "marks",
    "upper_letters",
    "non_ascii",
    "line_words",
    "repeated_lines",
    "least_window",
    "lone_marks",
)
#: Distinct words are counted in windows of so many, so that long texts compare with short ones.
WINDOW = 100
STAT_TYPE = T.StructType([T.StructField(x, T.DoubleType()) for x in STATS])
_CLASS = np.zeros(256, np.int64)  # of a UTF-8 byte: 0 other, 1 digit, 2 symbol, 3 mark, 4 capital, 5 continuation or lead byte
_CLASS[ord("0") : ord("9") + 1] = 1
_CLASS[[ord(x) for x in "#$%&*@^_|~<>{}[]=+/\\`"]] = 2
_CLASS[[ord(x) for x in ".,;:!?'\"()-"]] = 3
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[128:] = 5


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one whole text; a null text counts as an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=6) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    whole = [len(set(words[i : i + WINDOW])) / WINDOW for i in range(0, len(words) - WINDOW + 1, WINDOW)] or [len(set(words)) / n]
    once = sum(map(len, set(lines)))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n,
        sum(map(str.isupper, words)) / n,
        sum(len(w) <= 2 for w in words) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(whole) / len(whole),
        kinds[1],
        kinds[2],
        kinds[3],
        kinds[4],
        kinds[5],
        n / max(1, len(lines)),
        1 - once / max(1, sum(map(len, lines))),
        min(whole),
        sum(w in LONE for w in words) / n,
    ]


LONE = frozenset("| - * # = + / \\ · • ~".split())


@F.pandas_udf(STAT_TYPE)
def text_statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame(np.array([statistics_of(x) for x in texts], float).reshape(-1, len(STATS)), columns=list(STATS))


#: One test of a statistic: its name, whether it must be above, and the threshold.
Test = tuple[str, bool, float]


@dataclass
class RuleModel:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[Test, ...], float]] = field(default_factory=list)

    def score(self, stats: str) -> Column:
        """The compiled ensemble over a struct column of statistics."""
        total = F.lit(self.bias)
        for tests, weight in self.rules:
            total = total + F.when(holds(tests, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def holds(tests: tuple[Test, ...], stats: str) -> Column:
    found = F.lit(True)
    for name, above, at in tests:
        found = found & (F.col(f"{stats}.{name}") > at if above else F.col(f"{stats}.{name}") <= at)
    return found


def tree_rules(debug: str) -> list[tuple[Test, ...]]:
    """Every path of a printed tree, each cut to the tightest test of a statistic and side."""
    found, path = [], []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (-?[\d.E+-]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (STATS[int(m[2])], m[3] == ">", float(m[4])))]
        tight: dict[tuple[str, bool], float] = {}
        for _, (name, above, at) in path:
            old = tight.get((name, above), at)
            tight[name, above] = max(old, at) if above else min(old, at)
        found.append(tuple(sorted((name, above, at) for (name, above), at in tight.items())))
    return found


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_rows: int = 20_000,
    trees: int = 24,
    depth: int = 3,
    lasso: float = 0.0005,
    seed: int = 7,
) -> RuleModel:
    """Fit on at most ``max_rows`` labelled ids, those whose hash is smallest.

    Null labels and ids take no part. Of labels that contradict each other for one id
    the larger counts. Each row of a labelled id is one row of the sample, so ids that repeat go beyond
    ``max_rows`` by their repetitions. With one class only, the score is its share
    smoothed by one row of each; without labels it is one half.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    known = stash(known.withColumn("h", F.xxhash64("id")).orderBy("h").limit(max_rows), "labels")
    # The sample has max_rows rows of three numbers at most, so it may be broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    sample = stash(rows.select("label", text_statistics("text").alias("s")), "sample").withColumn("features", array_to_vector(F.array(*[f"s.{x}" for x in STATS])))
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        n, good = sum(counts.values()), counts.get(1.0, 0)
        return RuleModel(float(np.log((good + 1) / (n - good + 1))))
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", seed=seed, minInstancesPerNode=2).fit(sample)
    paths = sorted({x for tree in forest.trees for x in tree_rules(tree.toDebugString)})
    if not paths:
        return RuleModel(float(np.log(counts[1.0] / counts[0.0])))
    held = sample.select("label", array_to_vector(F.array(*[holds(p, "s").cast("double") for p in paths])).alias("features"))
    fitted = LogisticRegression(labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(stash(held, "rules"))
    return RuleModel(float(fitted.intercept), [(p, float(w)) for p, w in zip(paths, fitted.coefficients.toArray()) if w])


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score double (0 to 1) of every row; null texts are scored as empty ones.

    Repeated rows give repeated results, other columns aren't read, an empty table
    gives no rows.
    """
    return docs.select(F.col(id_col), text_statistics(F.col(text_col)).alias("s")).select(id_col, model.score("s").alias("score"))


def keep_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is ``least`` or more."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_statistics(F.col(text_col)).alias("s"))
    return rows.where(model.score("s") >= least).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
