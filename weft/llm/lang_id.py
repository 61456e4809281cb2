"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered by Spark from a bounded sample of labelled rows, the matrix of
log-probabilities is broadcast, and texts are scored in numpy, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Fixed odd multipliers of the n-gram hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
#: Code points are hashed in slices of so many, so that a very long text needs little memory.
SLICE = 1 << 18
UNKNOWN = "und"


def ngram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of each n-gram of each order; element i stands for the n-gram that starts at i."""
    h = np.zeros(len(codes), np.uint32)
    found = []
    for n in ORDERS:
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(MULTIPLIERS[1]) + codes[n - 1 :] * np.uint32(MULTIPLIERS[0])
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(MULTIPLIERS[2]) + np.uint32(n)
        found.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return found


class Folded:
    """Lower-cased code points by table: letters as they are, runs of anything else as one space."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x110000, bool)

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.known[raw].all():
            for c in np.unique(raw[~self.known[raw]]).tolist():
                x = chr(c)
                self.table[c] = ord(x.lower()[0]) if x.isalpha() else 32
                self.known[c] = True
        folded = self.table[raw]
        space = folded == 32
        return folded[~(space & np.concatenate(([True], space[:-1])))] if len(folded) else folded


@dataclass
class LanguageModel:
    """langs[i] has the log-probabilities weights[:, i] and the log-prior prior[i]."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def joint(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log-joint of each language for each text, given as code points.

        The n-grams of about SLICE code points at a time, of many short texts or a part of a long one, are the
        entries of one sparse matrix with a row for each piece, which is multiplied with the weights.
        """
        total = np.tile(self.prior.astype(float), (len(texts), 1))
        weights = np.vstack([self.weights, np.zeros((1, len(self.langs)))])  # the last row is for what crosses two pieces
        pieces = [(i, codes[lo : lo + SLICE + max(ORDERS) - 1]) for i, codes in enumerate(texts) for lo in range(0, len(codes), SLICE)]
        share = np.cumsum([len(c) for _, c in pieces]) // SLICE
        for group in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(share)) + 1) if pieces else ():
            rows, parts = [pieces[k][0] for k in group], [pieces[k][1] for k in group]
            sizes = np.array([len(c) for c in parts])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
            for n, h in zip(ORDERS, ngram_buckets(np.concatenate(parts))):
                columns = np.full(len(place), BUCKETS, np.int64)
                own = place < np.repeat(np.minimum(SLICE, sizes - n + 1), sizes)
                columns[own] = h[own[: len(h)]]
                np.add.at(total, rows, np.add.reduceat(weights[columns], starts, axis=0))
        return total

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log-joint of each language for one text."""
        return self.joint([codes])[0]

    def predict(self, texts: list[str | None], folded: Folded) -> pd.DataFrame:
        """lang_pred, score (the posterior); ``und`` and 0 for a null text, one without letters, or a model without languages."""
        codes = [folded.codes(t) if t and self.langs else np.zeros(0, np.uint32) for t in texts]
        known = np.array([bool((c != 32).any()) for c in codes], dtype=bool)
        found = pd.DataFrame({"lang_pred": [UNKNOWN] * len(codes), "score": [0.0] * len(codes)})
        if known.any():
            joint = self.joint([c for c, k in zip(codes, known) if k])
            best = joint.argmax(axis=1)
            found.loc[known, "lang_pred"] = [self.langs[i] for i in best]
            found.loc[known, "score"] = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
        return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each language and order of the task: its counts as an array of BUCKETS numbers."""
    folded, counts, docs = Folded(), {}, {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            codes = folded.codes(text or "")
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            docs[lang] = docs.get(lang, 0) + 1
            for lo in range(0, len(codes), SLICE):
                for h in ngram_buckets(codes[lo : lo + SLICE + max(ORDERS) - 1]):
                    own += np.bincount(h[:SLICE], minlength=BUCKETS)
    for lang, own in counts.items():
        at = own.nonzero()[0]
        yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(own[at], docs[lang])})


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = 20_000, smoothing: float = 0.5) -> LanguageModel:
    """Fit on at most ``max_rows`` labelled rows, those whose hashed id is smallest.

    Rows with a null language take no part; null and empty texts only count towards
    the prior. No labelled rows give a model that answers ``und``. What reaches the
    driver is the summed counts: at most BUCKETS numbers for each language of the sample.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen = rows.select(F.xxhash64("id").alias("h")).orderBy("h").limit(max_rows).agg(F.max("h"), F.count("*")).first()
    if not chosen[1]:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    sample = rows.where(F.xxhash64("id") <= chosen[0]).select("lang", "text")
    summed = sample.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    prior = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = summed[summed["lang"] == lang]
        prior[i] = own["n"][own["bucket"] == -1].sum()
        own = own[own["bucket"] >= 0]
        counts[own["bucket"].to_numpy(), i] = own["n"].to_numpy()
    weights = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=0))
    return LanguageModel(langs, weights.astype(np.float32), np.log(prior / prior.sum()))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred string, score double for every row; the whole text is read.

    Null texts and texts without a letter get ``und`` and 0. Repeated rows give
    repeated results, other columns are not read, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.prior))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, folded = LanguageModel(*shared.value), Folded()
        for texts in batches:
            yield own.predict(list(texts), folded)

    return docs.select(F.col(id_col), run(F.col(text_col)).alias("found")).select(id_col, "found.*")
