"""Substring dedup with difference-cover anchors.

A window of words is repeated if the same words start anywhere else. Anchors, which
are shorter windows, are hashed only at positions that a difference cover takes
modulo its period. Any two equal windows share an anchor at the same offset, so a
window without an anchor that occurs twice is unique and costs nothing more. The
other windows are hashed in full and counted, which extends an anchor's match to
both sides without listing the pairs of documents that share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.shared import stash
from weft.llm.word_hash import WordHashes, run_hashes, signed, words_of

#: Perfect difference sets; every distance modulo the period is a difference of two elements.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(window: int) -> tuple[int, int]:
    """(period, anchor length): the longest period whose anchors keep two fifths of the window's length."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)
    return period, window - period + 1


def _emit(hashes: list[np.ndarray], docs: np.ndarray, at: np.ndarray, k1: np.ndarray, k2: np.ndarray, names: list[str]) -> pd.DataFrame:
    """Rows of one batch. Of what the batch itself repeats, one row carries the hash on, the others are spread."""
    order = np.lexsort(hashes[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for h in hashes:
        same &= h[order][1:] == h[order][:-1]
    after, before = np.append(same, False)[: len(order)], np.append(False, same)[: len(order)]
    known = np.zeros(len(order), np.int8)
    known[order] = np.where(before, 2, np.where(after, 1, 0))
    out = {name: signed(h).copy() for name, h in zip(names, hashes)}
    own1, own2 = k1[docs], k2[docs]
    spread = known == 2
    for name in names:
        out[name][spread] = own1[spread] ^ (own2[spread] * 31 + at[spread])
    return pd.DataFrame(out | {"k1": own1, "k2": own2, "at": at.astype(np.int32), "known": known})


def _anchors(window: int):
    period, length = cover_for(window)
    cover = np.array(COVERS[period])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for pdf in batches:
            found, docs, at = [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)]
            for i, text in enumerate(pdf["text"]):
                words = words_of(text)
                if len(words) < window:
                    continue
                h = run_hashes(memo.of(words), length)
                taken = (np.arange(0, len(h), period)[:, None] + cover).ravel()
                taken = taken[taken < len(h)]
                found.append(h[taken])
                docs.append(np.full(len(taken), i))
                at.append(taken)
            yield _emit([np.concatenate(found)], np.concatenate(docs), np.concatenate(at), pdf["k1"].to_numpy(), pdf["k2"].to_numpy(), ["h"])

    return run


def _windows(window: int):
    period, _ = cover_for(window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for pdf in batches:
            one, two, docs, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, int)], [np.zeros(0, int)]
            for i, (text, anchors) in enumerate(zip(pdf["text"], pdf["anchors"])):
                words = memo.of(words_of(text))
                n = len(words) - window + 1
                # A window can be repeated if one of the anchors that start in its first period is.
                starts = (np.asarray(anchors)[:, None] - np.arange(period)).ravel()
                possible = np.zeros(n, bool)
                possible[starts[(starts >= 0) & (starts < n)]] = True
                taken = possible.nonzero()[0]
                one.append(run_hashes(words, window)[taken])
                two.append(run_hashes(words, window, 1)[taken])
                docs.append(np.full(len(taken), i))
                at.append(taken)
            yield _emit([np.concatenate(one), np.concatenate(two)], np.concatenate(docs), np.concatenate(at), pdf["k1"].to_numpy(), pdf["k2"].to_numpy(), ["w1", "w2"])

    return run


def kept_words(text: str | None, starts, window: int) -> tuple[list[bytes], int]:
    """(words that no repeated window covers, number of words)."""
    words = words_of(text)
    if starts is None or not len(starts):
        return words, len(words)
    edge = np.zeros(len(words) + 1, int)
    np.add.at(edge, np.asarray(starts), 1)
    np.add.at(edge, np.asarray(starts) + window, -1)
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """k1, k2 and the sorted positions of what occurs twice or more."""
    counted = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1 OR known > 0")
    return counted.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias(name))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """id, kept string, n_words long, n_removed long, kept_sha256 string for each row.

    Every word that a repeated window of ``window`` words covers is removed; windows
    are judged on the input, and a window of the same document counts as well. Kept
    words are joined by one space.

    Null and empty texts have no words. Rows that repeat both id and text share their
    result, and their windows count as repeated. Null ids are kept as they are. Other
    columns aren't read, so their names can't clash. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(F.xxhash64("text").alias("k1"), F.xxhash64("id").alias("k2"), "id", "text")
    anchors = rows.select("k1", "k2", "text").mapInPandas(_anchors(window), "h long, k1 long, k2 long, at int, known byte")
    flagged = stash(_repeated(anchors, ["h"], "anchors"), "anchors")
    # The texts are dealt by key once; both joins below read the same exchange.
    dealt = rows.repartition("k1", "k2")
    candidates = dealt.join(flagged, ["k1", "k2"]).select("k1", "k2", "id", "text", "anchors")
    windows = candidates.mapInPandas(_windows(window), "w1 long, w2 long, k1 long, k2 long, at int, known byte")
    starts = _repeated(windows, ["w1", "w2"], "starts")

    @F.pandas_udf(T.StructType().add("kept", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string"))
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out = []
            for text, own in zip(texts, lists):
                words, n = kept_words(text, own, window)
                kept = b" ".join(words)
                out.append((kept.decode("utf-8", "replace"), n, n - len(words), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["kept", "n_words", "n_removed", "kept_sha256"])

    return dealt.join(starts, ["k1", "k2"], "left").select(F.col("id").cast(id_type).alias(id_col), keep("text", "starts").alias("r")).select(id_col, "r.*")
