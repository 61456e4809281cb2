"""Nearest neighbours, embedding duplicates, repeated substrings, Jaccard links: brute force on small tables."""

import hashlib
import math
import pathlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.llm import ngram_join, rp_forest, shared, substring_dedup, word_hash

WORDS = re.compile("[^\x20\x09-\x0d]+")


def vectors_of(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit(1)).withColumn("n", F.lit(2))


def some_vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[: n // 10] = base[0] + rng.normal(size=(n // 10, dim)) * 0.05  # a dense group
    base[n // 10 : n // 5] = base[n - 1]  # copies
    return base


ODD = [(9000, [1.0] * 5, 0), (9001, None, 0), (9002, [0.0] * 8, 0), (9003, [1.0] * 7 + [float("nan")], 0), (9004, [float("inf")] * 8, 0), (9005, [1.0] * 7 + [None], 0), (9006, [], 0), (None, [1.0] * 8, 0)]


def test_nearest(spark):
    base = some_vectors(400, 8, 1)
    df = vectors_of(spark, [(i, base[i].tolist(), 0) for i in range(400)] + ODD)
    got = {}
    for r in rp_forest.nearest(df, lambda i: i % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    scores = base @ base.T
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21)) and q not in {x[1] for x in found}
        assert all(math.isclose(s, scores[q, v], rel_tol=1e-12, abs_tol=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        truth = sorted((j for j in range(400) if j != q), key=lambda j: (-scores[q, j], j))[:20]
        hits += len(set(truth) & {x[1] for x in found})
    assert hits / (20 * len(got)) >= 0.9


def uniform_and_grouped(n, dim, seed):
    """Half of the vectors without any near neighbour, half in groups of 50."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    centres = rng.normal(size=(n // 100, dim))
    base[: n // 2] = centres[np.arange(n // 2) % len(centres)] + 0.3 * rng.normal(size=(n // 2, dim))
    return base / np.linalg.norm(base, axis=1, keepdims=True)


@pytest.mark.parametrize("seed", [3])
def test_recall_of_nearest_in_64_dimensions(spark, seed):
    base = uniform_and_grouped(6000, 64, seed)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {}
    for r in rp_forest.nearest(df, lambda i: i % 20 == 0, 20, leaf_rows=32).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = base @ base.T
    np.fill_diagonal(scores, -9)
    hits = [len(set(np.argsort(-scores[q], kind="stable")[:20].tolist()) & got[q]) for q in range(0, 6000, 20)]
    assert set(map(len, got.values())) == {20} and np.mean(hits) / 20 >= 0.9


def test_recall_of_embedding_duplicates_in_64_dimensions(spark):
    """Pairs planted at a cosine of 0.9 to 0.95, with the settings of the registered query."""
    rng = np.random.default_rng(8)
    n = 4000
    base = rng.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for i in range(0, n // 2, 2):
        cos, away = rng.uniform(0.901, 0.95), rng.normal(size=64)
        away -= away @ base[i] * base[i]
        base[i + 1] = cos * base[i] + math.sqrt(1 - cos * cos) * away / np.linalg.norm(away)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_duplicates(df, 0.9).collect()}
    linked = base @ base.T >= 0.9
    np.fill_diagonal(linked, False)
    truth = linked.sum(axis=1)
    assert all(got[i][0] <= truth[i] for i in range(n)) and sum(g[0] for g in got.values()) >= 0.95 * truth.sum()


def test_nearest_of_few(spark):
    df = vectors_of(spark, [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (3, [0.5, 0.0], 0)])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rp_forest.nearest(df, lambda i: i % 20 == 0, 20).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert rp_forest.nearest(df.where("false"), lambda i: i % 20 == 0, 20).count() == 0
    assert rp_forest.nearest(vectors_of(spark, ODD[:3]), lambda i: i % 1 == 0, 20).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_embedding_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(rp_forest, "BLOCK_ROWS", block)
    base = some_vectors(300, 8, 2)
    df = vectors_of(spark, [(i, base[i].tolist(), 0) for i in range(300)] + ODD)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rp_forest.near_duplicates(df, 0.9, leaf_rows=40).collect()}
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    links = sum(got[i][0] for i in range(300))
    assert links <= linked.sum() and links >= 0.97 * linked.sum()
    label = list(range(300))
    for _ in range(300):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(linked[i]))]) for i in range(300)]
    assert sum(got[i][1] == label[i] for i in range(300)) >= 290
    for i, *_ in ODD[:-1]:
        assert got[i] == (0, i, True)
    assert all(kept == (i == c) for i, (_, c, kept) in got.items() if i is not None)
    assert rp_forest.near_duplicates(df.where("false")).count() == 0


def test_difference_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substring_dedup.cover_for(35) == (21, 15) and substring_dedup.cover_for(3) == (1, 3)


def test_run_hashes_depend_on_the_words_alone():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 5, 300).astype(np.uint64)
    for length in (1, 2, 3, 7, 15, 35):
        h = word_hash.run_hashes(words, length)
        for i in range(0, len(h), 17):
            for j in range(len(h)):
                assert (h[i] == h[j]) == bool((words[i : i + length] == words[j : j + length]).all())


def kept_by_brute_force(texts, window):
    tokens = [WORDS.findall(t or "") for t in texts]
    seen = {}
    for w in tokens:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] = seen.get(tuple(w[k : k + window]), 0) + 1
    out = []
    for w in tokens:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


@pytest.mark.parametrize("window", [3, 8, 35])
def test_repeated_substrings(spark, window):
    rng = random.Random(window)
    words = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(words) for _ in range(2 * window)]
    texts = [None, "", "one", " \t "]
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(body)), rng.randint(0, window)
            body[at:at] = passage[cut : cut + window + rng.randint(-1, 2)]
        texts.append("  ".join(body) + rng.choice(["", "\n", "\x0b"]))
    texts += [texts[10], texts[10], " ".join(["again"] * (window + 1)), "ü" * 300 + " " + "\n".join(passage)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("k1", F.lit(2))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, window=window).collect()}
    for i, (kept, n, removed) in enumerate(kept_by_brute_force(texts, window)):
        assert (got[i].kept, got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (kept, n, removed, hashlib.sha256(kept.encode()).hexdigest()), i


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()), key=repr)
    assert got == sorted([(1, 40, 40), (1, 40, 40), (None, 2, 0), (None, 0, 0)], key=repr)
    assert substring_dedup.remove_repeats(df.where("false")).count() == 0


def links_by_brute_force(texts, size, percent):
    low = {c: c + 32 for c in range(65, 91)}
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size,percent,frequent", [(3, 90, 64), (3, 90, 0), (5, 80, 64), (5, 80, 2), (1, 60, 1)])
def test_jaccard_links(spark, monkeypatch, size, percent, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "PAIRS_A_MEMBER", 1)
    rng = random.Random(size * percent + frequent)
    words = [f"w{i}" for i in range(300)]
    shared_line = [rng.choice(words) for _ in range(25)]
    texts = [None, "", "a", "A", "a b", "b a", " a\tb "]
    for n in (4, 9, 12, 39, 41, 47, 50, 120, 300):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own + (shared_line if rng.random() < 0.2 else [])))
    texts += [texts[20], texts[20].upper()] + [" ".join(shared_line + [rng.choice(words) for _ in range(30)]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_links(df, size=size, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == links_by_brute_force(texts, size, percent)


def test_jaccard_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    df = spark.createDataFrame([(3, long), (2, long + " end"), (2, long + " end"), (None, "a b c d"), (None, None), (7, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_links(df).collect()), key=repr)
    assert got == sorted([(3, 49_998, 2), (2, 49_999, 2), (2, 49_999, 2), (None, 2, None), (None, 0, None), (7, 2, 7)], key=repr)
    assert ngram_join.jaccard_links(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 1)]
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(label)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_links_of_a_large_group_without_a_common_original(spark, monkeypatch):
    """Near copies that all differ from their lost original, truncated ones, and one passage in many short documents."""
    monkeypatch.setattr(ngram_join, "PAIRS_A_MEMBER", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for size in (60, 90):
        original = [rng.choice(words) for _ in range(size)]
        for i in range(120):
            own = list(original)
            for _ in range(rng.choice([1, 1, 2, 2, 3, 4])):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[rng.choice(words)], [], [own[at], rng.choice(words)]])
            texts.append(" ".join(own[: rng.choice([size, size, size - 5])] + (["added", "line", "of", "words"] if i % 3 == 0 else [])))
    passage = [rng.choice(words) for _ in range(30)]
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 12))]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_links(df).collect()}
    assert [got[i] for i in range(len(texts))] == links_by_brute_force(texts, 3, 90)


def test_bin_counts_bound_the_overlap(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    for n, m, shared_ in ((5, 9, 3), (400, 300, 280), (90_000, 80_000, 70_000)):
        both = rng.integers(0, 1 << 63, n + m - shared_).astype(np.uint64)
        a, b = both[:n], both[n - shared_ :]
        found = next(iter(ngram_join.most_common.func(iter([(pd.Series([ngram_join.bin_counts(a)]), pd.Series([ngram_join.bin_counts(b)]))]))))
        assert found["common"][0] >= shared_ and found["both"][0] == n + m


def test_copies_are_not_indexed(spark, monkeypatch):
    """Keys of exact copies would all be shared, and a table of many copies would index every one of them."""
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    df = spark.createDataFrame([(10 * i + k, t) for i in range(20) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    found, keep = {}, ngram_join.stash

    def kept(rows, name):
        table = keep(rows, name)
        found[name] = table.count()
        return table

    monkeypatch.setattr(ngram_join, "stash", kept)
    assert {(r.doc_id % 10, r.component_id) for r in ngram_join.jaccard_links(df).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert found["shared-keys"] == 3  # the sizes of the three sets


def test_sketch_grows_with_the_documents():
    assert [ngram_join.sketch_bits(n) for n in (0, 51_282, 256_410, 1 << 19, 3_000_000, 1 << 40)] == [19, 19, 19, 21, 22, 22]
    wide = np.arange(300, dtype=np.int32)
    added = ngram_join._added(300)((7,), pd.DataFrame({"data": [ngram_join.narrowed(wide), ngram_join.narrowed(wide % 9)]}))
    assert np.frombuffer(added["data"][0], np.int32).tolist() == (wide + wide % 9).tolist()


def test_shuffles_of_a_stash_leave_the_disk(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = env.blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in dirs for f in pathlib.Path(d).rglob("shuffle_*")}
    before = files()
    assert shared.stash(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count(), "test").count() == 97
    left = {x for x in files() - before if x.endswith(".data")}
    assert len(left) <= 2  # of the count itself, whose rows are one a task
