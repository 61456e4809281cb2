"""Mixing against a plain computation, and the pipeline stage by stage."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import mixing, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, sizes, seed=1):
    rng = random.Random(seed)
    data, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = " ".join(f"{source}{rng.randrange(999)}" for _ in range(rng.randint(1, 30)))
            data.append((i, text, "en", source, len(text)))
            i += 1
    return data


def weights_of(tokens, exponent):
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent for s, t in tokens.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))


def summed(rows):
    tokens, taken, weight = {}, {}, {}
    for r in rows:
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens * r.copies
        weight[r.source] = r.weight
        assert len(r.mix_blocks) == r.copies
    return tokens, taken, weight


def test_mix_meets_its_entropy(spark):
    df = spark.createDataFrame(corpus(spark, {"a": 400, "b": 60, "c": 15}), DOCS)
    rows = mixing.mix_sources(df, target_entropy=0.9, max_epochs=None, block_tokens=100).collect()
    assert len(rows) == 475
    tokens, taken, weight = summed(rows)
    assert abs(entropy(weight) - 0.9) < 1e-3 and abs(sum(weight.values()) - 1) < 1e-9
    total = sum(tokens.values())
    for s in tokens:
        assert taken[s] <= weight[s] * total + 1e-6 and taken[s] > weight[s] * total - 31
    again = mixing.mix_sources(df, target_entropy=0.9, max_epochs=None, block_tokens=100).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mix_meets_its_repetition_limit(spark):
    df = spark.createDataFrame(corpus(spark, {"a": 300, "b": 50, "c": 10}), DOCS)
    rows = mixing.mix_sources(df, target_entropy=None, max_epochs=3.0).collect()
    tokens, taken, weight = summed(rows)
    assert abs(weight["c"] * sum(tokens.values()) / tokens["c"] - 3.0) < 0.01
    assert max(r.copies for r in rows) == 3
    cover = mixing.mix_sources(df, target_entropy=None, max_epochs=2.0, cover=True).collect()
    assert min(r.copies for r in cover) == 1 and max(r.copies for r in cover) == 2
    assert all(r.copies == 1 for r in cover if r.source == "a")
    # Every block of the mix has about its share of the largest source.
    blocks = {}
    for r in rows:
        for b in r.mix_blocks:
            blocks[b] = blocks.get(b, 0) + r.n_tokens
    assert set(blocks) <= set(range(64))


def test_mix_of_odd_rows(spark):
    data = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "x y", "en", None, 3), (4, "x y", "en", "a", 3), (4, "x y", "en", "a", 3)]
    df = spark.createDataFrame(data, DOCS).withColumn("block", F.lit(1)).withColumn("s", F.lit("s"))
    rows = mixing.mix_sources(df, max_epochs=1.0).collect()
    assert sorted((r.doc_id, r.copies) for r in rows if r.doc_id is not None) == [(1, 1), (2, 1), (4, 1), (4, 1)]
    assert mixing.mix_sources(df.where("false")).count() == 0
    assert mixing.repeat_documents(df, mixing.mix_sources(df, max_epochs=1.0)).columns == df.columns


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    good = lambda n: " ".join(rng.choice("the house was built by people who liked long walks near water and stone".split()) + str(rng.randrange(50)) for _ in range(n))
    data = [(i, good(60), "en", f"s{i % 3}" if i % 2 else "hot", 0) for i in range(90)]
    data += [(100 + i, " | ".join(["BUY NOW!!"] * 30), "en", "junk", 0) for i in range(40)]
    data += [(200, data[0][1], "en", "s1", 0), (201, data[3][1] + " more", "en", "s2", 0), (202, 'with token = "abcdef0123456789abcdef01" ' + good(50), "en", "s1", 0), (203, None, None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(data, DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 90, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    clean = {*range(90), 200, 201, 202}
    state = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, folder)
        seen[name] = state.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert state.columns == columns
            state = spark.createDataFrame(seen[name], docs.schema)
    kept = {r.doc_id for r in seen["quality classifier"]}
    assert clean <= kept and not kept & set(range(100, 140))
    single = [r.doc_id for r in seen["n-gram Jaccard join"]]
    assert len(single) == len(set(single)) and {0, 3, 202} <= set(single) and not {200, 201} & set(single)
    texts = {r.doc_id: r for r in seen["secret scans"]}
    assert not any(secret_scan.base_spans(r.text or "") for r in texts.values())
    assert "[SECRET]" in texts[202].text and texts[202].n_chars == len(texts[202].text)
    mixed = [r.doc_id for r in seen["mixing sources"]]
    assert set(mixed) == set(texts) and len(mixed) > len(texts) and max(mixed.count(i) for i in set(mixed)) == 2
    last = seen["BPE encoding"]
    assert len(last) == len(mixed) and all(r.n_tokens == len(r.ids) for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole if r.doc_id is not None) == sorted((r.doc_id, r.n_tokens) for r in last if r.doc_id is not None)
    assert re.fullmatch("[a-zA-Z -]+", corpus_pipeline.STAGES[0][0])


def test_secret_stage_redacts_live_extras_and_keeps_copied_ones(spark):
    live, shared = "ghp_q9Zk3LmP0aXw7RtY2uVb5NcD8eFh1GjK", "sk-A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6"
    data = [(1, f"x {live} y password: hunter22x", "en", "a", 0), (2, f"s {shared}", "en", "a", 0), (3, f"s {shared}", "en", "b", 0), (4, f"s {shared} z", "en", "c", 0)]
    data += [(5, "plain", "en", "a", 5), (6, None, None, None, 7), (1, f"x {live} y password: hunter22x", "en", "a", 0), (None, "", "en", "a", 0)]
    docs = spark.createDataFrame(data, DOCS)
    out = corpus_pipeline.redact_secrets(spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    want = [(i, "x [SECRET] y [SECRET]" if t and live in t else t, a, b) for i, t, a, b, _ in data]
    got = out.collect()
    assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None) and [r.n_chars for r in got if r.doc_id == 6] == [7]


def test_near_copy_stage_settles_repeated_ids(spark):
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    data = [(1, text("a"), "en", "s", 1), (2, text("a") + " more", "en", "s", 2), (3, text("b"), "en", "s", 3), (3, text("c"), "fr", "s", 4), (3, text("b"), "en", "r", 5)]
    data += [(4, text("d"), "en", "s", 6), (5, text("d"), "en", "s", 7), (5, text("e"), "en", "s", 8), (None, text("a"), "en", "s", 9), (6, None, None, None, None), (6, None, None, None, None), (7, "", "en", "s", 0), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, DOCS)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "")[:2], r.source) for r in out.collect()), key=repr)
    assert got == sorted([(1, "wa", "s"), (3, "wb", "r"), (3, "wc", "s"), (4, "wd", "s"), (None, "wa", "s"), (6, "", None), (7, "", "s"), (8, "", "s")], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").isEmpty()


def test_every_pass_has_an_order_of_its_own(spark):
    df = spark.createDataFrame(corpus(spark, {"big": 600, "small": 60}, seed=5), DOCS)
    rows = [r for r in mixing.mix_sources(df, target_entropy=0.99, max_epochs=None, block_tokens=20, mix_blocks=1000).collect() if r.source == "small"]
    passes = min(r.copies for r in rows)
    assert passes >= 3 and all(list(r.mix_blocks) == sorted(r.mix_blocks) for r in rows)
    orders = [[r.doc_id for r in sorted(rows, key=lambda r: (r.mix_blocks[i], r.doc_id))] for i in range(passes)]
    assert len({tuple(x) for x in orders}) == passes
    # A pass ends before the next one begins, but for the block of the mix that both share.
    assert all(max(r.mix_blocks[i] for r in rows) <= min(r.mix_blocks[i + 1] for r in rows) for i in range(passes - 1))


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = ("row", "s", "id", "n", "copies", "id_hash", "text_hash", "uid", "found", "base", "added", "component_id", "block", "weight", "kept", "p", "o", "count")
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, folder), stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        got = out.collect()
        assert sorted((repr(r.doc_id), r.text or "") for r in got) == sorted((repr(r.doc_id), r.text or "") for r in plain.collect()), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in got if r.doc_id is not None for c in extra), name
