"""The registered queries themselves: columns and types of each contract, a row for each input row, odd rows among them."""

import random

import pytest

from weft.llm import catalog

#: Columns and types that each contract names; more may follow.
CONTRACT = {
    "op1_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_embedding_duplicates": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_languages": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_article_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op11_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op13_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}
N = 48


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = {"en": "the house with people and water of".split(), "fr": "la maison avec des gens et une eau".split()}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, f"s{i % 3}", 0) for i in range(N - 4) for lang in [("en", "fr")[i % 2]]]
    docs += [(N - 4, None, None, None, None), (N - 3, "", "en", "s1", 0), (N - 2, "x" * 5000, "en", "s1", 5000), (N - 1, docs[0][1], "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(N)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(N - 2)] + [(N - 2, None, 0), (N - 1, [0.0] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<p>Hi"), (2, "v", None), (3, None, "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, folder, name):
    out = catalog.QUERIES[name](spark, folder)
    assert {c: t for c, t in out.dtypes if c in CONTRACT[name]} == CONTRACT[name]
    found = out.collect()
    if name == "op1_nearest":
        assert sorted({r.query_id for r in found}) == [0, 20, 40] and len(found) == 60
        assert all(r.vec_id < N - 2 and r.vec_id != r.query_id for r in found)
    elif name == "op10_article_text":
        assert sorted((r.page_id, r.text, r.n_chars) for r in found) == [(1, "Hi", 2), (2, "", 0), (3, "", 0)]
    else:
        key = next(iter(CONTRACT[name]))
        assert sorted(r[key] for r in found) == list(range(N))
    if "score" in CONTRACT[name] and name != "op1_nearest":
        assert all(0 <= r.score <= 1 for r in found)
