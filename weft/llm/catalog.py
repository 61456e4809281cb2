"""Registered queries of this subpackage, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, conversation_repair, fill_middle, html_text, lang_id, mixing, ngram_join, personal_data, quality, rp_forest, secret_scan, substring_dedup
from weft.llm.catalog_sql import CONVERSATIONS_SQL, FILL_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Texts can be long: small Arrow batches bound what a Python worker holds at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_text(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps once repeated windows of 35 words are gone."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9."""
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and copies of every document in a mix of near-even sources, as large as the corpus."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every whole text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), path, decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, with digests of the base spans."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secret_scan.KINDS), F.sha2(_span_text("base"), 256).alias("base_sha256"), _span_text("all").alias("spans"), "n_live", "n_example"
    )


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = lang_id.fit_languages(docs.where(~held_out))
    found = lang_id.predict_languages(docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(part != 1))
    return quality.score_quality(docs, model).select(
        "doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, with digests of the base spans."""
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, personal_data.KINDS), F.sha2(_span_text("base"), 256).alias("base_sha256"), _span_text("all").alias("spans"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after a damage that each row's crc32 decides.

    Conversations without a row after it have zeros, an empty audit and the hash of an empty text.
    """
    rows = table(spark, sf_dir, "conversations")
    report, repaired = conversation_repair.repair(conversation_repair.damage(rows), "conv", "turn", "role", "text")
    hashes = conversation_repair.digests(repaired)
    every = rows.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    met = every.join(report, F.col("conv_id").eqNullSafe(report["conv"]), "left").drop("conv")
    met = met.join(hashes, F.col("conv_id").eqNullSafe(hashes["conv"]), "left").drop("conv")
    return met.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut in three and put in the order of its form, with digests of the outcome and of the text rebuilt from it."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_substrings": op2_substrings,
    "op3_ngram_join": op3_ngram_join,
    "op4_embedding_duplicates": op4_embedding_duplicates,
    "op5_mixing": op5_mixing,
    "op6_bpe": op6_bpe,
    "op7_secrets": op7_secrets,
    "op8_languages": op8_languages,
    "op9_quality": op9_quality,
    "op10_article_text": op10_article_text,
    "op11_personal_data": op11_personal_data,
    "op12_conversations": op12_conversations,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {"op12_conversations": CONVERSATIONS_SQL, "op13_fill_in_middle": FILL_SQL}
