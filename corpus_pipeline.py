"""The corpus pipeline: quality filter, near-duplicates, secrets, source mix, BPE.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``. Each is written as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, mixing, ngram_join, quality, secret_scan
from weft.llm.catalog import table
from weft.llm.shared import stash

#: SQL can express neither the fitted classifier nor the tokenizer: tests compare with brute force instead.
ORACLE_SQL = None


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble, fitted on the labels, scores below one half.

    Null and empty texts are scored as such and may go. Repeated rows share their score. Labels of ids that
    aren't there any more have no part; without labels everything stays. All columns stay.
    """
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets at a similarity of 0.8: the one of smallest id.

    Rows with a null id stay. Rows that repeat an id are one document: they go together
    where one of them links to a smaller id. Of those that repeat id and text too, the
    one whose other columns are smallest stays. Null and empty texts link with nothing.
    """
    links = ngram_join.jaccard_links(docs, size=5, percent=80)
    gone = stash(links.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    repeated = stash(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    once = docs.join(gone.union(repeated), "doc_id", "left_anti").select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = docs.join(repeated, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("o"))
    return once.unionByName(again.select("doc_id", "text", *[F.col(f"o.{c}").alias(c) for c in others]).select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces base secrets and live extra ones in every text; every document stays, and n_chars follows its text."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources up to twice, for a flatter mix.

    A null source is a source of its own. Rows that repeat an id and a text share their number of copies, which is
    rounded up for each, so repeated rows are a little more than their weight.
    """
    mixed = mixing.mix_sources(docs, target_entropy=None, max_epochs=2.0, cover=True)
    return mixing.repeat_documents(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the number of characters that they decode to. A null text is empty; every row has its result."""
    coded = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), keep_cols=("doc_id", "lang", "source"), decode=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("n_decoded"))


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
