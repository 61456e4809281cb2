"""Queries of the small report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import reports
from weft.plans.inputs import load
from weft.plans.registry import query


@query("SELECT doc_id AS file, CAST(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS BIGINT) AS tests FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def tests_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tests_per_file(load(spark, sf_dir, "docs").select(F.col("doc_id").alias("file"), "text"), "[0-9]{3}-[0-9]{4}")


@query("SELECT event_type, count(*) AS files, count(*) FILTER (value > 60) AS stale FROM events GROUP BY 1")
def facts_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return reports.facts_summary(events.select("event_type", F.when(F.col("value") > 60, "stale").otherwise("fresh").alias("state")), "event_type")


@query(
    """SELECT c_custkey AS id, c_mktsegment AS page, CAST(NULL AS VARCHAR) AS anchor FROM customer
    UNION ALL SELECT c_custkey, 'n' || c_nationkey, c_name || '~x' FROM customer"""
)
def counterpart_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    values = F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey", F.lit("~"), "c_name", F.lit("~x")))
    return reports.counterpart_targets(customers.select(F.col("c_custkey").alias("id"), values.alias("values")), "id", "values")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%-d %B %Y') END AS long_date FROM orders"""
)
def site_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.when(F.col("o_orderstatus") == "P", " ?").otherwise(""))
    return orders.select("o_orderkey", reports.site_date(text).alias("long_date"))
