"""Typed fact tables derived from the driver's tables, in expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name to (table, filter, expressions).
INPUTS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "usage": (
        "events",
        "true",
        (
            "event_id AS id",
            "substring(CAST(ts AS STRING), 1, 19) AS at",
            "concat('1.', CAST(user_id % 12 AS STRING), '.', CAST(event_id % 3 AS STRING)) AS version",
            "concat('r', CAST(event_id % 50 AS STRING)) AS run",
            "event_type AS step",
            "CASE WHEN event_id % 4 = 1 THEN concat('s', CAST(event_id % 3 AS STRING)) END AS sub",
            "CASE WHEN event_id % 8 = 5 THEN concat('p', CAST(event_id % 2 AS STRING)) END AS part",
            "event_id % 997 + 1 AS ms",
            "CASE WHEN event_id % 5 = 0 THEN 'agent' END AS actor",
            "CASE WHEN event_id % 5 = 0 THEN concat('m', CAST(user_id % 4 AS STRING)) END AS model",
            "CASE WHEN event_id % 5 = 0 THEN event_id % 1000 END AS tokens_in",
            "CASE WHEN event_id % 5 = 0 THEN event_id % 300 END AS tokens_out",
            "CASE WHEN event_id % 10 = 0 THEN event_id % 77 END AS cache_read",
            "CASE WHEN event_id % 15 = 0 THEN event_id % 55 END AS cache_write",
            "concat('page', CAST(user_id % 40 AS STRING)) AS page",
        ),
    ),
    "commits": (
        "lineitem",
        "true",
        (
            "l_orderkey AS hash",
            "concat('a', CAST(l_orderkey % 37 AS STRING)) AS author",
            "substring(CAST(l_shipdate AS STRING), 1, 10) AS date",
            "concat('f', CAST(l_partkey % 500 AS STRING)) AS path",
            "CAST(l_quantity AS BIGINT) AS added",
            "CAST(l_linenumber AS BIGINT) AS deleted",
        ),
    ),
    "quality": (
        "part",
        "true",
        (
            "concat('f', CAST(p_partkey AS STRING)) AS file",
            "CAST(p_size AS BIGINT) * 13 AS lines",
            "CASE WHEN p_partkey % 9 = 0 THEN CAST(0 AS BIGINT) WHEN p_partkey % 10 <> 0 THEN p_partkey % 31 END AS complexity",
            "p_partkey % 6 AS functions",
            "p_partkey % 40 AS longest",
            "p_partkey % 17 AS duplicated",
            "p_partkey % 3 AS todo",
        ),
    ),
    "before": (
        "orders",
        "o_orderpriority <> '1-URGENT'",
        (
            "o_orderkey % 5000 AS k",
            "o_orderkey AS pos",
            "o_orderstatus AS auth",
            "CAST(o_custkey % 3 AS STRING) AS version",
            "concat('c', CAST(o_custkey % 5 AS STRING)) AS column_name",
        ),
    ),
    "after": (
        "orders",
        "o_orderpriority <> '5-LOW'",
        (
            "o_orderkey % 5000 AS k",
            "o_orderkey AS pos",
            "CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS auth",
            "CAST(o_custkey % 3 AS STRING) AS version",
            "CASE WHEN o_orderkey % 17 = 0 THEN 'c9' ELSE concat('c', CAST(o_custkey % 5 AS STRING)) END AS column_name",
        ),
    ),
    "ranges": (
        "lineitem",
        "true",
        ("l_partkey % 800 AS file", "l_suppkey * 3 % 400 + 1 AS lo", "l_suppkey * 3 % 400 + 1 + l_linenumber AS hi"),
    ),
    "touched": (
        "lineitem",
        "l_quantity < 6",
        ("l_partkey % 800 AS file", "l_orderkey % 400 + 1 AS lo", "l_orderkey % 400 + 1 + CAST(l_quantity AS BIGINT) AS hi"),
    ),
    "routes": (
        "part",
        "true",
        (
            "p_partkey AS pos",
            "CASE p_partkey % 4 WHEN 0 THEN concat('/api/', split_part(p_name, ' ', 1), '/:id') WHEN 1 THEN concat('/api/', split_part(p_name, ' ', 2), '/{key}/') "
            "WHEN 2 THEN concat('/', split_part(p_name, ' ', 1), '/[slug]/', split_part(p_name, ' ', 2)) ELSE concat('/v1/api/', split_part(p_name, ' ', 1), '/:id') END AS route",
            "CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'ANY' END AS method",
        ),
    ),
    "packages": (
        "part",
        "true",
        (
            "concat('pkg-', CAST(p_partkey % 700 AS STRING)) AS name",
            "p_partkey AS pos",
            "CASE WHEN p_partkey % 5 <> 0 THEN concat(CAST(p_size % 7 AS STRING), '.', CAST(p_partkey % 10 AS STRING), '.0') END AS version",
            "CASE WHEN p_partkey % 6 <> 0 THEN concat(CAST(p_size % 7 + p_partkey % 3 AS STRING), '.0.0') END AS latest",
            "CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'cargo' END AS ecosystem",
            "p_partkey % 2 = 0 AS direct",
            "p_brand AS manifest",
        ),
    ),
    "docs": ("documents", "true", ("doc_id", "text", "lang", "source")),
    "edges": (
        "lineitem",
        "true",
        ("l_partkey % 211 AS src", "(l_partkey % 211 * 3 + l_partkey % 2) % 211 AS dst"),
    ),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fact table ``name``; only the columns that a query uses are read."""
    table, where, columns = INPUTS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*columns)


def cte(*names: str) -> str:
    """The same tables for a DuckDB statement."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(INPUTS[n][2])} FROM {INPUTS[n][0]} WHERE {INPUTS[n][1]})" for n in names)
