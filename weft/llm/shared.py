"""Helpers that several operators of this subpackage use: tables in the shared folder, and components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from weft.operators.graph import groups
from weft.operators.tables import forget, shared_folder, written


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive lost executors. They belong to one run of an operator and are
    transient: what a result still reads stays in the folder until that is cleared,
    the rest goes with ``drop_stash``.
    """
    spark = df.sparkSession
    return written(df, f"{shared_folder(spark)}/stash-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")


def drop_stash(df: DataFrame) -> None:
    """Remove a table that ``stash`` has returned and that nothing reads any more."""
    forget(df)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``edges`` (a long, b long): node long, component long. Null ids and self-loops take no part; no edges give no rows."""
    return groups(edges.where("a <> b").select("a", "b")).withColumnRenamed("group", "component")
