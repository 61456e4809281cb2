"""Numbers over a whole table without a single task that takes all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.tables import saved


def numbered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` and ``name``: 1, 2, 3 … in the order of the columns ``order``.

    Rows are sorted by range and numbered inside each partition; the partitions' sizes
    are summed up in order, which takes one row for each partition. Equal rows are numbered in any order.
    """
    part, place = "_part", "_place"
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of this id count the rows of a partition.
    placed = saved(dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy(part).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select(part, before.alias("_before")), part).select(*rows.columns, (F.col("_before") + F.col(place) + 1).alias(name))
