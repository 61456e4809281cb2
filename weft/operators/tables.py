"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one task takes apart: rows of tokens are some hundred times as large while they are sorted.
TEXT_A_TASK = 1 << 20
#: Whether a statement's shuffle files go as soon as it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints/weft"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back. Its shuffles leave the disks at once: nothing reads them again, and the driver would only remove them when it next collects its own garbage."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written where driver and executors both see it, and read back."""
    spark = df.sparkSession
    return written(df, f"{shared_folder(spark)}/table-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")


def dealt(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """``files`` dealt to tasks by file, as many as their texts need: Spark would size tasks by compressed bytes, which say little about rows taken from a text. Windows by file need no other shuffle."""
    size = files.agg(F.sum(F.length(text))).first()[0] or 0
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_A_TASK)), file)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle: Spark knows tables by their compressed or guessed sizes, so one that grows with the input may look small and be sent through the driver."""
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Remove a table that ``saved`` has returned and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
