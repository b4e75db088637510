"""What the corpus operators share: the shared folder, written tables, small column helpers."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path, shared_folder, ship, shuffled  # noqa: F401

#: Rows of an Arrow batch: whole texts travel in these batches, so they are kept short.
BATCH_ROWS = "256"


def prepare(spark: SparkSession) -> SparkSession:
    """ship(), and keeps Arrow batches of whole texts small."""
    ship(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def keep_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """df's columns except those an operator adds under the same name (names compare without case)."""
    taken = {x.lower() for x in but}
    return [named(c) for c in df.columns if c.lower() not in taken]
