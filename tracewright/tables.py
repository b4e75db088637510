"""Tables in the shared folder, by which iterative operators cut their lineage."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode (tests); an error on a cluster, whose machines wouldn't see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@functools.lru_cache(maxsize=8)
def _ship(application: str) -> str:
    """A zip file of this package, for the executors."""
    package = Path(__file__).resolve().parent
    target = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    return target


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors (once)."""
    spark.sparkContext.addPyFile(_ship(spark.sparkContext.applicationId))
    return spark


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _scopes[-1:]:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that operators cut inside, at the end: for callers who have written the results by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast either side. Spark sizes a table after an explode, or a task's function, by the rows before it, and a compressed one by its files."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as a shuffle has: before an explode, as few rows that make very many would be put into one task by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written once in the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
