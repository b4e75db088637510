"""A corpus pipeline: quality, shared lines, near-duplicates, mixing, packing. Each stage is written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import lines, mixing, packing, quality, similar
from tracewright.llm.shared import named
from tracewright.tables import new_path, scratch


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(named(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: a score of 0.3 or more, null texts as empty ones. An empty table gives an empty one."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as_documents(quality.score(docs, model, 0.3).filter("predicted = 1"), docs)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that 10 or more of them share; n_chars follows the text. A null text becomes an empty one; an empty table stays empty."""
    kept = lines.drop_common_lines(docs, 10, 1)
    return _as_documents(kept.selectExpr("* except (n_chars)", "cast(length(text) as bigint) as n_chars") if "n_chars" in docs.columns else kept, docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, which share 0.8 or more of their five-word shingles: that of the smallest doc_id.

    Found through SimHash deletion-variant signatures. Null and wordless texts are one group; an empty table gives an empty one.
    """
    return _as_documents(similar.drop_similar(docs, 5, 0.8), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix uses them, in its order: a row for each use, cut to the words taken. Texts without words, null ones too, go; an empty table gives an empty one."""
    return _as_documents(mixing.mixed_documents(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null text is an end token; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048).drop("ids")


STAGES = [("quality", good_quality), ("lines", without_common_lines), ("simhash", one_of_each), ("mixing", mixed), ("packing", packed)]
#: Stages need trained tables and tokens, which SQL can't express; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):  # a stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
