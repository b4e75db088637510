"""Dropping lines that many documents share.

Lines are exploded with their positions, normalised and hashed; the documents of each hash are counted; lines over the threshold
are marked and the rest put together again by position. Only hashes and positions are shuffled, each text once, to its marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, keep_columns, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> list[Column]:
    """128 bits of hash, in two longs. Columns are hashed in turn, each seeded by the hash before, so the constant comes first: after the key it would add nothing."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def drop_common_lines(docs: DataFrame, threshold: int = 10, least_chars: int = 1) -> DataFrame:
    """docs with text less its common lines, and n_lines (before), n_dropped, in columns that replace any of those names.

    A line is common if its key has least_chars code points or more and stands in `threshold` rows of docs or more; all its lines
    go everywhere. A null or empty text is one empty line and becomes the empty text; so does a text whose lines all go. Every
    row counts as a document, also with a null or repeated doc_id. Other columns stay. An empty table gives an empty result.
    """
    text = F.coalesce(named("text"), F.lit(""))
    # rows of the same id and text share their lines, so that pair can name the row
    row = docs.select(F.struct(*keep_columns(docs)).alias("row"), named("doc_id").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"), F.split(text, "\n", -1).alias("lines"))
    lines = row.select("id", "t1", "t2", F.posexplode(F.transform("lines", line_key)).alias("pos", "key")).filter(F.length("key") >= least_chars)
    per_row = row.select(F.explode(F.array_distinct(F.transform("lines", line_key))).alias("key")).filter(F.length("key") >= least_chars)
    common = cut(per_row.select(*_hash(F.col("key"))).groupBy("h1", "h2").count().filter(F.col("count") >= threshold).select("h1", "h2"), "common")
    marks = lines.select("id", "t1", "t2", "pos", *_hash(F.col("key"))).join(common, ["h1", "h2"], "left_semi")
    marks = cut(marks.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("marked")), "marks").select(F.col("id").alias("m_id"), F.col("t1").alias("m1"), F.col("t2").alias("m2"), "marked")
    joined = row.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("marked"))
    kept = F.when(F.col("marked").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    out = {"text": kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("lines") - F.size(stay), F.lit(0)).cast("long")}
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in out]
    return joined.select(*others, *(v.alias(k) for k, v in out.items()))
