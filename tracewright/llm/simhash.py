"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at 2 or fewer differing bits. Cut into 2 segments of 32 bits, one of the two differs in at most one
bit. So each distinct fingerprint is indexed under 64 variants, a segment with one bit left out, and two linked fingerprints meet
in an equality join on (variant, remaining bits); the join's condition verifies the distance, at one variant for each pair.
A fingerprint has at most 64 + 64 * 63 / 2 others within 2 bits, so verified pairs grow with the number of fingerprints. Variants
of a half that very many fingerprints share are split further, as those can't all be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, keep_columns, named, prepare, shuffled

SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 32_768


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of a UTF-8 text: bit i is set if more than half of its shingles' hashes have it."""
    w = text.lower().split()  # of bytes: only A-Z change, only 0x09-0x0D and 0x20 part words
    if not w:
        return 0
    k = min(words, len(w))
    n, ones = len(w) - k + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = w[at : at + CHUNK + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(part) - k + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null or empty text has 0."""
    prepare(docs.sparkSession)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(named("doc_id").alias("doc_id"), F.coalesce(named("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(printed, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


#: Fingerprints with one half in common from which on that half's variants are split.
HOT = 2_000
#: First and last bit of a half's thirds: of halves that differ in two bits at most, one third is equal.
THIRDS = ((0, 11), (11, 22), (22, 32))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _half(i: int):
    return F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) if i == 0 else F.shiftrightunsigned("fp", 32)


def _hot_variants(prints: DataFrame) -> DataFrame:
    """pos, rest of the variants of those halves that more than HOT fingerprints have; most tables have none."""
    halves = prints.select(F.explode(F.array(*(F.struct(F.lit(i).alias("which"), _half(i).alias("half")) for i in (0, 1)))).alias("h")).groupBy("h.which", "h.half").count().filter(F.col("count") > HOT)
    bits = halves.select("which", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    rest = F.when(F.col("which") == 0, F.col("half")).otherwise(F.shiftleft("half", 32)).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") + 32 * F.col("which"))))
    return bits.select((F.col("bit") + 32 * F.col("which")).cast("tinyint").alias("pos"), rest.alias("rest")).distinct()


def near_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints in prints.fp at 1 or 2 differing bits.

    A variant that very many fingerprints share is split by the thirds of the other half, one of which is equal in any linked
    pair, so that fingerprints which agree on one half aren't all compared.
    """
    halves = (0xFFFFFFFF, 0xFFFFFFFF << 32)
    masks = F.array(*(F.struct(F.lit(p).cast("tinyint").alias("pos"), F.lit(_signed(halves[p // 32] & ~(1 << p))).alias("mask")) for p in range(64)))
    keyed = prints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.pos").alias("pos"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("rest"))
    hot = cut(_hot_variants(prints).withColumn("hot", F.lit(True)), "hot")  # a table of known size: broadcast if that is small
    third = [[F.struct(F.lit(k).cast("tinyint").alias("third"), _half(i).bitwiseAND(F.lit((1 << high) - (1 << low))).alias("piece")) for k, (low, high) in enumerate(THIRDS)] for i in (0, 1)]
    whole = F.array(F.struct(F.lit(-1).cast("tinyint").alias("third"), F.lit(0).cast("long").alias("piece")))
    parts = F.when(F.col("hot").isNull(), whole).when(F.col("pos") >= 32, F.array(*third[0])).otherwise(F.array(*third[1]))
    keyed = keyed.join(hot, ["pos", "rest"], "left").select("fp", "pos", "rest", F.explode(parts).alias("t")).select("fp", "pos", "rest", "t.third", "t.piece")
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)

    def bit(half):  # the place of its only bit, 0 if it has none
        return F.when(half == 0, 0).otherwise(F.round(F.log2(half.cast("double"))).cast("int"))

    once = F.when(F.bit_count(low) <= 1, bit(low)).otherwise(bit(high) + 32)
    other = F.when(F.col("a.pos") >= 32, low).otherwise(high)
    first = F.lit(len(THIRDS) - 1)
    for k in reversed(range(len(THIRDS) - 1)):
        first = F.when(other.bitwiseAND(F.lit((1 << THIRDS[k][1]) - (1 << THIRDS[k][0]))) == 0, k).otherwise(first)
    close = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= 2) & (F.col("a.pos") == once) & ((F.col("a.third") < 0) | (F.col("a.third") == first))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("pos", "rest", "third", "piece")]
    return a.join(shuffled(b), same[0] & same[1] & same[2] & same[3] & close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def classes_of(prints: DataFrame) -> DataFrame:
    """fp, component (a fingerprint that names the group), component_id (the group's smallest doc_id, null if it has none) of every fingerprint in prints (doc_id, fp)."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = components(near_pairs(nodes))  # node, component: fingerprints
    grouped = nodes.join(shuffled(labels), nodes.fp == labels.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    return cut(grouped.join(smallest, "component").select("fp", "component", "component_id"), "classes")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links), kept, for every row of docs.

    Rows of equal fingerprints are one node, so copies never make pairs. Texts without words have fingerprint zero and link like
    any other. A null doc_id gets the component of its fingerprint, whose smallest doc_id passes over nulls; repeated rows give
    repeated results. Other columns are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words), "fingerprints")
    joined = prints.join(shuffled(classes_of(prints)), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with one row of each group: that of its smallest doc_id (of the group's own rows that repeat it, any one). Of a group that has no doc_id at all, any one row."""

    @F.pandas_udf("long")
    def printed(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in text], dtype=np.uint64).view(np.int64))

    prints = cut(fingerprints(docs, words), "fingerprints")
    classes = classes_of(prints)
    first = prints.join(classes.filter("component_id is not null"), "fp").filter("doc_id = component_id").groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"))
    differs = prints.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("differs"))  # ids whose rows have several fingerprints
    kept = cut(first.join(differs, "doc_id").select(F.col("doc_id").alias("__kept"), F.col("fp").alias("__first"), F.col("component").alias("__component"), F.col("differs").alias("__differs")), "kept")
    same = docs.join(kept.filter("not __differs"), docs["doc_id"] == F.col("__kept")).select(*keep_columns(docs)).dropDuplicates(["doc_id"])
    several = docs.join(kept.filter("__differs"), docs["doc_id"] == F.col("__kept")).withColumn("__fp", printed(F.coalesce(named("text"), F.lit("")).cast("binary")))
    several = several.filter("__fp = __first").dropDuplicates(["__component"]).select(*keep_columns(docs))
    nameless = docs.filter(named("doc_id").isNull()).withColumn("__fp", printed(F.coalesce(named("text"), F.lit("")).cast("binary")))
    alone = classes.filter("component_id is null").select(F.col("fp").alias("__fp"), F.col("component").alias("__component"))
    return same.unionByName(several).unionByName(nameless.join(alone, "__fp").dropDuplicates(["__component"]).select(*keep_columns(docs)))
