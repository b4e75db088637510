"""Near-duplicate texts by their word shingles' similarity, found through SimHash deletion-variant signatures.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Candidates come from 128-bit
SimHash fingerprints of two-word shingles, which differ less for the same edits than those of longer shingles. A fingerprint is cut
into six segments; if one of them differs by at most one bit in two fingerprints, they meet in an equality on (place left out,
remaining bits), as each segment is indexed with each of its bits left out. Candidates differ by 22 bits at most.

Texts of equal words are one node. Candidates hang together in clusters: every node is joined to its buckets' leaders (the smallest
of each), and then clusters that other candidate pairs join. So a large group of near copies makes a few rows a text and not
its pairs. Then all pairs of a cluster are verified by their shingles, in blocks of bounded size, whose products count the shingles
that two texts share; a block returns a row a text, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .pivots import _local_smallest
from .shared import cut, keep_columns, named, prepare, shuffled

WORDS, SIMILARITY = 5, 0.8
#: Words of the shingles that fingerprints are made of; the most bits that a candidate pair differs by.
INDEX_WORDS, MOST_BITS = 2, 22
#: Texts, and bytes of shingles, to a block of a cluster; texts of small clusters to a task's group; shingles counted at a time.
BLOCK, BLOCK_BYTES, TOGETHER, COLUMNS = 1024, 16 << 20, 4096, 4096
#: First and last bit of each half's segments.
SEGMENTS = ((0, 21), (21, 42), (42, 64))
#: Multipliers of a well-known mixing function of 64 bits, and of our own combination of words.
MIX_1, MIX_2, COMBINE, SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words (of the whole run, if shorter), from the words' hashes."""
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for i in range(1, k):
        h = h * np.uint64(COMBINE) + words[i : i + n]
    return _mixed(h)


def _majority(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as a signed long."""
    ones = sum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(hashes, len(hashes) // 32_768 + 1))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def described(text: bytes, words: int = WORDS) -> tuple[bytes, int, int, bytes]:
    """Of a UTF-8 text: 128-bit hash of its words, both halves of its fingerprint, and its shingles' sorted 32-bit hashes."""
    w = text.lower().split()  # of bytes: only A-Z change, only 0x09-0x0D and 0x20 part words
    content = xxhash.xxh3_128_digest(b" ".join(w))
    if not w:
        return content, 0, 0, b""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    two = np.unique(shingle_hashes(h, INDEX_WORDS))  # each once, as similarity counts them
    return content, _majority(two), _majority(_mixed(two * np.uint64(SECOND))), np.unique(shingle_hashes(h, words).astype(np.uint32)).tobytes()


def shared_shingles(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For sets of hashes, a matrix of how many each two share, and their sizes."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, place, held = np.unique(np.concatenate([*sets, np.empty(0, np.uint32)]), return_inverse=True, return_counts=True)
    several = held > 1  # others are shared by none
    owner, place = owner[several[place]], (np.cumsum(several) - 1)[place[several[place]]]
    order = np.argsort(place, kind="stable")
    owner, place, shared = owner[order], place[order], np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(several.sum()), COLUMNS):
        begin, end = np.searchsorted(place, (low, low + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, int(several.sum()) - low)), dtype=np.float32)
        has[owner[begin:end], place[begin:end] - low] = 1
        shared += has @ has.T
    return shared, size


def linked_in_blocks(part: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """node, root for the texts of small clusters, or of one or two blocks of a large one, that have links: the smallest node that links lead to there."""
    out = []
    for _, texts in part.sort_values(["cluster", "node"]).groupby("cluster", sort=False):
        ids = texts["node"].to_numpy()
        shared, size = shared_shingles([np.frombuffer(x, np.uint32) for x in texts["shingles"]])
        linked = shared >= similarity * (size[:, None] + size[None, :] - shared)
        np.fill_diagonal(linked, True)
        root, _ = _local_smallest(linked, ids, ids)
        out.append(pd.DataFrame({"node": ids[root != ids], "root": root[root != ids]}))
    return pd.concat(out)


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row (its own number), doc_id, same (md5 of the text), c0, c1 (hash of the words), f0, f1 (fingerprint), shingles, of every row of docs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            made = [described(t, words) for t in batch.column(2).to_pylist()]
            content = np.frombuffer(b"".join(m[0] for m in made), dtype="<i8").reshape(-1, 2)
            columns = [pa.array(range(at, at + len(made)), pa.int64()), batch.column(0), batch.column(1), *(pa.array(content[:, i].copy()) for i in (0, 1)), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2)), pa.array([m[3] for m in made], pa.binary())]
            at += len(made)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "same", "c0", "c1", "f0", "f1", "shingles"])

    text = F.coalesce(named("text"), F.lit(""))
    rows = docs.select(named("doc_id").alias("doc_id"), F.md5(text).alias("same"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {dict(rows.dtypes)['doc_id']}, same string, c0 long, c1 long, f0 long, f1 long, shingles binary")


def _segments(nodes: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
    """nodes (f0, f1, ...), a row for each mask (pos, half, bits): pos and rest, that half's bits."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    table = F.array(*(F.struct(F.lit(p).cast("tinyint").alias("pos"), F.lit(half).cast("tinyint").alias("half"), F.lit(signed(bits)).alias("mask")) for p, half, bits in masks))
    keyed = nodes.select("*", F.explode(table).alias("m"))
    return keyed.withColumns({"pos": F.col("m.pos"), "rest": F.when(F.col("m.half") == 0, F.col("f0")).otherwise(F.col("f1")).bitwiseAND(F.col("m.mask"))}).drop("m")


def whole_segments(nodes: DataFrame) -> DataFrame:
    """nodes under their six segments."""
    return _segments(nodes, [(64 * half + low, half, (1 << high) - (1 << low)) for half in (0, 1) for low, high in SEGMENTS])


def variants(nodes: DataFrame) -> DataFrame:
    """nodes under the 128 variants of their segments: pos is the bit left out, rest the segment's other bits."""
    return _segments(nodes, [(64 * half + bit, half, ((1 << high) - (1 << low)) & ~(1 << bit)) for half in (0, 1) for low, high in SEGMENTS for bit in range(low, high)])


def _bits(a: str, b: str):
    return F.bit_count(F.col(a + "f0").bitwiseXOR(F.col(b + "f0"))) + F.bit_count(F.col(a + "f1").bitwiseXOR(F.col(b + "f1")))


def _clustered(nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """nodes (node, cluster, ...) with their clusters joined by pairs of clusters (a, b)."""
    joined = components(pairs)
    met = nodes.join(shuffled(joined.select(F.col("node").alias("cluster"), "component")), "cluster", "left")
    return cut(met.withColumn("cluster", F.coalesce("component", "cluster")).select(*nodes.columns), name)


def _led(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of clusters that candidates join in the buckets (pos, rest) of keyed (f0, f1, cluster): each with its bucket's leader, that of the smallest cluster."""
    bucket = W.partitionBy("pos", "rest").orderBy("cluster", "f0", "f1").rowsBetween(W.unboundedPreceding, W.currentRow)
    led = keyed.withColumns({"l" + c: F.first(c).over(bucket) for c in ("cluster", "f0", "f1")})
    return led.filter((F.col("cluster") != F.col("lcluster")) & (_bits("", "l") <= MOST_BITS)).select(F.col("cluster").alias("a"), F.col("lcluster").alias("b"))


def clusters(nodes: DataFrame) -> DataFrame:
    """nodes (node, f0, f1, ...) with cluster: the two of any candidate pair are in one cluster. Leaders join most, by equal segments first, so few pairs are left to be made."""
    own = _clustered(nodes.withColumn("cluster", F.col("node")), _led(whole_segments(nodes.select("f0", "f1", F.col("node").alias("cluster")))), "led")
    own = _clustered(own, _led(variants(own.select("f0", "f1", "cluster"))), "led")
    keyed = variants(own.select("f0", "f1", "cluster"))
    met = keyed.alias("a").join(shuffled(keyed.alias("b")), (F.col("a.pos") == F.col("b.pos")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.cluster") > F.col("b.cluster")) & (_bits("a.", "b.") <= MOST_BITS))
    return _clustered(own, met.select(F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b")), "clusters")


def groups(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """c0, c1, group of the different contents in prints (see describe): groups joined by links of similarity or more."""
    nodes = cut(prints.groupBy("c0", "c1").agg(F.min("row").alias("node"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first(F.length("shingles")).alias("bytes")), "nodes")
    clustered = clusters(nodes)
    sizes = cut(clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).filter("n > 1"), "sizes")
    sizes = sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    bins = -(-(sizes.filter("blocks = 1").agg(F.sum("n")).first()[0] or 1) // TOGETHER)
    several = F.col("blocks") > 1
    # small clusters go together by a hash, large ones block by block
    together = F.when(several, F.col("cluster")).otherwise(-1 - F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    members = clustered.join(sizes.select("cluster", "blocks"), "cluster").withColumns({"together": together, "own": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.select("node", "cluster", "together", "own").join(prints.select(F.col("row").alias("node"), "shingles"), "node").join(sizes.select("cluster", "blocks"), "cluster").withColumn("other", other)
    dealt = dealt.select("node", "cluster", "together", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "shingles")
    found = dealt.groupBy("together", "one", "two").applyInPandas(lambda part: linked_in_blocks(part, similarity), "node long, root long")
    joined = components(cut(found, "found"), "node", "root").select("node", F.col("component").alias("group"))
    return nodes.join(shuffled(joined), "node", "left").select("c0", "c1", F.coalesce("group", "node").alias("group"))


def _winners(prints: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """prints with their group, and for each group the row that stays: that of the smallest doc_id, then of the smallest text hash."""
    grouped = prints.select("doc_id", "same", "c0", "c1").join(groups(prints, similarity), ["c0", "c1"])
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "same")
    # each content's first row, then each group's: a content that a third of all rows share is pre-aggregated
    return grouped, cut(grouped.groupBy("group").agg(F.min(order).alias("w")).select("group", "w.doc_id", "w.same"), "winners")


def similar_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of its group), kept, for every row of docs.

    Words are parted by 0x09-0x0D and blanks, A-Z lower-cased; a text of fewer than `words` words is one shingle, so only its
    equals are like it, and texts without words (null ones too) are one group. A null doc_id gets its group's smallest id that isn't null, if there
    is one. Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    grouped, winners = _winners(cut(describe(docs, words), "described"), similarity)
    met = grouped.join(winners.select("group", F.col("doc_id").alias("component_id")), "group")
    return met.select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of similar_documents(): that of its smallest doc_id, of rows that repeat that id the one of the smallest text hash. Of a group without doc_id, one row by that hash."""
    return rows_of(docs, _winners(cut(describe(docs, words), "described"), similarity)[1])


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs with the doc_id and same (md5 of the text) of kept; of rows that repeat both, any one: they differ in other columns only."""
    own = docs.withColumns({"__id": named("doc_id"), "__same": F.md5(F.coalesce(named("text"), F.lit("")))})
    keys = kept.select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"))
    met = own.join(keys.filter("__id is not null"), ["__id", "__same"]).dropDuplicates(["__id", "__same"])
    nameless = own.filter("__id is null").join(keys.filter("__id is null").select("__same").distinct(), "__same").dropDuplicates(["__same"])
    return met.select(*keep_columns(docs)).unionByName(nameless.select(*keep_columns(docs)))
