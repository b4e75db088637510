"""Best-fit decreasing over all documents at once, with a segment tree over remaining capacities.

Best-fit decreasing depends on the pieces' lengths alone, and a length is at most the size of a sequence. So one histogram (at most
`size` rows, whatever the corpus) is the whole input of the plan: lengths go from long to short, the tree finds the tightest open
bin in logarithmic time, and bins that are alike are filled together, as one by one they would be filled alike. The plan is a table
of runs: the pieces of one length with ranks from..to go to the bins from `first_bin` on, `each` a bin, from a stated offset. Its
size depends on `size`, not on the corpus. Each piece then looks its own place up by its rank among the pieces of its length, which is its
rank within its part plus the counts of the parts before: no piece is gathered anywhere, and no bin is cut at a partition's end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named, prepare
from .tokens import encoder


class OpenBins:
    """Open bins by remaining capacity, as stretches (first bin, how many); a segment tree over capacities finds the tightest."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = [False] * (2 * self.leaves)
        self.stretches: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, first: int, bins: int) -> None:
        if capacity and bins:
            self.stretches[capacity].append((first, bins))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        stretch = self.stretches[capacity].pop()
        self._mark(capacity)
        return stretch

    def _mark(self, capacity: int) -> None:
        node = self.leaves + capacity
        self.filled[node] = bool(self.stretches[capacity])
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] or self.filled[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least `length` that an open bin has."""
        node = self.leaves + length
        while not self.filled[node]:
            while node % 2:  # a right child: its parent's right neighbour comes next
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        return node - self.leaves


class Plan:
    """Where the pieces of each length go. counts: pieces by length, from 1 to `size`."""

    def __init__(self, counts: dict[int, int], size: int):
        if any(not 0 < n <= size for n in counts):
            raise ValueError("lengths lie between 1 and the size of a sequence")
        self.bins, at, runs = 0, 0, []
        self.first = np.zeros(size + 1, dtype=np.int64)
        opened = OpenBins(size)
        for length in sorted(counts, reverse=True):
            self.first[length], left = at, counts[length]
            while left:
                capacity = opened.tightest(length)
                each = (size if capacity is None else capacity) // length
                if capacity is None:
                    start, bins, capacity = self.bins, -(-left // each), size
                    self.bins += bins
                else:
                    start, bins = opened.take(capacity)
                full = min(bins, left // each)
                parts = [(start, full, each)] if full else []
                if full < bins and (rest := min(each, left - full * each)):
                    parts.append((start + full, 1, rest))
                used = 0
                for first, many, pieces in parts:
                    runs.append((at, first, pieces, size - capacity))
                    opened.put(capacity - pieces * length, first, many)
                    at, left, used = at + many * pieces, left - many * pieces, used + many
                opened.put(capacity, start + used, bins - used)
        self.runs = np.array(runs, dtype=np.int64).reshape(-1, 4)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these lengths and ranks among the pieces of their length."""
        at = self.first[length] + rank
        run = self.runs[np.searchsorted(self.runs[:, 0], at, side="right") - 1]
        k = at - run[:, 0]
        return run[:, 1] + k // run[:, 2], run[:, 3] + k % run[:, 2] * length


PIECE = "part int, doc_id {}, piece int, start long, length int, at long, ids_crc32 long, ids binary"


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """Each document's ids and end_id in pieces of `size`, the last one shorter, written once to the shared folder; at: the pieces of the same length before it in its part."""
    spark = prepare(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, end = encoder(path), TaskContext.get().partitionId(), np.array([end_id], dtype="<u4")
        so_far = [0] * (size + 1)
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            row, columns = [], [[] for _ in types]
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(e.ids(text), end)
                for k, start in enumerate(range(0, len(ids), size)):
                    raw = ids[start : start + size].tobytes()
                    length = len(raw) // 4
                    row.append(i)
                    for column, value in zip(columns, (k, start, length, so_far[length], zlib.crc32(raw), raw), strict=True):
                        column.append(value)
                    so_far[length] += 1
            if row:
                made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(row), pa.int32()), batch.column(0).take(pa.array(row)), *made], names=["part", "doc_id", "piece", "start", "length", "at", "ids_crc32", "ids"])

    rows = docs.select(named("doc_id").alias("doc_id"), F.coalesce(named("text"), F.lit("")).alias("text"))
    return cut(rows.mapInArrow(encoded, PIECE.format(dict(rows.dtypes)["doc_id"])), "pieces")


def best_fit(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of docs in a sequence of at most `size` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    Only documents longer than `size` (end_id counted) are cut. A null or empty text is just its end id; null or repeated doc_id
    values pass through row by row; other columns are ignored; an empty table gives no piece. Pieces of equal length are
    interchangeable, so which of them meet depends on how the table was read, and how many sequences there are doesn't. The driver
    sees the histogram of lengths.
    """
    pieces = pieces_of(docs, path, size, end_id)
    sums = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    sums = cut(sums.select("part", "length", "n", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base")), "lengths")
    plan = Plan({r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}, size)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        where, offset = plan.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": where, "offset": offset})

    ranked = pieces.join(sums.select("part", "length", "base"), ["part", "length"]).withColumn("place", place("length", F.col("base") + F.col("at")))
    return ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "place.sequence_id", "place.offset", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian unsigned 32-bit), starts (offsets of its pieces) of best_fit()'s rows. One sequence's tokens are all that meets in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return whole.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("parts.offset").alias("starts"))
