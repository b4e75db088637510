"""Packing into fixed windows at target token proportions, by deficit round-robin over source queues.

Every queue (source) is the run of its documents' ids. Window k takes from each queue its share of the window plus the deficit
carried from the windows before. With whole-token service that rule has a closed form: token t of queue s is due at the virtual
time (t + 1/2) / weight, the first X tokens in order of (time, queue, t) are those served in the first X places, and each queue's
deficit after X places is its share of X less what it was served. So any task can work out any window by itself: deficits are
carried across windows and partitions without a sequential pass. A queue that runs dry leaves its share to the others.
By default weights are the queues' own token counts, with which all queues run dry together and every window has the corpus's mix.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named, prepare
from .tokens import encoder


class Schedule:
    """How many tokens each queue has been served in the first X places. sizes, weights: of the queues, in order."""

    def __init__(self, sizes: list[int], weights: list[float]):
        self.n, self.w, self.total = list(sizes), [w if n else 0 for n, w in zip(sizes, weights, strict=True)], sum(sizes)
        if any(n and w <= 0 for n, w in zip(self.n, self.w, strict=True)):
            raise ValueError("a queue with tokens needs a weight above 0")
        self.order = sorted((i for i, n in enumerate(self.n) if n), key=lambda i: self.n[i] / self.w[i])
        self.served = functools.lru_cache(maxsize=50_000)(self._served)

    def _time(self, x: int) -> float:
        left, share = x, sum(self.w)
        for i in self.order:
            if left * self.w[i] <= self.n[i] * share:
                return left / share
            left, share = left - self.n[i], share - self.w[i]
        return float("inf")

    def _served(self, x: int) -> tuple[int, ...]:
        if x >= self.total:
            return tuple(self.n)
        n, w, queues = self.n, self.w, range(len(self.n))
        time = self._time(x)
        r = [min(n[i], int(time * w[i] + 0.5)) if n[i] else 0 for i in queues]
        have = sum(r)
        while True:
            first = min(((2 * r[i] + 1) / w[i], i) for i in queues if r[i] < n[i]) if have < self.total else None
            last = max(((2 * r[i] - 1) / w[i], i) for i in queues if r[i]) if have else None
            if have < x:
                r[first[1]] += 1
                have += 1
            elif have > x:
                r[last[1]] -= 1
                have -= 1
            elif first and last and last > first:
                r[first[1]] += 1
                r[last[1]] -= 1
            else:
                return tuple(r)

    def place(self, queue: int, at: int) -> int:
        """About how many places are filled when the queue's token `at` is due."""
        time = (at + 0.5) / self.w[queue]
        return int(sum(min(n, time * w) for n, w in zip(self.n, self.w, strict=True)))

    def pieces(self, queue: int, start: int, length: int, window: int) -> Iterator[tuple[int, int, int]]:
        """(place, from, length) of the queue's tokens [start, start + length), cut at windows."""
        k = min(self.place(queue, start), self.total - 1) // window
        while self.served(k * window)[queue] > start:
            k -= 1
        end, low = start + length, self.served(k * window)
        while start < end:
            high = self.served((k + 1) * window)
            if (upto := min(end, high[queue])) > start:
                before = sum(high[:queue]) - sum(low[:queue])
                yield k * window + before + start - low[queue], start, upto - start
                start = upto
            k, low = k + 1, high


def tokenised(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Each row's ids with end_id, written once to the shared folder: part, queue, at (tokens of its queue before it in its part), doc_id, n, ids.

    queue is '=' + source, or '' for a null source.
    """
    spark = prepare(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, so_far, end = encoder(path), TaskContext.get().partitionId(), {}, np.array([end_id], dtype="<u4")
        for batch in batches:
            at, n, raw = [], [], []
            for queue, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.append(e.ids(text), end)
                at.append(so_far.get(queue, 0))
                so_far[queue] = at[-1] + len(ids)
                n.append(len(ids))
                raw.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column(1), pa.array(at, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["part", "queue", "at", "doc_id", "n", "ids"])

    rows = docs.select(named("doc_id").alias("doc_id"), F.coalesce(F.concat(F.lit("="), named("source")), F.lit("")).alias("queue"), F.coalesce(named("text"), F.lit("")).alias("text"))
    return cut(rows.mapInArrow(encoded, f"part int, queue string, at long, doc_id {dict(rows.dtypes)['doc_id']}, n long, ids binary"), "ids")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Every id of docs in one piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    Sequences are full but for the last. weights: of sources; without it their token counts. A null text is just the end id; a
    null source is a queue of its own; null or repeated doc_id values pass through row by row. Other columns are ignored, and an
    empty table gives no piece. The queues' sizes (one row a source) are all that the driver sees.
    """
    ids = tokenised(docs, path, end_id)
    sums = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    sums = cut(sums.withColumn("base", F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")), "queues")
    sizes = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).toLocalIterator()}
    queues = sorted(sizes)
    weight = [sizes[q] if weights is None else weights[q[1:] if q else None] for q in queues]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number = Schedule([sizes[q] for q in queues], weight), {q: i for i, q in enumerate(queues)}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]
        for batch in batches:
            queue, start, docs_in, n, raw = batch.columns
            rows, spans, crcs, parts = [], [], [], []
            for row, (q, first, size_in, whole) in enumerate(zip(queue.to_pylist(), start.to_pylist(), n.to_pylist(), raw.to_pylist(), strict=True)):
                for place, at, size in plan.pieces(number[q], first, size_in, length):
                    own = at - first
                    piece = whole[4 * own : 4 * (own + size)]
                    rows.append(row)
                    spans.append((place, own, size))
                    crcs.append(zlib.crc32(piece))
                    parts.append(piece)
            if rows:
                which, (place, own, size) = pa.array(rows), np.array(spans, dtype=np.int64).T
                source = pa.array([q[1:] if q else None for q in queue.to_pylist()], pa.string())
                numbers = [pa.array(c) for c in (place // length, place % length)]
                yield pa.RecordBatch.from_arrays([docs_in.take(which), pa.array(own), pa.array(size), pa.array(crcs, pa.int64()), n.take(which), *numbers, source.take(which), pa.array(parts, pa.binary())], names=names)

    placed = ids.join(sums.select("queue", "part", "base"), ["queue", "part"]).select("queue", (F.col("base") + F.col("at")).alias("start"), "doc_id", "n", "ids")
    return placed.mapInArrow(packed, f"doc_id {dict(ids.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
