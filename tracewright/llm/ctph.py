"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes ends a chunk where it is one less than a multiple of the block size; each chunk's hash gives
one symbol of two letters. A fingerprint is 'size:symbols:symbols', the second run at double the size. Fingerprints at equal or
neighbouring sizes are compared by the edit distance of their runs at the same size.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named, prepare

WINDOW, LEAST, CHUNKS = 7, 3, 64
LETTERS = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
SYMBOLS = [a + b for a in LETTERS for b in LETTERS]
#: An odd multiplier for each place of the window, from powers of a public prime.
FACTORS = [pow(0x9E3779B1, j + 1, 1 << 32) | 1 for j in range(WINDOW)]


def _rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash that ends at each byte."""
    wide = data.astype(np.uint32)
    out = wide * np.uint32(FACTORS[0])
    for j in range(1, min(WINDOW, len(wide))):
        out[j:] += wide[:-j] * np.uint32(FACTORS[j])
    out ^= out >> np.uint32(15)
    return out * np.uint32(0x85EBCA6B) >> np.uint32(3)


def _symbols(data: bytes, rolling: np.ndarray, size: int) -> str:
    """A chunk is over a quarter of the block size long, so that texts that repeat a byte don't end one at each byte, and four times it at most, so that texts that repeat a phrase still give a row of them."""
    ends, out, start, least, most = np.flatnonzero(rolling % np.uint32(size) == size - 1), [], 0, size // 4, 4 * size
    for end in (*(ends + 1).tolist(), len(data)):
        while end - start > most:
            out.append(SYMBOLS[zlib.crc32(data[start : start + most]) & 4095])
            start += most
        if end - start > least:
            out.append(SYMBOLS[zlib.crc32(data[start:end]) & 4095])
            start = end
    if start < len(data):
        out.append(SYMBOLS[zlib.crc32(data[start:]) & 4095])
    return "".join(out)


def fingerprint(text: str) -> str:
    """Block sizes are LEAST times a power of two, the smallest that makes about CHUNKS chunks or fewer. An empty text gives '3::'."""
    data = text.encode()
    if not data:
        return f"{LEAST}::"
    size = LEAST
    while size * CHUNKS < len(data):
        size *= 2
    rolling = _rolling(np.frombuffer(data, dtype=np.uint8))
    return f"{size}:{_symbols(data, rolling, size)}:{_symbols(data, rolling, 2 * size)}"


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over both lengths, by bit-parallel common subsequence."""
    if a == b:
        return 1.0
    x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    if not x or not y:
        return 0.0
    places: dict[str, int] = {}
    for i, s in enumerate(x):
        places[s] = places.get(s, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for s in y:
        u = v & places.get(s, 0)
        v = (v + u | v - u) & full
    return 2 * (len(x) - v.bit_count()) / (len(x) + len(y))


def likeness(a: str, b: str) -> float:
    """0 to 1; equal fingerprints 1, those of incompatible block sizes 0."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2) if a2 and b2 else 0.0)
    return _alike(a2, b1) if 2 * m == n else _alike(a1, b2) if m == 2 * n else 0.0


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many characters of the next text's start, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, print_: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    new = fingerprint(changed) if changed != text else print_
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), print_, new, likeness(print_, new), likeness(print_, next_print)


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row, in order of doc_id.

    The next of the last document is the first. A null text is empty; a null doc_id comes first; rows that repeat a doc_id follow
    each other by text. Other columns are ignored; an empty table gives an empty result. Texts are ranged by doc_id in one shuffle
    and each task compares neighbours as it reads; a range's first and last text are also written out, and the last of each range
    is then joined to the first of the next range that isn't empty.
    """
    prepare(docs.sparkSession)
    rows = docs.select(named("doc_id").alias("doc_id"), F.coalesce(named("text"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"part int, role string, doc_id {kind}, text string, {RESULT}"

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, types = TaskContext.get().partitionId(), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["part", "role", "doc_id", "text", *(x.split()[0] for x in RESULT.split(", "))]
        blank, before = (None,) * len(types), None

        def batch_of(out: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.string(), ids, pa.string(), *types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        ids = None
        for batch in batches:
            out, ids = [], batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                print_ = fingerprint(text)
                if before is None:
                    out.append((part, "first", doc_id, text, *blank))
                else:
                    out.append((part, "done", before[0], None, *_compared(*before[1:], text, print_)))
                before = doc_id, text, print_
            if out:
                yield batch_of(out, ids)
        if before is not None:
            yield batch_of([(part, "last", before[0], before[1], *blank)], ids)

    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    table = cut(ranged.mapInArrow(walked, schema), "neighbours")
    first, last = table.filter("role = 'first'"), table.filter("role = 'last'")
    order = first.select("part", F.lead("part").over(W.orderBy("part")).alias("next"), F.min("part").over(W.partitionBy()).alias("start"))  # one short row a range
    order = order.select("part", F.coalesce("next", "start").alias("next"))
    meeting = last.select("part", "doc_id", "text").join(order, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_compared(t, fingerprint(t), f, fingerprint(f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", *(x.split()[0] for x in RESULT.split(", "))])

    met = meeting.select("doc_id", "text", "following").mapInArrow(ends, f"doc_id {kind}, {RESULT}")
    return table.filter("role = 'done'").drop("part", "role", "text").unionByName(met)
