"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. Layout, all numbers little-endian:

    block*   entries, then crc32 of the entries (4 bytes)
             entry: varints shared, unshared, size; the key's unshared tail; the value of `size` bytes
             (`shared` bytes are those of the key before; the first entry of a block has its whole key)
             value: one byte, 2 or 4, the width of an id; then the ids
    bloom    count of hashes (1 byte), then the bits
    index    for each block: varint key length, its last key, varints offset and size
    footer   bloom offset and size, index offset and size, documents, ids (6 x 8 bytes), magic (8 bytes)

Keys are the document ids, 8 bytes big-endian with the sign bit turned, after a byte 1; a null id is the byte 0 and comes first.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named, new_path, prepare
from .tokens import encoder

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<6Q8s")
BLOCK_BYTES = 64 * 1024
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
MANIFEST = "path string, n_docs long, n_tokens long, first_key binary, last_key binary"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes (key, ids) in ascending key order. Holds one block, the block index and the keys' hashes."""

    def __init__(self, stream):
        self.stream, self.offset, self.block, self.last = stream, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_tokens = 0

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self.offset
        self.stream.write(data)
        self.offset += len(data)
        return at, len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            if key < self.last:
                raise ValueError("keys must ascend")
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append((self.last, *self._write(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))))
            self.block = bytearray()

    def finish(self) -> None:
        self.flush()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, dtype=np.uint8)
        for key in self.keys:
            bloom[bloom_places(key, bits)] = 1
        places = self._write(bytes([BLOOM_HASHES]) + np.packbits(bloom).tobytes())
        places += self._write(b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index))
        self._write(FOOTER.pack(*places, len(self.keys), self.n_tokens, MAGIC))


class Shard:
    """Reads a shard: all of it block by block, or the ids of one key by binary search."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        *places, self.n_docs, self.n_tokens, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        bloom, index = self._at(*places[:2]), self._at(*places[2:])
        self.bloom = np.unpackbits(np.frombuffer(bloom, dtype=np.uint8, offset=1))
        self.index, at = [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            key, at = index[at : at + n], at + n
            start, at = read_varint(index, at)
            n, at = read_varint(index, at)
            self.index.append((key, start, n))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, offset: int, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._at(offset, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < size - 4:
            shared, at = read_varint(data, at)
            unshared, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, dtype=f"<u{data[at]}", count=(n - 1) // data[at], offset=at + 1).astype("<u4")
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, offset, size in self.index:
            yield from self._block(offset, size)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document with this key."""
        if not self.bloom[bloom_places(key, len(self.bloom))].all():
            return []
        found = []
        for last, offset, size in self.index[bisect_left(self.index, key, key=lambda x: x[0]) :]:
            found += [ids for k, ids in self._block(offset, size) if k == key]
            if last > key:
                break
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, path: str, end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Encodes every text, appends end_id, and writes one shard for each range of doc_id. Returns the manifest, one row a shard.

    Texts are ranged by doc_id in one shuffle and encoded by the task that writes them. A task that runs again writes a file of
    another name; the manifest, a table in the shared folder, names only the files of tasks that ended well. doc_id must be whole
    numbers; a null one comes first; rows that repeat a doc_id are all kept, in order of their text; a null text has no ids but
    the end. Other columns are ignored. An empty table gives an empty manifest.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or new_path(spark, "shards")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = name = first = None
        e = encoder(path)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.sst"
                    fs, inner = pafs.FileSystem.from_uri(name)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(inner)
                    writer, first = ShardWriter(stream), key_of(doc_id)
                ids = e.ids(text or "")
                writer.add(key_of(doc_id), ids if end_id is None else np.append(ids, np.array([end_id], dtype="<u4")))
        if writer is not None:
            last = writer.last
            writer.finish()
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_docs": [len(writer.keys)], "n_tokens": [writer.n_tokens], "first_key": [first], "last_key": [last]})

    rows = docs.select(named("doc_id").cast("long").alias("doc_id"), named("text").alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(ranged.mapInArrow(written, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    before = W.orderBy("first_key").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    placed = manifest.select("path", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard, rows, held = Shard(path), [], 0
                for key, ids in shard:
                    raw = ids.tobytes()
                    rows.append((id_of(key), base, len(ids), zlib.crc32(raw), raw))
                    base += len(ids)
                    held += len(raw)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)], names=names)
                shard.close()

    shards = max(1, manifest.count())
    return placed.repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


@functools.lru_cache(maxsize=64)
def _opened(path: str) -> Shard:
    return Shard(path)


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents with the ids in wanted.doc_id, by binary search in the shards; absent ids give no row.

    Each task bisects the shards' first keys (one short row a shard), then asks that shard's Bloom filter, index and block.
    """
    ranges = [(r.first_key, r.path) for r in manifest.select("first_key", "path").orderBy("first_key").toLocalIterator()]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _ in ranges]
        for batch in batches:
            rows = []
            for doc_id in batch.column(0).to_pylist():
                key = key_of(doc_id)
                at = bisect_left(firsts, key)
                at -= at == len(firsts) or firsts[at] != key
                if at >= 0:
                    rows += [(doc_id, ids.tobytes()) for ids in _opened(ranges[at][1]).get(key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "ids"])

    return wanted.select(named("doc_id").cast("long").alias("doc_id")).mapInArrow(found, "doc_id long, ids binary")

