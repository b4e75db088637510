"""Alignment of two tokenizers' tokens by the byte offsets at which both end.

Each text's tokens of either side give a dictionary from cumulative byte ends to token numbers. The ends in both dictionaries, in
order, slice both id lists into groups; every A token of a group is linked to every B token of it. How many documents of the corpus
hold an id pair linked is counted by blocks: a task that tokenises makes blocks of documents up to a stated number of links, and
sends a block's different pairs with their numbers of documents, so that a pair found in all documents makes a row a block. Sums go
back to the blocks the same way, and each block's documents meet them there.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named, prepare
from .tokens import NOT_PLAIN, encoder, piece_encoder

#: A block of documents is closed once it holds so many (document, id pair) entries, or documents.
BLOCK_ENTRIES, BLOCK_DOCUMENTS = 1 << 20, 1 << 16
#: Links of a slice of groups that are expanded at once.
SLICE_LINKS = 1 << 20


class Vocabularies:
    """Both tokenizers, the bytes of their tokens and the ids as text."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, plain_specials=True), piece_encoder(path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.lengths_a, self.lengths_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        size = max(len(self.bytes_a), len(self.bytes_b))
        #: Ids as text, each followed by a comma, by the bar after a group's A side, and by the semicolon after a group.
        self.size, self.names = size, np.array([f"{i}{sign}" for sign in ",|;" for i in range(size)], dtype=bytes)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, or None where a text is empty or either side's bytes aren't the blank and the text."""
        asked = [t for t in texts if t]
        out = []
        for text, a, b in zip(asked, self.a.batch([" " + t for t in asked]), self.b.batch(asked), strict=True):
            whole = (" " + text).encode()
            if self.b.cuts and not NOT_PLAIN.search(text):  # nothing rewrites these characters, so bytes can only be missing
                same = self.lengths_a[a].sum() == len(whole) == self.lengths_b[b].sum()
            else:
                same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
            out.append((a.astype(np.int64), b.astype(np.int64)) if same else None)
        found = iter(out)
        return [next(found) if t else None for t in texts]

    def said(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        """The groups as `a1,a2|b1;a3|b2,b3`: every token has its place, its group's A side coming before the B side."""
        which = np.empty(len(a) + len(b), np.int64)
        which[np.arange(len(a)) + np.repeat(cuts_b[:-1], np.diff(cuts_a))] = a
        which[np.arange(len(b)) + np.repeat(cuts_a[1:], np.diff(cuts_b))] = b
        which[cuts_a[1:] + cuts_b[:-1] - 1] += self.size
        which[cuts_a[1:] + cuts_b[1:] - 1] += 2 * self.size
        return self.names[which].tobytes().translate(None, b"\0")[:-1].decode()  # fixed widths are filled up with zero bytes


@functools.lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def groups_of(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups begin in either id list, and the lists' ends last, from the byte lengths of the tokens.

    Ends only grow, so a dictionary holds them in order: A's ends that B's dictionary knows are the common ones, sorted.
    """
    at_a = dict(zip(np.cumsum(lengths_a).tolist(), range(1, len(lengths_a) + 1), strict=True))
    at_b = dict(zip(np.cumsum(lengths_b).tolist(), range(1, len(lengths_b) + 1), strict=True))
    one = np.fromiter(at_a.values(), np.int64, len(at_a))
    two = np.fromiter(map(at_b.get, at_a, itertools.repeat(0)), np.int64, len(at_a))  # 0: no end of B's
    return np.concatenate([[0], one[two > 0]]), np.concatenate([[0], two[two > 0]])


def linked(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Different id pairs (a * size_b + b, in order) that share a group, and how many links each has."""
    many_a, many_b = np.diff(cuts_a), np.diff(cuts_b)
    links = many_a * many_b
    upto = np.cumsum(links)
    keys, times, g = [], [], 0
    while g < len(links):
        end = max(g + 1, int(np.searchsorted(upto, (upto[g - 1] if g else 0) + SLICE_LINKS, side="right")))
        if links[g] > SLICE_LINKS:  # one long group: different ids of both sides, with how often they come
            x, n = np.unique(a[cuts_a[g] : cuts_a[g + 1]], return_counts=True)
            y, m = np.unique(b[cuts_b[g] : cuts_b[g + 1]], return_counts=True)
            keys.append((x[:, None] * size_b + y).ravel())
            times.append((n[:, None] * m).ravel())
        else:
            k, first = links[g:end], np.repeat(upto[g:end] - links[g:end], links[g:end])
            within = np.arange(len(first)) + (upto[g - 1] if g else 0) - first
            width = np.repeat(many_b[g:end], k)
            pairs, n = np.unique(a[np.repeat(cuts_a[g:end], k) + within // width] * size_b + b[np.repeat(cuts_b[g:end], k) + within % width], return_counts=True)
            keys.append(pairs)
            times.append(n)
        g = end
    if len(keys) == 1:
        return keys[0], times[0]
    pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, place, np.concatenate(times))
    return pairs, total


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string"
NUMBERS = pa.list_(pa.int64())


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]).astype(np.int64), pa.int64()))


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """Each row's groups and linked id pairs, and each block's different pairs, written once to the shared folder.

    Rows of documents: block, doc_id, n_a, n_b, n_groups, n_links, groups (digest: its SHA-256), pairs (a * size_b + b), links (of each pair). Rows of blocks: block, pairs,
    links (documents of the block that hold the pair), with is_block true.
    """
    spark = prepare(docs.sparkSession)
    size_b = len(vocabularies(path_a, path_b).bytes_b)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, part, block, held, n_docs, entries = vocabularies(path_a, path_b), TaskContext.get().partitionId(), 0, [], 0, 0
        names = ["is_block", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"]

        def rows(is_block: bool, ids: pa.Array, numbers: list[tuple], texts: list[str], pairs: list[np.ndarray], links: list[np.ndarray]) -> pa.RecordBatch:
            n, columns = len(ids), zip(*numbers, strict=True) if numbers else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array([is_block] * n), pa.array([part << 32 | block] * n, pa.int64()), ids, *(pa.array(c, pa.int64()) for c in columns), pa.array(texts, pa.string()), lists(pairs), lists(links)], names=names)

        def closed(kind: pa.DataType) -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64),) * 2
            return rows(True, pa.nulls(1, kind), [(0, 0, 0, 0)], [""], [pairs], [n])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            numbers, texts, pairs, links = [], [], [], []
            for tokens in v.tokens(batch.column(1).to_pylist()):
                if tokens is None:
                    numbers.append((0, 0, 0, 0))
                    texts.append("")
                    pairs.append(np.empty(0, np.int64))
                    links.append(np.empty(0, np.int64))
                    continue
                a, b = tokens
                cuts_a, cuts_b = groups_of(v.lengths_a[a], v.lengths_b[b])
                key, n = linked(a, b, cuts_a, cuts_b, size_b)
                said = v.said(a, b, cuts_a, cuts_b)
                numbers.append((len(a), len(b), len(cuts_a) - 1, int(n.sum())))
                texts.append(hashlib.sha256(said.encode()).hexdigest() if digest else said)
                pairs.append(key)
                links.append(n)
                held.append(key)
                entries += len(key)
            if numbers:
                yield rows(False, batch.column(0), numbers, texts, pairs, links)
            n_docs += len(numbers)
            if entries >= BLOCK_ENTRIES or n_docs >= BLOCK_DOCUMENTS:
                yield closed(kind)
                block, held, n_docs, entries = block + 1, [], 0, 0
        if n_docs:
            yield closed(kind)

    rows = docs.select(named("doc_id").alias("doc_id"), F.coalesce(named("text"), F.lit("")).alias("text"))
    return cut(rows.mapInArrow(made, f"is_block boolean, block long, doc_id {dict(rows.dtypes)['doc_id']}, {ALIGNED}, pairs array<long>, links array<long>"), "aligned")


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """pair, n_documents (that hold it linked), best (no pair of its A id has more) over all of aligned()'s blocks."""
    sums = table.filter("is_block").select(F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n_documents"))
    top = F.max("n_documents").over(W.partitionBy(F.floor(F.col("pair") / size_b)))  # at most as many rows as B has ids
    return sums.withColumn("best", F.col("n_documents") == top)


def _measured(kind: str):
    def measured(_: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("pair").to_numpy())
        pair, n, best = (counts.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n_documents", "best"))
        pairs, links = (docs.column(c).combine_chunks() for c in ("pairs", "links"))
        ends = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        at = np.searchsorted(pair, pairs.flatten().to_numpy())
        times = links.flatten().to_numpy()
        sums = []
        for worth in (best[at] if len(pair) else np.empty(0), n[at] if len(pair) else np.empty(0)):
            run = np.concatenate([[0], np.cumsum(times * worth.astype(np.int64))])
            sums.append(pa.array(run[ends[1:]] - run[ends[:-1]], pa.int64()))
        return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", sums[0]).append_column("count_sum", sums[1]).append_column("groups", docs.column("groups"))

    return measured


def alignment(docs: DataFrame, path_a: str, path_b: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row.

    groups: `a1,a2|b1;a3|b2,b3`, ids in order (digest: its SHA-256 in hexadecimal). n_links: pairs of an A and a B token in one
    group. count_sum: over links, how many documents of the corpus hold that id pair linked; n_best: links whose count is the highest
    of their A id, ties included. A null or empty text, or one whose bytes either side's tokens don't give back, has no tokens:
    zeros, and '' for groups (no digest either). Null and repeated doc_id values pass through row by row, each row being a document;
    other columns are ignored; an empty table gives an empty result. path_a: a byte-level vocabulary of the tokenizers library,
    given a blank and the text; path_b: a sentencepiece model, given the text.
    """
    size_b = len(vocabularies(path_a, path_b).bytes_b)
    table = aligned(docs, path_a, path_b, digest)
    asked = table.filter("is_block").select("block", F.explode("pairs").alias("pair"))
    counts = asked.join(pair_counts(table, size_b), "pair").select("block", "pair", "n_documents", "best")
    kind = dict(table.dtypes)["doc_id"]
    rows = table.filter("not is_block").select(F.col("block").alias("of"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links")
    return rows.groupBy("of").cogroup(counts.groupBy("block")).applyInArrow(_measured(kind), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
