"""Periodic runs of words, by tiles scaled to the period.

Periods are taken by octave: S = 2^k <= period < 2S. A document's words are exploded into tiles for each octave: a stretch of words
with as much overlap as its periods need, so that tiles are solved independently. In a tile anchors stand S words apart. A run of
four periods or more holds whole stretches of 2S words from an anchor that come again a period later; window hashes find such
(anchor, period) pairs by comparing columns, and Z-functions from the anchor, over the words after it and over the words before it
backwards, give exactly how far the words agree at each period. What a tile finds are fragments of runs. They are shuffled by document and
period and stitched where they meet; then what is long enough is a run. A stretch with a smaller period
(a divisor, as stretches are long) shows it in any window of two periods, so every tile leaves its fragments out.

A text of up to `whole` characters is one tile for each octave, so no tile of it needs to travel: it is solved where it is read.
Tiles of longer texts are dealt out to all tasks.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, named, prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run is at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts of more characters have their tiles dealt out; words of such a tile (more for long periods); words solved together elsewhere.
WHOLE_CHARS, TILE_WORDS, TOGETHER = 1 << 20, 1 << 16, 1 << 18


def z_function(x: list[int]) -> list[int]:
    """How long x agrees with itself from each place on."""
    n = len(x)
    z = [n] * (n > 0) + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def least_agreement(period: int) -> int:
    """Places i with word i = word i + period in a row that make a run."""
    return max(LEAST_WORDS, LEAST_PERIODS * period) - period


class Hashes:
    """Hashes of all windows of 1, 2, 4, ... words, one octave after the other. Equal windows have equal hashes; the reverse is left to the Z-functions."""

    def __init__(self, ids: np.ndarray):
        self.size, self.h = 1, (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.h ^= self.h >> np.uint64(29)

    def double(self) -> None:
        n = max(0, len(self.h) - self.size)
        self.h = self.h[:n] * np.uint64(0xBF58476D1CE4E5B9 + 2 * self.size) + self.h[self.size : self.size + n]
        self.h ^= self.h >> np.uint64(31)
        self.size *= 2

    def candidates(self) -> Iterator[tuple[int, list[int]]]:
        """Anchors, and the periods of their octave at which the next 2 * size words may come again."""
        size = self.size
        rows = len(self.h) // size + 1
        table = np.zeros(rows * size, np.uint64)
        table[: len(self.h)] = self.h
        table = table.reshape(rows, size)
        same = table[1:] == table[:-1, :1]
        anchor, over = np.nonzero(same[:-1] & same[1:])
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        for rows_of, periods in zip(np.split(anchor, cuts), np.split(over, cuts), strict=True):
            if len(rows_of):
                yield int(rows_of[0]) * size, (periods + size).tolist()


def fragments(ids: np.ndarray, hashes: Hashes) -> list[tuple[int, int, int]]:
    """(period, from, to) for the octave of `hashes`: places in from..to agree with those a period later; neighbours in the tile are joined."""
    size, n, found = hashes.size, len(ids), {}
    for c, periods in hashes.candidates():
        ahead = z_function(ids[c : c + 5 * size].tolist())
        smaller = max((d + ahead[d] for d in range(1, min(size, len(ahead)))), default=0)
        if smaller >= 4 * size:
            continue
        low, high = max(0, c - size), min(n, c + 2 * size)
        back = z_function([*ids[low:c][::-1].tolist(), -(1 << 62), *ids[low:high][::-1].tolist()])
        for p in periods:
            reach = min(ahead[p], 3 * size) if p < len(ahead) else 0
            if reach < 2 * size or smaller >= 2 * size + p:
                continue  # equal hashes of different words, or words of a smaller period, which no run of this period can hold
            start, end = c - back[c - low + 1 + high - (c + p)], c + reach
            stretches = found.setdefault(p, [])
            if stretches and stretches[-1][1] >= start:
                stretches[-1][1] = max(stretches[-1][1], end)
            else:
                stretches.append([start, end])
    return [(p, *s) for p, stretches in found.items() for s in stretches]


def octaves(n: int) -> int:
    """Octaves of the periods that a text of n words can hold."""
    return (n // LEAST_PERIODS).bit_length()


def number(words: list[list[str]]) -> list[np.ndarray]:
    """Words as numbers, equal ones alike."""
    ids = collections.defaultdict(itertools.count().__next__)
    return [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in words]


def solved(words: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Fragments of whole texts, those too short for a run left out. Texts lie one after the other with a number of their own between them, which nothing equals."""
    parts = number(words)
    gap = np.int64(-1)
    ids = np.concatenate([x for i, part in enumerate(parts) for x in (part, [gap - i])]).astype(np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    hashes = Hashes(ids)
    for k in range(octaves(max(map(len, words)))):
        if k:
            hashes.double()
        for p, start, end in fragments(ids, hashes):
            if end - start >= least_agreement(p):
                doc = int(np.searchsorted(ends, start, side="right"))
                begin = int(ends[doc]) - len(parts[doc]) - 1
                out[doc].append((p, start - begin, end - begin))
    return out


def tiles(ids: np.ndarray, words: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(octave, place of its first word, numbers) of a document's tiles: `words` words or eight times S, whichever is more, with S words before and 5 S after."""
    for k in range(octaves(len(ids))):
        size = 1 << k
        step = max(words, 8 * size) // size * size
        for at in range(0, len(ids), step):
            first = max(0, at - size)
            yield k, first, ids[first : at + step + 5 * size]


FRAGMENTS = "array<struct<period:int,start:long,end:long>>"


def _first(whole: int):
    def solving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("period", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [WORD.findall(t) if len(t) <= whole else [] for t in texts]
            found, first = [], 0
            while first < len(words):
                last, held = first, 0
                while last < len(words) and (last == first or held + len(words[last]) <= TOGETHER):
                    held, last = held + len(words[last]), last + 1
                found += solved(words[first:last])
                first = last
            keys, out, made = [], [], []
            for text, w, f in zip(texts, words, found, strict=True):
                is_long = len(text) > whole
                keys.append(hashlib.md5(text.encode()).hexdigest() if f or is_long else None)
                out.append(text if f or is_long else " ".join(w))
                made.append(None if is_long else [{"period": p, "start": s, "end": e} for p, s, e in f])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0), pa.array(out, pa.string()), pa.array(made, kind)], names=["key", "doc_id", "text", "found"])

    return solving


def _exploder(words: int):
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, first, ids in tiles(number([WORD.findall(text)])[0].astype("<i4"), words):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["key", "octave", "first", "ids"])

    return exploded


def _solver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, octave, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(raw, "<i4").astype(np.int64)
            hashes = Hashes(ids)
            for _ in range(octave):
                hashes.double()
            out += [(key, p, first + start, first + end) for p, start, end in fragments(ids, hashes)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["key", "period", "start", "end"])


def stitched(found: DataFrame) -> DataFrame:
    """key, start, length, period of the runs whose fragments these are (key, period, start, end)."""
    by = W.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    opened = found.distinct().withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    joined = opened.withColumn("stretch", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = joined.groupBy("key", "period", "stretch").agg(F.min("start").alias("start"), (F.max("end") + F.col("period")).alias("end"))
    enough = whole.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST_WORDS), F.lit(LEAST_PERIODS) * F.col("period")))
    return enough.select("key", "start", (F.col("end") - F.col("start")).alias("length"), F.col("period").cast("long").alias("period"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = WORD.findall(text)
            if runs:
                change = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                words = itertools.compress(words, (np.cumsum(change)[:-1] == 0).tolist())
            texts.append(" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, whole: int = WHOLE_CHARS, tile: int = TILE_WORDS) -> DataFrame:
    """doc_id, runs (array of start, length, period, in order of start and period), collapsed (the words that are kept, a space between them) of every row.

    A run is a stretch of LEAST_WORDS words and LEAST_PERIODS of its smallest period or more that no neighbouring word extends;
    its words after the first period go. Words are what white space (blank, tab to carriage return) parts. A null text has no words:
    no runs, and an empty collapsed text. Null and repeated doc_id values pass through, one result a row; other columns are ignored; an empty
    table gives an empty result. A document is known by the digest of its text, as equal texts have equal runs.
    """
    prepare(docs.sparkSession)
    rows = docs.select(named("doc_id").alias("doc_id"), F.coalesce(named("text"), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # one pass: finished texts as they are kept; texts with fragments, and long ones (no fragments yet), whole and with a key
    table = cut(rows.mapInArrow(_first(whole), f"key string, doc_id {kind}, text string, found {FRAGMENTS}"), "texts")
    short, many = table.filter("found is not null"), table.filter("found is null")
    dealt = many.select("key", "text").mapInArrow(_exploder(tile), "key string, octave int, first long, ids binary").repartition("key", "octave", "first")
    long_found = dealt.mapInArrow(_solver, "key string, period int, start long, end long")
    found = short.filter(F.size("found") > 0).select("key", F.explode("found").alias("f")).select("key", "f.period", "f.start", "f.end")
    runs = stitched(found.unionByName(long_found)).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    runs = runs.select("key", F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    run_type = "array<struct<start:long,length:long,period:long>>"
    none = F.array().cast(run_type)
    open_ = short.filter(F.size("found") > 0).select("key", "doc_id", "text").unionByName(many.drop("found"))
    ready = open_.join(runs, "key", "left").select("text", F.coalesce("runs", none).alias("runs"), "doc_id")
    ended = ready.mapInArrow(_collapsed, f"doc_id {kind}, runs {run_type}, collapsed string")
    return short.filter(F.size("found") == 0).select("doc_id", none.alias("runs"), F.col("text").alias("collapsed")).unionByName(ended)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts with a stretch of their words repeated to their end.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10): where h % 10 = 0 and there are n > 0 words, those from a = g % n on
    become the words a to a + p over and over, with p = 1 + floor((n - a) / (3 + g % 8)); the words are then joined by blanks. Other
    texts stay, as do those without doc_id.
    """
    h = F.crc32(named("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.nullif(F.size(w), F.lit(0))
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        over = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(over, F.lit(1), n - a)), " "))

    words = F.regexp_extract_all(named("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0)))  # the lambda's variable keeps the words, found once
    return docs.select(named("doc_id").alias("doc_id"), F.coalesce(changed, named("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the run with the greatest length/period (ties: smallest start, then period; null without runs); digests of the runs and of the kept words."""
    better = F.aggregate(
        "runs", F.element_at("runs", 1),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    rows = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, better).alias("best"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
