"""The registered corpus queries on the smallest tables: columns, types, and their results against SQL or plain versions."""

import bisect
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_corpus import plain_base, plain_likeness
from test_duplicates import plain_fingerprint, reach
from tokenizers import Tokenizer

from tracewright.llm import quality, queries, secrets

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, first_slot bigint, n_slots bigint",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op6_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_pack": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_ctph": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
}


@pytest.fixture(scope="module")
def result(spark):
    """Rows of a query by its first column, after its columns and types are checked; each query runs once."""
    done = {}

    def run(name):
        if name not in done:
            df = queries.queries()[name](spark, SF)
            assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
            done[name] = df.collect()
        return done[name]

    return run


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, result):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert columns == [x.split()[0] for x in COLUMNS[name].split(", ")]
    assert sorted(repr([plain(v) for v in r]) for r in result(name)) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())


def test_quality_scores(spark, result, texts):
    """Scores are the sums of the model's table entries; labels of held-out rows teach nothing."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    taught = [r for r in labels.collect() if not held(r.doc_id)]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame(taught, labels.schema))
    for r in result("op1_quality"):
        x = quality.features(texts[r.doc_id])
        total = model.intercept + sum(t[bisect.bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        total += sum(t[bisect.bisect_right(a.tolist(), x[i]), bisect.bisect_right(b.tolist(), x[j])] for i, j, a, b, t in model.pairs)
        assert r.held_out == held(r.doc_id) and r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9) and r.predicted == (r.score >= 0.3)
    assert len(result("op1_quality")) == len(texts)


def test_simhash_groups(result, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = reach(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result("op4_simhash")} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_tokens(result, texts):
    library, words = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {tuple(r) for r in result("op5_token_counts")} == {(i, len(texts[i].encode()), len(x), len(x) > 1024) for i, x in ids.items()}
    start, want = 0, set()
    for i in sorted(texts):
        x = [*words.encode(texts[i], add_special_tokens=False).ids, 1]
        want.add((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert {tuple(r) for r in result("op7_token_files")} == want
    pieces = sorted(result("op8_pack"), key=lambda r: (r.doc_id, r.start))
    place, filled = {}, {}
    for p in pieces:
        x = [*ids[p.doc_id], 1]
        assert p.start == place.get(p.doc_id, 0) and p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes())
        place[p.doc_id] = p.start + p.length
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert place == {i: len(x) + 1 for i, x in ids.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) == math.ceil(sum(place.values()) / 2048)


def test_secret_spans(spark, result, texts):
    """Base spans by plain patterns; added spans are those whose plain ratio, or that of a stretch of them, reaches the threshold."""
    for r in result("op9_secrets"):
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if x and not x.startswith("markov")) == base
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = [(-1, "see kJ8Qz2LwXv9RtB4mNc7YpD1sGh6Wa3Ue here"), (-2, "see the_ordinary_name_of_things here"), (-3, "x" * 40), (-4, "note Qz7VbK2xWm9TfR4cYh8NpL3d=setting")]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    model = secrets.train_on(docs)

    def ratio(v):
        return sum(model[(ord(a) - 33) * 94 + ord(b) - 33] for a, b in zip(v, v[1:], strict=False))

    candidates = {v for t in [*texts.values(), *(t for _, t in planted)] for v in re.findall(r"[A-Za-z0-9+/_=-]{16,}", t)}
    found = {x.doc_id: x.spans for x in secrets.find_secrets(docs).collect()}
    text = texts | dict(planted)
    added = {s["value"] for spans in found.values() for s in spans if s["kind"] == "markov"}
    for i, spans in found.items():
        taken = [(s, e) for _, s, e in plain_base(text[i])]
        for s in spans:
            if s["kind"] == "markov":
                assert text[i][s["start"] : s["end"]] == s["value"] and len(s["value"]) >= 16
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text[i]):  # whole runs that no rule touches
            if all(e <= m.start() or s >= m.end() for s, e in taken) and ratio(m.group()) >= len(m.group()) - 1 + 1e-6:
                assert m.group() in added
    for v in added & candidates:  # a run judged random holds a stretch that is
        assert ratio(v) >= len(v) - 1 - 1e-3 or any(ratio(p) >= len(p) - 1 - 1e-3 for p in re.split("[=/_-]+", v) if len(p) > 1)
    marked = {i: [s["value"] for s in found[i]] for i, _ in planted}
    assert marked[-1] == ["kJ8Qz2LwXv9RtB4mNc7YpD1sGh6Wa3Ue"] and not marked[-2] and not marked[-3] and any("Qz7VbK2xWm9TfR4cYh8NpL3d" in v for v in marked[-4])


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
M = 0xFFFFFFFF


def plain_chunks(data, size):
    """Chunks of bytes, one byte at a time."""
    factors = [pow(0x9E3779B1, j + 1, 1 << 32) | 1 for j in range(7)]
    out, start = [], 0
    for i in range(len(data)):
        h = sum(data[i - j] * factors[j] for j in range(min(7, i + 1))) & M
        h = ((h ^ h >> 15) * 0x85EBCA6B & M) >> 3
        length = i + 1 - start
        if length > 4 * size:  # too long: cut before this byte
            out.append(data[start : start + 4 * size])
            start, length = start + 4 * size, length - 4 * size
        if h % size == size - 1 and length > size // 4:
            out.append(data[start : i + 1])
            start = i + 1
    return out + [data[start:]] if start < len(data) else out


def plain_print(text):
    data, size = text.encode(), 3
    while size * 64 < len(data):
        size *= 2
    two = lambda c: LETTERS[zlib.crc32(c) % 4096 // 64] + LETTERS[zlib.crc32(c) % 64]
    return ":".join([str(size), *("".join(map(two, plain_chunks(data, s))) for s in (size, 2 * size))])


def plain_compare(a, b):
    (m, *x), (n, *y) = a.split(":"), b.split(":")
    pairs = {0: [(x[0], y[0]), (x[1], y[1])], 1: [(x[1], y[0])], -1: [(x[0], y[1])]}.get(int(math.log2(int(n) / int(m))) if int(n) != int(m) else 0, [])
    cut = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    return 1.0 if a == b else max([plain_likeness(cut(p), cut(q)) for p, q in pairs if p and q], default=0.0)


def test_piecewise_hashes(result, texts):
    ids = sorted(texts)
    short = sorted((i for i in ids), key=lambda i: len(texts[i]))[:120]  # the plain edit distance takes long
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = {r.doc_id: r for r in result("op10_ctph")}
    assert sorted(got) == ids
    for i in ids:
        t, nxt = texts[i], texts[following[i]]
        new = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        if i in short:
            assert got[i].fingerprint == plain_print(t) and got[i].edited_fingerprint == plain_print(new)
            assert got[i].near_edited == pytest.approx(plain_compare(plain_print(t), plain_print(new)))
            if len(nxt) < 4000:
                assert got[i].near_next == pytest.approx(plain_compare(plain_print(t), plain_print(nxt)))


def test_prefixes_of_the_written_mix_hold_the_shares(spark, tmp_path):
    from tracewright.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixing.mixed_documents(docs, block=64).write.parquet(str(tmp_path / "mix"))
    files = sorted(p for p in (tmp_path / "mix").glob("part-*"))
    sizes = []
    for p in files:
        for r in spark.read.parquet(str(p)).select("source", mixing.word_count(F.col("text")).alias("n")).collect():
            sizes.append((r.source, r.n))
    target = {r.source: r.target for r in mixing.taken_words(docs, block=64).join(docs, "doc_id").select("source", "target").distinct().collect()}
    whole, gone, done = sum(target.values()), 0, {}
    for source, n in sizes:
        gone, done[source] = gone + n, done.get(source, 0) + n
        if 0.3 * whole < gone < 0.9 * whole:
            for s, t in target.items():  # a long text weighs at once, the schedule's share within it
                assert abs(done.get(s, 0) / gone - t / whole) < 0.12
