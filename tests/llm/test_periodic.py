import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tracewright.llm import periodic, queries

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """(start, length, period) of all runs, period by period."""
    numbers = {}
    ids, out = np.array([numbers.setdefault(x, len(numbers)) for x in w], dtype=int), []
    for p in range(1, len(w) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids[:-p] == ids[p:], [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            x = w[s : e + p]
            if len(x) >= max(6, 4 * p) and not any(x[q:] == x[:-q] for q in range(1, p)):
                out.append((s, len(x), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(r):
    t = r.random()
    if t < 0.3:
        return [r.choice("ab") for _ in range(r.randint(0, 80))]
    if t < 0.4:
        return ["a"] * r.randint(0, 200)
    out = []
    while len(out) < r.randint(1, 300):
        unit = [r.choice("abcdefg"[: r.randint(1, 7)]) for _ in range(r.randint(1, 50))]
        out += unit * r.randint(1, 9) + unit[: r.randint(0, len(unit))]
    return out


def test_z_function():
    r = random.Random(0)
    for _ in range(200):
        x = [r.randint(0, 1) for _ in range(r.randint(0, 30))]
        want = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert periodic.z_function(x) == want


@pytest.mark.parametrize("whole,tile", [(1 << 20, 1 << 16), (0, 8), (100, 40)])
def test_periodic_runs(spark, docs, rows, none, whole, tile):
    """Against brute force: texts solved where they are read, in tiles dealt out, and both."""
    r = random.Random(whole + tile)
    texts = [" ".join(repetitive(r)) for _ in range(80)] + [x[1] for x in rows] + ["x\n" * 5, "x\t" * 6, "a b " * 4, "a b " * 3, "a b a"]
    texts += texts[:5]
    df = spark.createDataFrame([(i if i % 9 else None, t, "r", 7) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n int").repartition(4)
    got = [(x.doc_id, [tuple(y) for y in x.runs], x.collapsed) for x in periodic.periodic_runs(df, whole, tile).collect()]
    want = []
    for i, t in enumerate(texts):
        words = SPLIT.findall(t or "")
        runs = plain_runs(words)
        want.append((i if i % 9 else None, runs, plain_collapse(words, runs)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert periodic.periodic_runs(none, whole, tile).count() == 0


def edited(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digests(doc_id, text):
    w = edited(doc_id, SPLIT.findall(text or ""))
    runs = plain_runs(w)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(plain_collapse(w, runs)))


def test_digests(docs, rows):
    got = periodic.run_digests(periodic.periodic_runs(periodic.with_repeats(docs))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(digests(*r[:2])) for r in rows)


def test_registered_query(spark):
    df = queries.queries()["op13_runs"](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    got = df.collect()
    want = [digests(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_runs > 0 for r in got) > 5
