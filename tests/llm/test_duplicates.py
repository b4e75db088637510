import random

import numpy as np
import pytest
import xxhash

from tracewright.llm import components, lines, pivots, simhash


def reach(n, links):
    up = {x: x for x in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in n}


@pytest.mark.parametrize("local", [0, 30, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr("tracewright.components.LOCAL_LINKS", local)
    r = random.Random(4)
    for links in ([], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(r.randint(0, 99), r.randint(0, 99)) for _ in range(70)], [(99 - i, 98 - i) for i in range(50)] + [(5, 5)]):
        got = components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
        nodes = {x for l in links if l[0] != l[1] for x in l}
        assert {x.node: x.component for x in got.collect()} == reach(nodes, [l for l in links if l[0] != l[1]])


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, rows, none):
    prints = {i: plain_fingerprint(r[1]) for i, r in enumerate(rows)}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 2]
    groups = reach(prints, links)
    smallest = {}
    for i, g in groups.items():
        if rows[i][0] is not None:
            smallest[g] = min(smallest.get(g, 1 << 60), rows[i][0])
    want = sorted((str(rows[i][0]), f"{prints[i]:016x}", smallest.get(g)) for i, g in groups.items())
    got = simhash.near_duplicates(docs)
    assert sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in got.collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    nameless = {g for g in groups.values()} - set(smallest)
    assert nameless  # a group without any doc_id keeps one row too
    assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted([*map(str, set(smallest.values())), *["None"] * len(nameless)])


def test_rows_of_one_doc_id_in_several_groups(spark):
    r = random.Random(9)
    text = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(30)]
    # an id's first text is alone, or a copy of one with a smaller id; its second text is alone
    data = [(0, text[0], 0), (0, text[0], 0)] + [(i, text[0] if i % 2 else text[i], 0) for i in range(1, 10)] + [(i, text[i + 10], 1) for i in range(1, 10)] + [(None, text[29], 2)]
    for parts in (1, 5):
        kept = simhash.drop_near_duplicates(spark.createDataFrame(data, "doc_id long, text string, n int").repartition(parts)).collect()
        want = {(0, text[0])} | {(i, text[i]) for i in range(2, 10, 2)} | {(i, text[i + 10]) for i in range(1, 10)} | {(None, text[29])}
        assert len(kept) == len(want) and {(x.doc_id, x.text) for x in kept} == want


def test_near_pairs_find_every_pair_once(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = list({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(12)} | {0, 1, 3, 1 << 63, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert len(got) == len(want) and {(x.a, x.b) for x in got} == want


def test_fingerprints_that_agree_on_one_half(spark, monkeypatch):
    r = random.Random(8)
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    base = [r.getrandbits(32) for _ in range(120)]
    halves = {b ^ sum(1 << x for x in r.sample(range(32), r.randint(0, 3))) for b in base for _ in range(4)}
    for shift in (0, 32):  # all with the same low half, or high half, and some a bit away from it
        prints = [(h << (32 - shift)) | (((0xF0F0F0F0 ^ (1 << r.randrange(32)) * (r.random() < 0.3)) & 0xFFFFFFFF) << shift) for h in sorted(halves)]
        signed = [sign(p) for p in set(prints)]
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
        for hot in (50, 10**6):
            monkeypatch.setattr(simhash, "HOT", hot)
            got = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
            assert len(got) == len(want) > 20 and {(x.a, x.b) for x in got} == want
    many = [sign((0xABCD1234 << 32) | r.getrandbits(32)) for _ in range(100_000)]
    monkeypatch.setattr(simhash, "HOT", 2_000)
    got = simhash.near_pairs(spark.createDataFrame([(p,) for p in set(many)], "fp long"))
    seen, want = set(many), 0
    for p in seen:
        near = {sign((p & ((1 << 64) - 1)) ^ (1 << i) ^ (1 << j)) for i in range(32) for j in range(i + 1)} | {sign((p & ((1 << 64) - 1)) ^ (1 << i)) for i in range(32)}
        want += sum(q > p for q in near & seen)
    assert got.count() == want


def test_long_text_fingerprint_in_chunks(monkeypatch):
    t = " ".join(str(i * i) for i in range(900))
    whole = simhash.fingerprint(t.encode())
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(t.encode()) == whole == plain_fingerprint(t)


def test_lines(docs, rows, none):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    want = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        stay = [x for x in parts if not (key(x) and count[key(x)] >= 10)]
        want.append((str(r[0]), "\n".join(stay), len(parts), len(parts) - len(stay), r[5]))
    got = lines.drop_common_lines(docs, 10, 1)
    assert sorted((str(x.doc_id), x.text, x.n_lines, x.n_dropped, x.score) for x in got.collect()) == sorted(want)
    assert sum(w[3] for w in want) >= 10
    assert lines.drop_common_lines(none).count() == 0


def near_rows():
    r = np.random.default_rng(7)
    x = r.normal(size=(150, 16))
    near = np.repeat(x[:20], 6, axis=0) + r.normal(size=(120, 16)) * 0.18
    hub = x[0] + r.normal(size=(120, 16)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, hub]))]
    n = len(rows)
    rows += [(n + i, rows[3][1]) for i in range(5)] + [(n + 5, [2 * v for v in rows[3][1]]), (n + 6, None), (n + 7, []), (n + 8, [0.0] * 16), (n + 9, [float("nan")] * 16), (n + 10, [None, 1.0]), (n + 11, [1.0, 2.0]), (n + 12, [1.0, 2.0]), (n + 13, [float("inf")] * 16), (None, rows[0][1])]
    return rows


def brute(rows, threshold):
    ok = {i: np.array(v) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    return links, reach([i for i, _ in rows if i is not None], links)


def test_vectors(spark, monkeypatch):
    rows = near_rows()
    links, groups = brute(rows, 0.95)
    assert len(links) > 5000
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, n_links string")
    for block in (1024, 40):
        monkeypatch.setattr(pivots, "BLOCK", block)
        got = pivots.near_vectors(df, 0.95, pivots=24).collect()
        assert len(got) == len(rows)
        found = sum(x.n_links for x in got) / 2
        assert 0.99 * len(links) <= found <= len(links)
        assert all(x.n_links <= degree.get(x.vec_id, 0) for x in got)
        assert sum(x.component_id == groups.get(x.vec_id) for x in got if x.vec_id is not None) >= 0.99 * (len(rows) - 1)
        assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got)
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_vectors_that_cannot_link(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0]), (None, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((str(x.vec_id), x.n_links, x.component_id, x.kept) for x in pivots.near_vectors(df).collect()) == [("1", 0, 1, True), ("2", 0, 2, True), ("None", 0, None, False)]


def test_vectors_in_a_dense_cloud_with_default_pivots(spark):
    r = np.random.default_rng(8)
    for n, cloud, noise in ((600, 200, 0.2), (2400, 800, 0.2), (2400, 800, 0.229), (1500, 1500, 0.1), (2400, 800, 0.8)):
        x = r.normal(size=(n, 64))
        residual = r.normal(size=(cloud, 64))
        x[:cloud] = [1.0] + [0.0] * 63 + noise * residual / np.linalg.norm(residual, axis=1, keepdims=True)
        x[-100:] = x[:100] + 0.02 * r.normal(size=(100, 64)) * np.linalg.norm(x[:100], axis=1, keepdims=True)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = int(((unit @ unit.T) >= 0.95).sum()) - n
        found = sum(v.n_links for v in pivots.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect())
        assert links > 100 and 0.9 * links <= found <= links, (n, cloud, noise, links, found)
