import random

from test_duplicates import reach

from tracewright.llm import similar

SCHEMA = "doc_id long, text string, row int, same string, node long, group string"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def links_of(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    return [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = "new" + str(r.randrange(10**6))
    return out


def made(r):
    """Texts whose copies are edited in 0 to 8 words, so that links lie about the threshold; a chain of edits; short, empty, null and repeated ones."""
    vocabulary = ["".join(r.choice("abcdeghilmnorst") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 400))]
        rows += [base] + [edited(r, base, r.randint(0, 8)) for _ in range(r.randint(0, 5))]
    chain = [r.choice(vocabulary) for _ in range(300)]
    for _ in range(12):
        rows.append(chain)
        chain = edited(r, chain, 4)
    texts = [" ".join(w) for w in rows] + ["a b", "A  B", "a b a b", "a", "one two three four five", "", " ", None, " ".join(rows[0]).upper(), " ".join(rows[1] * 40)]
    return dict(enumerate(texts))


def test_groups_against_brute_force(spark):
    r = random.Random(12)
    texts = made(r)
    links = links_of(texts)
    want = reach(texts, links)
    got = {x.doc_id: x for x in similar.similar_documents(spark.createDataFrame([(i, t, 0, "s", 0, "g") for i, t in texts.items()], SCHEMA).repartition(5)).collect()}
    assert len(got) == len(texts) and len(links) > 80
    assert sum(got[a].component_id == got[b].component_id for a, b in links) >= 0.95 * len(links)
    pairs = {frozenset(x) for x in links}
    for i, x in got.items():  # groups hang together by links only
        assert x.component_id <= i and want[i] == want[x.component_id] and x.kept == (x.component_id == i)
        assert x.component_id == i or any(frozenset((i, j)) in pairs for j, y in got.items() if y.component_id == x.component_id)
    assert got[len(texts) - 3].component_id == got[len(texts) - 4].component_id == len(texts) - 5  # wordless texts


def test_one_row_of_each_group(spark):
    long = " ".join(f"w{i * i}" for i in range(90))
    near = long.replace("w81 ", "x ")
    data = [(5, long, 0), (3, near, 0), (3, near, 1), (3, "another text of its own here", 2), (7, long, 3), (None, long, 4), (None, "only a nameless text", 5), (None, "only a nameless text", 6), (9, None, 7), (8, "", 8)]
    for parts in (1, 4):
        df = spark.createDataFrame([(i, t, n, "s", 0, "g") for i, t, n in data], SCHEMA).repartition(parts)
        kept = similar.drop_similar(df)
        rows = sorted((str(x.doc_id), x.text) for x in kept.collect())
        assert kept.columns == df.columns and rows == sorted([("3", near), ("3", "another text of its own here"), ("8", ""), ("None", "only a nameless text")])
    assert similar.drop_similar(df.limit(0)).count() == 0 and similar.similar_documents(df.limit(0)).count() == 0


def test_large_clusters_go_block_by_block(spark, monkeypatch):
    r = random.Random(3)
    base = [f"v{r.randrange(5000)}" for _ in range(150)]
    texts = {i: " ".join(edited(r, base, r.randint(1, 4))) for i in range(300)}
    links = links_of(texts)
    want = reach(texts, links)
    assert 2 < len(set(want.values())) and len(links) > 1000
    tried = []
    plain = similar._clustered
    monkeypatch.setattr(similar, "_clustered", lambda nodes, pairs, name: (tried.append(pairs.distinct().count()), plain(nodes, pairs, name))[1])
    for block in (1024, 64):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = similar.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {x.doc_id: x.component_id for x in got} == want
    assert max(tried) < 25 * len(texts)  # of 44,850 pairs


def test_shared_shingles(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(str(r.randrange(30)) for _ in range(r.randrange(1, 40))) for _ in range(30)]
    texts += [t + " x" for t in texts] + ["", " "]
    for columns in (4096, 7):
        monkeypatch.setattr(similar, "COLUMNS", columns)
        import numpy as np

        shared, size = similar.shared_shingles([np.frombuffer(similar.described(t.encode())[3], np.uint32) for t in texts])
        s = [shingles(t) - {()} for t in texts]
        assert size.tolist() == [len(x) for x in s] and shared.astype(int).tolist() == [[len(a & b) if i != j else int(shared[i, j]) for j, b in enumerate(s)] for i, a in enumerate(s)]
