import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tracewright.llm import packing, sstable, token_counts
from tracewright.llm.tokens import Encoder, encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    e, library, r = encoder(path), Tokenizer.from_file(path), random.Random(1)
    letters = "abcXYZ '\n\t\r_-.!?0123456789éÉßüöñ’“…€<|>endoftext" + "".join(map(chr, range(0xC0, 0x180)))
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "日本語 テスト", "a\x00b", "²³½", "  x　y", "é", "'s'll'LL", "\x1c \x85"]
    for t in texts:
        assert e.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_texts_cut_at_blanks_have_the_librarys_ids():
    """White space beside blanks, signs that aren't plain and special tokens between them; what was met before isn't split again."""
    e, library, r = Encoder(BYTE), Tokenizer.from_file(BYTE), random.Random(3)
    words = ["the", "a", "don't", "x1", "foo,", "(b", "é", "日本", "<|endoftext|>", "<|endof", "text|>", "\n", "\t", "\x1c", "\x85", "\u3000", ".\n", "'s", "'", "_", "12", "²", ""]
    texts = [r.choice(["", " "]).join(r.choice(words) + r.choice(["", "", " ", "\n"]) for _ in range(r.randint(0, 9))) for _ in range(4000)]
    for t in [*texts, "a\n \nb", "a\n ", " ", "", "a  b", " a ", "a \n b"]:
        assert e.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert e.ids("the the, x1").tolist() == library.encode("the the, x1", add_special_tokens=False).ids
    assert {"the,", "x1"} <= e.after_blank.keys() and "\nb" not in e.after_blank


def test_token_counts(docs, rows, none):
    library = Tokenizer.from_file(BYTE)
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows)
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts.token_counts(docs, BYTE).collect())
    assert got == want
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_whole_tokens_are_proved():
    library = Tokenizer.from_file(BYTE)
    whole = token_counts.prove_whole_tokens(BYTE)
    assert len(whole) > 30_000
    for s in random.Random(2).sample(sorted(whole), 500):
        assert len(library.encode(s).ids) == 1


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_shards(spark, docs, rows, none):
    library = Tokenizer.from_file(WORD)
    manifest = sstable.write_shards(docs, WORD)
    want, start = [], 0
    for r in in_order(rows):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    wanted = spark.createDataFrame([(rows[0][0],), (rows[70][0],), (999_999,), (-6,)], "doc_id long")
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in sstable.lookup(manifest, wanted).collect()}
    assert found == {r[0]: [*library.encode(r[1], add_special_tokens=False).ids, 1] for r in (rows[0], rows[70])}
    assert sstable.read_shards(sstable.write_shards(none, WORD)).count() == 0


def test_shard_file(tmp_path):
    path = f"{tmp_path}/a.sst"
    keys = [sstable.key_of(k) for k in (None, -(2**62), -1, 0, 0, 5, 2**40)]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys][:2] == [None, -(2**62)]
    with open(path, "wb") as f:
        w = sstable.ShardWriter(f)
        for i, k in enumerate(keys):
            w.add(k, np.full(20_000 * (i % 3) + i, 70_000 if i == 5 else i, dtype="<u4"))
        w.finish()
    s = sstable.Shard(path)
    assert [len(x) for _, x in s] == [20_000 * (i % 3) + i for i in range(7)] and len(s.index) > 1
    assert [len(x) for x in s.get(sstable.key_of(0))] == [3, 20_004] and s.get(sstable.key_of(7)) == []
    assert s.get(sstable.key_of(5))[0][0] == 70_000
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(sstable.Shard(path))


def test_packing(docs, rows, none):
    library = Tokenizer.from_file(BYTE)
    length = 128
    pieces = packing.pack(docs, BYTE, length).collect()
    by_doc, places = {}, []
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        places.append((p.sequence_id * length + p.offset, p.length))
        assert 0 < p.length <= length - p.offset and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    at = 0
    for place, n in sorted(places):  # gapless
        assert place == at
        at += n
    want = sorted((str(r[0]), tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    assert at == sum(len(ids) for _, ids in want)
    got = []
    for (doc_id, n), ps in by_doc.items():
        ps.sort(key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist()
        assert len(ids) % n == 0
        if len(ids) == n:
            got.append((str(doc_id), tuple(ids)))
    assert set(got) <= set(want) and len(got) >= len(rows) - 4
    sizes = {}
    for p in pieces:
        sizes[p.source] = sizes.get(p.source, 0) + p.length
    full = {}
    for p in pieces:
        full.setdefault(p.sequence_id, {}).setdefault(p.source, 0)
        full[p.sequence_id][p.source] += p.length
    for k, parts in full.items():  # every full window holds its sources' shares within a token or two
        if k < at // length:
            assert all(abs(parts.get(s, 0) - length * n / at) < 3 for s, n in sizes.items())
    assert packing.pack(none, BYTE).count() == 0


def test_schedule_against_a_queue_of_tokens():
    r = random.Random(3)
    for _ in range(30):
        n = [r.choice([0, 1, 2, 5, 40, 300]) for _ in range(r.randint(1, 6))]
        if not sum(n):
            continue
        w = n if r.random() < 0.5 else [r.randint(1, 9) for _ in n]
        plan = packing.Schedule(n, w)
        order = sorted((((2 * t + 1) / w[i], i, t) for i in range(len(n)) for t in range(n[i])))
        for x in range(sum(n) + 1):
            want = [sum(1 for o in order[:x] if o[1] == i) for i in range(len(n))]
            assert list(plan.served(x)) == want, (n, w, x)
