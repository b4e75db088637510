import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tracewright.llm import alignment, queries
from tracewright.llm.tokens import piece_encoder

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def byte_of():
    from tracewright.llm.tokens import byte_letters

    return byte_letters()


def plain_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text, all links spelled out."""
    library, pieces, letters = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE), byte_of()
    library.encode_special_tokens = True
    out, links = [], []
    for text in texts:
        mine, groups = [], []
        if text:
            a = [(i, bytes(letters[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
                at = [0, 0]
                i = k = 0
                group = ([], [])
                while i < len(a) or k < len(b):
                    if at[0] <= at[1]:
                        at[0] += len(a[i][1])
                        group[0].append(a[i][0])
                        i += 1
                    else:
                        at[1] += len(b[k][1])
                        group[1].append(b[k][0])
                        k += 1
                    if at[0] == at[1] and at[0] in ends[0] & ends[1]:
                        groups.append(group)
                        mine += [(x, y) for x in group[0] for y in group[1]]
                        group = ([], [])
                out.append([len(a), len(b), len(groups)])
        if not groups:
            out.append([0, 0, 0])
        links.append((mine, ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)))
    held = collections.Counter(p for mine, _ in links for p in set(mine))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(*o, len(mine), sum(held[p] == top[p[0]] for p in mine), sum(held[p] for p in mine), said) for o, (mine, said) in zip(out, links, strict=True)]


def key(r):
    return repr(r)


def test_piece_ids_equal_the_library():
    e, r = piece_encoder(PIECE), random.Random(1)
    assert e.cuts
    letters = "abcXYZ '\n\t\r_-.!?0123456789éÉßüöñ’“…€<|>endoftext▁" + "".join(map(chr, range(0xC0, 0x180)))
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["".join(r.choice("ab  ,.") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    for t in [*texts, "", " ", "  ", "<s> </s><unk>", "日本語 テスト", "a\x00b", "²³½²."]:
        assert e.ids(t).tolist() == e.library.encode(t), t
    assert b"".join(e.token_bytes()[i] for i in e.ids("Ab, é\n日\x7f")) == " Ab, é\n日\x7f".encode()


def test_groups_and_links():
    cuts_a, cuts_b = alignment.groups_of(np.array([1, 2, 3, 1]), np.array([3, 2, 2]))
    assert cuts_a.tolist() == [0, 2, 4] and cuts_b.tolist() == [0, 1, 3]
    keys, n = alignment.linked(np.array([5, 5, 6, 7]), np.array([1, 2, 2]), cuts_a, cuts_b, 10)
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {51: 2, 62: 2, 72: 2}


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_links_in_slices(limit, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_LINKS", limit)
    r = random.Random(limit)
    for _ in range(60):
        many_a, many_b = ([r.randint(1, 6) for _ in range(12)] for _ in range(2))
        cuts_a, cuts_b = (np.cumsum([0, *m]) for m in (many_a, many_b))
        a, b = (np.array([r.randint(0, 5) for _ in range(sum(m))]) for m in (many_a, many_b))
        want = collections.Counter(int(x) * 9 + int(y) for i in range(12) for x in a[cuts_a[i] : cuts_a[i + 1]] for y in b[cuts_b[i] : cuts_b[i + 1]])
        keys, n = alignment.linked(a, b, cuts_a, cuts_b, 9)
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(want)


def test_alignment(docs, rows, none):
    got = alignment.alignment(docs, BYTE, PIECE).collect()
    want = [(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True)]
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert alignment.alignment(none, BYTE, PIECE).count() == 0


def test_small_blocks(spark, monkeypatch):
    """Sums over many blocks of a task; a text that either side can't give back; special strings are plain text."""
    texts = ["the cat", "the cat sat", "a▁b", "<|endoftext|> the </s>", "", None, "日本 the", " the  the"] * 3
    want = sorted((i, *x) for i, x in enumerate(plain_alignment(texts)))
    assert want[2][1:] == (0, 0, 0, 0, 0, 0, "")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.alignment(df, BYTE, PIECE).collect())) == want


def test_registered_query(spark):
    df = queries.queries()["op12_alignment"](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for r, x in zip(texts, plain_alignment([r.text for r in texts]), strict=True)]
    assert sorted(map(tuple, df.collect())) == sorted(want)
