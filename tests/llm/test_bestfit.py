import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import bestfit, queries

WORD = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def plain_best_fit(lengths, size):
    """Remaining capacities after best-fit decreasing, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(size - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    size = r.choice([1, 7, 10, 64, 100])
    lengths = [r.randint(1, r.choice([size, max(1, size // 3)])) for _ in range(r.choice([0, 1, 5, 60, 400]))]
    counts = {n: lengths.count(n) for n in lengths}
    plan = bestfit.Plan(counts, size)
    taken = {}
    for n, many in counts.items():
        for where, offset in zip(*plan.place(np.full(many, n), np.arange(many)), strict=True):
            taken.setdefault(int(where), []).append((int(offset), n))
    assert sorted(taken) == list(range(plan.bins))
    for parts in taken.values():  # gapless
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert sorted(size - sum(n for _, n in parts) for parts in taken.values()) == plain_best_fit(lengths, size)


def test_plan_does_not_grow_with_the_corpus():
    r = random.Random(0)
    counts = {n: r.randint(1, 50) for n in range(1, 2049)}
    small, large = bestfit.Plan(counts, 2048), bestfit.Plan({n: c * 10**9 for n, c in counts.items()}, 2048)
    assert len(large.runs) < 4 * len(small.runs) < 100_000
    with pytest.raises(ValueError):
        bestfit.Plan({2049: 1}, 2048)


def check(pieces, want, size):
    """Pieces in their sequences, against each row's ids (sorted lists of (doc_id, ids))."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    lengths = []
    for doc_id, texts in want.items():
        made = sorted((p.piece, p.start, p.length, p.ids_crc32) for p in by_doc.pop(doc_id))
        due = []
        for ids in texts:
            for k, start in enumerate(range(0, len(ids), size)):
                part = ids[start : start + size]
                due.append((k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert made == sorted(due)
        lengths += [d[2] for d in due]
    assert not by_doc and len(by_sequence) == len(plain_best_fit(lengths, size))


def ids_of(rows):
    library, want = Tokenizer.from_file(WORD), {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    return want


def test_best_fit(docs, rows, none):
    packed = bestfit.best_fit(docs, WORD, 100).cache()
    check(packed.collect(), ids_of([r[:2] for r in rows]), 100)
    ids = {}
    for p in packed.collect():
        assert len(p.ids) == 4 * p.length
        ids.setdefault(p.sequence_id, []).append((p.offset, p.ids))
    for s in bestfit.sequences(packed).collect():
        assert s.ids == b"".join(x for _, x in sorted(ids.pop(s.sequence_id))) and s.n_tokens * 4 == len(s.ids) and s.starts[0] == 0
    assert not ids
    assert bestfit.best_fit(none, WORD).count() == 0


def test_same_number_of_sequences_however_read(docs):
    counts = {bestfit.best_fit(docs.repartition(n), WORD, 64).agg(F.countDistinct("sequence_id")).first()[0] for n in (1, 3, 11)}
    assert len(counts) == 1


def test_registered_query(spark):
    df = queries.queries()["op11_best_fit"](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    check(df.collect(), ids_of(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), 2048)
