"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, with the library, before the job. Texts are split into
pre-tokens; those in the proved set count 1 each, and only the rest go through the merges, whose counts a process remembers
(a bounded memory: beyond it counts are made anew). Texts with unusual characters or special strings go to the library whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import named, prepare
from .tokens import BYTE_PIECES, REMEMBERED, byte_letters, encoder


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and that the library encodes as one id. At most one entry a vocabulary string."""
    library, letters = encoder(path).library, byte_letters()
    strings = []
    for token in library.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(letters[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # no text by itself
            continue
    proved = [s for s, e in zip(strings, library.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    return frozenset(s for s in proved if BYTE_PIECES.findall(s) == [s])


@functools.lru_cache(maxsize=4)
def _counts_of(path: str) -> dict[str, int]:
    return {}


def count_batch(texts: list[str], path: str, whole: frozenset[str]) -> list[int]:
    """Token counts of a batch of texts."""
    e, known, fresh, out, split = encoder(path), _counts_of(path), {}, [], []
    for text in texts:
        if not e.plain(text):
            split.append((len(e.library.encode(text, add_special_tokens=False).ids), []))
            continue
        pieces = BYTE_PIECES.findall(text)
        rest = [p for p in pieces if p not in whole]
        split.append((len(pieces) - len(rest), rest))
        fresh.update((p, 0) for p in rest if p not in known)
    for piece, made in zip(fresh, e.library.encode_batch_fast(list(fresh), add_special_tokens=False), strict=True):
        fresh[piece] = len(made.ids)
    for n, rest in split:
        out.append(n + sum(known[p] if p in known else fresh[p] for p in rest))
    if len(known) < REMEMBERED:
        known.update(fresh)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated doc_id values pass through, one result per row; other
    columns are ignored; an empty table gives an empty result. path: a byte-level vocabulary of the tokenizers library.
    """
    spark = prepare(docs.sparkSession)
    if encoder(path).words:
        raise ValueError("the shortcut needs a byte-level vocabulary")
    whole = spark.sparkContext.broadcast(prove_whole_tokens(path))  # bounded by the vocabulary

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = count_batch(batch.column(2).to_pylist(), path, whole.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(named("text"), F.lit(""))
    rows = docs.select(named("doc_id").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(counted, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
