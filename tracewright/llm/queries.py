"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bestfit, ctph, lines, mixing, packing, periodic, pivots, quality, secrets, simhash, sstable, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return quality.score(docs.select("doc_id", "text"), model, 0.3).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, sf_dir, "documents"), 10, 1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprints_with_next(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return made.withColumnRenamed("groups", "groups_sha256")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_repeats(table(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_quality, op2_near_vectors, op3_mix, op4_simhash, op5_token_counts, op6_lines, op7_token_files, op8_pack, op9_secrets, op10_ctph, op11_best_fit, op12_alignment, op13_runs, pipeline)
    return {f.__name__: f for f in own}


SQL_OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

SQL_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS same FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS DOUBLE) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM d GROUP BY source
), a AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), b AS (SELECT source, source_size, cap, w, max(CASE WHEN level * w <= cap THEN level END) OVER () AS level FROM a),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * w > cap THEN cap ELSE level * w END AS target FROM b),
o AS (
  SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, same ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
b1 AS (SELECT source, CAST(ceil(CAST(floor(target + 0.5) AS BIGINT) / 1024.0) AS BIGINT) AS blocks, source IS NULL AS none FROM t),
b2 AS (SELECT *, CAST(sum(blocks) OVER (ORDER BY NOT none, encode(source)) AS BIGINT) AS upper, CAST(sum(blocks) OVER () AS BIGINT) AS total FROM b1 WHERE blocks > 0),
p AS (SELECT slot, (slot * CAST(0.6180339887498949 AS DOUBLE) - floor(slot * CAST(0.6180339887498949 AS DOUBLE))) * CAST(total AS DOUBLE) AS at FROM (SELECT unnest(range(max(total))) AS slot, max(total) AS total FROM b2) AS r),
q AS (SELECT slot, min(upper) AS upper FROM p JOIN b2 ON b2.upper > p.at GROUP BY slot),
r AS (SELECT slot, b2.upper, blocks, row_number() OVER (PARTITION BY b2.upper ORDER BY slot) - 1 AS rank FROM q JOIN b2 ON q.upper = b2.upper),
over_ AS (SELECT slot, row_number() OVER (ORDER BY slot) AS k FROM r WHERE rank >= blocks),
given AS (SELECT b2.upper, b2.blocks, b2.none, b2.source, count(r.slot) AS n FROM b2 LEFT JOIN r ON r.upper = b2.upper GROUP BY ALL),
gap AS (SELECT upper, block, row_number() OVER (ORDER BY block, NOT none, encode(source)) AS k FROM (SELECT *, unnest(range(n, blocks)) AS block FROM given WHERE n < blocks) AS g),
slots AS (SELECT slot, upper, rank AS block FROM r WHERE rank < blocks UNION ALL SELECT slot, upper, block FROM over_ JOIN gap ON over_.k = gap.k),
turn AS (SELECT o.*, b2.upper, start + pass * source_size AS lo, least(start + pass * source_size + size, words) AS hi FROM o JOIN b2 ON o.source IS NOT DISTINCT FROM b2.source, (VALUES (0), (1)) AS v(pass) WHERE size > 0),
piece AS (SELECT doc_id, same, upper, unnest(range(lo // 1024, (hi - 1) // 1024 + 1)) AS block FROM turn WHERE lo < hi),
used AS (SELECT doc_id, same, min(slot) AS first_slot, count(*) AS n_slots FROM piece JOIN slots ON piece.upper = slots.upper AND piece.block = slots.block GROUP BY doc_id, same)
SELECT o.doc_id, size, source_size, target,
       greatest(0, least(start + size, words) - start) + greatest(0, least(source_size + start + size, words) - source_size - start) AS taken,
       first_slot, coalesce(n_slots, 0) AS n_slots
FROM o LEFT JOIN used ON o.doc_id = used.doc_id AND o.same = used.same
"""

SQL_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_vectors": SQL_OP2, "op3_mix": SQL_OP3, "op6_lines": SQL_OP6}
