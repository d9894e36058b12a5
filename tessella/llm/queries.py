"""The queries of this subpackage: thin bindings of the operators to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, exact_topk, forest, langid, mixing, neardup, packing, placement, quality, resampling, retrieval_packing, suffixes
from .common import Scratch, table


#: The vocabulary of the packing query; its place is a parameter of the operator.
WORD_VOCABULARY = "word_bpe_49k.json"
CHAT_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(spark, docs, vocabulary(WORD_VOCABULARY), ["doc_id"], payload=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(spark, docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(spark, table(spark, sf_dir, "documents"), trusted)


def op4_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(spark, table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(spark, forest.from_embeddings(table(spark, sf_dir, "embeddings")))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(spark, exact_topk.from_embeddings(table(spark, sf_dir, "embeddings")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(spark, docs, payload=False)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_control_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(rows, vocabulary(CHAT_VOCABULARY)))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = Scratch(spark, "mix").write(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sized")
    return mixing.mix(sized, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark, codes.from_embeddings(table(spark, sf_dir, "embeddings")))


def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), ["doc_id"], payload=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_lookup_sharding": op4_lookup_sharding,
    "op5_projection_forest": op5_projection_forest,
    "op6_exact_topk": op6_exact_topk,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_chat_format": op9_chat_format,
    "op10_mix_sources": op10_mix_sources,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_retrieval_packing": op13_retrieval_packing,
}


def _codes_twin(rounds: int = 6) -> str:
    """Each round as two tables: the nearest entry of every part, and the entries after it."""
    nearest = """n{k} AS MATERIALIZED (
  SELECT rid, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d FROM (
    SELECT p.rid, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j])))::BIGINT AS d
    FROM p JOIN b{k} b ON p.part = b.part) GROUP BY ALL)"""
    moved = """b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY j) AS x FROM (
      SELECT part, entry, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS mean FROM (
        SELECT n.part, n.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS j FROM n{k} n JOIN p ON n.rid = p.rid AND n.part = p.part) GROUP BY ALL)
    GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry)"""
    steps = ",\n".join(f"{nearest}" .format(k=k) + (",\n" + moved.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM e, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY dense_rank() OVER (ORDER BY vec_id) <= 16),
{steps},
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN e USING (rid), h
"""

ORACLE: dict[str, str] = {
    "op12_vector_codes": _codes_twin(),
    "op4_lookup_sharding": f"""
WITH d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {placement.SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, printf('shard-%03d', ({placement.lookup_table()}::INTEGER[])[slot + 1]) AS shard FROM d
""",
    "op6_exact_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_mix_sources": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS n,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
e AS (SELECT *, ('0x' || substr(k, 1, 4))::INTEGER % 64 AS shard FROM d),
by_shard AS (SELECT s, n, shard, sum(size)::BIGINT AS words FROM e GROUP BY ALL),
src AS (SELECT s, n, sum(words)::BIGINT AS source_size FROM by_shard GROUP BY ALL),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY n, s) - 1) % 3 + 1)::INT] AS weight FROM src),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, n, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT s, n, source_size, weight,
        least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target FROM l),
p AS (SELECT *, greatest(1, ceil(sum(source_size) OVER () / 134217728.0))::BIGINT AS block,
        (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS whole,
        row_number() OVER (ORDER BY n, s) AS id FROM t),
free AS (SELECT *, target / block AS share, count(*) OVER () AS others, round(sum(target / block) OVER ())::BIGINT AS seats FROM p WHERE whole < 3),
bids AS (SELECT s, n, id, seats, share / (2 * unnest(range(0, ceil(share)::BIGINT + others)) + 1) AS quotient FROM free),
wins AS (SELECT s, n, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, id) AS place FROM bids WHERE quotient > 0) WHERE place <= seats GROUP BY ALL),
rest AS (SELECT free.s, free.n, by_shard.shard, greatest(0, round(coalesce(blocks, 0) - whole * source_size / block))::BIGINT AS seats, words, source_size, count(*) OVER (PARTITION BY free.s, free.n) AS others
         FROM free LEFT JOIN wins USING (s, n) JOIN by_shard USING (s, n) WHERE source_size > 0),
bids2 AS (SELECT s, n, shard, seats, seats * words / source_size / (2 * unnest(range(0, ceil(seats * words / source_size)::BIGINT + others)) + 1) AS quotient FROM rest),
wins2 AS (SELECT s, n, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY s, n ORDER BY quotient DESC, shard) AS place FROM bids2 WHERE quotient > 0) WHERE place <= seats GROUP BY ALL),
dealt AS (SELECT s, n, shard, source_size, target, whole, coalesce(quota, 0) * block AS take FROM p JOIN by_shard USING (s, n) LEFT JOIN wins2 USING (s, n, shard)),
f AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s, n, shard ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, take - before)))::BIGINT AS taken
FROM f JOIN dealt USING (s, n, shard)
""",
}
