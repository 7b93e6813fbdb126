"""The registered queries of the corpus operators, and their SQL where DuckDB can run it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.llm.common import table


def op7_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.ring import shard_ring

    placed = shard_ring(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.ivfpq import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.cotrain import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.maxscore import top_inner

    return top_inner(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.pii import personal_spans, span_text

    found = personal_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", span_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.suffixdedup import dedup_digest

    return dedup_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from astrolith.llm.packing import pack_binary

    packed = pack_binary(table(spark, sf_dir, "documents"), ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


MAXSCORE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_crf, op2_maxscore, op3_pieces, op4_cotraining, op5_pii, op6_suffixes, op7_ring, op8_ivfpq, op9_minhash, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_maxscore": MAXSCORE_SQL}
