"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import spread
from .arrow_stream import read_documents, write_tokens
from .caps import cap_links
from .exact import exact_dedup
from .mixing import MIX_SQL, mix_sources
from .packing import pack_pieces, token_pieces
from .quality import score_quality, train_quality
from .sharding import shard_documents
from .simhash import simhash_dedup
from .suffixes import remove_repeats
from .toxicity import score_toxicity, train_toxicity
from ._scale import TEXT_ROWS, materialize


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all `documents` in sequences of at most 2048 ids."""
    pieces = materialize(token_pieces(_read(spark, sf_dir, "documents"), with_ids=False), "pieces", batch_rows=TEXT_ROWS)
    return pack_pieces(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as Arrow files of token ids, read back."""
    return read_documents(write_tokens(_read(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` in 16 shards of nearly equal bytes; equal texts share a shard."""
    d = shard_documents(_read(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.98 or more among all `embeddings` of a label."""
    return cap_links(_read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all `documents` with sources weighing 1, 2, 3, repeating."""
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of `documents`."""
    return simhash_dedup(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`."""
    docs = _read(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _read(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of `documents`: the largest doc_id stays."""
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` in 50-byte strings that a smaller document has too."""
    return remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every row of `documents` by two co-trained views."""
    docs = _read(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_files": op2_token_files,
    "op3_sharding": op3_sharding,
    "op4_cap_filters": op4_cap_filters,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_repeats": op9_repeats,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op4_cap_filters": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(embedding) = list_count(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a, min(least(a, b)) AS component FROM r GROUP BY a
        ), n AS (
            SELECT a, count(*) AS links FROM l GROUP BY a
        )
        SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id,
               vec_id IS NOT DISTINCT FROM coalesce(component, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
    """,
    "op9_repeats": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)
        ), m AS (
            SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING count(*) > 1
        ), hit AS (
            SELECT doc_id, p, p > lag(p, 1, -51) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS fresh
            FROM s JOIN m USING (g) WHERE doc_id > first_id
        ), run AS (
            SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit
        ), span AS (
            SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k
        ), gap AS (
            SELECT doc_id, k, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS from_b FROM span
        ), kept AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
                   string_agg(substr(h, 2 * from_b + 1, 2 * (a - from_b)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS rest
            FROM gap JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(rest, h))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op5_mixing": MIX_SQL.replace("{docs}", "documents"),
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY text) AS keep_id,
               count(*) OVER (PARTITION BY text) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text) AS kept,
               sha256(text) AS text_sha256
        FROM t
    """,
}
