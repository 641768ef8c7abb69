"""A training corpus from `documents`: five stages, each over all that the one before kept.

Every stage takes an empty table (and gives one), ignores columns it does not know, and all but the
last return the columns of their input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._scale import TEXT_ROWS, boxed, materialize, text_or_empty, unboxed
from tessera.llm.exact import exact_dedup
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import pack_pieces, token_pieces
from tessera.llm.quality import score_quality, train_quality
from tessera.llm.simhash import simhash_dedup

#: Rows to drop up to which their keys (under 100 bytes each) are sent to the documents.
FEW_DROPS = 200_000


def _without(rows: DataFrame, drops: DataFrame, on: list[str]) -> DataFrame:
    """Boxed rows less those whose `on` columns are in `drops`; texts move only if the drops are many."""
    drops = materialize(drops, "drops")
    few = drops.limit(FEW_DROPS + 1).count() <= FEW_DROPS
    # more are merged: Spark would go by the size of their compressed file and build up to millions on the driver
    return unboxed(rows.join(F.broadcast(drops) if few else drops.hint("merge"), on, "left_anti"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go.

    A null text counts as empty, nulls in the page's columns as values; a score just at the threshold
    keeps its row; repeated rows go or stay together. Without labels of both classes all stay.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = boxed(docs, text="text", lang="lang", source="source", n_chars="n_chars")
    # written here, where the rows that a worker gets at once are set
    return materialize(unboxed(score_quality(rows, model).where("quality_keep")), "kept", batch_rows=TEXT_ROWS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays. Rows without a doc_id all stay.

    A null text equals an empty one. Rows that share both id and text stay or go together.
    """
    found = materialize(exact_dedup(docs), "exact")
    drops = found.where("not kept and doc_id is not null").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    rows = boxed(docs, doc_id="doc_id", sha=F.sha2(text_or_empty("text").cast("binary"), 256))
    return _without(rows, drops, ["doc_id", "sha"])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays. Rows without a doc_id all stay.

    Texts without words, null ones among them, have one fingerprint and so are one group. Rows that
    share an id go together if any of them does.
    """
    drops = simhash_dedup(docs).where("doc_id != component_id").select("doc_id").distinct()
    return _without(boxed(docs, doc_id="doc_id"), drops, ["doc_id"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; a document is a row for each time it is taken.

    A null source is a source, last in order. Texts without words have size 0 and are taken with those
    of their source that are. Equal keys go by doc_id; rows without a doc_id draw by their text.
    """
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that was mixed in sequences of at most 2048 ids.

    A null or empty text is its end id alone; a document taken twice is packed twice. Other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, with_ids=False), "pieces", batch_rows=TEXT_ROWS)
    return pack_pieces(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier and packing plan are not expressible in SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
