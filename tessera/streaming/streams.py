"""Structured Streaming forms of incremental sync, A/B analysis and exact dedup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.evaluation import satisfaction


def stream_ab(events: DataFrame, ts: str = "ts", lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Windowed sums a group for `ab_test`: events (ts, group, thumbs_up, follow_up, source_click, dwell)."""
    s = satisfaction(F.col("thumbs_up"), F.col("follow_up"), F.col("source_click"), F.col("dwell"))
    d = events.withColumn("satisfaction", s).withWatermark(ts, lateness)
    return d.groupBy(F.window(ts, width).alias("w"), "group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("satisfaction").alias("total"), F.sum(F.col("satisfaction") * F.col("satisfaction")).alias("squares")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "group", "n", "total", "squares")


def stream_dedup(docs: DataFrame, ts: str = "ts", lateness: str = "1 day", content: str = "content") -> DataFrame:
    """The first document of each content within the watermark; state is one digest a content."""
    d = docs.withColumn("content_hash", content_hash(F.coalesce(F.col(content), F.lit(""))))
    return d.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["content_hash"])


def stream_sync(docs: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch of documents to `apply` (an IndexManager's sync, say)."""
    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
