"""How rows are laid out over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it is a scan of fewer tasks than half of them, else as it is.

    Small inputs often are one file, which one core would read and then work on alone. Inputs
    with more splits than cores, which is any large one, are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def few(df: DataFrame, rows: int) -> Callable[[DataFrame], DataFrame]:
    """`broadcast` if `df` has at most `rows` rows, which are counted no further, else a function that does nothing."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda d: d


def cut(df: DataFrame) -> DataFrame:
    """End the plan's growth: a checkpoint in the shared folder, or a cache where none is named."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started meanwhile hand Python workers at most `rows` rows at once; the session's setting is put back.

    Spark's own 10,000 rows are over 30 MB of common documents, held by the executor, a worker, and again as objects.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if spark.conf.get(name) != before:
            spark.conf.set(name, before)
