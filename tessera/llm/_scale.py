"""Shared building blocks: materialisation, ranks and components at any size.

Every helper is a plain DataFrame program whose driver-side state is bounded.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_OWN: dict[str, str] = {}
#: Rows of whole texts that a Python worker gets at once. A batch lies in the executor's direct memory, in
#: the worker, and while it grows once more; Spark's own 10,000 rows are over 40 MB of common documents.
TEXT_ROWS = 1000
#: Edges above which nothing made of them is broadcast; Spark only sees the size of their compressed files.
FEW_EDGES = 200_000


def work_dir(spark: SparkSession) -> str:
    """Folder all executors share: the session's ``spark.checkpoint.dir``.

    Only where the setting is absent (tests on one machine) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """Fresh folder name under `work_dir`, removed when the application ends."""
    path = f"{work_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    # with its scheme, so that a bare path means the cluster's default store to every reader
    return re.sub("^file:/+", "file:///", fs.makeQualified(where).toString())


def materialize(df: DataFrame, label: str, release: bool = False, batch_rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends in replicated files.

    `release` also lets Spark drop the shuffle files that were needed to get here. `batch_rows`: rows
    that Python workers get at once meanwhile, at most; the session's setting is put back.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    if batch_rows and not 0 < int(before) <= batch_rows:
        spark.conf.set(rows, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if spark.conf.get(rows) != before:
            spark.conf.set(rows, before)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The cluster's shuffle parallelism."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def gapless_rank(
    df: DataFrame, keys: list[str], order: list[str], buckets: int, out: str = "rank"
) -> DataFrame:
    """Number the rows of each key from 0 without sorting a key in one task.

    Rows of a key are dealt to `buckets` hash buckets of the `order` columns; buckets are
    counted, the counts are prefix-summed, and only rows of one bucket are sorted together.
    The order is therefore (bucket, order columns): stable between runs, not sorted by
    `order` alone. `order` must identify a row for the numbering to be reproducible;
    equal rows take consecutive numbers. Keys must not be null.
    """
    b = F.pmod(F.xxhash64(*order), F.lit(max(1, buckets))).cast("int")
    d = df.withColumn("_rank_b", b)
    before = (
        d.groupBy(*keys, "_rank_b")
        .agg(F.count(F.lit(1)).alias("_rank_c"))
        .withColumn(
            "_rank_o",
            F.coalesce(
                F.sum("_rank_c").over(
                    W.partitionBy(*keys).orderBy("_rank_b").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(*[F.col(k).alias(f"_rank_k{i}") for i, k in enumerate(keys)], F.col("_rank_b").alias("_rank_bb"), "_rank_o")
    )
    w = W.partitionBy(*keys, "_rank_b").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    on = F.col("_rank_b") == F.col("_rank_bb")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_rank_k{i}"))
    return (
        d.withColumn("_rank_r", F.row_number().over(w))
        .join(before, on)
        .withColumn(out, (F.col("_rank_o") + F.col("_rank_r") - 1).cast("long"))
        .drop("_rank_b", "_rank_bb", "_rank_r", "_rank_o", *[f"_rank_k{i}" for i in range(len(keys))])
    )


def _fingerprint(df: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("hi"),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as rows (a, b) of long node ids.

    Alternates large-star and small-star rounds; each round's edges are written to the
    shared folder. Returns (node, component) for every node that can reach a smaller one,
    where component is the smallest node id reachable. Nodes that are the smallest of their
    component do not appear. Self-loops, nulls and repeated edges are ignored.
    """

    def sized(df: DataFrame, n: int) -> DataFrame:
        return df if n <= FEW_EDGES else df.hint("merge")

    e = materialize(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(),
        "edges",
    )
    last = _fingerprint(e)
    if not last[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(sized(low, last[0]), both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(sized(low2, last[0]), large.a == low2.k)
        e = materialize(
            small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a > b")
            .distinct(),
            "edges",
        )
        now = _fingerprint(e)
        if now == last:
            return sized(e.select(F.col("a").alias("node"), F.col("b").alias("component")), now[0])
        last = now
    raise RuntimeError("components did not settle")


def with_components(nodes: DataFrame, node: str, links: DataFrame, out: str) -> DataFrame:
    """`nodes` plus `out`: the component of each node, or the node itself without links."""
    return nodes.join(links, F.col(node) == F.col("node"), "left").withColumn(out, F.coalesce("component", node)).drop(
        "node", "component"
    )


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def boxed(docs: DataFrame, **cols: Column | str) -> DataFrame:
    """Each whole row of `docs` as one column `_row`, beside the named columns: whatever columns
    `docs` has, their names cannot clash. `unboxed` gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")
