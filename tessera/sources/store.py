"""Vector store and incremental index over plain tables.

A store is a DataFrame with replace-on-write semantics: every change is a plan that makes
the next version; `save` writes it. Chunks: (id, document_id, content, metadata VARIANT or
columns, embedding array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import content_hash
from ..operators.search import vector_search


class BaseVectorStore:
    """What a store offers."""

    def upsert(self, chunks: DataFrame):
        raise NotImplementedError("upsert not implemented")

    def upsert_by_document(self, chunks: DataFrame):
        raise NotImplementedError("upsert_by_document not implemented")

    def search(self, queries: DataFrame, **options) -> DataFrame:
        raise NotImplementedError("search not implemented")

    def delete(self, ids: DataFrame):
        raise NotImplementedError("delete not implemented")

    def delete_by_document(self, document_ids: DataFrame):
        raise NotImplementedError("delete_by_document not implemented")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row, by `order`, of each key."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class TableStore(BaseVectorStore):
    """In-plan store. `score_mode` says how cosines become scores (see functions.vectors)."""

    def __init__(self, chunks: DataFrame, dimension: int | None = None, score_mode: str = "cosine"):
        self.chunks, self.dimension, self.score_mode = chunks, dimension, score_mode

    def _checked(self, chunks: DataFrame) -> DataFrame:
        if self.dimension is None:
            return chunks
        ok = F.col("embedding").isNull() | (F.size("embedding") == self.dimension)
        fail = F.raise_error(F.lit(f"embedding dimension is not {self.dimension}"))
        return chunks.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(fail.cast("array<double>")))

    def upsert(self, chunks: DataFrame, order: str | None = None) -> TableStore:
        """Rows replace those of equal id; within `chunks` the last by `order` wins."""
        new = self._checked(last_of_each(chunks, "id", order) if order else chunks)
        kept = self.chunks.join(new.select("id"), "id", "left_anti")
        return TableStore(kept.unionByName(new, allowMissingColumns=True), self.dimension, self.score_mode)

    def upsert_by_document(self, chunks: DataFrame, order: str | None = None) -> TableStore:
        return self.delete_by_document(chunks.select("document_id").distinct()).upsert(chunks, order)

    def delete(self, ids: DataFrame) -> TableStore:
        return TableStore(self.chunks.join(ids.select("id"), "id", "left_anti"), self.dimension, self.score_mode)

    def delete_by_document(self, document_ids: DataFrame) -> TableStore:
        return TableStore(self.chunks.join(document_ids.select("document_id"), "document_id", "left_anti"), self.dimension, self.score_mode)

    def search(self, queries: DataFrame, top_k: int = 5, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
        """`where` is pushed below scoring, and to the scan where it is on plain columns."""
        rows = self.chunks if where is None else self.chunks.where(where)
        return vector_search(queries, rows, top_k, threshold, self.score_mode)

    def save(self, path: str) -> None:
        self.chunks.write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, **options) -> TableStore:
        return TableStore(spark.read.parquet(path), **options)


def metadata_equals(column: str, **values) -> Column:
    """All of `values` equal, type and all, in a VARIANT column (a number is not its string)."""
    out = F.lit(True)
    for key, v in values.items():
        kind = "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        typed = F.schema_of_variant(F.expr(f"variant_get({column}, '$.{key}')"))
        stored = F.expr(f"try_variant_get({column}, '$.{key}', '{kind}')")
        family = {"boolean": ["BOOLEAN"], "string": ["STRING"]}.get(kind)
        same = typed.isin(family) if family else ~typed.isin("STRING", "BOOLEAN")
        out = out & same & F.coalesce(stored == F.lit(v), F.lit(False))
    return out


def sync_changes(current: DataFrame, state: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(document_id, hash, status): added, updated, unchanged or deleted, by content hash."""
    now = current.select(F.col(id_col).alias("document_id"), content_hash(F.coalesce(F.col(content), F.lit(""))).alias("hash"))
    old = state.select(F.col("document_id").alias("_id"), F.col("hash").alias("_hash"))
    j = now.join(old, F.col("document_id") == F.col("_id"), "full_outer")
    status = (
        F.when(F.col("_id").isNull(), "added")
        .when(F.col("document_id").isNull(), "deleted")
        .when(F.col("hash") == F.col("_hash"), "unchanged")
        .otherwise("updated")
    )
    return j.select(F.coalesce("document_id", "_id").alias("document_id"), "hash", status.alias("status"))


def sync_report(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "deleted", "unchanged")])


class IndexManager:
    """Keeps a store in step with documents: only changed ones are chunked and embedded anew."""

    def __init__(self, state: DataFrame | None = None):
        self.state = state

    def sync(self, docs: DataFrame, store: TableStore, chunk, embed) -> tuple[TableStore, DataFrame]:
        """(next store, one-row report). chunk: docs -> chunks; embed: chunks -> chunks with embedding."""
        spark = docs.sparkSession
        state = self.state if self.state is not None else spark.createDataFrame([], "document_id string, hash string, updated_at timestamp")
        changes = sync_changes(docs, state)
        todo = docs.join(changes.where("status in ('added', 'updated')").select(F.col("document_id").alias("id")), "id", "left_semi")
        gone = changes.where("status in ('deleted', 'updated')").select("document_id")
        store = store.delete_by_document(gone).upsert(embed(chunk(todo)))
        kept = state.join(changes.where("status = 'unchanged'").select("document_id"), "document_id", "left_semi")
        fresh = changes.where("status in ('added', 'updated')").select("document_id", "hash", F.current_timestamp().alias("updated_at"))
        self.state = kept.unionByName(fresh)
        return store, sync_report(changes)

    def hash_snapshot(self) -> DataFrame | None:
        return self.state

    def restore_hashes(self, state: DataFrame) -> None:
        self.state = state
