"""Post-processors of search results: rows (query_id, chunk_id, score, rank, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from .search import top_k


def ranked():
    """Each query's results in rank order."""
    return W.partitionBy("query_id").orderBy("rank")


def above(results: DataFrame, threshold: float = 0.5, max_results: int = 10) -> DataFrame:
    """Best first, those at `threshold` or above, at most `max_results`."""
    return top_k(results.drop("rank").where(F.col("score") >= threshold), max_results)


def rerank(results: DataFrame, scorer: Column | Callable[[Column, Column], Column], k: int = 5, query: str = "query", content: str = "content") -> DataFrame:
    """New scores from a Column, or a function of the query and content columns (an expression or
    an Arrow UDF). The old ones stay as original_score."""
    new = scorer if isinstance(scorer, Column) else scorer(F.col(query), F.col(content))
    d = results.withColumn("original_score", F.col("score")).withColumn("score", new).withColumn("rerank_score", F.col("score"))
    return top_k(d.drop("rank"), k)


def enrich_context(results: DataFrame, chunks: DataFrame, window: int = 2) -> DataFrame:
    """content: the chunk's with its neighbours' in the document, `window` on each side, a line each.

    `chunks`: (id, document_id, chunk_index, content).
    """
    hit = results.select("chunk_id").distinct().join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index"), "chunk_id")
    # each hit names the places it wants, so the join is on equal keys and no document meets itself
    want = hit.select("chunk_id", "document_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    near = want.join(chunks.select("document_id", "chunk_index", F.col("content").alias("_c")), ["document_id", "chunk_index"])
    text = near.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "_c"))).alias("_n"))
    text = text.select("chunk_id", F.array_join("_n._c", "\n").alias("content"), F.size("_n").alias("enriched_from"))
    return results.drop("content").join(text, "chunk_id", "left")


def truncate_context(results: DataFrame, max_tokens: int = 4096, system_reserved: int = 0, generation_reserved: int = 500, content: str = "content", used: Column | None = None) -> DataFrame:
    """The leading results of each query whose tokens fit; the first that doesn't ends it."""
    budget = max(0, max_tokens - system_reserved - generation_reserved)
    n = tx.token_count(F.col(content)) if used is None else used
    d = results.withColumn("tokens", n)
    return d.withColumn("used_tokens", F.sum("tokens").over(ranked().rowsBetween(W.unboundedPreceding, 0))).where(F.col("used_tokens") <= budget)


def merge_subqueries(results: DataFrame) -> DataFrame:
    """Results of a query's sub-queries (sub_index, rank) one after another, each chunk at its first place."""
    w = W.partitionBy("query_id", "chunk_id").orderBy("sub_index", "rank")
    d = results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("sub_index", "rank")))


def select_sentences(results: DataFrame, llm, query: str = "query", content: str = "content") -> DataFrame:
    """Only the sentences a model names (by number, JSON or plain); a chunk of one sentence stays,
    a chunk of which none is named goes, an unreadable answer keeps all."""
    from .providers import chat_column

    s = tx.sentences(F.col(content))
    listed = tx.let(s, lambda x: F.array_join(F.transform(x, lambda v, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), tx.trim(v))), "\n"))
    ask = F.concat(F.lit("问题："), F.col(query), F.lit("\n"), listed, F.lit("\n请返回与问题相关的句子编号，没有则返回 NONE。"))
    d = results.withColumn("_s", s).withColumn("_a", F.when(F.size("_s") > 1, chat_column(llm, ask)))
    numbers = F.transform(F.regexp_extract_all("_a", F.lit(r"(\d+)")), lambda x: x.try_cast("int"))
    none = F.upper(tx.trim(F.col("_a"))).contains("NONE")
    keep = tx.let(numbers, lambda ns: F.filter(F.col("_s"), lambda x, i: F.array_contains(ns, i)))
    text = (
        F.when(F.size("_s") <= 1, F.col(content))
        .when(none, None)
        .when(F.size(numbers) > 0, F.nullif(F.array_join(F.transform(keep, tx.trim), " "), F.lit("")))
        .otherwise(F.col(content))
    )
    return d.withColumn(content, text).where(F.col(content).isNotNull()).drop("_s", "_a")


def compress(results: DataFrame, llm, max_tokens: int = 200, query: str = "query", content: str = "content") -> DataFrame:
    """A model's short version for the question, or the content itself where it fails; both lengths."""
    from .providers import chat_column

    ask = F.concat(F.lit(f"请在 {max_tokens} 个 token 内压缩与问题相关的内容。\n问题："), F.col(query), F.lit("\n"), F.col(content))
    got = tx.trim(chat_column(llm, ask))
    d = results.withColumn("original_length", F.length(content)).withColumn(content, F.coalesce(F.when(F.length(got) > 0, got), F.col(content)))
    return d.withColumn("compressed_length", F.length(content))


#: What every post-processor keeps.
RESULT = T.StructType().add("query_id", "string").add("chunk_id", "string").add("score", "double").add("rank", "integer")
