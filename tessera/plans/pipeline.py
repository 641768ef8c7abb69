"""Orchestration: ingest, index and query pipelines, presets, a builder, monitors and a logger."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import cut, few, text_batches
from ..operators import documents as docs_ops
from ..operators import generation, post, search
from ..operators.providers import LLM, Embedding, embed_column
from ..sources.store import TableStore

#: Hits up to which they are sent to every part of a store (a row is under 200 bytes).
FEW_HITS = 200_000
LEVELS = ("debug", "info", "warn", "error", "silent")


class Logger:
    """Writes messages at `level` or above."""

    def __init__(self, level: str = "info", sink: Callable[[str], None] | None = None):
        self.level, self.sink = level, sink or (lambda line: print(line, file=sys.stderr))

    def log(self, level: str, message: str) -> None:
        if LEVELS.index(level) >= LEVELS.index(self.level):
            self.sink(f"[{level}] {message}")


class Monitor:
    """Hears of stages and finished runs; does nothing by itself."""

    def on_stage_start(self, stage: str) -> None: ...

    def on_stage_end(self, metrics: dict) -> None: ...

    def on_query_complete(self, report: dict) -> None: ...


class LoggingMonitor(Monitor):
    def __init__(self, logger: Logger | None = None):
        self.logger = logger or Logger()

    def on_stage_end(self, metrics: dict) -> None:
        self.logger.log("info", f"{metrics['stage']}: {metrics['duration_ms']:.0f} ms")

    def on_query_complete(self, report: dict) -> None:
        self.logger.log("info", f"total: {report['total_ms']:.0f} ms")


@dataclass
class CollectingMonitor(Monitor):
    stages: list[dict] = field(default_factory=list)
    reports: list[dict] = field(default_factory=list)

    def on_stage_end(self, metrics: dict) -> None:
        self.stages.append(metrics)

    def on_query_complete(self, report: dict) -> None:
        self.reports.append(report)


Chunk = Callable[[DataFrame], DataFrame]
Retrieve = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """chunk -> embed -> store, and transform -> retrieve -> post-process -> budget -> generate.

    Stages are lazy plans but for the hits, which are found when asked for; the times a monitor hears are those of planning unless `eager`, which
    stores each stage's result in memory and counts it.
    """

    llm: LLM
    embedding: Embedding
    store: TableStore
    chunk: Chunk
    retrieve: Callable[[Pipeline, DataFrame], DataFrame] | None = None
    transforms: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    post_processors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    template: str = "default"
    max_tokens: int | None = None
    top_k: int = 5
    monitor: Monitor = field(default_factory=Monitor)
    eager: bool = False
    keyword: search.KeywordIndex | None = None

    def __post_init__(self) -> None:
        for name in ("llm", "embedding", "store", "chunk"):
            if getattr(self, name) is None:
                raise ValueError(f"a pipeline needs {name}")

    def _stage(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        self.monitor.on_stage_start(name)
        t = time.perf_counter()
        out = run()
        n = None
        if self.eager:
            out = out.persist()
            n = out.count()
        self.monitor.on_stage_end({"stage": name, "duration_ms": 1000 * (time.perf_counter() - t), "result_count": n})
        return out

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Documents (id, content) into the store and the keyword index; returns the new chunks."""
        chunks = self._stage("chunk", lambda: self.chunk(docs))
        chunks = chunks.withColumnRenamed("chunk_id", "id")
        chunks = self._stage("embed", lambda: chunks.withColumn("embedding", embed_column(self.embedding, "content")))
        self.store = self.store.upsert_by_document(chunks)
        self.keyword = search.KeywordIndex.build(self.store.chunks)
        return chunks

    def _retrieve(self, q: DataFrame) -> DataFrame:
        if self.retrieve is not None:
            return self.retrieve(self, q)
        return self.store.search(q.withColumn("embedding", embed_column(self.embedding, "query")), self.top_k)

    def retrieve_all(self, queries: DataFrame) -> DataFrame:
        """Post-processed results of queries (query_id, query), with contents."""
        t = time.perf_counter()
        q = self._stage("transform", lambda: search.transform_queries(queries, self.transforms))
        key = F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("sub_index").cast("string"))
        subs = q.withColumn("_q", F.col("query_id")).withColumn("query_id", key)
        with text_batches(queries.sparkSession):
            hits = self._stage("retrieve", lambda: self._retrieve(subs))
            hits = hits.join(subs.select("query_id", "_q", "sub_index"), "query_id").drop("query_id").withColumnRenamed("_q", "query_id")
            # few rows, looked up in all chunks: found once, and sent to the chunks rather than met with them in a shuffle
            hits = cut(post.merge_subqueries(hits))
            small = few(hits, FEW_HITS)
        texts = self.store.chunks.select(F.col("id").alias("chunk_id"), "document_id", "content")
        hits = small(hits).join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id")
        for p in self.post_processors:
            hits = self._stage("post_process", lambda p=p, h=hits: p(h))
        if self.max_tokens:
            hits = self._stage("token_budget", lambda: post.truncate_context(hits, self.max_tokens))
        self.monitor.on_query_complete({"total_ms": 1000 * (time.perf_counter() - t)})
        return hits

    def query(self, queries: DataFrame) -> DataFrame:
        """queries plus answer and sources."""
        with text_batches(queries.sparkSession):
            hits = cut(self.retrieve_all(queries))  # a prompt and a list of sources are made of them
        return self._stage("generate", lambda: generation.generate(queries, hits.drop("query"), self.llm, self.template, None))

    def query_stream(self, spark, question: str) -> Iterator[str]:
        """Pieces of one question's answer, on the driver."""
        q = spark.createDataFrame([("0", question)], "query_id string, query string")
        hits = self.retrieve_all(q).drop("query")
        row = generation.prompts(q, hits, self.template).first()
        if not row["source_count"]:
            yield generation.NO_SOURCES
            return
        yield from self.llm.stream([m.asDict() for m in row["messages"]])


def fused_retrieval(vector_weight: float = 0.7, keyword_weight: float = 0.3, k: int = 5, threshold: float = 0.0):
    """Retriever of both arms, 2k hits each, fused by weights."""

    def run(p: Pipeline, q: DataFrame) -> DataFrame:
        v = p.store.search(q.withColumn("embedding", embed_column(p.embedding, "query")), 2 * k)
        return search.fuse(v, p.keyword.search(q, 2 * k), k, vector_weight, keyword_weight, threshold)

    return run


def simple_rag(llm: LLM, embedding: Embedding, store: TableStore, chunk_size: int = 500, overlap: int = 50, top_k: int = 5) -> Pipeline:
    """Fixed-size chunks and vector search."""
    return Pipeline(llm, embedding, store, lambda d: docs_ops.chunk_fixed_size(d, chunk_size, overlap), top_k=top_k)


def advanced_rag(llm: LLM, embedding: Embedding, store: TableStore, chunk_size: int = 500, overlap: int = 50, top_k: int = 5, threshold: float = 0.5, rewrite: bool = True, max_tokens: int | None = None) -> Pipeline:
    """Recursive chunks, rewritten queries, fused search, a threshold."""
    return Pipeline(
        llm, embedding, store, lambda d: docs_ops.chunk_recursive(d, chunk_size, overlap),
        retrieve=fused_retrieval(k=top_k),
        transforms=[lambda q: search.rewrite_queries(q, llm)] if rewrite else [],
        post_processors=[lambda r: post.above(r, threshold, top_k)],
        max_tokens=max_tokens, top_k=top_k,
    )


class PipelineBuilder:
    """Collects components; `build` fails where one is missing."""

    def __init__(self) -> None:
        self.parts: dict = {}

    def use(self, **parts) -> PipelineBuilder:
        """Any field of `Pipeline` by name; lists are extended."""
        for k, v in parts.items():
            if k not in Pipeline.__dataclass_fields__:
                raise ValueError(f"unknown component {k}")
            self.parts[k] = [*self.parts.get(k, []), *v] if isinstance(v, list) else v
        return self

    def build(self) -> Pipeline:
        missing = [k for k in ("llm", "embedding", "store", "chunk") if self.parts.get(k) is None]
        if missing:
            raise ValueError("missing components: " + ", ".join(missing))
        return Pipeline(**self.parts)


@dataclass
class IndexingPipeline:
    """load -> clean -> dedup -> metadata -> augment -> chunk -> embed -> store; stages left out are skipped."""

    store: TableStore
    chunk: Chunk
    embedding: Embedding | None = None
    load: Callable[[str], DataFrame] | None = None
    clean: Chunk | None = None
    dedup: Chunk | None = None
    metadata: Chunk | None = None
    augment: Chunk | None = None

    def index(self, docs: DataFrame) -> DataFrame:
        """One-row report: documents_loaded, documents_after_dedup, chunks_created, chunks_embedded, chunks_stored, duration."""
        start = time.perf_counter()
        spark = docs.sparkSession
        d = self.clean(docs) if self.clean else docs
        d = self.dedup(d) if self.dedup else d
        kept = d
        for step in (self.metadata, self.augment):
            d = step(d) if step else d
        c = self.chunk(d).withColumnRenamed("chunk_id", "id")
        if self.embedding is not None:
            c = c.withColumn("embedding", embed_column(self.embedding, "content"))
        c = c.persist()
        self.store = self.store.upsert(c)
        n = c.agg(F.count(F.lit(1)).alias("a"), F.count("embedding").alias("b") if "embedding" in c.columns else F.lit(0).alias("b")).first()
        row = (docs.count(), kept.count(), n["a"], n["b"], n["a"], time.perf_counter() - start)
        return spark.createDataFrame([row], "documents_loaded long, documents_after_dedup long, chunks_created long, chunks_embedded long, chunks_stored long, duration_s double")

    def index_from_source(self, source: str) -> DataFrame:
        if self.load is None:
            raise ValueError("index_from_source needs a loader")
        return self.index(self.load(source))

    def reindex_document(self, docs: DataFrame) -> DataFrame:
        self.store = self.store.delete_by_document(docs.select(F.col("id").cast("string").alias("document_id")))
        return self.index(docs)
