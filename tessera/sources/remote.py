"""Hosted vector stores, spoken to by the executors: each task sends its rows in batches.

A `Service` says what to send and how to read the answer; `RemoteStore` runs it over
DataFrames. Everything is plain HTTP except PostgreSQL, which takes a function that opens
a connection (by default psycopg's, where it is installed). Rows without an embedding are not sent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import BaseVectorStore

#: (chunk_id, document_id, content, score) of one hit.
Hit = tuple[str, str, str, float]
HITS = "chunk_id string, document_id string, content string, score double"


class RemoteError(RuntimeError):
    """A service's refusal."""


@dataclass
class Service:
    """Base of the HTTP services. `call` returns (status, parsed body)."""

    url: str
    api_key: str | None = None
    timeout: float = 60.0
    #: Rows in one request.
    batch: int = 100

    def headers(self) -> dict[str, str]:
        return {}

    def call(self, method: str, path: str, body: Any = None, accept: tuple[int, ...] = ()) -> tuple[int, Any]:
        import urllib.error
        import urllib.request

        data = None if body is None else json.dumps(body).encode()
        r = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json", **self.headers()}, method=method)
        try:
            with urllib.request.urlopen(r, timeout=self.timeout) as f:
                raw = f.read()
                return f.status, json.loads(raw) if raw else None
        except urllib.error.HTTPError as e:
            if e.code in accept:
                return e.code, None
            raise RemoteError(f"{method} {path}: {e.code} {e.read()[:300]!r}") from e

    def prepare(self, dimension: int) -> None:
        """Make the collection if it is not there."""

    def upsert(self, rows: list[dict]) -> None:
        raise NotImplementedError

    def search(self, vector: list[float], k: int, threshold: float, where: dict) -> list[Hit]:
        raise NotImplementedError

    def delete(self, ids: list[str]) -> None:
        raise NotImplementedError

    def delete_documents(self, ids: list[str]) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _payload(row: dict) -> dict:
    return {"documentId": row["document_id"], "content": row["content"], **row["metadata"]}


@dataclass
class Pinecone(Service):
    """Scores are the service's; the threshold is applied here."""

    namespace: str | None = None

    def headers(self):
        return {"Api-Key": self.api_key or ""}

    def _in(self, body: dict) -> dict:
        return body | ({"namespace": self.namespace} if self.namespace else {})

    def upsert(self, rows):
        self.call("POST", "/vectors", self._in({"vectors": [{"id": r["id"], "values": r["embedding"], "metadata": _payload(r)} for r in rows]}))

    def search(self, vector, k, threshold, where):
        body = {"vector": vector, "topK": k, "includeMetadata": True} | ({"filter": where} if where else {})
        got = self.call("POST", "/query", self._in(body))[1]["matches"]
        told = [(m, m.get("metadata") or {}) for m in got if m["score"] >= threshold]
        return [(m["id"], p.get("documentId", ""), p.get("content", ""), m["score"]) for m, p in told]

    def delete(self, ids):
        self.call("DELETE", "/vectors", self._in({"ids": ids}))

    def delete_documents(self, ids):
        for i in ids:
            self.call("POST", "/vectors/delete", self._in({"filter": {"documentId": {"$eq": i}}}))


@dataclass
class Qdrant(Service):
    """Cosine collection; the service applies the threshold. A collection that is not there has no hits."""

    collection: str = "rag_chunks"

    def headers(self):
        return {"api-key": self.api_key} if self.api_key else {}

    @property
    def path(self) -> str:
        return f"/collections/{self.collection}"

    def prepare(self, dimension):
        if self.call("GET", self.path, accept=(404,))[0] == 404:
            self.call("PUT", self.path, {"vectors": {"size": dimension, "distance": "Cosine"}}, accept=(409,))

    def upsert(self, rows):
        points = [{"id": r["id"], "vector": r["embedding"], "payload": _payload(r)} for r in rows]
        self.call("PUT", f"{self.path}/points?wait=true", {"points": points})

    @staticmethod
    def _must(where: dict) -> dict:
        return {"must": [{"key": k, "match": {"value": v}} for k, v in where.items()]}

    def search(self, vector, k, threshold, where):
        body = {"vector": vector, "limit": k, "with_payload": True, "with_vector": True, "score_threshold": threshold}
        got = self.call("POST", f"{self.path}/points/search", body | ({"filter": self._must(where)} if where else {}), accept=(404,))[1]
        told = [(r, r.get("payload") or {}) for r in (got or {}).get("result") or []]
        return [(str(r["id"]), p.get("documentId", ""), p.get("content", ""), r["score"]) for r, p in told]

    def delete(self, ids):
        self.call("POST", f"{self.path}/points/delete?wait=true", {"points": ids}, accept=(404,))

    def delete_documents(self, ids):
        for i in ids:
            self.call("POST", f"{self.path}/points/delete?wait=true", {"filter": self._must({"documentId": i})}, accept=(404,))


@dataclass
class Weaviate(Service):
    """score = 1 - distance, at least the threshold."""

    class_name: str = "Chunk"

    def headers(self):
        return {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}

    def upsert(self, rows):
        objects = [{"id": r["id"], "class": self.class_name, "properties": _payload(r), "vector": r["embedding"]} for r in rows]
        self.call("POST", "/v1/batch/objects", {"objects": objects})

    def search(self, vector, k, threshold, where):
        parts = [f'{{ path: [{json.dumps(n)}], operator: Equal, valueString: {json.dumps(str(v))} }}' for n, v in where.items()]
        only = f"where: {{ operator: And, operands: [{', '.join(parts)}] }}" if parts else ""
        near = f"nearVector: {{ vector: {json.dumps(vector)} }} limit: {k} {only}"
        ask = f"{{ Get {{ {self.class_name}({near}) {{ documentId content _additional {{ id distance }} }} }} }}"
        got = self.call("POST", "/v1/graphql", {"query": ask})[1]
        found = ((got or {}).get("data") or {}).get("Get", {}).get(self.class_name) or []
        hits = [(o["_additional"]["id"], o["documentId"], o["content"], 1 - o["_additional"]["distance"]) for o in found]
        return [h for h in hits if h[3] >= threshold]

    def delete(self, ids):
        for i in ids:
            self.call("DELETE", f"/v1/objects/{self.class_name}/{i}", accept=(404,))

    def delete_documents(self, ids):
        for i in ids:
            match = {"class": self.class_name, "where": {"operator": "Equal", "path": ["documentId"], "valueString": i}}
            self.call("DELETE", "/v1/batch/objects", {"match": match})


@dataclass
class Chroma(Service):
    """score = 1 / (1 + distance), at least the threshold. The collection is made if it is not there."""

    collection: str = "rag_chunks"
    tenant: str = "default_tenant"
    database: str = "default_database"

    @property
    def path(self) -> str:
        return f"/api/v2/{self.tenant}/{self.database}/collections"

    def prepare(self, dimension):
        if self.call("GET", f"{self.path}/{self.collection}", accept=(404,))[0] == 404:
            self.call("POST", self.path, {"name": self.collection, "dimension": dimension}, accept=(409,))

    def upsert(self, rows):
        body = {
            "ids": [r["id"] for r in rows],
            "embeddings": [r["embedding"] for r in rows],
            "documents": [r["content"] for r in rows],
            "metadatas": [{"documentId": r["document_id"], **r["metadata"]} for r in rows],
        }
        self.call("POST", f"{self.path}/{self.collection}/upsert", body)

    def search(self, vector, k, threshold, where):
        self.prepare(len(vector))
        body = {"query_embeddings": [vector], "n_results": k, "include": ["documents", "metadatas", "distances"]}
        got = self.call("POST", f"{self.path}/{self.collection}/query", body | ({"where": where} if where else {}))[1]
        ids, texts, distances = (got[c][0] for c in ("ids", "documents", "distances"))
        own = (got.get("metadatas") or [[{}] * len(ids)])[0]
        hits = [(i, (m or {}).get("documentId", ""), t, 1 / (1 + d)) for i, t, d, m in zip(ids, texts, distances, own)]
        return [h for h in hits if h[3] >= threshold]

    def delete(self, ids):
        self.call("POST", f"{self.path}/{self.collection}/delete", {"ids": ids})

    def delete_documents(self, ids):
        for i in ids:
            self.call("POST", f"{self.path}/{self.collection}/delete", {"where": {"documentId": i}})


def _psycopg(dsn: str):
    try:
        import psycopg
    except ImportError as e:
        raise ImportError("a PostgreSQL store needs psycopg, or `connect`") from e
    return psycopg.connect(dsn)


@dataclass
class PgVector(Service):
    """A table with an approximate (HNSW) cosine index. score = 1 / (1 + distance); the threshold is applied to the k nearest.

    `url` is the connection string; `connect` opens a DB-API connection from it.
    """

    table: str = "rag_chunks"
    schema: str = "public"
    connect: Callable[[str], Any] = _psycopg
    held: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"held": []}

    @property
    def name(self) -> str:
        return f'"{self.schema}"."{self.table}"'

    def run(self, sql: str, *values, many: list | None = None) -> list | None:
        """One statement (or one for each of `many`) in a transaction of its own."""
        if not self.held:
            self.held.append(self.connect(self.url))
        con = self.held[0]
        try:
            with con.cursor() as c:
                if many is not None:
                    c.executemany(sql, many)
                else:
                    c.execute(sql, values)
                rows = c.fetchall() if sql.startswith("SELECT") else None
            con.commit()
            return rows
        except BaseException:
            con.rollback()
            raise

    def prepare(self, dimension):
        self.run("CREATE EXTENSION IF NOT EXISTS vector")
        if self.schema != "public":
            self.run(f'CREATE SCHEMA IF NOT EXISTS "{self.schema}"')
        columns = f"id TEXT PRIMARY KEY, document_id TEXT NOT NULL, content TEXT NOT NULL, metadata JSONB DEFAULT '{{}}', embedding vector({dimension})"
        self.run(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns})")
        self.run(f'CREATE INDEX IF NOT EXISTS "idx_{self.schema}_{self.table}_embedding" ON {self.name} USING hnsw (embedding vector_cosine_ops)')

    def upsert(self, rows):
        kept = ", ".join(f"{c} = EXCLUDED.{c}" for c in ("document_id", "content", "metadata", "embedding"))
        sql = f"INSERT INTO {self.name} (id, document_id, content, metadata, embedding) VALUES (%s, %s, %s, %s, %s::vector) ON CONFLICT (id) DO UPDATE SET {kept}"
        self.run(sql, many=[(r["id"], r["document_id"], r["content"], json.dumps(r["metadata"]), json.dumps(r["embedding"])) for r in rows])

    def search(self, vector, k, threshold, where):
        only = "".join(" AND metadata->>%s = %s" for _ in where)
        sql = f"SELECT id, document_id, content, embedding <=> %s::vector AS distance FROM {self.name} WHERE embedding IS NOT NULL{only} ORDER BY distance LIMIT %s"
        got = self.run(sql, json.dumps(vector), *[x for n, v in where.items() for x in (n, str(v))], k)
        hits = [(i, d, c, 1 / (1 + float(x))) for i, d, c, x in got]
        return [h for h in hits if h[3] >= threshold]

    def delete(self, ids):
        self.run(f"DELETE FROM {self.name} WHERE id = %s", many=[(i,) for i in ids])

    def delete_documents(self, ids):
        self.run(f"DELETE FROM {self.name} WHERE document_id = %s", many=[(i,) for i in ids])

    def close(self):
        while self.held:
            self.held.pop().close()


class RemoteStore(BaseVectorStore):
    """A hosted store. Changes run at once; a task that is repeated sends the same rows again, which replaces them."""

    def __init__(self, service: Service):
        self.service = service

    def _each(self, rows: DataFrame, send: Callable[[Service, pd.DataFrame], None]) -> int:
        """`send` over batches of all rows, on the executors; the number of rows sent."""
        service = self.service

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            try:
                for pdf in batches:
                    for i in range(0, len(pdf), service.batch):
                        send(service, pdf.iloc[i : i + service.batch])
                    yield pd.DataFrame({"n": [len(pdf)]})
            finally:
                service.close()

        return rows.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def upsert(self, chunks: DataFrame) -> int:
        """Chunks (id, document_id, content, embedding[, metadata map]) that replace those of equal id."""
        meta = F.to_json("metadata") if "metadata" in chunks.columns else F.lit("{}")
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        rows = chunks.where("id is not null and embedding is not null").select(F.col("id").cast("string").alias("id"), text("document_id"), text("content"), F.coalesce(meta, F.lit("{}")).alias("metadata"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        first = rows.select(F.size("embedding")).first()
        if first is None:
            return 0
        self.service.prepare(first[0])
        self.service.close()

        def send(service: Service, pdf: pd.DataFrame) -> None:
            service.upsert([r | {"metadata": json.loads(r["metadata"]), "embedding": list(map(float, r["embedding"]))} for r in pdf.to_dict("records")])

        return self._each(rows, send)

    def upsert_by_document(self, chunks: DataFrame) -> int:
        self.delete_by_document(chunks.select("document_id").distinct())
        return self.upsert(chunks)

    def delete(self, ids: DataFrame) -> int:
        return self._each(ids.select(F.col("id").cast("string").alias("id")).dropna(), lambda s, pdf: s.delete(pdf["id"].tolist()))

    def delete_by_document(self, document_ids: DataFrame) -> int:
        rows = document_ids.select(F.col("document_id").cast("string").alias("id")).dropna()
        return self._each(rows, lambda s, pdf: s.delete_documents(pdf["id"].tolist()))

    def search(self, queries: DataFrame, top_k: int = 5, threshold: float = 0.0, where: dict | None = None) -> DataFrame:
        """(query_id, chunk_id, document_id, content, score, rank, source) of queries (query_id, embedding), one request each."""
        service, kind = self.service, queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            try:
                for pdf in batches:
                    out = [(q, *h) for q, v in zip(pdf["query_id"], pdf["embedding"]) for h in service.search(list(map(float, v)), top_k, threshold, where or {})]
                    yield pd.DataFrame(out, columns=["query_id", "chunk_id", "document_id", "content", "score"])
            finally:
                service.close()

        hits = queries.where("embedding is not null").select("query_id", "embedding").mapInPandas(run, f"query_id {kind}, {HITS}")
        w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
        return hits.withColumn("rank", F.row_number().over(w)).withColumn("source", F.lit("vector"))
