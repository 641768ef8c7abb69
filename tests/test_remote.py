"""Hosted stores against a small server that speaks their protocols, and a made-up database connection."""

from __future__ import annotations

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.sources import remote


class _Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _do(self):
        raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        body, s = json.loads(raw) if raw else None, self.server
        s.seen.append((self.command, self.path, body, dict(self.headers)))
        status, answer = self._answer(self.command, self.path, body, s)
        data = json.dumps(answer).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_PUT = do_DELETE = _do

    @staticmethod
    def _nearest(s, vector, k, where):
        def cosine(v):
            return sum(a * b for a, b in zip(v, vector)) / (sum(a * a for a in v) * sum(b * b for b in vector)) ** 0.5

        some = [(cosine(v), i, p) for i, (v, p) in s.points.items() if all(str(p.get(n)) == str(x) for n, x in where.items())]
        return sorted(some, key=lambda x: (-x[0], x[1]))[:k]

    def _answer(self, method, path, body, s):
        put = lambda i, v, p: s.points.__setitem__(i, (v, p))
        drop = lambda f: [s.points.pop(i) for i in [i for i, (_, p) in s.points.items() if f(i, p)]]
        if path == "/fail/vectors":
            return 500, {"error": "no"}
        if path == "/vectors" and method == "POST":
            [put(v["id"], v["values"], v["metadata"]) for v in body["vectors"]]
        elif path == "/query":
            return 200, {"matches": [{"id": i, "score": c, "metadata": p} for c, i, p in self._nearest(s, body["vector"], body["topK"], body.get("filter", {}))]}
        elif path == "/vectors":
            drop(lambda i, p: i in body["ids"])
        elif path == "/vectors/delete":
            drop(lambda i, p: p["documentId"] == body["filter"]["documentId"]["$eq"])
        elif re.fullmatch(r"/collections/\w+|/api/v2/\w+/\w+/collections/\w+", path) and method == "GET":
            return (200 if s.made else 404), {"id": "x"}
        elif re.fullmatch(r"/collections/\w+|/api/v2/\w+/\w+/collections", path):
            s.made.append(body)
        elif path.endswith("/points?wait=true"):
            [put(p["id"], p["vector"], p["payload"]) for p in body["points"]]
        elif path.endswith("/points/search"):
            if not s.made:
                return 404, {}
            where = {m["key"]: m["match"]["value"] for m in body.get("filter", {}).get("must", [])}
            got = self._nearest(s, body["vector"], body["limit"], where)
            return 200, {"result": [{"id": i, "score": c, "payload": p} for c, i, p in got if c >= body["score_threshold"]]}
        elif path.endswith("/points/delete?wait=true"):
            keys = {m["match"]["value"] for m in body.get("filter", {}).get("must", [])}
            drop(lambda i, p: i in body.get("points", ()) or p["documentId"] in keys)
        elif path == "/v1/batch/objects" and method == "POST":
            [put(o["id"], o["vector"], o["properties"]) for o in body["objects"]]
        elif path == "/v1/graphql":
            vector, k = json.loads(re.search(r"vector: (\[.*?\])", body["query"])[1]), int(re.search(r"limit: (\d+)", body["query"])[1])
            where = dict(re.findall(r'path: \["(\w+)"\], operator: Equal, valueString: "(\w+)"', body["query"]))
            got = self._nearest(s, vector, k, where)
            return 200, {"data": {"Get": {"Chunk": [{"documentId": p["documentId"], "content": p["content"], "_additional": {"id": i, "distance": 1 - c}} for c, i, p in got]}}}
        elif path.startswith("/v1/objects/Chunk/"):
            return (200 if drop(lambda i, p: i == path.rsplit("/", 1)[1]) else 404), None
        elif path == "/v1/batch/objects":
            drop(lambda i, p: p["documentId"] == body["match"]["where"]["valueString"])
        elif path.endswith("/upsert"):
            [put(i, v, {**m, "content": t}) for i, v, t, m in zip(*(body[c] for c in ("ids", "embeddings", "documents", "metadatas")))]
        elif path.endswith("/query"):
            got = self._nearest(s, body["query_embeddings"][0], body["n_results"], body.get("where", {}))
            return 200, {"ids": [[i for _, i, _ in got]], "documents": [[p["content"] for *_, p in got]], "metadatas": [[p for *_, p in got]], "distances": [[1 - c for c, *_ in got]]}
        elif path.endswith("/delete"):
            drop(lambda i, p: i in body.get("ids", ()) or p["documentId"] == body.get("where", {}).get("documentId"))
        else:
            return 400, {"path": path}
        return 200, {}


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    s.points, s.made, s.seen = {}, [], []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def chunks(spark):
    rows = [("a", "d1", "one", {"lang": "en"}, [1.0, 0.0]), ("b", "d1", "two", {"lang": "de"}, [0.8, 0.6]), ("c", "d2", "three", {"lang": "en"}, [0.0, 1.0]), ("x", "d3", "none", None, None)]
    return spark.createDataFrame(rows, "id string, document_id string, content string, metadata map<string,string>, embedding array<double>")


@pytest.mark.parametrize("kind,scores", [(remote.Pinecone, (1.0, 0.8)), (remote.Qdrant, (1.0, 0.8)), (remote.Weaviate, (1.0, 0.8)), (remote.Chroma, (1.0, 1 / 1.2))])
def test_http_stores(spark, server, kind, scores):
    store = remote.RemoteStore(kind(f"http://127.0.0.1:{server.server_port}", "key", batch=2))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    find = lambda **o: [tuple(r) for r in store.search(q, **o).orderBy("query_id", "rank").collect()]
    if kind is remote.Qdrant:
        assert find() == []  # no collection yet
    assert store.upsert(chunks(spark)) == 3 and store.upsert(chunks(spark)) == 3 and len(server.points) == 3
    got = find(top_k=2)
    assert [(r[0], r[1], r[2], r[3], r[5], r[6]) for r in got] == [(1, "a", "d1", "one", 1, "vector"), (1, "b", "d1", "two", 2, "vector")]
    assert [r[4] for r in got] == pytest.approx(scores)
    assert [r[1] for r in find(threshold=0.81 if scores[1] == 0.8 else 0.9)] == ["a"]
    assert [r[1] for r in find(where={"lang": "en"})] == ["a", "c"]
    assert len(server.made) == (kind in (remote.Qdrant, remote.Chroma))
    assert store.delete(spark.createDataFrame([("a",), ("gone",)], "id string")) == 2 and sorted(server.points) == ["b", "c"]
    only = chunks(spark).where("id = 'a'")
    assert store.upsert_by_document(only) == 1 and sorted(server.points) == ["a", "c"]
    assert store.delete_by_document(spark.createDataFrame([("d2",)], "document_id string")) == 1 and sorted(server.points) == ["a"]
    assert store.upsert(chunks(spark).where("id = 'x'")) == 0


def test_refusals(spark, server):
    store = remote.RemoteStore(remote.Pinecone(f"http://127.0.0.1:{server.server_port}/fail", "key"))
    with pytest.raises(Exception, match="500"):
        store.upsert(chunks(spark))


class _Connection:
    """Logs statements to a file and answers a search with two rows."""

    def __init__(self, path):
        self.path, self.last = path, ""

    def _log(self, *x):
        with open(self.path, "a") as f:
            f.write(json.dumps(x) + "\n")

    def cursor(self):
        return self

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def execute(self, sql, values=()):
        self._log(sql, list(values))
        if "boom" in str(values):
            raise ValueError("boom")

    def executemany(self, sql, rows):
        self._log(sql, [list(r) for r in rows])

    def fetchall(self):
        return [("a", "d1", "one", 0.0), ("b", "d1", "two", 0.25)]

    def commit(self):
        self._log("COMMIT")

    def rollback(self):
        self._log("ROLLBACK")

    def close(self):
        self._log("CLOSE")


def test_postgres(spark, tmp_path):
    log = str(tmp_path / "log")
    # the class goes to the executors by value
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    store = remote.RemoteStore(remote.PgVector(log, table="t", schema="s", connect=_Connection))
    assert store.upsert(chunks(spark)) == 3
    said = [json.loads(x) for x in open(log)]
    text = " ".join(x[0] for x in said)
    assert "CREATE EXTENSION" in text and 'CREATE SCHEMA IF NOT EXISTS "s"' in text and "vector(2)" in text and "USING hnsw (embedding vector_cosine_ops)" in text
    sent = [r for sql, *rows in said if sql.startswith("INSERT") for r in rows[0]]
    assert sorted(r[0] for r in sent) == ["a", "b", "c"] and all("ON CONFLICT (id) DO UPDATE" in x[0] for x in said if x[0].startswith("INSERT"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = store.search(q, 2, 0.9, {"lang": "en"}).collect()
    assert [(r["chunk_id"], r["score"], r["rank"]) for r in got] == [("a", 1.0, 1)]
    sql, values = next(x for x in map(json.loads, open(log)) if x[0].startswith("SELECT"))
    assert "ORDER BY distance LIMIT %s" in sql and values == ["[1.0, 0.0]", "lang", "en", 2]
    assert store.delete(spark.createDataFrame([("a",)], "id string")) == 1
    assert store.delete_by_document(spark.createDataFrame([("d1",)], "document_id string")) == 1
    with pytest.raises(Exception, match="boom"):
        store.search(q, where={"x": "boom"}).collect()
    assert json.loads(open(log).read().splitlines()[-2])[0] == "ROLLBACK"
    with pytest.raises(ImportError):
        remote.PgVector("dsn").run("SELECT 1")
