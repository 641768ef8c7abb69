"""Micro-fixtures: small inputs with known results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import documents as dx
from tessera.operators import evaluation as ev
from tessera.operators import generation as gen
from tessera.operators import graph as gx
from tessera.operators import post, search
from tessera.operators.providers import ExtractiveLLM, HashingEmbedding, JsonParseError, ScriptedLLM, embed_column, merge_roles
from tessera.plans import pipeline as pl
from tessera.sources import loaders
from tessera.sources.store import BaseVectorStore, IndexManager, TableStore, metadata_equals


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- text ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("t,n", [("hello world", 3), ("你好世界", 4), ("你好 world", 4), ("", 0)])
def test_token_count(spark, t, n):
    assert one(spark, tx.token_count(F.col("t")), t=t) == n


def test_cleaning(spark):
    header = "\n".join(["Page Header"] + [f"line {i} a" for i in range(6)] + ["Page Header"] + [f"line {i} b" for i in range(6)] + ["Page Header"])
    d = spark.createDataFrame(
        [(1, "<p>Hello &amp; &lt;world&gt;</p>&nbsp;text"), (2, "  hello   world\n\n\n\nfoo  "), (3, "Hello 你好 @#$%^&* world!?"), (4, header), (5, None)], "id int, content string"
    )
    base = {r["id"]: r["content"] for r in dx.clean_documents(d).collect()}
    assert base[1] == "Hello & <world> text" and base[2] == "hello world\n\nfoo" and base[5] is None
    special = {r["id"]: r["content"] for r in dx.clean_documents(d, html=False, special_chars=True, whitespace=False).collect()}
    assert special[3] == "Hello 你好  world!?"
    lines = {r["id"]: r["content"] for r in dx.clean_documents(d, html=False, header_footer=True).collect()}[4].split("\n")
    assert "Page Header" not in lines and len(lines) == 12


def test_tokenizers(spark):
    assert one(spark, tx.words(F.col("t")), t="Straße, naïve x_1!") == ["straße", "naïve", "x_1"]
    assert "编程" in one(spark, tx.words_cjk(F.col("t")), t="TypeScript是一种编程语言")
    assert one(spark, tx.metric_tokens(F.col("t")), t="Ab c，你好!!") == ["ab", "c", "，", "你", "好", "!!"]
    assert one(spark, tx.ngrams(tx.words(F.col("t")), 2), t="a b c") == ["a b", "b c"]


def test_metadata(spark):
    d = spark.createDataFrame([(1, "\n# Title here\nsome text"), (2, "中文内容很多"), (3, ""), (4, "123")], "id int, content string")
    got = {r["id"]: r for r in dx.base_metadata(d).collect()}
    assert (got[1]["title"], got[1]["language"], got[1]["word_count"], got[1]["line_count"]) == ("Title here", "en", 4, 3)
    assert got[2]["language"] == "zh" and got[2]["word_count"] == 6
    assert got[3]["title"] == dx.UNTITLED and got[4]["language"] == "unknown"
    failing = dx.llm_metadata(d, ScriptedLLM())
    assert {r["topic"] for r in failing.collect()} == {dx.FAILED}


# --- dedup ---------------------------------------------------------------------------------------------------


def test_dedup(spark):
    d = spark.createDataFrame([(1, "same text"), (2, "same  text\n"), (3, "other")], "ord int, content string")
    assert sorted(r["ord"] for r in dx.dedup_hash(d).collect()) == [1, 3]
    v = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (2, "b", [0.99, 0.01, 0.0]), (3, "c", [0.0, 0.0, 1.0])], "ord int, content string, embedding array<double>")
    assert sorted(r["ord"] for r in dx.dedup_embedding(v).collect()) == [1, 3]
    longer = v.withColumn("content", F.when(F.col("ord") == 2, "bbbb").otherwise(F.col("content")))
    assert sorted(r["ord"] for r in dx.dedup_embedding(longer).collect()) == [2, 3]


def survivors(size, near):
    """The rule in a plain loop: size of each document in order, near(i, j)."""
    keep = [True] * len(size)
    for i in range(len(size)):
        for j in range(i + 1, len(size)) if keep[i] else ():
            if keep[j] and near(i, j):
                if size[i] < size[j]:
                    keep[i] = False
                    break
                keep[j] = False
    return [i for i, k in enumerate(keep) if k]


@pytest.mark.parametrize("small", [10**9, 0])
def test_dedup_embedding_by_the_rule(spark, small):
    """In one task a component, and by rounds; the second and third rows are near the first's neighbour only."""
    import numpy as np

    at = lambda d: [math.cos(d), math.sin(d)]
    for lengths, want in (((3, 3, 5), [3]), ((3, 6, 5), [2])):
        v = spark.createDataFrame([(i + 1, "x" * n, at(d)) for i, (n, d) in enumerate(zip(lengths, (0.0, 1.0, 0.5)))], "ord int, content string, embedding array<double>")
        assert sorted(r["ord"] for r in dx.dedup_embedding(v, 0.7, small=small).collect()) == want
    g = np.random.default_rng(1)
    base = g.standard_normal((8, 6))
    vec = np.stack([base[i % 8] + g.standard_normal(6) * 0.35 for i in range(120)])
    vec[60:70] = vec[50]  # copies
    size = g.integers(1, 30, 120).tolist()
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, "x" * size[i], vec[i].tolist()) for i in range(120)] + [(200, None, None)], "ord int, content string, embedding array<double>")
    got = sorted(r["ord"] for r in dx.dedup_embedding(docs, small=small).collect())
    assert got == survivors(size, lambda i, j: unit[i] @ unit[j] >= 0.95) + [200]
    assert dx.dedup_embedding(docs.where("false"), small=small).count() == 0


def test_deduplicate_modes(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha  beta gamma"), (3, "x" * 2000 + "1"), (4, "x" * 2000 + "22"), (5, None)], "ord int, content string")
    got = lambda mode: sorted(r["ord"] for r in dx.deduplicate(d, mode, HashingEmbedding(64)).collect())
    assert got("hash") == [1, 3, 4, 5]
    # only the first 2,000 characters are embedded: rows 3 and 4 are alike, the longer stays
    assert got("both") == [1, 4, 5] and got("embedding") == [2, 4, 5]
    with pytest.raises(ValueError):
        dx.deduplicate(d, "both")
    with pytest.raises(ValueError):
        dx.deduplicate(d, "fuzzy")


def test_dedup_embedding_long_chain(spark):
    """Each vector is near the next of a shuffled chain only; labels that crawl along it leave pieces."""
    import numpy as np

    n = 400
    g = np.random.default_rng(5)
    place, size = g.permutation(n), g.integers(1, 30, n)  # place[o]: where on the chain the row is
    data = [(o, "x" * int(size[o]), [float(np.cos(place[o] * 0.012)), float(np.sin(place[o] * 0.012))]) for o in range(n)]
    docs = spark.createDataFrame(data, "ord int, content string, embedding array<double>")
    assert sorted(r["ord"] for r in dx.dedup_embedding(docs, 0.9999).collect()) == survivors(size.tolist(), lambda i, j: abs(place[i] - place[j]) <= 1)
    at = np.argsort(place).tolist()
    chain = spark.createDataFrame(list(zip(at, at[1:])), "a int, b int")
    assert sorted(map(tuple, dx._components(chain).collect())) == [(o, 0) for o in range(n)]
    with pytest.raises(RuntimeError):
        dx._components(chain, 2)


# --- chunks ---------------------------------------------------------------------------------------------------


def test_fixed_size():
    got = dx.fixed_size_cut("a" * 1200, 500, 50, "\n")
    assert [len(x[0]) for x in got] == [500, 500, 300]
    assert dx.fixed_size_cut("  short ", 500, 50, "\n") == [("short",)] and dx.fixed_size_cut(" \n", 5, 1, "\n") == []
    text = "x" * 300 + "\n" + "y" * 400
    assert dx.fixed_size_cut(text, 500, 0, "\n")[0] == ("x" * 300,)
    covered = "".join(x[0] for x in dx.fixed_size_cut("ab cd " * 300, 100, 0, "\n", strict=True))
    assert covered.replace(" ", "") == "abcd" * 300


def test_chunk_options(spark):
    d = spark.createDataFrame([("d", "text")], "id string, content string")
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            dx.chunk_fixed_size(d, size, overlap)
    r = dx.chunk_recursive(d).first()
    assert (r["chunk_id"], r["document_id"], r["chunk_index"], r["content"]) == ("d_chunk_0", "d", 0, "text")


def test_recursive():
    got = [x[0] for x in dx.recursive_cut("A" * 50 + "\n\n" + "B" * 50 + "\n\n" + "C" * 50, 60, 10)]
    assert [len(x) for x in got] == [50, 61, 61] and got[1].startswith("A" * 10 + " B")
    assert [x[0] for x in dx.recursive_cut("z" * 25, 10, 0)] == ["z" * 10, "z" * 10, "z" * 5]


def test_sentences_and_semantic():
    assert [x[0] for x in dx.sentence_cut("One. Two. Three.", 9)] == ["One. Two.", "Three."]
    assert [x[0] for x in dx.sentence_cut("k" * 25, 10)] == ["k" * 10, "k" * 10, "k" * 5]
    embed = lambda parts: [[1.0, 0.0] if "cat" in p else [0.0, 1.0] for p in parts]
    got = dx.semantic_cut("A cat sat. A cat ran. Dogs bark loud.", embed, 0.5, 5, 1000)
    assert [x[0] for x in got] == ["A cat sat. A cat ran.", "Dogs bark loud."]
    merged = dx.semantic_cut("A cat sat. Dog. A cat ran.", embed, 0.5, 8, 1000)
    assert merged[0][0] == "A cat sat. Dog."


def test_markdown():
    text = "intro\n# One\nbody one\n## Two\nbody two\n### Three\ndeep\n# Empty\n# Last\nend"
    got = dx.markdown_cut(text, 500, 2, True)
    assert [(h, lv) for _, h, lv in got] == [("", 0), ("One", 1), ("Two", 2), ("Last", 1)]
    assert got[2][0] == "## Two\nbody two\n### Three\ndeep"
    long_ = "# H\n" + "\n\n".join(["p" * 40] * 4)
    assert all(x[0].startswith("# H\n") for x in dx.markdown_cut(long_, 100, 2, True)) and len(dx.markdown_cut(long_, 100, 2, True)) == 2


def test_contextual_header(spark):
    d = spark.createDataFrame([("d", "First. Second.")], "id string, content string")
    c = dx.chunk_sentences(d)
    assert dx.chunk_with_headers(c, d, ScriptedLLM([("", "sum")])).first()["content"] == "[摘要: sum]\nFirst. Second."
    assert dx.chunk_with_headers(c, d, ScriptedLLM()).first()["content"] == "[摘要: ]\nFirst. Second."


# --- stores ---------------------------------------------------------------------------------------------------


@pytest.fixture
def store(spark):
    c = [("c1", "d1", "one", [1.0, 0.0, 0.0], '{"category":"A","n":1}'), ("c2", "d1", "two", [0.0, 1.0, 0.0], '{"category":"B","n":"1"}'), ("c3", "d2", "three", [0.0, 0.0, 1.0], '{"n":2}')]
    d = spark.createDataFrame(c, "id string, document_id string, content string, embedding array<double>, meta string")
    return TableStore(d.withColumn("meta", F.parse_json("meta")), 3)


def test_store(spark, store):
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    assert rows(store.search(q, 1), "chunk_id", "score") == [("c1", 1.0)]
    assert [r[0] for r in rows(store.search(q, 5, where=metadata_equals("meta", category="A")), "chunk_id")] == ["c1"]
    assert [r[0] for r in rows(store.search(q, 5, where=metadata_equals("meta", n=1)), "chunk_id")] == ["c1"]
    assert [r[0] for r in rows(store.search(q, 5, where=metadata_equals("meta", n="1")), "chunk_id")] == ["c2"]
    assert rows(store.search(q, 5, threshold=0.5), "chunk_id") == [("c1",)]
    new = spark.createDataFrame([("c1", "d9", "x", [0.0, 0.0, 1.0], 1), ("c1", "d9", "y", [0.0, 1.0, 0.0], 2)], "id string, document_id string, content string, embedding array<double>, o int")
    up = store.upsert(new, "o")
    assert up.chunks.where("id = 'c1'").first()["content"] == "y" and up.chunks.count() == 3
    assert store.delete_by_document(spark.createDataFrame([("d1",)], "document_id string")).chunks.count() == 1
    bad = store.upsert(new.withColumn("embedding", F.array(F.lit(1.0))), "o")
    with pytest.raises(Exception, match="dimension"):
        bad.chunks.collect()
    inverse = TableStore(store.chunks, score_mode="inverse_distance")
    assert rows(inverse.search(q, 2), "score") == [(1.0,), (0.5,)]
    with pytest.raises(NotImplementedError):
        BaseVectorStore().delete(None)


def test_index_manager(spark):
    docs = lambda *r: spark.createDataFrame(r, "id string, content string")
    m = IndexManager()
    empty = TableStore(spark.createDataFrame([], "id string, document_id string, content string, chunk_index int, embedding array<double>"))
    chunk = lambda d: dx.chunk_fixed_size(d).withColumnRenamed("chunk_id", "id")
    embed = lambda c: c.withColumn("embedding", embed_column(HashingEmbedding(8), "content"))
    report = lambda r: tuple(r.select("added", "updated", "deleted", "unchanged").first())
    s, r = m.sync(docs(("a", "x"), ("b", "y")), empty, chunk, embed)
    assert report(r) == (2, 0, 0, 0)
    s, r = m.sync(docs(("a", "x "), ("b", "y")), s, chunk, embed)
    assert report(r) == (0, 0, 0, 2)
    s, r = m.sync(docs(("a", "changed"), ("c", "z")), s, chunk, embed)
    assert report(r) == (1, 1, 1, 0)
    assert sorted(rows(s.chunks, "document_id", "content")) == [("a", "changed"), ("c", "z")]
    other = IndexManager()
    other.restore_hashes(m.hash_snapshot())
    assert report(other.sync(docs(("a", "changed"), ("c", "z")), s, chunk, embed)[1]) == (0, 0, 0, 2)


# --- search ------------------------------------------------------------------------------------------------------


def test_bm25(spark):
    d = spark.createDataFrame([("1", "TypeScript programming language"), ("2", "Python is a snake"), ("3", "The weather is nice"), ("4", "")], "id string, content string")
    q = spark.createDataFrame([(1, "TypeScript programming"), (2, ""), (3, "zebra"), (4, "is is")], "query_id int, query string")
    ix = search.KeywordIndex.build(d)
    got = ix.search(q, 2)
    assert rows(got.where("rank = 1 and query_id = 1"), "chunk_id") == [("1",)]
    assert got.where("query_id in (2, 3)").count() == 0 and ix.search(q, threshold=100.0).count() == 0
    n, avg = ix.stats.first()
    assert (n, avg) == (4, 11 / 4)
    idf = math.log((4 - 2 + 0.5) / 2.5 + 1)
    assert math.isclose(got.where("query_id = 4 and chunk_id = '2'").first()["score"], 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / avg)))
    zh = spark.createDataFrame([("1", "TypeScript是一种编程语言"), ("2", "Python也很流行"), ("3", "今天天气很好")], "id string, content string")
    z = search.KeywordIndex.build(zh).search(spark.createDataFrame([(1, "编程语言")], "query_id int, query string"))
    assert z.orderBy("rank").first()["chunk_id"] == "1"
    assert search.KeywordIndex.build(d.where("false")).search(q).count() == 0


def test_bm25_stored_and_arms(spark, tmp_path):
    """A stored index, read by terms, and several arms in one pass give what plain searches give."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["编程", "语言学"]
    data = [(i, " ".join(r.choices(words, range(42, 0, -1), k=r.randint(0, 30)))) for i in range(200)] + [(200, None)]
    d, q = spark.createDataFrame(data, "id int, content string"), spark.createDataFrame([(1, "w1 w2 w2"), (2, "w30 语言"), (3, None)], "query_id int, query string")
    ix = search.KeywordIndex.build(d)
    ix.save(str(tmp_path / "ix"))
    kept = search.KeywordIndex.load(spark, str(tmp_path / "ix"))
    plain = lambda x: sorted(rows(x, "query_id", "rank", "chunk_id", "score"))
    want = {b: plain(ix.search(q, 4, b=b, digits=6)) for b in (0.75, 0.0)}
    assert len(want[0.75]) == 8 and plain(kept.search(q, 4, digits=6)) == want[0.75]
    arms = kept.search_arms(q, (0.75, 0.0), 4, digits=6)
    assert [plain(arms.where(F.col("arm") == i)) for i in (0, 1)] == [want[0.75], want[0.0]]


def test_vector_search_odd_vectors(spark, monkeypatch):
    """NaN, null and zero vectors are at 0, other lengths are not compared, ties go to the smaller id; any number of blocks."""
    r = random.Random(9)
    v = lambda n=4: [r.choice([-1.0, 0.0, 1.0]) for _ in range(n)]
    data = [(i, v()) for i in range(300)] + [(300, [float("nan"), 1.0, 0.0, 0.0]), (301, [None, 1.0, 0.0, 0.0]), (302, [0.0] * 4), (303, [1.0, 2.0]), (304, None), (305, [])]
    data += [(i, data[0][1]) for i in range(400, 420)]
    c = spark.createDataFrame(data, "id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, data[0][1]), (2, v()), (3, [float("nan")] * 4), (4, [3.0, 1.0]), (5, None), (6, [0.0] * 4)], "query_id int, embedding array<double>")

    def cosine(a, b):
        if any(x is None or x != x for x in (*a, *b)):
            return 0.0
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = []
    for i, a in q.collect():
        s = sorted((-round(cosine(a, b), 6), j) for j, b in data if a is not None and b is not None and len(a) == len(b))
        want += [(i, n, j, -x) for n, (x, j) in enumerate([x for x in s if -x[0] >= 0][:7], 1)]
    got = lambda: sorted(rows(search.vector_search(q, c, 7, digits=6), "query_id", "rank", "chunk_id", "score"))
    assert got() == sorted(want)
    monkeypatch.setattr(search, "QUERY_BYTES", 80)
    assert got() == sorted(want)
    assert search.vector_search(q.where("false"), c).count() == 0 and search.vector_search(q, c.where("false")).count() == 0


def hits(spark, *r):
    return spark.createDataFrame([(1, *x) for x in r], "query_id int, chunk_id string, score double, rank int")


def test_fusion(spark):
    v, k = hits(spark, ("c1", 0.9, 1), ("c2", 0.7, 2)), hits(spark, ("c1", 0.8, 1), ("c3", 0.6, 2))
    assert dict(rows(search.fuse(v, k, 5, 0.6, 0.4), "chunk_id", "score")) == {"c1": 1.0, "c2": 0.0, "c3": 0.0}
    assert rows(search.fuse(hits(spark, ("x", 0.3, 1)), hits(spark).where("false"), 5), "score") == [(0.5,)]
    assert rows(search.fuse(hits(spark, ("a", 0.3, 1), ("b", 0.3, 2)), hits(spark).where("false"), 5), "score") == [(0.25,), (0.25,)]
    r = dict(rows(search.rrf([v, k]), "chunk_id", "score"))
    assert math.isclose(r["c1"], 2 / 61) and math.isclose(r["c2"], 1 / 62)
    assert math.isclose(search.rrf([v], constant=10).first()["score"], 1 / 11)


def test_small_to_big(spark):
    c = spark.createDataFrame([("s1", "big"), ("s2", "big"), ("s3", "lost"), ("s4", None)], "id string, parent_id string")
    h = hits(spark, ("s1", 0.9, 1), ("s3", 0.8, 2), ("s2", 0.7, 3), ("s4", 0.6, 4))
    got = search.small_to_big(h, c, spark.createDataFrame([("big",)], "id string"))
    assert sorted(rows(got, "rank", "chunk_id", "score")) == [(1, "big", 0.9), (2, "s4", 0.6)]


def test_hierarchical(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    s = spark.createDataFrame([("summary-1", "doc-1", [1.0, 0.0])], "id string, document_id string, embedding array<double>")
    d = spark.createDataFrame([("detail-1", "doc-1", [1.0, 0.1]), ("detail-2", "doc-1", [0.5, 0.5]), ("far", "doc-2", [1.0, 0.0])], "id string, document_id string, embedding array<double>")
    for pre in (False, True):
        assert sorted(rows(search.hierarchical(q, s, d, k=2, prefilter=pre), "rank", "chunk_id")) == [(1, "detail-1"), (2, "detail-2")]


def test_query_transforms(spark):
    q = spark.createDataFrame([(1, "what is x")], "query_id int, query string")
    assert rows(search.expand_queries(q, ScriptedLLM([("", '```json\n["a", "b", "c", "d"]\n```')]), "multi", 3), "query") == [("a",), ("b",), ("c",)]
    assert rows(search.expand_queries(q, ScriptedLLM([("", "1. a\n2) b\n\n")]), "decompose", 5), "query") == [("a",), ("b",)]
    assert rows(search.expand_queries(q, ScriptedLLM(), "multi"), "sub_index", "query") == [(0, "what is x")]
    assert rows(search.rewrite_queries(q, ScriptedLLM([("", "  better ")])), "query") == [("better",)]
    both = search.transform_queries(q, [lambda d: search.expand_queries(d, ScriptedLLM([("", '["a", "b"]')]), "multi"), lambda d: search.expand_queries(d, ScriptedLLM([("", lambda p: p[-1] + "1\n" + p[-1] + "2")]), "decompose")])
    assert sorted(rows(both, "sub_index", "query")) == [(0, "a1"), (1, "a2"), (2, "b1"), (3, "b2")]
    routed = search.route(q, [("w", F.col("query").startswith("what")), ("all", F.lit(True))])
    assert rows(routed, "route") == [("w",)]
    assert rows(search.route(q, [("llm", search.llm_rule(ScriptedLLM([("", "Yes, it is")]), "is it?"))]), "route") == [("llm",)]


# --- post-processing ------------------------------------------------------------------------------------------------


def test_post(spark):
    r = hits(spark, ("a", 0.9, 1), ("b", 0.4, 2), ("c", 0.6, 3)).withColumn("content", F.col("chunk_id")).withColumn("query", F.lit("q"))
    assert sorted(rows(post.above(r), "rank", "chunk_id")) == [(1, "a"), (2, "c")]
    s = F.when(F.col("content") == "b", 0.99).when(F.col("content") == "a", 0.5).otherwise(0.3)
    assert sorted(rows(post.rerank(r, s, 2), "rank", "chunk_id", "original_score")) == [(1, "b", 0.4), (2, "a", 0.9)]
    t = r.withColumn("content", F.expr("repeat('word', 100)"))
    assert post.truncate_context(t, 800, 0, 500).count() == 3 and post.truncate_context(t, 750, 0, 500).count() == 2
    assert post.truncate_context(t, 100, 100).count() == 0
    u = hits(spark, ("a", 0.9, 1), ("b", 0.4, 2)).withColumn("sub_index", F.lit(0)).union(hits(spark, ("b", 0.9, 1), ("c", 0.4, 2)).withColumn("sub_index", F.lit(1)))
    assert sorted(rows(post.merge_subqueries(u), "rank", "chunk_id")) == [(1, "a"), (2, "b"), (3, "c")]
    c = spark.createDataFrame([(x, "d", i, x.upper()) for i, x in enumerate("abcdef")], "id string, document_id string, chunk_index int, content string")
    assert dict(rows(post.enrich_context(r, c, 1), "chunk_id", "content")) == {"a": "A\nB", "b": "A\nB\nC", "c": "B\nC\nD"}


def test_selective_and_compression(spark):
    r = hits(spark, ("a", 0.9, 1)).withColumn("content", F.lit("One. Two. Three.")).withColumn("query", F.lit("q"))
    keep = lambda answer: rows(post.select_sentences(r, ScriptedLLM([("", answer)])), "content")
    assert keep("[0, 2]") == [("One. Three.",)] and keep("NONE") == [] and keep("1") == [("Two.",)] and keep("??") == [("One. Two. Three.",)]
    c = post.compress(r, ScriptedLLM([("", "short")])).first()
    assert (c["content"], c["original_length"], c["compressed_length"]) == ("short", 16, 5)
    assert post.compress(r, ScriptedLLM()).first()["content"] == "One. Two. Three."


# --- generation -------------------------------------------------------------------------------------------------------


def test_prompts(spark):
    q = spark.createDataFrame([(1, "what {context}?"), (2, "none")], "query_id int, query string")
    r = hits(spark, ("a", 0.9, 1), ("b", 0.4, 2)).withColumn("content", F.when(F.col("rank") == 1, "first").otherwise("second one"))
    p = {x["query_id"]: x for x in gen.prompts(q, r).collect()}
    assert p[1]["context"] == "[1] first\n\n[2] second one" and p[1]["source_count"] == 2
    assert "用户问题：what {context}?" in p[1]["messages"][1]["content"] and p[2]["source_count"] == 0
    cut = {x["query_id"]: x["context"] for x in gen.build_context(r, 16).collect()}
    assert cut[1] == "[1] first\n\n[2] sec..."
    assert gen.build_context(r, 12).first()["context"] == "[1] first"


def test_answers(spark):
    q = spark.createDataFrame([(1, "second one?"), (2, "none")], "query_id int, query string")
    r = hits(spark, ("a", 0.9, 1), ("b", 0.4, 2)).withColumn("content", F.when(F.col("rank") == 1, "first part.").otherwise("second one."))
    got = {x["query_id"]: x for x in gen.generate(q, r, ExtractiveLLM()).collect()}
    assert "second one." in got[1]["answer"] and len(got[1]["sources"]) == 2 and got[2]["answer"] == gen.NO_SOURCES
    a = spark.createDataFrame([(1, "带引用的回答[2][1][2][9]。")], "query_id int, answer string")
    c = gen.parse_citations(a, r).first()
    assert c["cited"] == [1, 2] and [s["chunk_id"] for s in c["cited_sources"]] == ["a", "b"] and c["source_list"].startswith("[1] first part....")
    m = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (2, 1, "b"), (2, 2, "a")], "query_id int, round int, answer string")
    assert sorted(rows(gen.majority(m), "query_id", "answer", "votes")) == [(1, "y", 2), (2, "b", 1)]
    g = gen.grounded(q, r, ScriptedLLM([("请检查", '{"isGrounded": true, "unsupportedClaims": [], "groundingScore": 0.7}'), ("", "ok")])).collect()
    assert {x["verification"]["groundingScore"] for x in g} == {0.7}
    assert gen.consistent(q, r, ScriptedLLM([("", "same")])).where("votes = 3").count() == 2


def test_consistency_by_model(spark):
    q = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id int, query string")
    r = hits(spark, ("a", 0.9, 1)).withColumn("content", F.lit("text"))
    llm = ScriptedLLM([("第 1 次", "one"), ("", "two")])
    judge = ScriptedLLM([("问题：good.*答案 1:\none", '{"consistencyScore": 0.4, "bestAnswer": "one", "conflicts": ["x"]}'), ("", '{"consistencyScore": 1.4, "bestAnswer": "one", "conflicts": []}')])
    got = {x["query_id"]: x for x in gen.consistent(q, r, llm, judge=judge).collect()}
    assert (got[1]["answer"], got[1]["score"], got[1]["conflicts"], got[1]["answers"]) == ("one", 0.4, ["x"], ["one", "two", "two"])
    assert (got[2]["answer"], got[2]["score"], got[2]["conflicts"]) == ("two", pytest.approx(2 / 3), [])


def test_faithfulness_by_model(spark):
    d = spark.createDataFrame(
        [(1, "a b. c", "ctx a b"), (2, "q y. a", "ctx a"), (3, "any", ""), (4, "none", "ctx"), (5, "odd one. ctx two", "the ctx two"), (6, None, None)], "query_id int, answer string, context string"
    )
    llm = ScriptedLLM(
        [
            ("提取.*a b. c", '{"claims": ["first", "second", " "]}'),
            ("提取.*none", '{"claims": []}'),
            ("提取.*odd one", "no json"),
            ("待验证.*1. first", '{"verdicts": [{"claim": "first", "supported": true, "reason": "r"}, {"claim": "second", "supported": false, "reason": "r"}]}'),
            ("待验证.*1. odd one", '{"verdicts": [{"claim": "odd one", "supported": true}]}'),
        ]
    )
    got = {r["query_id"]: (r["faithfulness"], r["total_claims"], r["supported_claims"], r["unsupported_claims"]) for r in ev.faithfulness_by_model(d, llm).collect()}
    assert got[1] == (0.5, 2, 1, ["second"]) and got[2] == (0.5, 2, 1, ["q y"])
    assert got[3] == got[6] == (0.0, 0, 0, []) and got[4] == (1.0, 0, 0, [])
    # verdicts that lack a reason are not taken
    assert got[5] == (0.5, 2, 1, ["odd one"])


def test_generation_benchmark(spark):
    d = spark.createDataFrame([(1, "the cat", "the cat", ["the cat sat"]), (2, "a dog", "the cat", None)], "query_id int, answer string, reference string, contexts array<string>")
    scores, stats = ev.run_generation_benchmark(d, {"rouge1": lambda a, r, c: ev.rouge_n(a, r)["f1"], "faithfulness": lambda a, r, c: ev.faithfulness(a, c)})
    assert sorted(rows(scores, "query_id", "name", "score")) == [(1, "faithfulness", 1.0), (1, "rouge1", 1.0), (2, "faithfulness", 0.0), (2, "rouge1", 0.0)]
    assert {r["name"]: r["mean"] for r in stats.collect()} == {"rouge1": 0.5, "faithfulness": 0.5}


def test_load_web_keeps_going(spark, tmp_path):
    (tmp_path / "p.html").write_text("<html><title>T</title><body>hello</body></html>")
    got = {r["source"]: r for r in loaders.load_web(spark, [f"file://{tmp_path}/p.html", f"file://{tmp_path}/none.html", "nonsense"]).collect()}
    ok, bad = got[f"file://{tmp_path}/p.html"], [r for s, r in got.items() if not s.endswith("p.html")]
    assert (ok["title"], ok["content"], ok["error"]) == ("T", "hello", None) and all(r["error"] and r["content"] is None for r in bad)


def test_self_rag(spark):
    q = spark.createDataFrame([(1, "a"), (2, "bb")], "query_id int, query string")
    src = spark.createDataFrame([("c", 1.0, 1, "text")], "chunk_id string, score double, rank int, content string")
    llm = ScriptedLLM([("是否需要检索.*bb", "no"), ("是否需要检索", "yes"), ("资料是否相关", "yes"), ("资料是否支持", "no"), ("", "ans")])
    got = gen.self_rag(q, lambda d: d.select("query_id").crossJoin(src), llm, 3)
    assert dict(rows(got, "query_id", "rounds")) == {1: 3, 2: 1}


def test_providers(spark):
    llm = ScriptedLLM([("good", '```json\n{"a": 1}\n```'), ("bad", "not json")])
    ask = lambda t: llm.chat_json([{"role": "user", "content": t}], {"type": "object"})
    assert ask("good") == {"a": 1}
    with pytest.raises(JsonParseError):
        ask("bad")
    e = HashingEmbedding(16)
    assert math.isclose(sum(x * x for x in e.embed("a b c")), 1.0) and e.embed("") == [0.0] * 16
    assert "".join(ExtractiveLLM().stream([{"role": "user", "content": "x"}])) == "x"
    c = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", "hi"), (1, 2, "user", "a"), (1, 3, "user", "b"), (1, 4, "assistant", "c")], "conv_id int, turn int, role string, text string")
    assert sorted(rows(merge_roles(c), "turn", "role", "text")) == [(0, "user", "a\n\nb"), (1, "assistant", "c")]


# --- evaluation ----------------------------------------------------------------------------------------------------------


def metrics(spark, ranked, truth, k=10):
    q = spark.createDataFrame([(1,)], "query_id int")
    r = spark.createDataFrame([(1, c, i) for i, c in enumerate(ranked, 1)] or [(9, "z", 1)], "query_id int, chunk_id string, rank int")
    t = spark.createDataFrame([(1, *x) if isinstance(x, tuple) else (1, x, 1.0) for x in truth] or [(9, "z", 1.0)], "query_id int, chunk_id string, rel double")
    return (*ev.retrieval_metrics(q, r, t, k).first()[1:], ev.ndcg(q, r, t, k).first()["ndcg"])


def test_retrieval_metrics(spark):
    assert metrics(spark, "abc", "ab", 3) == (1.0, pytest.approx(2 / 3), 1.0, 1.0)
    assert metrics(spark, "xab", "ab", 2)[:3] == (0.5, 0.5, 0.5)
    assert metrics(spark, "xyz", "a") == (0.0, 0.0, 0.0, 0.0) and metrics(spark, "", "a") == (0.0, 0.0, 0.0, 0.0)
    assert metrics(spark, "ab", "")[0] == 0.0
    assert metrics(spark, "ab", [("a", 3.0), ("b", 2.0)])[3] == 1.0
    assert 0 < metrics(spark, "ba", [("a", 3.0), ("b", 2.0)])[3] < 1
    dcg, idcg = 1 / math.log2(3), 1 + 1 / math.log2(3)
    assert metrics(spark, "xa", "ab")[3] == pytest.approx(dcg / idcg)


def test_generation_metrics(spark):
    score = lambda f, a, r: one(spark, f(F.col("a"), F.col("r")), a=a, r=r)
    t = "the cat sat on the mat"
    assert score(ev.bleu, t, t) == pytest.approx(1.0) and score(ev.bleu, "x y z w", t) == 0.0 and score(ev.bleu, "", t) == 0.0
    assert score(ev.bleu, "the cat sat on", t) == pytest.approx(math.exp(1 - 6 / 4))
    for f in (lambda a, r: ev.rouge_n(a, r, 1)["f1"], lambda a, r: ev.rouge_n(a, r, 2)["f1"], lambda a, r: ev.rouge_l(a, r)["f1"]):
        assert score(f, t, t) == pytest.approx(1.0) and score(f, "q w", t) == 0.0 and score(f, "", "") == 0.0
    assert score(lambda a, r: ev.rouge_l(a, r)["recall"], "cat on mat", t) == pytest.approx(0.5)
    assert score(lambda a, r: ev.rouge_n(a, r, 1)["precision"], "the the the", "the the") == pytest.approx(2 / 3)
    assert score(ev.tf_cosine, "a a b", "a b") == pytest.approx(3 / math.sqrt(10)) and score(ev.tf_cosine, "", "a") == 0.0
    assert score(ev.faithfulness, "the cat. a dog flew away", "the cat sat") == 0.5
    assert score(ev.faithfulness, "x", " ") == 0.0 and score(ev.faithfulness, " ", "x") == 1.0
    s = spark.createDataFrame([(1, "what is spark", "spark is an engine")], "query_id int, query string, answer string")
    assert ev.answer_relevance(s).first()["answer_relevance"] == pytest.approx(2 / 3)
    q = ev.answer_relevance(s, ScriptedLLM([("", '{"questions": ["what is spark", "spark"]}')])).first()["answer_relevance"]
    assert q == pytest.approx((1 + 1 / math.sqrt(3)) / 2)
    assert ev.judge(s, ScriptedLLM()).first()["overall"] == 5.0


def test_ab(spark):
    def run(a, b):
        e = spark.createDataFrame([("A", x) for x in a] + [("B", x) for x in b], "group string, satisfaction double")
        return ev.ab_test(e).first()

    s = spark.createDataFrame([(True, False, True, 45.0), (False, True, False, 3.0)], "t boolean, f boolean, s boolean, d double")
    got = [r[0] for r in s.select(ev.satisfaction(*[F.col(c) for c in "tfsd"])).collect()]
    assert got == [pytest.approx(0.7), 0.0]
    assert run([0.7] * 50, [0.1] * 50)["winner"] == "A" and run([0.5] * 5, [0.5] * 5)["winner"] == "tie"
    assert run([1.0], [0.0])["winner"] == "tie"
    r = run([0.1, 0.2, 0.3, 0.25], [0.4, 0.5, 0.6, 0.55])
    assert r["winner"] == "B" and r["significant"] and r["p_value"] <= r["p_value_exact"] + 1e-6


def test_reports(spark):
    s = spark.createDataFrame([(1, "recall", 1.0), (2, "recall", 0.5), (1, "mrr", 0.2)], "query_id int, name string, score double")
    st = {r["name"]: r for r in ev.metric_stats(s).collect()}
    assert (st["recall"]["mean"], st["recall"]["std"], st["recall"]["samples"]) == (0.75, 0.25, 2)
    r = ev.evaluation_report(ev.metric_stats(s)).first()
    assert r["overall"] == pytest.approx(0.475) and r["verdict"] == "需改进" and r["samples"] == 2 and r["recommendations"] == [ev.NO_ADVICE]
    low = spark.createDataFrame([("recall@10", 0.69, 4), ("precision@10", 0.6, 4), ("ndcg@10", 0.1, 4)], "name string, mean double, samples long")
    gen_ = spark.createDataFrame([("faithfulness", 0.9, 7), ("bleu", 0.2, 7)], "name string, mean double, samples long")
    scored = ev.judge(spark.createDataFrame([(1, "q", "a"), (2, "q", "b")], "query_id int, query string, answer string"), ScriptedLLM([("回答：a", '{"准确性": 9}')]))
    full = ev.evaluation_report(low, gen_, scored, spark.createDataFrame([("A",)], "winner string")).first()
    means = [0.69, 0.6, 0.1, 0.9, 0.2, (5.8 + 5.0) / 2 / 10]
    assert full["overall"] == pytest.approx(sum(means) / 6) and full["samples"] == 4 + 7 + 2 and full["ab"]["winner"] == "A"
    assert full["judge_scores"]["准确性"] == 7.0 and [x[:6] for x in full["recommendations"]] == ["Recall", "NDCG@K", "BLEU 低"]
    c = spark.createDataFrame([(1, 1, "red car", "a red car"), (1, 2, "red car", "blue sky"), (1, 3, "red car", "car red")], "query_id int, rank int, query string, content string")
    assert ev.context_relevance(c).first()["score"] == pytest.approx((1 + 2 / 3) / 2)
    j = '{"judgments": [{"index": 0, "relevant": false}, {"index": 1, "relevant": true}]}'
    assert ev.context_relevance(c, ScriptedLLM([("", j)])).first()["score"] == pytest.approx(0.5)


# --- graph ------------------------------------------------------------------------------------------------------------------


@pytest.fixture
def graph(spark):
    m = "map<string,string>"
    e = spark.createDataFrame([(f"e{i}", n, t, {}, i) for i, (n, t) in enumerate([("张三", "人物"), ("ABC科技", "组织"), ("智析平台", "产品"), ("深度学习", "技术"), ("李四", "人物")], 1)], f"id string, name string, type string, metadata {m}, ord int")
    r = spark.createDataFrame([("e1", "e2", "属于", {}, 1), ("e2", "e3", "开发", {}, 2), ("e3", "e4", "使用", {}, 3), ("e5", "e2", "属于", {}, 4), ("e5", "e2", "属于", {}, 5)], f"source string, target string, type string, metadata {m}, ord int")
    return gx.GraphStore(e, r)


def test_graph(spark, graph):
    seed = lambda s: spark.createDataFrame([(s,)], "seed string")
    assert tuple(graph.stats().first()) == (5, 4)
    assert sorted(r[0] for r in rows(graph.neighbors(seed("e2")), "id")) == ["e1", "e3", "e5"]
    assert sorted(rows(graph.neighbors(seed("e2"), hops=2), "id", "hop")) == [("e1", 1), ("e3", 1), ("e4", 2), ("e5", 1)]
    assert sorted(rows(graph.neighbors(seed("e2"), limit=2), "place", "id")) == [(1, "e3"), (2, "e1")]
    assert rows(graph.neighbors(seed("e2"), relation_types=["开发"]), "id") == [("e3",)]
    assert sorted(r[0] for r in rows(graph.neighbors(seed("e1"), hops=3, entity_types=["组织", "人物"]), "id")) == ["e2", "e5"]
    p = spark.createDataFrame([("e1", "e4"), ("e1", "zz"), ("e1", "e1")], "source_id string, target_id string")
    got = {r["target_id"]: r["path"] for r in graph.paths(p).collect()}
    assert got == {"e4": ["e1", "e2", "e3", "e4"], "e1": ["e1"]}
    q = spark.createDataFrame([(1, "张三 组织"), (2, " ")], "query_id int, query string")
    found, rel = graph.query(q)
    assert sorted(rows(found, "query_id", "id")) == [(1, "e1"), (1, "e2")] and rows(rel, "source", "target") == [("e1", "e2")]
    more = graph.add_entities(spark.createDataFrame([("e1", "other", "x", {"a": "1"}, 9)], graph.entities.schema))
    x = more.entity("e1").first()
    assert (x["name"], x["metadata"]) == ("张三", {"a": "1"})
    with pytest.raises(NotImplementedError):
        gx.Neo4jGraphStore()


def test_graph_merge_last_wins(spark):
    e = spark.createDataFrame([("e", "n", "t", {"a": "1", "b": "2"}, 1), ("e", "m", "u", {"b": "99", "c": "3"}, 2)], "id string, name string, type string, metadata map<string,string>, ord int")
    r = gx.merge_entities(e).first()
    assert (r["name"], r["type"], r["metadata"]) == ("n", "t", {"a": "1", "b": "99", "c": "3"})


def test_graph_retrieval(spark, graph):
    q = spark.createDataFrame([(1, "ABC科技")], "query_id int, query string")
    m = gx.mentions(q, graph.entities)
    got = gx.graph_retrieve(m, graph.entities, graph.relations, 1).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "graph_e2" and got[0]["score"] == pytest.approx(0.6) and "张三 --[属于]--> ABC科技" in got[0]["content"]
    named = gx.mentions(q, graph.entities, ScriptedLLM([("", '{"entities": ["智析平台"]}')]))
    assert rows(named, "id") == [("e3",)]
    x = gx.expand_hits(hits(spark, ("c", 1.0, 1)).withColumn("content", F.lit("about ABC科技 now")), graph.entities, graph.relations).first()
    assert x["chunk_id"] == "graph_expanded_e2" and x["score"] == pytest.approx(0.8)
    e = gx.graph_enhanced(hits(spark, ("a", 0.5, 1), ("b", 0.25, 2)), hits(spark, ("a", 1.0, 1), ("g", 0.5, 2)))
    assert {k: pytest.approx(v) for k, v in rows(e, "chunk_id", "score")} == {"a": 1.0, "b": 0.3, "g": 0.2}


def test_graph_build(spark):
    d = spark.createDataFrame([("d1", "Ann works", 1), ("d2", "fail", 2)], "id string, content string, ord int")
    j = '{"entities": [{"name": "Ann  B", "type": "人物"}, {"name": "Co", "type": "组织"}], "relations": [{"source": "Ann  B", "target": "Co", "type": "属于"}, {"source": "Ann  B", "target": "Nobody", "type": "属于"}]}'
    g, report = gx.build_graph(d, ScriptedLLM([("works", j)]))
    assert tuple(report.first()) == (2, 1, 2, 1)
    assert sorted(r[0] for r in rows(g.entities, "id")) == ["entity_ann_b", "entity_co"]


# --- loaders and pipelines ------------------------------------------------------------------------------------------------------


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nx,"a ""q"" b"\ny , two \n', encoding="utf-8")
    c = loaders.load_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(r[0] for r in rows(c, "content")) == ['x\na "q" b', "y\ntwo"]
    assert sorted(loaders.load_csv(spark, str(tmp_path / "a.csv"), header=False).first()["metadata"]) == ["col_0", "col_1"]
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert rows(loaders.load_csv(spark, str(tmp_path / "t.tsv"), "\t", ("b",)), "content") == [("2",)]
    (tmp_path / "j.json").write_text('{"data": {"items": ["x", {"k": 1}]}, "by": "me"}')
    j = loaders.load_json(spark, str(tmp_path / "j.json"), "data.items", ("by", "nope"))
    assert sorted(rows(j, "item_index", "content", "metadata")) == [(0, "x", '{"by": "me"}'), (1, '{\n  "k": 1\n}', '{"by": "me"}')]
    (tmp_path / "m.md").write_text("lead\n# A\ntext a\n## A1\nmore\n# B\ntext b\n")
    m = loaders.load_markdown(spark, str(tmp_path / "m.md"), True)
    assert sorted(rows(m, "section_index", "heading", "content")) == [(0, "(preamble)", "lead"), (1, "A", "text a\n## A1\nmore"), (2, "B", "text b")]
    (tmp_path / "e.md").write_text("no heading")
    assert rows(loaders.load_markdown(spark, str(tmp_path / "e.md"), True), "heading") == [("(full)",)]
    (tmp_path / "l.txt").write_bytes("été".encode("latin-1"))
    assert loaders.load_text(spark, str(tmp_path / "l.txt"), "iso-8859-1").first()["content"] == "été"
    p = loaders.split_pages(spark.createDataFrame([("one\f \ftwo",)], "content string"))
    assert sorted(rows(p, "page_number", "total_pages", "content")) == [(1, 2, "one"), (2, 2, "two")]
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            loaders.load_pdf(spark, str(tmp_path))


def test_html(spark):
    h = '<html><head><title>T  x</title><meta name="description" content="D"></head><body><nav>no</nav><h1>H</h1><p>A &amp; b</p><img alt="pic"><script>x<y</script><div id="m">in</div></body></html>'
    d = spark.createDataFrame([(h,)], "html string")
    r = loaders.extract_html(d, include_image_alt=True).first()
    assert (r["title"], r["content"], r["description"]) == ("T x", "H A & b in pic", "D")
    assert loaders.extract_html(d, "#m").first()["content"] == "in"
    assert d.select(loaders.html_text(F.col("html"))).first()[0] == "H A & b in"


def test_pipelines(spark):
    store = lambda: TableStore(spark.createDataFrame([], "id string, document_id string, content string, chunk_index int, embedding array<double>"), 64)
    docs = spark.createDataFrame([("1", "Spark is an engine for data."), ("2", "Cats sleep a lot."), ("3", "Rain falls in spring.")], "id string, content string")
    q = spark.createDataFrame([(1, "engine for data"), (2, "when do cats sleep")], "query_id int, query string")
    seen = pl.CollectingMonitor()
    p = pl.simple_rag(ExtractiveLLM(), HashingEmbedding(64), store())
    p.monitor = seen
    p.ingest(docs)
    got = {r["query_id"]: r["answer"] for r in p.query(q).collect()}
    assert "engine" in got[1] and "Cats" in got[2]
    assert {"chunk", "embed", "retrieve", "generate"} <= {s["stage"] for s in seen.stages} and seen.reports
    assert "engine" in "".join(p.query_stream(spark, "engine for data"))
    a = pl.advanced_rag(ExtractiveLLM(), HashingEmbedding(64), store(), rewrite=True, threshold=0.1, max_tokens=2000)
    a.ingest(docs)
    assert {r["query_id"] for r in a.query(q).where("size(sources) > 0").collect()} == {1, 2}
    with pytest.raises(ValueError, match="missing"):
        pl.PipelineBuilder().use(llm=ExtractiveLLM()).build()
    with pytest.raises(ValueError):
        pl.PipelineBuilder().use(nothing=1)
    built = pl.PipelineBuilder().use(llm=ExtractiveLLM(), embedding=HashingEmbedding(64), store=store(), chunk=dx.chunk_fixed_size).use(post_processors=[post.above]).build()
    assert built.post_processors
    ix = pl.IndexingPipeline(store(), dx.chunk_fixed_size, HashingEmbedding(64), clean=dx.clean_documents, dedup=dx.dedup_hash)
    r = ix.index(docs.union(docs.limit(1)).withColumn("ord", F.monotonically_increasing_id())).first()
    assert (r["documents_loaded"], r["documents_after_dedup"], r["chunks_created"], r["chunks_embedded"]) == (4, 3, 3, 3)
    lines = []
    log = pl.Logger("warn", lines.append)
    log.log("info", "no")
    log.log("error", "yes")
    assert lines == ["[error] yes"]


def test_shortest_paths_pass_a_hub(spark, monkeypatch):
    """60 sources and 400 leaves at each of three hubs in a ring; no hop lists leaves by source."""
    r = random.Random(2)
    hubs = ["h0", "h1", "h2"]
    rel = [("h0", "h1"), ("h1", "h2"), ("h2", "m"), ("m", "h0"), ("h0", "h0"), ("h1", "gone")]
    rel += [(f"s{i}", r.choice(hubs)) for i in range(60)] + [(f"t{i}", r.choice(hubs)) for i in range(1200)]
    names = sorted({x for e in rel for x in e} - {"gone"}) + ["alone"]
    pairs = [(f"s{i}", f"t{i}") for i in range(60)] + [("s1", "s2"), ("s1", "h2"), ("h0", "t5"), ("t5", "h0"), ("s3", "s3"), ("alone", "s1"), ("s1", "alone"), ("s1", "gone"), ("gone", "s1"), ("s4", "m")]
    near = {n: sorted({y for e in rel for x, y in (e, e[::-1]) if x == n and y in names}) for n in names}

    def best(s, t, most):
        front, seen = [[s]] if s in near else [], {s}
        for _ in range(most + 1):
            for p in front:
                if p[-1] == t:
                    return p
            new = {}
            for p in sorted(front):
                for y in near[p[-1]]:
                    if y not in seen:
                        new.setdefault(y, [*p, y])
            seen |= set(new)
            front = list(new.values())
        return None

    sizes, cut = [], gx.cut
    monkeypatch.setattr(gx, "cut", lambda df: (sizes.append(df.count()), cut(df))[1])
    ents = spark.createDataFrame([(n,) for n in names], "id string")
    rels = spark.createDataFrame([(*e, "t", {}, i) for i, e in enumerate(rel)], "source string, target string, type string, metadata map<string,string>, ord long")
    for most in (1, 3, 6):
        sizes.clear()
        got = {(x["source_id"], x["target_id"]): x["path"] for x in gx.shortest_paths(spark.createDataFrame(pairs, "source_id string, target_id string"), ents, rels, most).collect()}
        assert got == {p: b for p in pairs if (b := best(*p, most))}
        assert max(sizes) <= 2 * len(rel)


def test_first_chunks_are_made_once(spark):
    from tessera.plans import document_queries as dq

    p = pl.advanced_rag(ExtractiveLLM(), HashingEmbedding(64), dq._empty_store(spark), rewrite=False)
    p.ingest(spark.createDataFrame([(1, "one two. three"), (2, None)], "id long, content string").withColumn("ord", F.col("id")))
    plan = p.store.chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan
    assert {x["document_id"] for x in p.store.chunks.collect()} >= {"1"}


def test_bm25_of_many_passages_at_once(spark, monkeypatch):
    """Words of one passage and of all, chunks that are equal, none dealt out by posting: as scored one by one."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choices(words, range(60, 0, -1), k=n))
    data = [(i, text(r.randint(0, 30))) for i in range(300)]
    data += [(i, data[7][1]) for i in range(300, 340)] + [(340, None)]
    asked = [(i, text(12)) for i in range(30)] + [(30, data[7][1]), (31, "zebra"), (32, None), (33, "w59 w59")]
    d = spark.createDataFrame(data, "id int, content string").repartition(3)
    ix = search.KeywordIndex.build(d)
    monkeypatch.setattr(search, "PAIRS", 7)
    got = ix.search(spark.createDataFrame(asked, "query_id int, query string"), 5)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    tokens = {i: (t or "").split() for i, t in data}
    avg = sum(map(len, tokens.values())) / len(tokens)
    df = {w: sum(w in t for t in tokens.values()) for w in words}
    want = []
    for q, t in asked:
        s = []
        for i, have in tokens.items():
            x = sum(math.log((len(data) - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.split().count(w) * (have.count(w) * 2.5 / (have.count(w) + 1.5 * (0.25 + 0.75 * len(have) / avg))) for w in sorted({*(t or "").split()} & {*have}))
            s += [(-x, i)] if x > 0 else []
        want += [(q, n, i, -x) for n, (x, i) in enumerate(sorted(s)[:5], 1)]
    found = sorted(rows(got, "query_id", "rank", "chunk_id", "score"))
    assert [x[:3] for x in found] == [x[:3] for x in want] and all(math.isclose(x[3], y[3], rel_tol=1e-12) for x, y in zip(found, want))


def test_pipeline_embeds_chunks_once(spark, tmp_path):
    """One search for prompt and sources, and the texts of hits are looked up without a shuffle of all chunks."""
    from tessera.plans import document_queries as dq

    noted = str(tmp_path / "n")

    class Counting(HashingEmbedding):
        def embed_batch(self, texts):
            with open(noted, "a") as f:
                f.write(f"{len(texts)}\n")
            return HashingEmbedding.embed_batch(self, texts)

    e = Counting(64)
    docs = spark.createDataFrame([(str(i), f"Number {i} is here. " * (i % 7 + 1)) for i in range(50)], "id string, content string")
    q = spark.createDataFrame([(1, "number 5"), (2, "here is 17")], "query_id int, query string")
    for make in (pl.simple_rag, pl.advanced_rag):
        (tmp_path / "n").write_text("")
        p = make(ExtractiveLLM(), e, dq._empty_store(spark), chunk_size=40, overlap=5)
        p.ingest(docs)
        got = p.query(q)
        assert len(got.where("size(sources) > 0").collect()) == 2
        given = sum(map(int, (tmp_path / "n").read_text().split()))
        # the two passages may be embedded again, chunks never
        assert p.store.chunks.select("id").count() <= given <= p.store.chunks.select("id").count() + 8
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_nearest_of_a_task(spark):
    """A task hands on each query's k best, however many batches it has; equal vectors by id."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    x = r.normal(size=(500, 8))
    x[100:400:3] = x[5]
    q = pa.table({"query_id": pa.array([1, 2, 3]), "embedding": pa.array([x[5].tolist(), x[6].tolist(), [0.0] * 8])})
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 50)), pa.array(x[i : i + 50].tolist())], ["id", "embedding"]) for i in range(0, 500, 50)]
    got = pa.Table.from_batches(search._nearest(q, 4, 0.0)(iter(batches[::-1]))).to_pydict()
    assert len(got["chunk_id"]) == 12
    assert [c for i, c in zip(got["query_id"], got["chunk_id"]) if i != 2] == [5, 100, 103, 106, 0, 1, 2, 3]
