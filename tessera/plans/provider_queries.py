"""Registered queries of operators that ask a provider, with fixed rules in its place, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import generation as gen
from ..operators import graph as gx
from ..operators import post, search
from ..operators.providers import ScriptedLLM
from .document_queries import _GRAPH, _S, graph_of
from .retrieval_queries import HITS, K, bm25_sql, hits_with_text, keyword_hits, questions, vector_questions, vectors, cosine_sql, DIGITS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _body(prompt: str) -> str:
    return prompt.split("：\n", 1)[1]


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


@query(f"SELECT item_id AS query_id, {_trim(chr(39) + 'about ' + chr(39) + ' || text')} AS query FROM benchmark")
def query_rewrite(spark, sf_dir):
    llm = ScriptedLLM([("", lambda p: f" about {_body(p)} ")])
    return search.rewrite_queries(questions(spark, sf_dir), llm).select("query_id", "query")


@query("SELECT item_id AS query_id, CASE WHEN length(text) % 2 = 0 THEN 'made up' ELSE text END AS query FROM benchmark")
def query_hyde(spark, sf_dir):
    """A provider that fails for texts of odd length, which then stay."""

    def answer(p: str) -> str:
        if len(_body(p)) % 2:
            raise RuntimeError("no answer")
        return "made up"

    return search.rewrite_queries(questions(spark, sf_dir), ScriptedLLM([("", answer)]), "hyde").select("query_id", "query")


@query("SELECT item_id AS query_id, i::INTEGER AS sub_index, text || CASE i WHEN 0 THEN '' ELSE ' ' || i END AS query FROM benchmark, unnest(range(0, 3)) t(i)")
def query_multi_expand(spark, sf_dir):
    """Paraphrases as fenced JSON; more than asked for are dropped."""
    llm = ScriptedLLM([("", lambda p: "```json\n" + json.dumps([_body(p), *[f"{_body(p)} {i}" for i in range(1, 6)]]) + "\n```")])
    return search.expand_queries(questions(spark, sf_dir), llm, "multi", 3).select("query_id", "sub_index", "query")


@query("SELECT item_id AS query_id, CASE WHEN contains(text, 'the') THEN 'english' ELSE 'other' END AS route FROM benchmark")
def route_by_provider(spark, sf_dir):
    llm = ScriptedLLM([("", lambda p: "Yes." if "the" in p.split("\n", 1)[1].rsplit("\n", 1)[0] else "No.")])
    return search.route(questions(spark, sf_dir), [("english", search.llm_rule(llm, "?"))], "other").select("query_id", "route")


@query("WITH " + cosine_sql(5) + " SELECT * FROM vhits")
def score_mode_one_minus_distance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.vector_search(vector_questions(v), v, K, 0.0, "one_minus_distance", DIGITS).select(*HITS)


_HIT_TEXT = "WITH " + bm25_sql() + ", h AS (SELECT query_id, chunk_id, rank, d.text FROM hits JOIN documents d ON d.doc_id = chunk_id)"


@query(
    _HIT_TEXT
    + r", s AS (SELECT *, list_filter(string_split(regexp_replace(text, '([。！？.!?\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: length("
    + _trim("x")
    + ") > 0) AS s FROM h) SELECT query_id, chunk_id, rank, md5(CASE WHEN len(s) <= 1 THEN text ELSE array_to_string(list_transform(list_filter(s, lambda x, i: i % 2 = 1), lambda x: "
    + _trim("x")
    + "), ' ') END) AS content_md5 FROM s"
)
def post_selective_context(spark, sf_dir):
    """A provider that names every other sentence."""
    llm = ScriptedLLM([("", lambda p: json.dumps(list(range(0, p.count("\n["), 2))))])
    return post.select_sentences(hits_with_text(spark, sf_dir), llm).select("query_id", "chunk_id", "rank", F.md5("content").alias("content_md5"))


@query(_HIT_TEXT + f" SELECT query_id, chunk_id, length(text)::INTEGER AS original_length, length({_trim('substr(text, 1, 60)')})::INTEGER AS compressed_length, {_trim('substr(text, 1, 60)')} AS content FROM h")
def post_compression(spark, sf_dir):
    """A provider that returns the first 60 characters."""
    rows = hits_with_text(spark, sf_dir).withColumn("query", F.lit("q"))
    llm = ScriptedLLM([("", lambda p: p.split("问题：q\n", 1)[1][:60])])
    return post.compress(rows, llm).select("query_id", "chunk_id", "original_length", "compressed_length", "content")


_PROMPT = (
    _HIT_TEXT
    + ", c AS (SELECT query_id, count(*) AS n, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS c FROM h GROUP BY query_id),"
    + " p AS (SELECT item_id AS query_id, text AS query, coalesce(n, 0) AS n, '参考资料（共 ' || coalesce(n, 0) || ' 条）：' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || '用户问题：' || text AS u FROM benchmark LEFT JOIN c ON c.query_id = item_id)"
)


@query(_PROMPT + " SELECT query_id, n AS source_count, md5(u || chr(10) || chr(10) || '请在答案中使用 [1]、[2] 等标记标注引用来源。') AS user_md5 FROM p")
def prompt_messages(spark, sf_dir):
    p = gen.prompts(questions(spark, sf_dir), hits_with_text(spark, sf_dir), "citation")
    return p.select("query_id", "source_count", F.md5(F.element_at("messages", 2)["content"]).alias("user_md5"))


@query(_PROMPT + f" SELECT query_id, CASE WHEN n = 0 THEN '{gen.NO_SOURCES}' ELSE 'answer ' || length(u) END AS answer, n::INTEGER AS n_sources FROM p")
def generate_answers(spark, sf_dir):
    """A provider that tells the prompt's length."""
    out = gen.generate(questions(spark, sf_dir), hits_with_text(spark, sf_dir), ScriptedLLM([("", lambda p: f"answer {len(p)}\n")]))
    return out.select("query_id", "answer", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))


@query("SELECT item_id AS query_id, length(text) % 2 = 0 AS grounded, CASE WHEN length(text) % 2 = 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS score FROM benchmark")
def generate_grounded(spark, sf_dir):
    """Verdicts readable for questions of even length only."""
    q = questions(spark, sf_dir)
    verdict = '{"isGrounded": true, "unsupportedClaims": [], "groundingScore": 0.75}'
    llm = ScriptedLLM([("^请检查", lambda p: verdict if p.endswith("even") else "?"), ("", lambda p: "odd" if len(p.rpartition("用户问题：")[2]) % 2 else "even")])
    out = gen.grounded(q, hits_with_text(spark, sf_dir), llm)
    return out.select("query_id", F.col("verification.isGrounded").alias("grounded"), F.col("verification.groundingScore").alias("score"))


@query("SELECT item_id AS query_id, 'b' AS answer, 2::BIGINT AS votes, 3::BIGINT AS rounds FROM benchmark")
def consistency_check(spark, sf_dir):
    """Three rounds of which the last two agree."""
    llm = ScriptedLLM([("第 1 次", "a"), ("", "b")])
    return gen.consistent(questions(spark, sf_dir), hits_with_text(spark, sf_dir), llm).select("query_id", "answer", "votes", "rounds")


@query("WITH " + bm25_sql() + ", n AS (SELECT query_id, count(*) AS n FROM hits GROUP BY query_id) SELECT item_id AS query_id, CASE WHEN coalesce(n, 0) >= 2 THEN '1,2' WHEN n = 1 THEN '1' ELSE '' END AS cited FROM benchmark LEFT JOIN n ON n.query_id = item_id")
def generate_with_citations(spark, sf_dir):
    q, r = questions(spark, sf_dir), hits_with_text(spark, sf_dir)
    answers = gen.generate(q, r, ScriptedLLM([("", "so [2] and [1], not [77]")]), "citation", None, False)
    return gen.parse_citations(answers, r).select("query_id", F.array_join("cited", ",").alias("cited"))


@query("WITH " + _GRAPH + " SELECT (SELECT count(*) FROM e) AS entity_count, (SELECT count(*) FROM (SELECT DISTINCT source, target, type FROM r)) AS relation_count")
def graph_stats(spark, sf_dir):
    return gx.GraphStore(*graph_of(spark, sf_dir)).stats()


@query("WITH " + _GRAPH + " SELECT id, name, type FROM e WHERE id = 'n:3'")
def graph_get_entity(spark, sf_dir):
    return gx.GraphStore(*graph_of(spark, sf_dir)).entity("n:3").select("id", "name", "type")


@query(_HIT_TEXT + " SELECT query_id, count(*) AS n FROM h GROUP BY query_id")
def route_and_retrieve(spark, sf_dir):
    """Routed queries to their retrievers; here both are the same search."""
    q = search.route(questions(spark, sf_dir), [("long", F.length("query") > 300)])
    hits = keyword_hits(spark, sf_dir)

    def retrieve(own: DataFrame) -> DataFrame:
        return hits.join(own.select("query_id"), "query_id", "left_semi")

    return search.routed(q, {"long": retrieve, "default": retrieve}).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
