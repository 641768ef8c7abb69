"""Registered queries: search, fusion, post-processing, stores and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.layout import few, spread
from ..operators import evaluation as ev
from ..operators import generation as gen
from ..operators import post, search
from ..sources.store import TableStore, sync_changes, sync_report

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K = 5
#: Tables whose rows are work enough to spread over the cores.
TEXTS = ("documents", "conversations", "pages")
DIGITS = 6


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword_hits(spark: SparkSession, sf_dir: str, k: int = K, b: float = 0.75) -> DataFrame:
    index = search.KeywordIndex.build(chunks_of(spark, sf_dir)).cached()
    return index.search(questions(spark, sf_dir), k, b=b, digits=DIGITS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def vector_questions(v: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def bm25_sql(k: int = K, b: float = 0.75, name: str = "hits", queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark") -> str:
    """CTEs that end in `name` (query_id, chunk_id, score, rank)."""
    n = name
    return rf"""
    {n}_t AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS term FROM documents),
    {n}_p AS (SELECT term, chunk_id, count(*) AS tf FROM {n}_t GROUP BY ALL),
    {n}_l AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS dl FROM documents),
    {n}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {n}_l),
    {n}_d AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY term),
    {n}_q AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS term FROM ({queries})),
    {n}_c AS (
        SELECT query_id, p.chunk_id,
               round(sum(ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * (p.tf * 2.5) / (p.tf + 1.5 * (1 - {b} + {b} * l.dl / s.avgdl))), 6) AS score
        FROM {n}_q q JOIN {n}_p p USING (term) JOIN {n}_d d USING (term) JOIN {n}_l l ON l.chunk_id = p.chunk_id, {n}_s s
        GROUP BY query_id, p.chunk_id
    ),
    {n} AS (
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank
        FROM {n}_c WHERE score > 0 QUALIFY rank <= {k}
    )"""


def cosine_sql(k: int, extra: str = "", score: str = "s", name: str = "vhits", queries: str = "vec_id % 50 = 0", rows: str = "true") -> str:
    return f"""
    {name}_s AS (
        SELECT q.vec_id AS query_id, e.vec_id AS chunk_id,
               list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])
                 / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))) AS s
        FROM embeddings q, embeddings e WHERE q.{queries} AND ({rows})
    ),
    {name} AS (
        SELECT query_id, chunk_id, round({score}, 6) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, chunk_id)::INTEGER AS rank
        FROM {name}_s WHERE round({score}, 6) >= 0 {extra} QUALIFY rank <= {k}
    )"""


HITS = ["query_id", "chunk_id", "score", "rank"]


@query("WITH " + bm25_sql() + " SELECT query_id, chunk_id, score, rank FROM hits")
def keyword_search_bm25(spark, sf_dir):
    """BM25 over all documents for every benchmark passage."""
    return keyword_hits(spark, sf_dir).select(*HITS)


@query("WITH " + cosine_sql(5) + " SELECT * FROM vhits")
def vector_search_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.vector_search(vector_questions(v), v, K, digits=DIGITS).select(*HITS)


@query("WITH " + cosine_sql(5, rows="e.label = 3") + " SELECT * FROM vhits")
def vector_search_filter(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.vector_search(vector_questions(v), v.where(F.col("label") == 3), K, digits=DIGITS).select(*HITS)


@query("WITH " + cosine_sql(5, "AND round(s, 6) >= 0.3") + " SELECT * FROM vhits")
def vector_search_threshold(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.vector_search(vector_questions(v), v, K, 0.3, digits=DIGITS).select(*HITS)


@query("WITH " + cosine_sql(5, score="1.0 / (2.0 - s)") + " SELECT * FROM vhits")
def score_mode_inverse_distance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.vector_search(vector_questions(v), v, K, 0.0, "inverse_distance", DIGITS).select(*HITS)


# --- stores -----------------------------------------------------------------------------------


@query(
    """WITH new AS (SELECT vec_id // 2 AS id, label + 100 AS label, vec_id AS ord FROM embeddings),
    last AS (SELECT id, label FROM new QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1)
    SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM last) UNION ALL SELECT id, label FROM last"""
)
def store_upsert_last_wins(spark, sf_dir):
    v = vectors(spark, sf_dir)
    new = v.select(F.floor(F.col("id") / 2).alias("id"), (F.col("label") + 100).alias("label"), F.col("id").alias("ord"))
    return TableStore(v.select("id", "label")).upsert(new, "ord").chunks.select("id", "label")


@query("SELECT vec_id AS id, label AS document_id FROM embeddings WHERE label NOT IN (1, 2)")
def store_delete_by_document(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.col("label").alias("document_id"))
    gone = spark.createDataFrame([(1,), (2,)], "document_id int")
    return TableStore(v).delete_by_document(gone).chunks.select("id", "document_id")


def _snapshots(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    current = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    # the state before has every document: some with another text, some under a number that is gone
    old = F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    return current, d.select(old.alias("document_id"), tx.content_hash(text).alias("hash"))


_SYNC = r"""WITH now AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))) AS hash FROM documents),
    old AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, sha256(trim(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END, '[ \t\n\r\f\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g'))) AS hash FROM documents),
    c AS (SELECT coalesce(now.doc_id, old.doc_id) AS document_id, now.hash,
        CASE WHEN old.doc_id IS NULL THEN 'added' WHEN now.doc_id IS NULL THEN 'deleted' WHEN now.hash = old.hash THEN 'unchanged' ELSE 'updated' END AS status
        FROM now FULL JOIN old USING (doc_id))"""


@query(_SYNC + " SELECT document_id, hash, status FROM c")
def index_sync_changes(spark, sf_dir):
    return sync_changes(*_snapshots(spark, sf_dir))


@query(
    _SYNC
    + " SELECT count_if(status = 'added')::BIGINT AS added, count_if(status = 'updated')::BIGINT AS updated, count_if(status = 'deleted')::BIGINT AS deleted, count_if(status = 'unchanged')::BIGINT AS unchanged FROM c"
)
def index_sync_report(spark, sf_dir):
    return sync_report(sync_changes(*_snapshots(spark, sf_dir)))


# --- fusion and structure -----------------------------------------------------------------------

_ARMS = "WITH " + bm25_sql(10) + "," + bm25_sql(10, 0.0, "flat")


def _arms(spark, sf_dir):
    index = search.KeywordIndex.build(chunks_of(spark, sf_dir)).cached()
    hits = index.search_arms(questions(spark, sf_dir), (0.75, 0.0), 2 * K, digits=DIGITS).persist()
    return tuple(hits.where(F.col("arm") == i).drop("arm") for i in (0, 1))


def _scaled(name: str, weight: float) -> str:
    return f"""SELECT query_id, chunk_id, {weight} * CASE WHEN count(*) OVER w = 1 THEN 1.0 WHEN max(score) OVER w = min(score) OVER w THEN 0.5
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM {name} WINDOW w AS (PARTITION BY query_id)"""


_RANK = "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank"


def _rounded(df: DataFrame, k: int) -> DataFrame:
    return search.top_k(df.withColumn("score", F.round("score", DIGITS)).drop("rank"), k).select(*HITS)


@query(
    _ARMS
    + f", u AS ({_scaled('hits', 0.6)} UNION ALL {_scaled('flat', 0.4)}), g AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM u GROUP BY ALL) {_RANK} FROM g QUALIFY rank <= 5"
)
def fusion_minmax(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return _rounded(search.fuse(a, b, 4 * K, 0.6, 0.4), K)


@query(
    _ARMS
    + f", u AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS score FROM hits UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank) FROM flat), g AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM u GROUP BY ALL) {_RANK} FROM g QUALIFY rank <= 5"
)
def rrf_fuse(spark, sf_dir):
    return _rounded(search.rrf([*_arms(spark, sf_dir)], 4 * K), K)


@query(
    "WITH "
    + cosine_sql(10)
    + """, h AS (SELECT v.*, CASE WHEN v.chunk_id % 3 > 0 THEN 1000000 + label END AS parent_id, label FROM vhits v JOIN embeddings e ON e.vec_id = v.chunk_id),
    k AS (SELECT query_id, coalesce(parent_id, chunk_id) AS chunk_id, arg_min(score, rank) AS score, min(rank) AS r FROM h WHERE parent_id IS NULL OR label < 8 GROUP BY query_id, coalesce(parent_id, chunk_id))
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r)::INTEGER AS rank FROM k"""
)
def small_to_big(spark, sf_dir):
    """Vectors as children of their label's parent; labels from 8 on have no registered parent."""
    v = vectors(spark, sf_dir)
    c = v.select("id", F.when(F.col("id") % 3 > 0, F.col("label").cast("long") + 1_000_000).alias("parent_id"), "label")
    parents = c.where("label < 8").select(F.col("label").cast("long").alias("id")).distinct().select((F.col("id") + 1_000_000).alias("id"))
    hits = search.vector_search(vector_questions(v), v, 10, digits=DIGITS)
    return search.small_to_big(hits, c.select("id", "parent_id"), parents).select(*HITS)


@query(
    "WITH "
    + cosine_sql(3, name="top", rows="e.vec_id % 10 = 0")
    + ","
    + cosine_sql(9, name="low", rows="e.vec_id % 10 != 0")
    + """, d AS (SELECT DISTINCT query_id, label FROM top JOIN embeddings e ON e.vec_id = chunk_id),
    h AS (SELECT low.query_id, chunk_id, score, e.label FROM low JOIN embeddings e ON e.vec_id = chunk_id JOIN d ON d.query_id = low.query_id AND d.label = e.label),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, chunk_id) <= 3)
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM b QUALIFY rank <= 5"""
)
def hierarchical_search(spark, sf_dir):
    """Every tenth vector is its label's summary, the others are details."""
    v = vectors(spark, sf_dir).withColumn("document_id", F.col("label"))
    q = vector_questions(v)
    return search.hierarchical(q, v.where("id % 10 = 0"), v.where("id % 10 != 0"), digits=DIGITS).select(*HITS)


# --- post-processing ----------------------------------------------------------------------------


@query("WITH " + bm25_sql() + f" {_RANK} FROM hits WHERE score >= 20.0 QUALIFY rank <= 3")
def post_threshold(spark, sf_dir):
    return post.above(keyword_hits(spark, sf_dir), 20.0, 3).select(*HITS)


def hits_with_text(spark, sf_dir, k: int = K) -> DataFrame:
    h = keyword_hits(spark, sf_dir, k)
    h = h.join(chunks_of(spark, sf_dir).select(F.col("id").alias("chunk_id"), "content", F.col("source").alias("document_id")), "chunk_id")
    q = questions(spark, sf_dir)
    return h.join(few(q, 100_000)(q), "query_id")


_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9一-鿿]+')"
_JACCARD = (
    "coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)".format(
        a=_TOKENS.format("b.text"), b=_TOKENS.format("d.text")
    )
)


@query(
    "WITH "
    + bm25_sql(10)
    + f", r AS (SELECT query_id, chunk_id, h.score AS original_score, round({_JACCARD}, 6) AS score FROM hits h JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id)"
    + " SELECT query_id, chunk_id, original_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM r QUALIFY rank <= 5"
)
def post_rerank(spark, sf_dir):
    scorer = lambda q, c: F.round(ev.jaccard(tx.ascii_tokens(q), tx.ascii_tokens(c)), DIGITS)
    return post.rerank(hits_with_text(spark, sf_dir, 10), scorer).select("query_id", "chunk_id", "original_score", "score", "rank")


@query(
    "WITH "
    + bm25_sql()
    + """, c AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    n AS (SELECT h.query_id, h.chunk_id, string_agg(b.text, chr(10) ORDER BY b.i) AS content, count(*) AS enriched_from
          FROM hits h JOIN c a ON a.doc_id = h.chunk_id JOIN c b ON b.source = a.source AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY ALL)
    SELECT query_id, chunk_id, md5(content) AS content_md5, enriched_from::INTEGER AS enriched_from FROM n"""
)
def context_enrich(spark, sf_dir):
    """Hits with their neighbours in the source, which plays the document."""
    c = chunks_of(spark, sf_dir)
    c = c.withColumn("chunk_index", F.row_number().over(W.partitionBy("source").orderBy("id"))).withColumnRenamed("source", "document_id")
    out = post.enrich_context(keyword_hits(spark, sf_dir), c)
    return out.select("query_id", "chunk_id", F.md5("content").alias("content_md5"), "enriched_from")


_COUNT = "(len(regexp_extract_all({0}, '[一-鿿가-힯぀-ゟ゠-ヿ]')) + ceil((length({0}) - len(regexp_extract_all({0}, '[一-鿿가-힯぀-ゟ゠-ヿ]'))) / 4.0))::INTEGER"


@query(
    "WITH "
    + bm25_sql()
    + f", t AS (SELECT query_id, chunk_id, rank, {_COUNT.format('d.text')} AS tokens FROM hits JOIN documents d ON d.doc_id = chunk_id), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used_tokens FROM t) SELECT * FROM u WHERE used_tokens <= 3500"
)
def token_budget_truncate(spark, sf_dir):
    out = post.truncate_context(hits_with_text(spark, sf_dir), 4100, 100, 500)
    return out.select("query_id", "chunk_id", "rank", "tokens", "used_tokens")


_SUBS = "SELECT item_id * 2 AS query_id, text AS query FROM benchmark UNION ALL SELECT item_id * 2 + 1, substr(text, 1, length(text) // 2) FROM benchmark"


@query(
    "WITH "
    + bm25_sql(queries=_SUBS)
    + """, s AS (SELECT query_id // 2 AS query_id, query_id % 2 AS sub_index, chunk_id, rank FROM hits),
    f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub_index, rank) = 1)
    SELECT query_id, chunk_id, sub_index::INTEGER AS sub_index, row_number() OVER (PARTITION BY query_id ORDER BY sub_index, rank)::INTEGER AS rank FROM f"""
)
def multi_query_merge(spark, sf_dir):
    """Each passage and its first half as two sub-queries."""
    q = questions(spark, sf_dir)
    half = q.select((F.col("query_id") * 2 + 1).alias("query_id"), F.substr("query", F.lit(1), F.floor(F.length("query") / 2).cast("int")).alias("query"))
    both = q.withColumn("query_id", F.col("query_id") * 2).unionByName(half)
    hits = search.KeywordIndex.build(chunks_of(spark, sf_dir)).cached().search(both, K, digits=DIGITS)
    hits = hits.withColumn("sub_index", (F.col("query_id") % 2).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 2))
    return post.merge_subqueries(hits).select("query_id", "chunk_id", "sub_index", "rank")


@query(
    "SELECT item_id AS query_id, CASE WHEN length(text) > 300 THEN 'long' WHEN regexp_matches(text, '[0-9]') THEN 'number' ELSE 'plain' END AS route FROM benchmark"
)
def route_queries(spark, sf_dir):
    rules = [("long", F.length("query") > 300), ("number", F.rlike("query", F.lit("[0-9]")))]
    return search.route(questions(spark, sf_dir), rules, "plain").select("query_id", "route")


@query("SELECT item_id AS query_id, (i - 1)::INTEGER AS sub_index, trim(s[i]) AS query FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), '. ') AS s FROM benchmark), unnest(range(1, 4)) t(i) WHERE i <= len(s) AND length(trim(s[i])) > 0")
def query_decompose(spark, sf_dir):
    """Sub-questions as a provider lists them: its numbered lines, three at most."""
    from ..operators.providers import ScriptedLLM

    llm = ScriptedLLM([("", lambda p: "\n".join(f"{i}. {s}" for i, s in enumerate(p.split("：\n", 1)[1].replace("\n", " ").split(". ")[:3], 1)))])
    return search.expand_queries(questions(spark, sf_dir), llm, "decompose", 3).select("query_id", "sub_index", "query")


# --- retrieval metrics ---------------------------------------------------------------------------

_QRELS = "truth AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"
_EVAL = (
    "WITH "
    + bm25_sql()
    + ", "
    + _QRELS
    + """, n AS (SELECT query_id, count(*) AS n_true FROM truth GROUP BY query_id),
    j AS (SELECT h.query_id, h.chunk_id, h.rank, (t.chunk_id IS NOT NULL)::INTEGER AS hit FROM hits h LEFT JOIN truth t ON t.query_id = h.query_id AND t.chunk_id = h.chunk_id),
    m AS (SELECT b.item_id AS query_id, coalesce(max(n_true), 0) AS n_true, coalesce(sum(hit) FILTER (rank <= 10), 0) AS hits, min(rank) FILTER (hit = 1) AS first
          FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id LEFT JOIN j ON j.query_id = b.item_id GROUP BY b.item_id)"""
)


def qrels(spark, sf_dir) -> DataFrame:
    """Documents that hold a passage: the stated passages, a table of fixed meaning, meet all texts."""
    d = chunks_of(spark, sf_dir).select(F.col("id").alias("chunk_id"), "content")
    q = questions(spark, sf_dir)
    return d.join(few(q, 100_000)(q), F.contains("content", "query")).select("query_id", "chunk_id")


def _metrics(spark, sf_dir, k: int = 10) -> DataFrame:
    return ev.retrieval_metrics(questions(spark, sf_dir), keyword_hits(spark, sf_dir), qrels(spark, sf_dir), k)


@query(_EVAL + " SELECT query_id, round(coalesce(hits / nullif(n_true, 0), 0.0), 6) AS score FROM m")
def eval_recall(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", F.round("recall", DIGITS).alias("score"))


@query(_EVAL + " SELECT query_id, round(hits / 10.0, 6)::DOUBLE AS score FROM m")
def eval_precision(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", F.round("precision", DIGITS).alias("score"))


@query(_EVAL + " SELECT query_id, round(coalesce(1.0 / first, 0.0), 6)::DOUBLE AS score FROM m")
def eval_mrr(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", F.round("reciprocal_rank", DIGITS).cast("double").alias("score"))


@query(
    _EVAL
    + """, f AS (SELECT coalesce(h.query_id, t.query_id) AS query_id, coalesce(h.chunk_id, t.chunk_id) AS chunk_id, h.rank, (t.chunk_id IS NOT NULL)::DOUBLE AS rel FROM hits h FULL JOIN truth t ON t.query_id = h.query_id AND t.chunk_id = h.chunk_id),
    i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, chunk_id) AS i FROM f),
    g AS (SELECT query_id, coalesce(sum(rel / log2(rank + 1)), 0) AS dcg, coalesce(sum(rel / log2(i + 1)) FILTER (i <= 10), 0) AS idcg FROM i GROUP BY query_id)
    SELECT b.item_id AS query_id, round(coalesce(dcg / nullif(idcg, 0), 0.0), 6) AS score FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id"""
)
def eval_ndcg(spark, sf_dir):
    n = ev.ndcg(questions(spark, sf_dir), keyword_hits(spark, sf_dir), qrels(spark, sf_dir))
    return n.select("query_id", F.round("ndcg", DIGITS).alias("score"))


_STATS = (
    _EVAL
    + """, l AS (SELECT query_id, 'recall@10' AS name, coalesce(hits / nullif(n_true, 0), 0.0)::DOUBLE AS score FROM m UNION ALL SELECT query_id, 'precision@10', hits / 10.0 FROM m
         UNION ALL SELECT query_id, 'reciprocal_rank@10', coalesce(1.0 / first, 0.0) FROM m),
    st AS (SELECT name, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS mn, max(score) AS mx, count(*) AS samples FROM l GROUP BY name)"""
)


def _stats(spark, sf_dir) -> DataFrame:
    return ev.metric_stats(ev.long_form(_metrics(spark, sf_dir), ["recall", "precision", "reciprocal_rank"], "@10"))


@query(_STATS + " SELECT name, round(mean, 6) AS mean, round(std, 6) AS std, round(mn, 6) AS min, round(mx, 6) AS max, samples FROM st")
def benchmark_stats(spark, sf_dir):
    return _stats(spark, sf_dir).select("name", *[F.round(c, DIGITS).alias(c) for c in ("mean", "std", "min", "max")], "samples")


def _advice_sql(names: tuple[str, ...]) -> str:
    rules = [(least, text) for part, name, least, text in ev.ADVICE if part == "retrieval" and name in names]
    cases = ", ".join(f"CASE WHEN (SELECT mean FROM st WHERE name = '{n}@10') < {least} THEN '{text}' END" for n, (least, text) in zip(names, rules))
    return f"coalesce(nullif(array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '|'), ''), '{ev.NO_ADVICE}')"


@query(
    _STATS
    + f""" SELECT round(avg(mean), 6) AS overall, CASE WHEN avg(mean) >= 0.9 THEN '优秀' WHEN avg(mean) >= 0.75 THEN '良好' WHEN avg(mean) >= 0.6 THEN '及格' ELSE '需改进' END AS verdict,
    max(samples)::BIGINT AS samples, {_advice_sql(('recall', 'precision'))} AS recommendations FROM st"""
)
def eval_report(spark, sf_dir):
    r = ev.evaluation_report(_stats(spark, sf_dir))
    return r.select(F.round("overall", DIGITS).alias("overall"), "verdict", "samples", F.array_join("recommendations", "|").alias("recommendations"))


@query(
    "WITH "
    + bm25_sql()
    + f""", r AS (SELECT query_id, rank, {_JACCARD} >= 0.1 AS relevant FROM hits JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id),
    p AS (SELECT *, CASE WHEN relevant THEN sum(relevant::INTEGER) OVER w::DOUBLE / count(*) OVER w END AS p FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank))
    SELECT query_id, round(coalesce(avg(p), 0.0), 6) AS score, sum(relevant::INTEGER)::BIGINT AS relevant_count FROM p GROUP BY query_id"""
)
def eval_context_relevance_jaccard(spark, sf_dir):
    out = ev.context_relevance(hits_with_text(spark, sf_dir))
    return out.select("query_id", F.round("score", DIGITS).alias("score"), "relevant_count")


# --- prompts --------------------------------------------------------------------------------------


@query(
    "WITH "
    + bm25_sql()
    + """, t AS (SELECT query_id, rank, '[' || rank || '] ' || d.text AS t, length('[' || rank || '] ') AS p FROM hits JOIN documents d ON d.doc_id = chunk_id),
    u AS (SELECT *, sum(length(t)) OVER (PARTITION BY query_id ORDER BY rank) AS e FROM t),
    v AS (SELECT *, min(rank) FILTER (e > 3000) OVER (PARTITION BY query_id) AS f FROM u),
    x AS (SELECT query_id, rank, CASE WHEN e <= 3000 THEN t WHEN rank = f AND 3000 - (e - length(t)) > p THEN substr(t, 1, (3000 - (e - length(t)))::BIGINT) || '...' END AS x FROM v)
    SELECT query_id, md5(coalesce(string_agg(x, chr(10) || chr(10) ORDER BY rank), '')) AS context_md5, count(*) AS source_count FROM x GROUP BY query_id"""
)
def prompt_context_build(spark, sf_dir):
    out = gen.build_context(hits_with_text(spark, sf_dir), 3000)
    return out.select("query_id", F.md5("context").alias("context_md5"), "source_count")


@query(
    "WITH p AS (SELECT vec_id AS a, lead(vec_id) OVER (ORDER BY vec_id) AS b FROM embeddings) SELECT a.vec_id AS vec_id, round(greatest(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 0.0), 6) AS score FROM p JOIN embeddings a ON a.vec_id = p.a JOIN embeddings b ON b.vec_id = p.b"
)
def eval_semantic_similarity(spark, sf_dir):
    """Each vector against the next one."""
    v = vectors(spark, sf_dir)
    ids = v.select("id", F.lead("id").over(W.orderBy("id")).alias("next")).where("next is not null")
    d = ids.join(v.select("id", "embedding"), "id").join(v.select(F.col("id").alias("next"), F.col("embedding").alias("other")), "next")
    return d.select(F.col("id").alias("vec_id"), F.round(ev.semantic_similarity(F.col("embedding"), F.col("other")), DIGITS).alias("score"))


@query(
    """WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS g,
        least(greatest(0.4 * (event_type = 'purchase')::INTEGER - 0.3 * (event_type = 'error')::INTEGER + 0.15 * (event_type = 'click')::INTEGER + 0.15 * coalesce(value > 30, false)::INTEGER, 0), 1)::DOUBLE AS s FROM events),
    a AS (SELECT count(s) FILTER (g = 'A') AS n_a, avg(s) FILTER (g = 'A') AS mean_a, var_samp(s) FILTER (g = 'A') AS var_a,
                 count(s) FILTER (g = 'B') AS n_b, avg(s) FILTER (g = 'B') AS mean_b, var_samp(s) FILTER (g = 'B') AS var_b FROM e),
    z AS (SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS z FROM a),
    t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM z),
    p AS (SELECT *, (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z) AS p FROM t)
    SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(z, 6) AS z, round(p, 6) AS p_value, p < 0.05 AS significant,
           CASE WHEN p >= 0.05 THEN 'tie' WHEN mean_a > mean_b THEN 'A' ELSE 'B' END AS winner FROM p"""
)
def ab_test(spark, sf_dir):
    """Groups by user; purchases as thumbs up, clicks as source clicks, errors as follow-ups, value as seconds."""
    r = ev.ab_test(ab_events(read(spark, sf_dir, "events")))
    r = r.withColumn("p_value", F.round("p_value", DIGITS))
    return r.select("n_a", "n_b", *[F.round(c, DIGITS).alias(c) for c in ("mean_a", "mean_b", "z")], "p_value", "significant", "winner")


def ab_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    s = ev.satisfaction(kind == "purchase", kind == "error", kind == "click", F.col("value"))
    return events.select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("group"), s.alias("satisfaction"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(
    f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN length(a.vec_id::VARCHAR) >= length(b.vec_id::VARCHAR) THEN b.vec_id ELSE a.vec_id END AS loser
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.9),
    g AS (SELECT list_reduce(list([a, b, loser] ORDER BY a, b), lambda gone, x: CASE WHEN list_contains(gone, x[1]) OR list_contains(gone, x[2]) THEN gone ELSE list_append(gone, x[3]) END, []::BIGINT[]) AS gone FROM p)
    SELECT vec_id AS id, label FROM embeddings, g WHERE NOT list_contains(coalesce(gone, []::BIGINT[]), vec_id)"""
)
def dedup_embedding_vectors(spark, sf_dir):
    """Greedy near-dedup of the vectors of each label."""
    from ..operators.documents import dedup_embedding

    v = vectors(spark, sf_dir).withColumn("content", F.col("id").cast("string"))
    return dedup_embedding(v, 0.9, block="label", order="id").select("id", "label")


@query(
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) >= 0.9"
)
def similar_vector_pairs(spark, sf_dir):
    from ..operators.documents import similar_pairs

    return similar_pairs(vectors(spark, sf_dir), 0.9, block="label", order="id").select("a", "b", F.round("cosine", DIGITS).alias("cosine"))


