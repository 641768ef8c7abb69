"""Registered queries: documents, loaders, chunks, generation and graph, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import documents as dx
from ..operators import evaluation as ev
from ..operators import generation as gen
from ..operators import graph as gx
from ..operators.providers import ExtractiveLLM, HashingEmbedding, ScriptedLLM, merge_roles
from ..sources import loaders
from ..sources.store import TableStore
from ..streaming import streams
from . import pipeline as pl
from .retrieval_queries import DIGITS, ab_events, bm25_sql, questions, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", F.col("doc_id").alias("ord"))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared place the session names, or a temporary one where it names none."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# --- cleaning and metadata -----------------------------------------------------------------------

_S = r"[ \t\n\r\f\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_HTML = "replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"


@query("SELECT page_id, md5(" + _HTML.format("html") + ") AS content_md5 FROM pages")
def clean_strip_html(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("content", F.col("html"))
    return dx.clean_documents(p, whitespace=False, stamp=False).select("page_id", F.md5("content").alias("content_md5"))


@query("SELECT doc_id AS id, " + _trim(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS content FROM documents")
def clean_whitespace(spark, sf_dir):
    return dx.clean_documents(docs_of(spark, sf_dir), html=False, stamp=False).select("id", "content")


@query(
    r"""SELECT doc_id AS id, regexp_replace(text, '[^一-龥a-zA-Z0-9 \t\n\r\f\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}.,;:!?"''()\[\]{}。，；：！？“”‘’（）【】-]', '', 'g') AS content FROM documents"""
)
def clean_special_chars(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return dx.clean_documents(d, html=False, special_chars=True, whitespace=False, stamp=False).select("id", "content")


@query(
    f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    e AS (SELECT doc_id, i, ls[i] AS line, {_trim('ls[i]')} AS k, len(ls) AS n FROM l, unnest(range(1, len(ls) + 1)) t(i)),
    f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM e),
    g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (n >= 10 AND length(k) BETWEEN 1 AND 79 AND c >= greatest(3, n * 0.1))), '') AS content FROM f GROUP BY doc_id)
    SELECT doc_id AS id, content FROM g"""
)
def clean_header_footer(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    return dx.clean_documents(d, html=False, header_footer=True, whitespace=False, stamp=False).select("id", "content")


@query(
    f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: length(x) > 0) AS ls FROM documents),
    t AS (SELECT *, {_trim("regexp_replace(ls[1], '^#+" + _S + "*', '')")} AS t, len(regexp_extract_all(text, '[一-龥]'))::BIGINT AS han, len(regexp_extract_all(text, '[a-zA-Z]'))::BIGINT AS latin FROM l)
    SELECT doc_id AS id, CASE WHEN length(t) > 0 THEN t ELSE '未命名' END AS title,
           CASE WHEN han + latin = 0 THEN 'unknown' WHEN han / (han + latin) > 0.3 THEN 'zh' ELSE 'en' END AS language,
           length(text)::BIGINT AS char_count, (han + len(regexp_extract_all(text, '[a-zA-Z]+')))::BIGINT AS word_count, len(string_split(text, chr(10)))::BIGINT AS line_count
    FROM t"""
)
def metadata_base(spark, sf_dir):
    return dx.base_metadata(docs_of(spark, sf_dir)).select("id", "title", "language", "char_count", "word_count", "line_count")


@query("SELECT doc_id AS id, (len(regexp_extract_all(text, '[一-鿿가-힯぀-ゟ゠-ヿ]')) + ceil((length(text) - len(regexp_extract_all(text, '[一-鿿가-힯぀-ゟ゠-ヿ]'))) / 4.0))::INTEGER AS tokens FROM documents")
def token_count(spark, sf_dir):
    return docs_of(spark, sf_dir).select("id", tx.token_count(F.col("content")).alias("tokens"))


@query("SELECT doc_id AS id, md5(text) AS content_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(text, '" + _S + "+', ' ', 'g')) ORDER BY doc_id) = 1")
def dedup_hash(spark, sf_dir):
    return dx.dedup_hash(docs_of(spark, sf_dir)).select("id", F.md5("content").alias("content_md5"))


@query(
    r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([。！？.!?\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: length("
    + _trim("x")
    + ") > 0) AS s FROM documents) SELECT doc_id AS id, (i - 1)::INTEGER AS pos, s[i] AS sentence FROM s, unnest(range(1, len(s) + 1)) t(i)"
)
def sentence_split(spark, sf_dir):
    return docs_of(spark, sf_dir).select("id", F.posexplode(tx.sentences(F.col("content"))).alias("pos", "sentence"))


def _llm_json() -> ScriptedLLM:
    import json

    def answer(p: str) -> str:
        body = p.split("\n", 1)[1]
        words = body.split()
        return json.dumps({"topic": "技术" if len(words) % 2 else "其他", "keywords": words[:7], "summary": " ".join(words[:8]), "pairs": []}, ensure_ascii=False)

    return ScriptedLLM([("", answer)])


@query(
    "WITH w AS (SELECT doc_id, list_filter(string_split_regex(substr(text, 1, 2000), '\\s+'), lambda x: x != '') AS w FROM documents) SELECT doc_id AS id, CASE WHEN len(w) % 2 = 1 THEN '技术' ELSE '其他' END AS topic, array_to_string(w[1:5], '|') AS keywords, array_to_string(w[1:8], ' ') AS summary FROM w"
)
def metadata_llm(spark, sf_dir):
    """Topic, keywords and summary by a provider with fixed rules."""
    d = dx.llm_metadata(docs_of(spark, sf_dir), _llm_json(), ["技术", "其他"])
    return d.select("id", "topic", F.array_join("keywords", "|").alias("keywords"), "summary")


@query(
    "WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(substr(text, 1, 3000), '\\s+'), lambda x: x != '') AS a, list_filter(string_split_regex(substr(text, 1, 2000), '\\s+'), lambda x: x != '') AS b FROM documents) SELECT doc_id AS id, md5(text || chr(10) || chr(10) || '---' || chr(10) || '[摘要] ' || array_to_string(a[1:8], ' ') || chr(10) || chr(10) || '[关键词] ' || array_to_string(b[1:7], ', ')) AS content_md5 FROM w"
)
def augment_documents(spark, sf_dir):
    return dx.augment_documents(docs_of(spark, sf_dir), _llm_json()).select("id", F.md5("content").alias("content_md5"))


# --- chunks -----------------------------------------------------------------------------------------


def _chunk_rows(c: DataFrame) -> DataFrame:
    return c.select("chunk_id", "document_id", "chunk_index", "content")


def _last(window: str, sep: str) -> str:
    """Place, from 0, of the last `sep` in a window; -1 without one."""
    return f"CASE WHEN contains({window}, {sep}) THEN length({window}) - strpos(reverse({window}), {sep}) ELSE -1 END"


_FIXED = f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE length({_trim('text')}) > 0),
    w AS (
        SELECT doc_id, text, 0 AS n, 0 AS pos, substr(text, 1, 500) AS win, {_trim('text')} AS piece, length(text) <= 500 AS over FROM d WHERE length(text) <= 500
        UNION ALL
        SELECT doc_id, text, n, pos, win, CASE WHEN last THEN {_trim('win')} ELSE {_trim('substr(win, 1, ' + 'e)')} END, last FROM (
            SELECT doc_id, text, 0 AS n, 0 AS pos, substr(text, 1, 500) AS win, false AS last,
                   CASE WHEN {_last('substr(text, 1, 500)', 'chr(10)')} > 250 THEN {_last('substr(text, 1, 500)', 'chr(10)')} WHEN {_last('substr(text, 1, 500)', "' '")} > 250 THEN {_last('substr(text, 1, 500)', "' '")} ELSE 500 END AS e
            FROM d WHERE length(text) > 500)
        UNION ALL
        SELECT doc_id, text, n, pos, win, CASE WHEN last THEN {_trim('win')} ELSE {_trim('substr(win, 1, ' + 'e)')} END, last FROM (
            SELECT *, CASE WHEN {_last('win', 'chr(10)')} > 250 THEN {_last('win', 'chr(10)')} WHEN {_last('win', "' '")} > 250 THEN {_last('win', "' '")} ELSE length(win) END AS e FROM (
                SELECT doc_id, text, n + (length(piece) > 0)::INTEGER AS n, pos + length(piece) - 50 AS pos, substr(text, pos + length(piece) - 50 + 1, 500) AS win, pos + length(piece) - 50 + 500 >= length(text) AS last
                FROM w WHERE NOT over AND length(piece) > 50 AND pos + length(piece) - 50 < length(text)))
    )"""


@query(_FIXED + " SELECT doc_id || '_chunk_' || n AS chunk_id, doc_id::VARCHAR AS document_id, n::INTEGER AS chunk_index, piece AS content FROM w WHERE length(piece) > 0")
def chunk_fixed_size(spark, sf_dir):
    return _chunk_rows(dx.chunk_fixed_size(docs_of(spark, sf_dir)))


@query()
def chunk_recursive(spark, sf_dir):
    return _chunk_rows(dx.chunk_recursive(docs_of(spark, sf_dir)))


#: Sentences of each document with the group each is packed into, longest groups of 1,000 characters.
_PACKED = (
    r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([。！？.!?\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: length("""
    + _trim("x")
    + r""") > 0) AS s FROM documents),
    g AS (
        SELECT doc_id, s, 1 AS i, 0 AS n, length(s[1]) AS held FROM s WHERE len(s) > 0
        UNION ALL
        SELECT doc_id, s, i + 1, CASE WHEN held + length(s[i + 1]) > 1000 THEN n + 1 ELSE n END, CASE WHEN held + length(s[i + 1]) > 1000 THEN length(s[i + 1]) ELSE held + length(s[i + 1]) END FROM g WHERE i < len(s)
    ),
    one AS (SELECT doc_id, """
    + _trim("s[1]")
    + """ AS t FROM s WHERE len(s) = 1),
    p AS (
        SELECT doc_id, n, """
    + _trim("string_agg(s[i], ' ' ORDER BY i)")
    + """ AS content FROM g WHERE doc_id NOT IN (SELECT doc_id FROM one WHERE length(t) > 1000) GROUP BY doc_id, n
        UNION ALL SELECT doc_id, k, substr(t, 1000 * k + 1, 1000) FROM one, unnest(range(0, 1000)) u(k) WHERE length(t) > 1000 AND 1000 * k < length(t)
    )"""
)


@query(_PACKED + " SELECT doc_id || '_chunk_' || n AS chunk_id, doc_id::VARCHAR AS document_id, n::INTEGER AS chunk_index, content FROM p")
def chunk_sentence_pack(spark, sf_dir):
    return _chunk_rows(dx.chunk_sentences(docs_of(spark, sf_dir)))


@query()
def chunk_semantic(spark, sf_dir):
    return _chunk_rows(dx.chunk_semantic(docs_of(spark, sf_dir), HashingEmbedding(64)))


@query()
def chunk_markdown(spark, sf_dir):
    return dx.chunk_markdown(docs_of(spark, sf_dir)).select("chunk_id", "document_id", "chunk_index", "content", "heading", "heading_level")


@query(
    _PACKED
    + " SELECT doc_id || '_chunk_' || n AS chunk_id, doc_id::VARCHAR AS document_id, n::INTEGER AS chunk_index, '[摘要: ' || "
    + _trim("substr(content || chr(10) || chr(10) || '请用一句话说明片段内容。', 1, 40)")
    + " || ']' || chr(10) || content AS content FROM p"
)
def chunk_contextual_header(spark, sf_dir):
    d = docs_of(spark, sf_dir)
    llm = ScriptedLLM([("", lambda p: p.split("片段：\n", 1)[1][:40])])
    return _chunk_rows(dx.chunk_with_headers(dx.chunk_sentences(d), d, llm))


# --- loaders ------------------------------------------------------------------------------------------


@query("SELECT 'n_name' AS k, n_name AS content, n_nationkey::VARCHAR AS nationkey FROM nation")
def load_csv(spark, sf_dir):
    """`nation` written as CSV and loaded back, the name as content."""
    path = scratch(spark, "csv")
    read(spark, sf_dir, "nation").coalesce(1).write.csv(path, header=True, escape='"')
    d = loaders.load_csv(spark, path, content_columns=("n_name",))
    return d.select(F.lit("n_name").alias("k"), "content", F.col("metadata")["n_nationkey"].alias("nationkey"))


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS item_index, n_name AS content, '{\"key\": ' || n_nationkey || '}' AS metadata FROM nation")
def load_json(spark, sf_dir):
    path = scratch(spark, "json")
    n = read(spark, sf_dir, "nation")
    rows = n.agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("text")))).alias("items"))
    body = rows.select(F.to_json(F.struct(F.struct("items").alias("data"))).alias("value"))
    body.write.text(path)
    d = loaders.extract_json(loaders.load_text(spark, path), "data.items")
    items = d.select("source", "item_index", F.get_json_object("content", "$.text").alias("content"), F.concat(F.lit('{"key": '), F.get_json_object("content", "$.key"), F.lit("}")).alias("metadata"))
    return items.select("item_index", "content", "metadata")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS section_index, n_name AS heading, 'region ' || n_regionkey AS content FROM nation")
def load_markdown(spark, sf_dir):
    path = scratch(spark, "markdown")
    n = read(spark, sf_dir, "nation")
    part = F.concat(F.lit("# "), F.col("n_name"), F.lit("\nregion "), F.col("n_regionkey").cast("string"), F.lit("\n"))
    body = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), part.alias("p")))), lambda x: x["p"]), "\n").alias("value"))
    body.write.text(path)
    return loaders.load_markdown(spark, path, split_by_heading=True).select("section_index", "heading", "content")


@query("SELECT r_name AS content FROM region")
def load_text(spark, sf_dir):
    path = scratch(spark, "text")
    r = read(spark, sf_dir, "region").select(F.col("r_name").alias("value"), "r_regionkey")
    r.repartition(5, "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return loaders.load_text(spark, f"{path}/*/*.txt").select(F.regexp_replace("content", "\n$", "").alias("content"))


_WEB = "html"
for _tag in loaders.DROPPED:
    _WEB = f"regexp_replace({_WEB}, '(?is)<{_tag}\\b.*?</{_tag}\\s*>', ' ', 'g')"
_BODY = f"coalesce(nullif(regexp_extract({_WEB}, '(?is)<body[^>]*>(.*)</body>', 1), ''), {_WEB})"
_PLAIN = f"replace(replace(replace(replace(replace(regexp_replace({_BODY}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"


@query(
    f"SELECT page_id, trim(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '{_S}+', ' ', 'g')) AS title, trim(regexp_replace({_PLAIN}, '{_S}+', ' ', 'g')) AS content FROM pages"
)
def web_text(spark, sf_dir):
    """Page text by patterns, JVM only."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", loaders.html_title(F.col("html")).alias("title"), loaders.html_text(F.col("html")).alias("content"))


@query()
def web_extract(spark, sf_dir):
    """Page text by a parser."""
    return loaders.extract_html(read(spark, sf_dir, "pages")).select("page_id", "title", "content")


# --- generation metrics over conversations --------------------------------------------------------------

_TURNS = """s AS (SELECT conv_id, turn, text AS query, lead(text) OVER w AS answer, role, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, query, answer FROM s WHERE role = 'user' AND next = 'assistant')"""


def samples(spark, sf_dir) -> DataFrame:
    """User turns with the assistant turn that follows."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return c.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("text").alias("query"), "answer")


def _score(spark, sf_dir, f) -> DataFrame:
    return samples(spark, sf_dir).select("conv_id", "turn", F.round(f(F.col("answer"), F.col("query")), DIGITS).alias("score"))



def _metric_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[^a-zA-Z0-9一-鿿]+|[一-鿿]|[a-zA-Z0-9]+'), lambda x: length({_trim('x')}) > 0)"



def _overlap(n: int) -> str:
    """CTEs o{n}: per sample, n-grams of the answer (a) and query (r) and their clipped overlap (h)."""

    def grams(t: str) -> str:
        runs = f"SELECT conv_id, turn, array_to_string({t}[i:i + {n} - 1], ' ') AS g FROM k, unnest(range(1, greatest(len({t}) - {n} + 2, 1))) u(i)"
        return f"(SELECT conv_id, turn, g, count(*) AS c FROM ({runs}) GROUP BY ALL)"

    return f"""a{n} AS {grams('ta')}, r{n} AS {grams('tr')},
    o{n} AS (SELECT k.conv_id, k.turn, greatest(len(ta) - {n} + 1, 0) AS a, greatest(len(tr) - {n} + 1, 0) AS r, coalesce(h, 0) AS h FROM k LEFT JOIN
        (SELECT a.conv_id, a.turn, sum(least(a.c, b.c)) AS h FROM a{n} a JOIN r{n} b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.g = b.g GROUP BY ALL) x USING (conv_id, turn))"""


_K = "WITH " + _TURNS + f", k AS (SELECT conv_id, turn, {_metric_tokens('answer')} AS ta, {_metric_tokens('query')} AS tr FROM p), "
_F1 = "round(CASE WHEN h > 0 THEN 2 * (h / a) * (h / r) / (h / a + h / r) ELSE 0.0 END, 6)::DOUBLE"


@query(
    _K
    + ", ".join(_overlap(n) for n in (1, 2, 3, 4))
    + """ SELECT o1.conv_id, o1.turn, round(CASE WHEN least(o1.h, o2.h, o3.h, o4.h) = 0 THEN 0.0 ELSE
        (CASE WHEN o1.a > o1.r THEN 1.0 ELSE exp(1 - o1.r / o1.a) END) * exp((ln(o1.h / o1.a) + ln(o2.h / o2.a) + ln(o3.h / o3.a) + ln(o4.h / o4.a)) / 4) END, 6)::DOUBLE AS score
    FROM o1 JOIN o2 USING (conv_id, turn) JOIN o3 USING (conv_id, turn) JOIN o4 USING (conv_id, turn)"""
)
def eval_bleu(spark, sf_dir):
    return _score(spark, sf_dir, ev.bleu)


@query(_K + _overlap(1) + f" SELECT conv_id, turn, {_F1} AS score FROM o1")
def eval_rouge1(spark, sf_dir):
    return _score(spark, sf_dir, lambda a, r: ev.rouge_n(a, r, 1)["f1"])


@query(_K + _overlap(2) + f" SELECT conv_id, turn, {_F1} AS score FROM o2")
def eval_rouge2(spark, sf_dir):
    return _score(spark, sf_dir, lambda a, r: ev.rouge_n(a, r, 2)["f1"])


#: A row of the table of common subsequences for each token of the answer, from the row before.
_LCS = """k2 AS (SELECT conv_id, turn, len(ta) AS a, len(tr) AS r, CASE WHEN len(ta) = 0 OR len(tr) = 0 THEN 0 ELSE list_last(list_reduce(
        list_transform(ta, lambda x: list_transform(tr, lambda y: (x = y)::INTEGER)),
        lambda row, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN m[i] = 1 THEN 1 + CASE WHEN i = 1 THEN 0 ELSE row[i - 1] END ELSE row[i] END)))::INTEGER[],
        list_transform(tr, lambda y: 0))) END AS h FROM k)"""


@query(_K + _LCS + f" SELECT conv_id, turn, {_F1} AS score FROM k2")
def eval_rouge_l(spark, sf_dir):
    return _score(spark, sf_dir, lambda a, r: ev.rouge_l(a, r)["f1"])


_AT = "regexp_extract_all(lower({}), '[a-z0-9一-鿿]+')"


@query(
    "WITH "
    + _TURNS
    + f""", x AS (SELECT conv_id, turn, w, count(*)::DOUBLE AS c FROM (SELECT conv_id, turn, unnest({_AT.format('answer')}) AS w FROM p) GROUP BY ALL),
    y AS (SELECT conv_id, turn, w, count(*)::DOUBLE AS c FROM (SELECT conv_id, turn, unnest({_AT.format('query')}) AS w FROM p) GROUP BY ALL),
    nx AS (SELECT conv_id, turn, sum(c * c) AS n FROM x GROUP BY ALL), ny AS (SELECT conv_id, turn, sum(c * c) AS n FROM y GROUP BY ALL),
    d AS (SELECT conv_id, turn, sum(x.c * y.c) AS d FROM x JOIN y USING (conv_id, turn, w) GROUP BY ALL)
    SELECT p.conv_id, p.turn, round(coalesce(d / (sqrt(nx.n) * sqrt(ny.n)), 0.0), 6) AS score FROM p LEFT JOIN d USING (conv_id, turn) LEFT JOIN nx USING (conv_id, turn) LEFT JOIN ny USING (conv_id, turn)"""
)
def eval_tf_cosine(spark, sf_dir):
    return _score(spark, sf_dir, ev.tf_cosine)


@query(
    "WITH "
    + _TURNS
    + f""", c AS (SELECT conv_id, turn, lower(query) AS low, query, list_filter(list_transform(string_split_regex(answer, '[。.!！?？]+'), lambda x: {_trim('x')}), lambda x: length(x) > 0) AS cs FROM p),
    v AS (SELECT *, list_filter(cs, lambda x: 2 * len(list_filter(string_split_regex(lower(x), '{_S}+'), lambda w: length(w) > 0 AND contains(low, w))) >= len(list_filter(string_split_regex(lower(x), '{_S}+'), lambda w: length(w) > 0))) AS ok FROM c)
    SELECT conv_id, turn, round(CASE WHEN length({_trim('query')}) = 0 THEN 0.0 WHEN len(cs) = 0 THEN 1.0 ELSE len(ok) / len(cs) END, 6)::DOUBLE AS score FROM v"""
)
def eval_faithfulness_fallback(spark, sf_dir):
    """The user's turn plays the context."""
    return _score(spark, sf_dir, ev.faithfulness)


@query(
    "WITH "
    + _TURNS
    + f", t AS (SELECT conv_id, turn, lower(answer) AS low, list_distinct({_AT.format('query')}) AS ts FROM p) SELECT conv_id, turn, round(coalesce(len(list_filter(ts, lambda x: contains(low, x))) / nullif(len(ts), 0), 0.0), 6)::DOUBLE AS score FROM t"
)
def eval_answer_relevance_fallback(spark, sf_dir):
    return ev.answer_relevance(samples(spark, sf_dir)).select("conv_id", "turn", F.round("answer_relevance", DIGITS).alias("score"))


@query("WITH " + _TURNS + " SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 5.0 ELSE 6.6 END::DOUBLE AS overall FROM p")
def eval_llm_judge(spark, sf_dir):
    """A provider that scores odd turns and fails on even ones."""
    s = samples(spark, sf_dir).withColumn("query", F.concat("query", F.lit(" #"), (F.col("turn") % 2).cast("string")))
    llm = ScriptedLLM([("#1\n回答", '```json\n{"准确性": 8, "完整性": 7, "相关性": 9, "流畅性": 4}\n```')])
    return ev.judge(s, llm).select("conv_id", "turn", "overall")


# --- generation -------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN turn % 6 BETWEEN 1 AND 3 THEN CASE WHEN turn % 6 = 2 THEN '2' ELSE '2,' || (turn % 6) END ELSE '2' END AS cited FROM conversations")
def citation_parse(spark, sf_dir):
    """Marks in made-up answers against three sources."""
    c = read(spark, sf_dir, "conversations")
    answer = F.concat("text", F.lit(" [2] see ["), (F.col("turn") % 6).cast("string"), F.lit("] and [2]"))
    c = c.select("conv_id", "turn", F.regexp_replace("text", r"[\[\]]", "").alias("text")).withColumn("answer", answer)
    return c.select("conv_id", "turn", F.array_join(gen.cited_markers(F.col("answer"), F.lit(3)), ",").alias("cited"))


@query("SELECT conv_id, turn, turn % 3 < 2 AS grounded, CASE turn % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS score, CASE WHEN turn % 3 < 2 THEN 1 ELSE 0 END AS unsupported FROM conversations")
def grounding_parse(spark, sf_dir):
    """Verdicts as JSON, as JSON within text, and unreadable."""
    body = lambda s: f'{{"isGrounded": true, "unsupportedClaims": ["x"], "groundingScore": {s}}}'
    c = read(spark, sf_dir, "conversations")
    a = F.when(F.col("turn") % 3 == 0, F.lit(f"```json\n{body(0.9)}\n```")).when(F.col("turn") % 3 == 1, F.lit(f"Verdict: {body(0.8)} done")).otherwise(F.lit("no idea"))
    c = c.withColumn("v", gen.parse_grounding(a))
    return c.select("conv_id", "turn", F.col("v.isGrounded").alias("grounded"), F.col("v.groundingScore").alias("score"), F.size("v.unsupportedClaims").alias("unsupported"))


@query(
    """WITH g AS (SELECT conv_id, role AS answer, count(*) AS votes, min(turn) AS f, sum(count(*)) OVER (PARTITION BY conv_id)::BIGINT AS rounds FROM conversations GROUP BY conv_id, role)
    SELECT conv_id, answer, votes, rounds, round(votes / rounds, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, f) = 1"""
)
def consistency_majority(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("round"), F.col("role").alias("answer"))
    return gen.majority(c).select(F.col("query_id").alias("conv_id"), "answer", "votes", "rounds", F.round("score", DIGITS).alias("score"))


@query(
    """WITH m AS (SELECT *, max((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations WHERE role != 'system'),
    n AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS f FROM m WHERE u = 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM n)
    SELECT conv_id, (r - 1)::BIGINT AS turn, first(role ORDER BY turn) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, r"""
)
def normalize_roles(spark, sf_dir):
    return merge_roles(read(spark, sf_dir, "conversations"))


@query(
    "WITH "
    + bm25_sql(3)
    + """, c AS (SELECT query_id, string_agg('[' || rank || '] ' || d.text, chr(10) || chr(10) ORDER BY rank) AS c FROM hits JOIN documents d ON d.doc_id = chunk_id GROUP BY query_id)
    SELECT item_id AS query_id, 'answer' AS answer, CASE WHEN length('资料是否支持回答？yes / no' || chr(10) || coalesce(c, '') || chr(10) || CASE WHEN c IS NULL THEN '__none__' ELSE 'answer' END) % 2 = 1 THEN 1 ELSE 2 END AS rounds
    FROM benchmark LEFT JOIN c ON c.query_id = item_id"""
)
def self_rag_rounds(spark, sf_dir):
    """Passages as questions; support is denied once for those of odd length."""
    from ..operators import search

    d = docs_of(spark, sf_dir)
    index = search.KeywordIndex.build(d)

    def retrieve(q):
        return index.search(q, 3, digits=DIGITS).join(d.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")

    llm = ScriptedLLM([("是否需要检索", "yes"), ("资料是否相关", "yes"), ("资料是否支持回答", lambda p: "yes" if len(p) % 2 else "no"), ("", "answer")])
    return gen.self_rag(questions(spark, sf_dir), retrieve, llm, 2).select("query_id", "answer", "rounds")


# --- graph ----------------------------------------------------------------------------------------------------


def graph_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and suppliers with their foreign keys as relations."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ents, rels, base = None, None, 0
    spec = (
        ("region", "r:", "r_regionkey", "r_name", None, None),
        ("nation", "n:", "n_nationkey", "n_name", "r:", "n_regionkey"),
        ("customer", "c:", "c_custkey", "c_name", "n:", "c_nationkey"),
        ("supplier", "s:", "s_suppkey", "s_name", "n:", "s_nationkey"),
    )
    for i, (table, p, k, name, up, fk) in enumerate(spec):
        t, base = read(spark, sf_dir, table), i * 10_000_000_000
        meta = F.create_map(F.lit("table"), F.lit(table)).alias("metadata")
        e = t.select(key(p, k).alias("id"), F.col(name).alias("name"), F.lit(table).alias("type"), meta, (F.col(k).cast("long") + base).alias("ord"))
        ents = e if ents is None else ents.unionByName(e)
        if up:
            r = t.select(key(p, k).alias("source"), key(up, fk).alias("target"), F.lit(f"{table}_in").alias("type"), meta, (F.col(k).cast("long") + base).alias("ord"))
            rels = r if rels is None else rels.unionByName(r)
    return ents, rels


_GRAPH = """e AS (SELECT 'r:' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation' FROM nation
        UNION ALL SELECT 'c:' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier' FROM supplier),
    r AS (SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'nation_in' AS type FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'customer_in' FROM customer
        UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'supplier_in' FROM supplier),
    b AS (SELECT source AS here, target AS there, source, target, type FROM r UNION ALL SELECT target, source, source, target, type FROM r)"""


@query(
    """WITH m AS (SELECT user_id, event_type AS k, value AS v, event_id FROM events),
    l AS (SELECT user_id, k, arg_max(v, event_id) AS v FROM m GROUP BY ALL)
    SELECT 'u:' || user_id AS id, (SELECT arg_min(k, event_id) FROM m WHERE m.user_id = l.user_id) AS name, string_agg(k || '=' || round(v, 2)::DECIMAL(18,2)::VARCHAR, ',' ORDER BY k) AS metadata FROM l GROUP BY user_id"""
)
def graph_merge_entities(spark, sf_dir):
    """Each event as a mention of its user, with one metadata entry."""
    e = read(spark, sf_dir, "events")
    m = e.select(
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("name"), F.lit("user").alias("type"),
        F.create_map("event_type", F.round("value", 2).cast("decimal(18,2)").cast("string")).alias("metadata"), F.col("event_id").alias("ord"),
    )
    g = gx.merge_entities(m)
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return g.select("id", "name", F.array_join(pairs, ",").alias("metadata"))


@query("SELECT o_custkey AS source, o_orderpriority AS target, o_orderstatus AS type, min(o_orderkey) AS ord FROM orders GROUP BY ALL")
def graph_dedup_relations(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("type"), F.create_map(F.lit("k"), F.col("o_orderkey").cast("string")).alias("metadata"), F.col("o_orderkey").alias("ord"))
    return gx.dedup_relations(r).select("source", "target", "type", "ord")


def _seeds(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("seed"))


@query("WITH " + _GRAPH + " SELECT DISTINCT here AS seed, there AS id, 1 AS hop, source, target, type FROM b WHERE here LIKE 'n:%'")
def graph_neighbors_1hop(spark, sf_dir):
    return gx.neighbors(_seeds(spark, sf_dir), *graph_of(spark, sf_dir)).select("seed", "id", "hop", "source", "target", "type")


@query(
    "WITH "
    + _GRAPH
    + ", h AS (SELECT DISTINCT here AS seed, there AS id FROM b WHERE here LIKE 'n:%'), k AS (SELECT DISTINCT h.seed, b.there AS id FROM h JOIN b ON b.here = h.id WHERE b.there != h.seed) SELECT seed, id, 1 AS hop FROM h UNION ALL SELECT seed, id, 2 FROM k WHERE (seed, id) NOT IN (SELECT (seed, id) FROM h)"
)
def graph_neighbors_2hop(spark, sf_dir):
    return gx.neighbors(_seeds(spark, sf_dir), *graph_of(spark, sf_dir), hops=2).select("seed", "id", "hop")


@query(
    """SELECT 's:' || s_suppkey AS source_id, 'c:' || c_custkey AS target_id, CASE WHEN s_nationkey = c_nationkey THEN 2 ELSE 4 END AS hops
    FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey WHERE a.n_regionkey = b.n_regionkey"""
)
def graph_shortest_path(spark, sf_dir):
    """From each supplier to the customer of its number."""
    s = read(spark, sf_dir, "supplier")
    pairs = s.select(*[F.concat(F.lit(p), F.col("s_suppkey").cast("string")).alias(n) for p, n in (("s:", "source_id"), ("c:", "target_id"))])
    return gx.shortest_paths(pairs, *graph_of(spark, sf_dir), max_hops=4).select("source_id", "target_id", "hops")


def _names(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long")).alias("query_id"), F.col("r_name").alias("query"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("query_id"), F.col("n_name").alias("query"))
    return r.unionByName(n)


_NAMED = (
    "WITH "
    + _GRAPH
    + r""", q AS (SELECT r_regionkey::BIGINT AS query_id, r_name AS query FROM region UNION ALL SELECT n_nationkey::BIGINT + 100, n_name FROM nation),
    w AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(query), '\s+')) AS kw FROM q),
    m AS (SELECT DISTINCT query_id, id FROM w JOIN e ON contains(lower(name), kw) OR contains(lower(type), kw))"""
)


@query(_NAMED + " SELECT query_id, id FROM m")
def graph_keyword_query(spark, sf_dir):
    """Region and nation names as queries."""
    return gx.keyword_entities(_names(spark, sf_dir), graph_of(spark, sf_dir)[0])


@query(
    _NAMED
    + """, f AS (SELECT DISTINCT m.query_id, b.there, b.source, b.target, b.type FROM m JOIN b ON b.here = m.id),
    x AS (SELECT query_id, id FROM m UNION SELECT query_id, there FROM f), l AS (SELECT DISTINCT query_id, source, target, type FROM f),
    n AS (SELECT x.query_id, x.id, count(l.source) AS n FROM x LEFT JOIN l ON l.query_id = x.query_id AND (l.source = x.id OR l.target = x.id) GROUP BY ALL)
    SELECT query_id, 'graph_' || id AS chunk_id, round(least(1.0, 0.3 + n * 0.1), 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(least(1.0, 0.3 + n * 0.1), 6) DESC, 'graph_' || id)::INTEGER AS rank FROM n QUALIFY rank <= 5"""
)
def graph_retriever_score(spark, sf_dir):
    e, r = graph_of(spark, sf_dir)
    m = gx.keyword_entities(_names(spark, sf_dir), e)
    out = gx.graph_retrieve(m, e, r, max_hops=1, max_entities=None)
    return out.select("query_id", "chunk_id", F.round("score", DIGITS).alias("score"), "rank")


@query(
    "WITH v AS (SELECT vec_id // 10 AS query_id, 'x' || (vec_id % 7) AS chunk_id, max(label + 1.0)::DOUBLE AS score FROM embeddings GROUP BY ALL), g AS (SELECT vec_id // 10 AS query_id, 'x' || (vec_id % 4 + 5) AS chunk_id, max(label * 2.0)::DOUBLE AS score FROM embeddings GROUP BY ALL),"
    " u AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) * 0.6 AS score FROM v UNION ALL SELECT query_id, chunk_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) * 0.4 ELSE 0 END FROM g),"
    " s AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM u GROUP BY ALL) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM s QUALIFY rank <= 5"
)
def graph_enhanced_merge(spark, sf_dir):
    """Two arms made of labels, merged by their maxima."""
    from ..operators.search import top_k

    v = read(spark, sf_dir, "embeddings").withColumn("query_id", F.floor(F.col("vec_id") / 10))
    arm = lambda chunk, score: top_k(v.groupBy("query_id", F.concat(F.lit("x"), chunk.cast("string")).alias("chunk_id")).agg(F.max(score).cast("double").alias("score")), 100)
    a, g = arm(F.col("vec_id") % 7, F.col("label") + 1.0), arm(F.col("vec_id") % 4 + 5, F.col("label") * 2.0)
    out = gx.graph_enhanced(a, g, k=100).drop("rank").withColumn("score", F.round("score", DIGITS))
    return top_k(out, 5).select("query_id", "chunk_id", "score", "rank")


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x != '')[1:2] AS w FROM documents),
    m AS (SELECT doc_id, i, CASE WHEN len(w) = 0 THEN 'x' ELSE w[i] END AS name FROM w, unnest(range(1, 3)) t(i) WHERE i <= greatest(len(w), 1))
    SELECT 'entity_' || lower(name) AS id, arg_min(name, doc_id * 10 + i) AS name, '概念' AS type FROM m GROUP BY lower(name)"""
)
def graph_extract(spark, sf_dir):
    """Entities of documents by a provider that names the source and language."""
    import json

    def answer(p: str) -> str:
        w = p.split("\n", 1)[1].split()[:2] or ["x"]
        return json.dumps({"entities": [{"name": x, "type": "概念"} for x in w], "relations": [{"source": w[0], "target": w[-1], "type": "相关"}]})

    x = gx.extract_graph(docs_of(spark, sf_dir), ScriptedLLM([("", answer)]))
    return gx.graph_tables(x)[0].select("id", "name", "type")


# --- pipelines and streams ----------------------------------------------------------------------------------------


def _empty_store(spark) -> TableStore:
    # limit(0) is what tells the optimizer that there is nothing to replace, or new chunks would be made once more for each look
    none = spark.createDataFrame([], "id string, document_id string, content string, chunk_index int, embedding array<double>").limit(0)
    return TableStore(none, 64)


@query()
def rag_pipeline_simple(spark, sf_dir):
    """Every passage asked of an index of all documents, whose chunks are cut anew where they are read: cheaper than to keep them."""
    p = pl.simple_rag(ExtractiveLLM(), HashingEmbedding(64), _empty_store(spark))
    p.ingest(docs_of(spark, sf_dir))
    return p.query(questions(spark, sf_dir)).select("query_id", "answer", F.size("sources").alias("n_sources"))


@query()
def rag_pipeline_advanced(spark, sf_dir):
    p = pl.advanced_rag(ExtractiveLLM(), HashingEmbedding(64), _empty_store(spark), rewrite=False, max_tokens=4000)
    p.ingest(docs_of(spark, sf_dir))
    return p.query(questions(spark, sf_dir)).select("query_id", "answer", F.size("sources").alias("n_sources"))


@query()
def indexing_pipeline_report(spark, sf_dir):
    ix = pl.IndexingPipeline(_empty_store(spark), dx.chunk_fixed_size, HashingEmbedding(64), clean=dx.clean_documents, dedup=dx.dedup_hash, metadata=dx.base_metadata)
    return ix.index(docs_of(spark, sf_dir)).drop("duration_s")


@query(
    """WITH e AS (SELECT ts, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS g,
        least(greatest(0.4 * (event_type = 'purchase')::INTEGER - 0.3 * (event_type = 'error')::INTEGER + 0.15 * (event_type = 'click')::INTEGER + 0.15 * coalesce(value > 30, false)::INTEGER, 0), 1)::DOUBLE AS s FROM events)
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, g AS "group", count(*) AS n, round(sum(s), 4) AS total FROM e GROUP BY ALL"""
)
def stream_ab_test(spark, sf_dir):
    """Daily sums a group from `events` as a stream."""
    kind = F.col("event_type")
    e = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("group"), (kind == "purchase").alias("thumbs_up"), (kind == "error").alias("follow_up"), (kind == "click").alias("source_click"), F.col("value").alias("dwell"))
    out = _drain(streams.stream_ab(e, lateness="3650 days"), "complete", spark)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "group", "n", F.round("total", 4).alias("total"))


@query("SELECT count(DISTINCT trim(regexp_replace(text, '" + _S + "+', ' ', 'g'))) AS kept FROM documents")
def stream_dedup(spark, sf_dir):
    d = spark.readStream.schema(read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    d = d.select("doc_id", F.col("text").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return _drain(streams.stream_dedup(d).select("doc_id"), "append", spark).agg(F.count(F.lit(1)).alias("kept"))


def _drain(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there and return what it wrote last."""
    path = scratch(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(
    """SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS "group", round(avg(least(greatest(0.4 * (event_type = 'purchase')::INTEGER - 0.3 * (event_type = 'error')::INTEGER
        + 0.15 * (event_type = 'click')::INTEGER + 0.15 * coalesce(value > 30, false)::INTEGER, 0), 1)::DOUBLE), 6) AS mean FROM events GROUP BY ALL"""
)
def ab_test_groups(spark, sf_dir):
    """Mean satisfaction a group, the input of `ab_test`."""
    return ab_events(read(spark, sf_dir, "events")).groupBy("group").agg(F.round(F.avg("satisfaction"), DIGITS).alias("mean"))
