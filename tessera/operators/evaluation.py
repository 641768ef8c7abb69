"""Evaluation of retrieval and generation as batch aggregates.

results: (query_id, chunk_id, rank); truth: (query_id, chunk_id[, rel]); a query of `queries`
without results or truth gets 0. Samples: (query_id, answer, reference).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.vectors import cosine
from .providers import chat_column, json_body


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def judged(queries: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """Ranked hits with hit (0 or 1) and rel, beside every query's number of true chunks."""
    t = truth.select("query_id", "chunk_id", (F.col("rel") if "rel" in truth.columns else F.lit(1.0)).alias("rel")).dropDuplicates(["query_id", "chunk_id"])
    n = t.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_true"))
    h = results.select("query_id", "chunk_id", "rank").join(t, ["query_id", "chunk_id"], "left").withColumn("hit", F.col("rel").isNotNull().cast("int"))
    return queries.select("query_id").distinct().join(n, "query_id", "left").join(h, "query_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))


def retrieval_metrics(queries: DataFrame, results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, precision, reciprocal_rank): one pass, one shuffle of the hits.

    recall: hits in the first k over distinct true chunks; precision: over k, however few were
    found; reciprocal_rank: of the first hit at any rank.
    """
    j = judged(queries, results, truth)
    hits = F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0))
    return j.groupBy("query_id").agg(
        ratio(hits, F.max("n_true")).alias("recall"),
        (hits / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias("precision"),
        F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
    )


def ndcg(queries: DataFrame, results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, dcg, idcg, ndcg), gains linear. The ideal takes the relevances of the first k
    results and of the true chunks that are missing there, best first, k at most."""
    t = truth.select("query_id", "chunk_id", (F.col("rel") if "rel" in truth.columns else F.lit(1.0)).cast("double").alias("rel")).dropDuplicates(["query_id", "chunk_id"])
    r = results.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
    both = r.join(t, ["query_id", "chunk_id"], "full_outer").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    ideal = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rel").desc(), "chunk_id"))
    gain = lambda at: F.col("rel") / F.log2(at + 1)
    s = both.withColumn("_i", ideal).groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), gain(F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("_i") <= k, gain(F.col("_i")))), F.lit(0.0)).alias("idcg"),
    )
    s = queries.select("query_id").distinct().join(s, "query_id", "left").na.fill(0.0, ["dcg", "idcg"])
    return s.withColumn("ndcg", ratio(F.col("dcg"), F.col("idcg")))


def average_precision(flags: DataFrame) -> DataFrame:
    """(query_id, score, relevant_count): mean of the precisions at relevant ranks. flags: (query_id, rank, relevant)."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    r = F.col("relevant").cast("int")
    d = flags.withColumn("_p", F.when(F.col("relevant"), F.sum(r).over(w) / F.count(F.lit(1)).over(w)))
    return d.groupBy("query_id").agg(F.coalesce(F.avg("_p"), F.lit(0.0)).alias("score"), F.sum(r).alias("relevant_count"))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


_JUDGE = T.StructType().add("judgments", T.ArrayType(T.StructType().add("index", "integer").add("relevant", "boolean")))


def context_relevance(contexts: DataFrame, llm=None, least: float = 0.1, query: str = "query", content: str = "content") -> DataFrame:
    """Average precision of contexts (query_id, rank, query, content) by a model's verdicts.

    Without a model, or where its answer cannot be read, a context is relevant if it shares at least
    `least` of its and the query's distinct tokens.
    """
    near = jaccard(tx.ascii_tokens(F.col(query)), tx.ascii_tokens(F.col(content))) >= least
    d = contexts.withColumn("relevant", near)
    if llm is not None:
        listed = F.concat(F.lit("["), (F.col("rank") - 1).cast("string"), F.lit("] "), F.col(content))
        g = d.groupBy("query_id").agg(F.first(query).alias("_q"), F.array_sort(F.collect_list(F.struct("rank", listed.alias("c")))).alias("_l"))
        ask = F.concat(F.lit("请逐条判断上下文是否与查询相关，以 JSON 返回 judgments（index、relevant）。\n查询："), F.col("_q"), F.lit("\n"), F.array_join("_l.c", "\n\n"))
        g = g.select("query_id", F.from_json(json_body(chat_column(llm, ask)), _JUDGE)["judgments"].alias("_j"))
        verdict = F.exists("_j", lambda x: (x["index"] == F.col("rank") - 1) & x["relevant"])
        d = d.join(g, "query_id", "left").withColumn("relevant", F.when(F.col("_j").isNotNull(), F.coalesce(verdict, F.lit(False))).otherwise(F.col("relevant"))).drop("_j")
    return average_precision(d)


# --- generation metrics on one row: answer against reference --------------------------------


# Texts go to Python as they are, once; tokens, n-grams and counts never travel.

_METRIC = re.compile(tx.METRIC)
_ASCII = re.compile(tx.ASCII)
_BLANK = re.compile(f"{tx.SPACE}+")


def _metric_tokens(text: str | None) -> list[str]:
    """`tx.metric_tokens` of a lower-cased text."""
    return [t for t in _METRIC.findall(text) if not _BLANK.fullmatch(t)] if text else []


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _overlaps(a: pd.Series, b: pd.Series, top: pd.Series) -> pd.Series:
    """Numbers of tokens of two texts, then the multiset overlap of their n-grams for n from 1 to `top`."""

    def one(x, y, n):
        x, y = _metric_tokens(x), _metric_tokens(y)
        return [len(x), len(y), *((_grams(x, k) & _grams(y, k)).total() for k in range(1, n + 1))]

    return pd.Series([one(*r) for r in zip(a, b, top)])


def bleu(answer: Column, reference: Column, max_n: int = 4) -> Column:
    """Geometric mean of clipped n-gram precisions with a brevity penalty; 0 if any precision is 0."""

    def score(x: Column) -> Column:
        c, m = F.get(x, F.lit(0)), F.get(x, F.lit(1))
        precisions = [ratio(F.get(x, F.lit(2 + n)), F.greatest(c - n, F.lit(0))) for n in range(max_n)]
        zero, logs = F.lit(False), F.lit(0.0)
        for p in precisions:
            zero, logs = zero | (p == 0), logs + F.ln(F.when(p > 0, p))
        brevity = F.when(c > m, 1.0).otherwise(F.exp(1 - m / F.when(c > 0, c)))
        return F.when((c == 0) | (m == 0) | zero, 0.0).otherwise(brevity * F.exp(logs / max_n))

    return score(_overlaps(F.lower(answer), F.lower(reference), F.lit(max_n)))


def _prf(hit: Column, answer: Column, reference: Column) -> Column:
    p, r = ratio(hit, answer), ratio(hit, reference)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def rouge_n(answer: Column, reference: Column, n: int = 1) -> Column:
    """Struct of precision, recall and f1 of clipped n-gram overlap."""
    x = _overlaps(F.lower(answer), F.lower(reference), F.lit(n))
    count = lambda i: F.greatest(F.get(x, F.lit(i)) - (n - 1), F.lit(0))
    return _prf(F.get(x, F.lit(n + 1)), count(0), count(1))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Numbers of tokens of two texts and the length of their longest common subsequence."""

    def one(x, y) -> list[int]:
        x, y = _metric_tokens(x), _metric_tokens(y)
        # bit-parallel: a word of the row is a bit, so a step is a few big-integer operations
        at: dict = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << i
        full, v = (1 << len(x)) - 1, (1 << len(x)) - 1
        for w in y:
            u = v & at.get(w, 0)
            v = (v + u | v - u) & full
        return [len(x), len(y), len(x) - v.bit_count()]

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def rouge_l(answer: Column, reference: Column) -> Column:
    """Struct of precision, recall and f1 of the longest common token subsequence."""
    x = _lcs(F.lower(answer), F.lower(reference))
    return _prf(F.get(x, F.lit(2)), F.get(x, F.lit(0)), F.get(x, F.lit(1)))


@F.pandas_udf(T.DoubleType())
def _count_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> float:
        x, y = (Counter(_ASCII.findall(t) if t else ()) for t in (x, y))
        if not x or not y:
            return 0.0
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return sum(v * y[k] for k, v in x.items()) / norm

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def tf_cosine(a: Column, b: Column) -> Column:
    """Cosine of term counts; 0 if either has no terms."""
    return _count_cosine(F.lower(a), F.lower(b))


def semantic_similarity(a: Column, b: Column) -> Column:
    """Cosine of two embeddings, not below 0."""
    return F.greatest(cosine(a, b), F.lit(0.0))


def faithfulness(answer: Column, context: Column, claims: Column | None = None) -> Column:
    """Share of claims that the context carries: at least half of a claim's words occur in it.

    Claims are the answer's sentences unless given. No context: 0; no claims: 1.
    """
    c = claims if claims is not None else F.split(answer, "[。.!！?？]+")
    c = F.filter(F.transform(c, tx.trim), lambda x: F.length(x) > 0)

    def carried(low: Column):
        half = lambda ws: F.size(F.filter(ws, lambda w: F.contains(low, w))) * 2 >= F.size(ws)
        return lambda x: tx.let(F.filter(F.split(F.lower(x), f"{tx.SPACE}+"), lambda w: F.length(w) > 0), half)

    n = F.size(c)
    return F.when(F.length(tx.trim(F.coalesce(context, F.lit("")))) == 0, 0.0).when(n == 0, 1.0).otherwise(
        tx.let(F.lower(context), lambda low: F.size(F.filter(c, carried(low)))) / n
    )


_CLAIMS = T.StructType().add("claims", T.ArrayType(T.StringType()))
_VERDICTS = T.StructType().add("verdicts", T.ArrayType(T.StructType().add("claim", "string").add("supported", "boolean").add("reason", "string")))


def faithfulness_by_model(samples: DataFrame, llm, answer: str = "answer", context: str = "context") -> DataFrame:
    """samples plus faithfulness, total_claims, supported_claims and unsupported_claims.

    A model lists an answer's claims and then judges them all against the context; the score is the supported
    ones over all claims. Where the list cannot be read, claims are the sentences; where the
    verdicts cannot, a claim counts as in `faithfulness`. No context: 0; no claims: 1.
    """
    a, c = F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(context), F.lit(""))
    has = F.length(c) > 0
    d = samples.withColumn("_c", F.from_json(json_body(chat_column(llm, F.when(has, F.concat(F.lit("请从以下回答中提取所有原子事实声明，以 JSON 返回 claims：\n\n"), a)))), _CLAIMS)["claims"])
    listed = F.filter("_c", lambda x: F.length(tx.trim(x)) > 0)
    plain = F.filter(F.transform(F.split(a, "[。.!！?？]+"), tx.trim), lambda x: F.length(x) > 0)
    d = d.withColumn("_c", F.when(F.col("_c").isNotNull() & ~F.exists("_c", F.isnull), listed).otherwise(plain))
    numbered = F.array_join(F.transform("_c", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    ask = F.concat(F.lit("请逐条判断每个声明是否被上下文支持，以 JSON 返回 verdicts（claim、supported、reason）。\n上下文：\n"), c, F.lit("\n\n待验证的声明：\n"), numbered)
    d = d.withColumn("_v", F.from_json(json_body(chat_column(llm, F.when(has & (F.size("_c") > 0), ask))), _VERDICTS)["verdicts"])
    whole = F.col("_v").isNotNull() & ~F.exists("_v", lambda v: v.isNull() | v["claim"].isNull() | v["supported"].isNull() | v["reason"].isNull())

    def carried(low: Column):
        words = lambda x: F.filter(F.split(F.lower(x), f"{tx.SPACE}+"), lambda w: F.length(w) > 0)
        half = lambda ws: F.size(F.filter(ws, lambda w: F.contains(low, w))) * 2 >= F.size(ws)
        return lambda x: F.struct(x.alias("claim"), tx.let(words(x), half).alias("supported"))

    own = F.transform("_v", lambda v: F.struct(v["claim"].alias("claim"), v["supported"].alias("supported")))
    d = d.withColumn("_v", F.when(whole, own).otherwise(tx.let(F.lower(c), lambda low: F.transform("_c", carried(low)))))
    n, yes = F.size("_c"), F.size(F.filter("_v", lambda v: v["supported"]))
    none = F.array().cast("array<string>")
    judged_ = has & (n > 0)
    d = d.withColumn("faithfulness", F.when(~has, 0.0).when(n == 0, 1.0).otherwise(yes / n))
    d = d.withColumn("total_claims", F.when(judged_, n).otherwise(0)).withColumn("supported_claims", F.when(judged_, yes).otherwise(0))
    d = d.withColumn("unsupported_claims", F.when(judged_, F.transform(F.filter("_v", lambda v: ~v["supported"]), lambda v: v["claim"])).otherwise(none))
    return d.drop("_c", "_v")


_QUESTIONS = T.StructType().add("questions", T.ArrayType(T.StringType()))


def answer_relevance(samples: DataFrame, llm=None, questions: int = 3, query: str = "query", answer: str = "answer") -> DataFrame:
    """samples plus answer_relevance: mean count cosine of the query with questions a model makes
    from the answer; without them the share of the query's tokens that the answer has."""
    tokens = F.array_distinct(tx.ascii_tokens(F.col(query)))
    hits = tx.let(F.lower(F.col(answer)), lambda low: F.size(F.filter(tokens, lambda t: F.contains(low, t))))
    plain = ratio(hits, F.size(tokens))
    if llm is None:
        return samples.withColumn("answer_relevance", plain)
    ask = F.concat(F.lit(f"请根据回答反向生成 {questions} 个问题，以 JSON 返回 questions。\n"), F.col(answer))
    d = samples.withColumn("_q", F.from_json(json_body(chat_column(llm, ask)), _QUESTIONS)["questions"])
    own = F.filter("_q", lambda x: F.length(tx.trim(x)) > 0)
    parts = [F.coalesce(tf_cosine(F.get(own, F.lit(i)), F.col(query)), F.lit(0.0)) for i in range(questions)]
    mean = sum(parts[1:], parts[0]) / F.least(F.size(own), F.lit(questions))
    return d.withColumn("answer_relevance", F.when(F.size(own) > 0, mean).otherwise(plain)).drop("_q")


#: Dimensions of the judge, fixed values.
DIMENSIONS = ("准确性", "完整性", "相关性", "流畅性", "安全性")


def judge(samples: DataFrame, llm, dimensions: tuple[str, ...] = DIMENSIONS, query: str = "query", answer: str = "answer") -> DataFrame:
    """samples plus scores (map dimension -> 1..10) and overall (their mean); a failed call scores 5 throughout."""
    ask = F.concat(F.lit(f"请从以下维度以 1-10 分评价回答，以 JSON 对象返回：{'、'.join(dimensions)}。\n问题："), F.col(query), F.lit("\n回答："), F.col(answer))
    d = samples.withColumn("_j", F.from_json(json_body(chat_column(llm, ask)), "map<string,double>"))
    score = lambda n: F.least(F.greatest(F.coalesce(F.try_element_at("_j", F.lit(n)), F.lit(5.0)), F.lit(1.0)), F.lit(10.0))
    d = d.withColumn("scores", F.create_map(*[x for n in dimensions for x in (F.lit(n), score(n))]))
    mean = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x) / len(dimensions)
    return d.withColumn("overall", mean).drop("_j")


# --- summaries ------------------------------------------------------------------------------


def metric_stats(scores: DataFrame) -> DataFrame:
    """(name, mean, std, min, max, samples) of long-form scores (query_id, name, score); std of the population."""
    return scores.groupBy("name").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("score").alias("samples")
    )


def long_form(wide: DataFrame, names: list[str], suffix: str = "") -> DataFrame:
    """(query_id, name, score) from metric columns; `suffix` tells apart metrics at different k."""
    pairs = F.array(*[F.struct(F.lit(n + suffix).alias("name"), F.col(n).cast("double").alias("score")) for n in names])
    return wide.select("query_id", F.explode(pairs).alias("_x")).select("query_id", "_x.name", "_x.score")


#: Lower ends of the verdict bands, fixed values.
VERDICTS = ((0.9, "优秀"), (0.75, "良好"), (0.6, "及格"), (float("-inf"), "需改进"))
#: Advice: report, metric, mean below which it is given, text. Fixed values.
ADVICE = (
    ("retrieval", "recall", 0.7, "Recall@K 低于 0.7，建议：优化嵌入模型、调整切块策略（增大 chunkSize 或尝试语义切块）、增加查询变换"),
    ("retrieval", "precision", 0.6, "Precision@K 低于 0.6，建议：改进嵌入模型质量、添加重排序后处理器、调整检索阈值"),
    ("retrieval", "ndcg", 0.7, "NDCG@K 低于 0.7，建议：优化检索排序策略、引入 Reranker 后处理器"),
    ("generation", "faithfulness", 0.8, 'Faithfulness 低于 0.8，存在幻觉风险，建议：在 prompt 中加强"仅基于提供的上下文回答"约束、使用 GroundingGenerator'),
    ("generation", "answer_relevance", 0.7, "AnswerRelevance 低于 0.7，回答偏离问题，建议：优化 prompt 模板、检查检索上下文的相关性"),
    ("generation", "bleu", 0.3, "BLEU 低于 0.3，回答与参考差异较大，建议：检查 prompt 设计、增加 few-shot 示例"),
)
#: What is said where no advice is due, fixed value.
NO_ADVICE = "各项指标表现良好，暂无改进建议"


def verdict(score: Column) -> Column:
    out = F.lit(VERDICTS[-1][1])
    for least, name in reversed(VERDICTS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def evaluation_report(retrieval: DataFrame | None = None, generation: DataFrame | None = None, judge_scores: DataFrame | None = None, ab: DataFrame | None = None) -> DataFrame:
    """One row: overall, verdict, samples, judge_scores (mean a dimension), recommendations, ab (the row of `ab_test`).

    `retrieval` and `generation` are statistics as of `metric_stats` (names may end in @k), `judge_scores`
    rows of `judge`. overall is the mean of all metrics' means and of a tenth of the judge's mean;
    0 without any. samples adds up those of the parts. Statistics are a row a metric, so this is small work.
    """
    given = [x for x in (retrieval, generation, judge_scores, ab) if x is not None]
    if not given:
        raise ValueError("a report needs at least one part")
    spark = given[0].sparkSession
    means = None
    for part, stats in (("retrieval", retrieval), ("generation", generation)):
        if stats is not None:
            m = stats.select(F.lit(part).alias("part"), F.lower(F.regexp_replace("name", "@.*", "")).alias("name"), F.col("mean").cast("double").alias("mean"), F.col("samples").cast("long").alias("samples"))
            means = m if means is None else means.unionByName(m)
    if judge_scores is not None:
        m = judge_scores.agg((F.avg("overall") / 10).alias("mean"), F.count(F.lit(1)).alias("samples")).where("samples > 0")
        m = m.select(F.lit("judge").alias("part"), F.lit("judge").alias("name"), "mean", "samples")
        means = m if means is None else means.unionByName(m)
    if means is None:
        means = spark.createDataFrame([], "part string, name string, mean double, samples long")
    rules = spark.createDataFrame([(i, *x) for i, x in enumerate(ADVICE)], "i int, part string, name string, least double, advice string")
    due = means.join(F.broadcast(rules), ["part", "name"]).where("mean < least").groupBy("i").agg(F.first("advice").alias("advice"))
    due = due.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "advice"))), lambda x: x["advice"]).alias("recommendations"))
    samples = means.groupBy("part").agg(F.max("samples").alias("samples")).agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"))
    r = means.agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("overall")).crossJoin(samples).crossJoin(due)
    if judge_scores is not None:
        d = judge_scores.select(F.explode("scores").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v"))
        r = r.crossJoin(d.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("judge_scores")))
    if ab is not None:
        r = r.crossJoin(ab.select(F.struct("*").alias("ab")))
    advice = F.when(F.size("recommendations") > 0, F.col("recommendations")).otherwise(F.array(F.lit(NO_ADVICE)))
    return r.withColumn("verdict", verdict(F.col("overall"))).withColumn("recommendations", advice)


def satisfaction(thumbs_up: Column, follow_up: Column, source_click: Column, dwell: Column) -> Column:
    """0.4 for a thumb up, -0.3 for a follow-up, 0.15 for a source click and for over 30 s, kept within 0..1."""
    flag = lambda c: F.coalesce(c.cast("boolean"), F.lit(False)).cast("double")
    s = 0.4 * flag(thumbs_up) - 0.3 * flag(follow_up) + 0.15 * flag(source_click) + 0.15 * flag(dwell > 30)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def _erf(x: Column) -> Column:
    """Polynomial approximation of the error function for x >= 0 (error under 2e-7); coefficients are fixed values."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 1 - poly * F.exp(-x * x)


def ab_test(events: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row from events (group A or B, satisfaction): counts, means, z, p_value, p_value_exact, significant, winner.

    p_value keeps the definition 2 * (1 - (1 + erf(|z|)) / 2) that is matched; p_value_exact takes
    erf(|z| / sqrt(2)). Under two events in a group: a tie. Groups without variance and with different
    means are told apart.
    """
    g = events.groupBy().agg(
        *[
            f(F.when(F.col("group") == n, F.col("satisfaction"))).alias(f"{name}_{n.lower()}")
            for n in ("A", "B")
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    se2 = F.coalesce(F.col("var_a"), F.lit(0.0)) / F.greatest("n_a", F.lit(1)) + F.coalesce(F.col("var_b"), F.lit(0.0)) / F.greatest("n_b", F.lit(1))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    diff = F.coalesce(F.col("mean_a") - F.col("mean_b"), F.lit(0.0))
    g = g.withColumn("z", F.when(enough & (se2 > 0), diff / F.sqrt(F.when(se2 > 0, se2))).otherwise(0.0))
    flat = enough & (se2 == 0) & (diff != 0)
    z = F.abs("z")
    p = lambda e: F.when(flat, 0.0).when(enough, 1 - e).otherwise(1.0)
    g = g.withColumn("p_value", p(_erf(z))).withColumn("p_value_exact", p(_erf(z / F.sqrt(F.lit(2.0)))))
    g = g.withColumn("significant", enough & (F.col("p_value") < 1 - confidence))
    return g.withColumn("winner", F.when(~F.col("significant"), "tie").when(diff > 0, "A").otherwise("B"))


def run_benchmark(samples: DataFrame, retrieve, truth: DataFrame, ks: tuple[int, ...] = (10,)) -> tuple[DataFrame, DataFrame]:
    """(per-sample scores in long form, their statistics) of a retriever over all samples in one job."""
    results = retrieve(samples).persist()
    out = None
    for k in ks:
        m = retrieval_metrics(samples, results, truth, k).join(ndcg(samples, results, truth, k).select("query_id", "ndcg"), "query_id")
        s = long_form(m, ["recall", "precision", "reciprocal_rank", "ndcg"], f"@{k}")
        out = s if out is None else out.unionByName(s)
    return out, metric_stats(out)


def run_generation_benchmark(samples: DataFrame, evaluators: dict[str, Callable[[Column, Column, Column], Column]], sample_id: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(per-sample scores in long form, their statistics) of answers against references.

    samples: (id, answer, reference[, contexts]); contexts, an array, reach an evaluator as one text.
    `evaluators`: name -> function of the columns answer, reference and context that gives a score.
    """
    context = F.array_join("contexts", "\n---\n") if "contexts" in samples.columns else F.lit(None).cast("string")
    wide = samples.select(F.col(sample_id).alias("query_id"), *[f(F.col("answer"), F.col("reference"), context).cast("double").alias(n) for n, f in evaluators.items()])
    out = long_form(wide, list(evaluators))
    return out, metric_stats(out)
