"""Prompts, answers, citations, grounding and consistency, over batches of questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from .providers import chat_column, json_body


def ranked():
    """Each query's results in rank order."""
    return W.partitionBy("query_id").orderBy("rank")


@dataclass(frozen=True)
class PromptTemplate:
    """A system text and a user text with {query}, {context} and {sourceCount}."""

    system: str
    user: str


_SOURCES = "参考资料（共 {sourceCount} 条）：\n{context}\n\n用户问题：{query}"
#: Preset texts, fixed values.
TEMPLATES = {
    "default": PromptTemplate("你是一个知识库助手。请根据提供的参考资料回答用户问题。如果参考资料不足以回答，请明确说明。", _SOURCES),
    "strict": PromptTemplate(
        '你是一个严谨的知识库助手。你必须严格基于提供的参考资料回答问题，不得添加任何参考资料之外的信息。如果资料不足以回答，请回答"根据现有资料无法回答此问题"。',
        _SOURCES,
    ),
    "citation": PromptTemplate(
        "你是一个知识库助手。请根据参考资料回答问题，并在答案中用 [1]、[2] 等标记引用来源。每条引用对应参考资料中的编号。",
        _SOURCES + "\n\n请在答案中使用 [1]、[2] 等标记标注引用来源。",
    ),
}
#: Answer where nothing was found, fixed value.
NO_SOURCES = "抱歉，无法找到与您问题相关的信息。"


def build_context(results: DataFrame, max_length: int | None = None, content: str = "content") -> DataFrame:
    """(query_id, context, source_count): "[i] content" by rank, an empty line between.

    With `max_length`, counted without separators, the source that does not fit is cut and
    marked with ... if more than its number fits, and nothing follows it.
    """
    d = results.withColumn("_i", F.row_number().over(ranked()))
    prefix = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "))
    d = d.withColumn("_p", F.length(prefix)).withColumn("_t", F.concat(prefix, F.coalesce(F.col(content), F.lit(""))))
    text = F.col("_t")
    if max_length:
        d = d.withColumn("_end", F.sum(F.length("_t")).over(ranked().rowsBetween(W.unboundedPreceding, 0)))
        room = F.lit(max_length) - (F.col("_end") - F.length("_t"))
        cut = F.when((room > F.col("_p")), F.concat(F.substr("_t", F.lit(1), room.cast("int")), F.lit("...")))
        # once one does not fit, sums stay above the limit: later rows have no room either
        first = F.min(F.when(F.col("_end") > max_length, F.col("_i"))).over(W.partitionBy("query_id"))
        text = F.when(F.col("_end") <= max_length, F.col("_t")).when(F.col("_i") == first, cut)
    g = d.withColumn("_x", text).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_x").isNotNull(), F.struct("_i", "_x")))).alias("_l"), F.count(F.lit(1)).alias("source_count")
    )
    return g.select("query_id", F.array_join("_l._x", "\n\n").alias("context"), "source_count")


def fill(template: str, values: dict[str, Column]) -> Column:
    """Placeholders filled in one pass: what is filled in is not looked at again."""
    import re

    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[values[p[1:-1]] if p[:1] == "{" and p[1:-1] in values else F.lit(p) for p in parts if p])


def prompts(queries: DataFrame, results: DataFrame, template: PromptTemplate | str = "default", max_length: int | None = None, text: str = "query") -> DataFrame:
    """queries plus context, source_count and messages (array of role and content)."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    d = queries.join(build_context(results, max_length), "query_id", "left")
    d = d.withColumn("context", F.coalesce("context", F.lit(""))).withColumn("source_count", F.coalesce("source_count", F.lit(0)))
    user = fill(t.user, {"query": F.col(text), "context": F.col("context"), "sourceCount": F.col("source_count").cast("string")})
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return d.withColumn("messages", F.array(message("system", F.lit(t.system)), message("user", user)))


def sources_of(results: DataFrame) -> DataFrame:
    """(query_id, sources): chunk, document and content of each result by rank."""
    cols = [c for c in ("rank", "chunk_id", "document_id", "content") if c in results.columns]
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("sources"))


def generate(queries: DataFrame, results: DataFrame, llm, template: PromptTemplate | str = "default", max_tokens: int | None = None, include_sources: bool = True, text: str = "query") -> DataFrame:
    """(query columns, answer, sources). Without results the answer is fixed and no model is asked."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    d = prompts(queries, results, t, max_tokens * 4 if max_tokens else None, text)
    ask = F.when(F.col("source_count") > 0, F.element_at("messages", 2)["content"])
    d = d.withColumn("answer", F.coalesce(tx.trim(chat_column(llm, ask, t.system)), F.when(F.col("source_count") == 0, F.lit(NO_SOURCES))))
    d = d.drop("messages", "context", "source_count")
    return d.join(sources_of(results), "query_id", "left") if include_sources else d


def cited_markers(answer: Column, count: Column) -> Column:
    """Numbers n of the marks [n] with 1 <= n <= count, each once, at their first place."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.filter(F.array_distinct(found), lambda x: (x >= 1) & (x <= count))


def parse_citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answers plus cited (numbers in order), cited_sources and source_list ("[n] first 100 characters...")."""
    s = sources_of(results)
    d = answers.join(s.withColumnRenamed("sources", "_s"), "query_id", "left")
    cited = F.array_sort(cited_markers(F.col("answer"), F.coalesce(F.size("_s"), F.lit(0))))
    d = d.withColumn("cited", F.coalesce(cited, F.array().cast("array<int>")))
    d = d.withColumn("cited_sources", F.transform("cited", lambda n: F.get(F.col("_s"), n - 1)))
    line = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.substr(F.get(F.col("_s.content"), n - 1), F.lit(1), F.lit(100)), F.lit("..."))
    return d.withColumn("source_list", F.array_join(F.transform("cited", line), "\n")).drop("_s")


_GROUNDING = T.StructType().add("isGrounded", "boolean").add("unsupportedClaims", T.ArrayType(T.StringType())).add("groundingScore", "double")


def parse_grounding(answer: Column) -> Column:
    """A verdict struct from a model's answer: as JSON, else its part from { to }, else not grounded at 0."""
    whole = F.from_json(json_body(answer), _GROUNDING)
    inner = F.from_json(F.regexp_extract(answer, r"(\{[\s\S]*\})", 1), _GROUNDING)
    ok = lambda s: F.when(s["isGrounded"].isNotNull() & s["groundingScore"].isNotNull() & s["unsupportedClaims"].isNotNull(), s)
    none = F.struct(F.lit(False).alias("isGrounded"), F.array().cast("array<string>").alias("unsupportedClaims"), F.lit(0.0).alias("groundingScore"))
    return F.coalesce(ok(whole), ok(inner), none)


def grounded(queries: DataFrame, results: DataFrame, llm, max_tokens: int | None = None, text: str = "query") -> DataFrame:
    """Answers by the strict template, each with a verdict on how far the sources carry it."""
    d = generate(queries, results, llm, "strict", max_tokens, True, text).join(build_context(results), "query_id", "left")
    ask = F.concat(F.lit("请检查回答是否完全由资料支持，以 JSON 返回 isGrounded、unsupportedClaims、groundingScore。\n资料：\n"), F.coalesce("context", F.lit("")), F.lit("\n回答：\n"), F.coalesce("answer", F.lit("")))
    return d.withColumn("verification", parse_grounding(F.coalesce(chat_column(llm, ask), F.lit("")))).drop("context", "source_count")


def yes(c: Column) -> Column:
    """True or false as a model says it; null where it does not answer."""
    a = F.lower(tx.trim(c))
    return F.when(a.startswith("yes") | a.startswith("true") | a.startswith("是"), True).when(F.length(a) > 0, False)


def self_rag(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], llm, max_rounds: int = 3, text: str = "query") -> DataFrame:
    """(query_id, answer, rounds, needed, relevant, supported).

    Each question is first asked whether it needs sources. Then up to `max_rounds` passes:
    generate, stop if the sources are not relevant, else stop if they support the answer.
    A pass takes only what is still open. A reflection that fails counts as passed.
    """
    d = queries.withColumn("needed", F.coalesce(yes(chat_column(llm, F.concat(F.lit("是否需要检索？yes / no\n"), F.col(text)))), F.lit(True)))
    # decided once: later branches must see the same answers
    d = d.persist()
    hits = retrieve(d.where("needed"))
    open_, done = d.select("query_id", text, "needed"), None
    for i in range(1, max_rounds + 1):
        a = generate(open_, hits, llm, "default", None, False, text).join(build_context(hits).select("query_id", "context"), "query_id", "left")
        a = a.withColumn("answer", F.coalesce("answer", F.lit("")))
        rel = chat_column(llm, F.concat(F.lit("资料是否相关？yes / no\n"), F.coalesce("context", F.lit("")), F.lit("\n"), F.col(text)))
        sup = chat_column(llm, F.concat(F.lit("资料是否支持回答？yes / no\n"), F.coalesce("context", F.lit("")), F.lit("\n"), F.col("answer")))
        a = a.withColumn("relevant", F.coalesce(yes(rel), F.lit(True))).withColumn("supported", F.coalesce(yes(sup), F.lit(True)))
        a = a.withColumn("rounds", F.lit(i)).persist()
        ends = (~F.col("needed")) | (~F.col("relevant")) | F.col("supported") | F.lit(i == max_rounds)
        got = a.where(ends).select("query_id", "answer", "rounds", "needed", "relevant", "supported")
        done = got if done is None else done.unionByName(got)
        open_ = a.where(~ends).select("query_id", text, "needed")
    return done


def majority(answers: DataFrame, answer: str = "answer", order: str = "round") -> DataFrame:
    """(query_id, answer, votes, rounds, score): the most frequent answer, the first on a tie."""
    g = answers.groupBy("query_id", F.col(answer).alias("answer")).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    total = F.sum("votes").over(W.partitionBy("query_id"))
    w = W.partitionBy("query_id").orderBy(F.col("votes").desc(), "_first")
    d = g.withColumn("rounds", total).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return d.select("query_id", "answer", "votes", "rounds", (F.col("votes") / F.col("rounds")).alias("score"))


_CONSISTENCY = T.StructType().add("consistencyScore", "double").add("bestAnswer", "string").add("conflicts", T.ArrayType(T.StringType()))


def consistent(queries: DataFrame, results: DataFrame, llm, rounds: int = 3, text: str = "query", judge=None) -> DataFrame:
    """Several answers a question: (query_id, answer, votes, rounds, score, answers, conflicts).

    Answer and score are the majority's; a model as `judge` compares the answers instead and also names
    conflicts. Where its verdict cannot be read, or its score is not in 0..1, the majority stands.
    """
    base = prompts(queries, results, "default", None, text)
    d = base.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    ask = F.concat(F.element_at("messages", 2)["content"], F.lit("\n（第 "), F.col("round").cast("string"), F.lit(" 次）"))
    d = d.withColumn("answer", tx.trim(chat_column(llm, ask))).where("answer is not null").select("query_id", F.col(text).alias("_q"), "round", "answer")
    each = d.groupBy("query_id").agg(F.first("_q").alias("_q"), F.transform(F.array_sort(F.collect_list(F.struct("round", "answer"))), lambda x: x["answer"]).alias("answers"))
    out = majority(d).join(each, "query_id").withColumn("conflicts", F.array().cast("array<string>"))
    if judge is not None:
        listed = F.array_join(F.transform("answers", lambda x, i: F.concat(F.lit("答案 "), (i + 1).cast("string"), F.lit(":\n"), x)), "\n\n")
        ask = F.concat(F.lit("请对比以下针对同一问题多次生成的答案，以 JSON 返回 consistencyScore、bestAnswer、conflicts。\n问题："), F.col("_q"), F.lit("\n\n"), listed)
        out = out.withColumn("_j", F.from_json(json_body(chat_column(judge, ask)), _CONSISTENCY))
        ok = F.col("_j.consistencyScore").between(0, 1) & F.col("_j.bestAnswer").isNotNull() & F.col("_j.conflicts").isNotNull()
        for c, j in (("answer", "bestAnswer"), ("score", "consistencyScore"), ("conflicts", "conflicts")):
            out = out.withColumn(c, F.when(ok, F.col(f"_j.{j}")).otherwise(F.col(c)))
    return out.select("query_id", "answer", "votes", "rounds", "score", "answers", "conflicts")
