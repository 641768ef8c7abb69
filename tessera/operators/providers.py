"""Model providers: an embedding and a chat interface, offline defaults, optional HTTP ones.

Providers run inside Arrow UDFs, a batch of rows a call. The defaults need no network and
are deterministic, so every operator runs and can be tested anywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx


class JsonParseError(ValueError):
    """An answer that should be JSON and is not."""


class LLM:
    """Chat interface. Subclasses implement `complete`; messages are {role, content} dicts."""

    #: How JSON is asked for: by schema, as an object, or in the prompt alone.
    json_mode = "prompt_only"

    def complete(self, messages: Sequence[dict], **options) -> str:
        raise NotImplementedError

    def stream(self, messages: Sequence[dict], **options) -> Iterator[str]:
        """Pieces of the answer; one by one by character where there is nothing better."""
        yield from self.complete(messages, **options)

    def chat_json(self, messages: Sequence[dict], schema: dict | None = None, **options):
        """The answer parsed as JSON; code fences around it are tolerated."""
        if schema is not None and self.json_mode == "prompt_only":
            ask = {"role": "system", "content": "Answer with JSON only, after this schema:\n" + json.dumps(schema, ensure_ascii=False)}
            messages = [ask, *messages]
        elif schema is not None:
            options["response_format"] = {"type": self.json_mode, "schema": schema}
        answer = self.complete(messages, **options)
        try:
            return json.loads(strip_fence(answer))
        except ValueError as e:
            raise JsonParseError(answer[:200]) from e


def strip_fence(answer: str) -> str:
    m = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", answer, re.S)
    return m[1] if m else answer.strip()


@dataclass
class ScriptedLLM(LLM):
    """Answers from (pattern, answer) rules on the last message; for tests and fixed flows.

    An answer may be a callable of the prompt. Without a match it raises, as a failing service would.
    """

    rules: list[tuple[str, str | Callable[[str], str]]] = field(default_factory=list)

    def complete(self, messages: Sequence[dict], **options) -> str:
        prompt = messages[-1]["content"]
        for pattern, answer in self.rules:
            if re.search(pattern, prompt, re.S):
                return answer(prompt) if callable(answer) else answer
        raise RuntimeError("no rule for this prompt")


class ExtractiveLLM(LLM):
    """Returns the context sentence that shares most words with the question."""

    def complete(self, messages: Sequence[dict], **options) -> str:
        prompt = messages[-1]["content"]
        head, mark, question = prompt.rpartition("用户问题：")
        wanted = set(re.findall(r"\w+", (question if mark else prompt).lower()))
        parts = [s for s in re.split(r"(?<=[。！？.!?\n])\s*", head or prompt) if s.strip()]
        best = max(parts, key=lambda s: len(wanted & set(re.findall(r"\w+", s.lower()))), default="")
        return best.strip()


class Embedding:
    """Text -> vector. `batch` texts go into one call."""

    dimension = 64
    batch = 2048

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        raise NotImplementedError

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


@dataclass
class HashingEmbedding(Embedding):
    """Signed hashing of words into `dimension` slots, scaled to length one; no model needed."""

    dimension: int = 64
    pattern: str = r"\w+"

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        words = [re.findall(self.pattern, (t or "").lower()) for t in texts]
        h = np.fromiter((zlib.crc32(w.encode()) for ws in words for w in ws), np.uint32)
        at = np.repeat(np.arange(len(texts)), [len(ws) for ws in words]) * self.dimension + h % self.dimension
        # sums of ones and minus ones: exact in any order
        out = np.bincount(at, np.where(h >> 31, 1.0, -1.0), len(texts) * self.dimension).reshape(len(texts), self.dimension)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(n > 0, n, 1)).tolist()


@dataclass
class HttpProvider:
    """Address, key and model of a service; requests go out through urllib."""

    url: str
    api_key: str
    model: str
    headers: dict = field(default_factory=dict)
    timeout: float = 60.0

    def post(self, body: dict) -> dict:
        import urllib.request

        r = urllib.request.Request(
            self.url,
            json.dumps(body).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}", **self.headers},
        )
        with urllib.request.urlopen(r, timeout=self.timeout) as f:
            return json.load(f)


class HttpEmbedding(HttpProvider, Embedding):
    """Embeddings of a service that takes {model, input} and returns data[] with an index."""

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            got = self.post({"model": self.model, "input": list(texts[i : i + self.batch])})["data"]
            out += [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]
        return out


class HttpLLM(HttpProvider, LLM):
    """Chat of a service that takes {model, messages} and returns choices[]."""

    json_mode = "json_schema"

    def complete(self, messages: Sequence[dict], **options) -> str:
        return self.post({"model": self.model, "messages": list(messages), **options})["choices"][0]["message"]["content"]


class SystemFieldLLM(HttpProvider, LLM):
    """Chat of a service that takes the system text apart from the messages and needs max_tokens."""

    def complete(self, messages: Sequence[dict], max_tokens: int = 1024, **options) -> str:
        body = {"model": self.model, "max_tokens": max_tokens, "messages": [m for m in messages if m["role"] != "system"], **options}
        if system := "\n".join(m["content"] for m in messages if m["role"] == "system"):
            body["system"] = system
        return self.post(body)["content"][0]["text"]


def embed_column(embedding: Embedding, c: Column | str) -> Column:
    """Embeddings of a text column, by Arrow batches; null texts stay null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        have = texts.dropna()
        for i in range(0, len(have), embedding.batch):
            part = have.iloc[i : i + embedding.batch]
            for k, v in zip(part.index, embedding.embed_batch(part.tolist())):
                out[k] = v
        return out

    return run(F.col(c) if isinstance(c, str) else c)


def chat_column(llm: LLM, prompt: Column | str, system: str | None = None) -> Column:
    """Answers to a prompt column; null where a call fails, so that callers can fall back in SQL."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            try:
                lead = [{"role": "system", "content": system}] if system else []
                return llm.complete([*lead, {"role": "user", "content": p}])
            except Exception:
                return None

        return prompts.map(one)

    return run(F.col(prompt) if isinstance(prompt, str) else prompt)


def json_body(c: Column) -> Column:
    """The JSON text of an answer without code fences."""
    return tx.trim(F.regexp_replace(c, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def merge_roles(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations for services that want alternating roles, starting with a user.

    System rows and what comes before the first user go; neighbours of one role become one
    message, their texts joined by an empty line. Returns (conversation, turn, role, text).
    """
    w = W.partitionBy(conversation).orderBy(turn)
    m = messages.where("role != 'system'").withColumn("_user", F.max((F.col("role") == "user").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    m = m.where("_user = 1").withColumn("_new", (F.lag("role").over(w).isNull() | (F.lag("role").over(w) != F.col("role"))).cast("int"))
    m = m.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = m.groupBy(conversation, "_run").agg(
        F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct(turn, "text"))).alias("_t")
    )
    return g.select(conversation, (F.col("_run") - 1).alias(turn), "role", F.array_join("_t.text", "\n\n").alias("text"))
