"""Exact dedup against a minimal perfect hash over the digests of earlier documents.

The history's distinct digests are dealt to shards by hash. Each shard is one row: a
three-way peeled hypergraph function (2-bit values plus ranks) that maps the shard's n
digests one-to-one onto n slots; a slot holds the full 32-byte digest, the locator of
the document that wins and the group's size. A lookup computes the slot and compares all
32 bytes, so it never takes a stranger for a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import materialize, parts, text_or_empty

INDEX = "shard int, seed long, n long, g binary, digests binary, winners binary, counts binary"
_M = np.uint64(0xFF51AFD7ED558CCD)


def _hashes(words: np.ndarray, seed: int) -> list[np.ndarray]:
    """Three 64-bit hashes of each row of `words` (n x 4 uint64: a digest)."""
    out = []
    with np.errstate(over="ignore"):
        for i in range(3):
            h = np.full(len(words), (seed * 3 + i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for j in range(words.shape[1]):
                h = (h ^ words[:, j]) * _M
                h ^= h >> np.uint64(32)
            out.append(h)
    return out


def _vertices(words: np.ndarray, seed: int, third: int) -> np.ndarray:
    """The edge of each digest: one vertex in each third of the table."""
    hs = _hashes(words, seed)
    return np.stack([(h % np.uint64(third)).astype(np.int64) + i * third for i, h in enumerate(hs)], axis=1)


def build_mph(words: np.ndarray) -> tuple[int, np.ndarray]:
    """(seed, g): g[v] in 0..2 says which vertex of an edge is its own, 3 that v is nobody's."""
    n = len(words)
    third = max(3, int(1.3 * n / 3) + 2)
    for seed in range(1, 1000):
        e = _vertices(words, seed, third)
        degree = np.bincount(e.ravel(), minlength=3 * third)
        xor = np.zeros(3 * third, np.int64)  # of the edges at a vertex; names the edge at degree 1
        for i in range(3):
            np.bitwise_xor.at(xor, e[:, i], np.arange(n))
        done, rounds = np.zeros(n, bool), []
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            own, first = np.unique(xor[ready], return_index=True)
            v = ready[first]
            rounds.append((own, v))
            done[own] = True
            for i in range(3):
                np.subtract.at(degree, e[own, i], 1)
                np.bitwise_xor.at(xor, e[own, i], own)
            near = np.unique(e[own].ravel())
            ready = near[degree[near] == 1]
        if done.all():
            g = np.full(3 * third, 3, np.uint8)
            for own, v in reversed(rounds):
                others = np.zeros(len(own), np.int64)
                place = np.zeros(len(own), np.int64)
                for i in range(3):
                    at = e[own, i]
                    mine = at == v
                    place[mine] = i
                    others += np.where(mine | (g[at] == 3), 0, g[at])
                g[v] = (place - others) % 3
            return seed, g
    raise RuntimeError("no peelable seed: the digests are not distinct")


def mph_slots(words: np.ndarray, seed: int, g: np.ndarray) -> np.ndarray:
    """Slot of each digest; digests outside the history get an arbitrary slot or one past the end."""
    e = _vertices(words, seed, len(g) // 3)
    vals = g[e]
    pick = np.where(vals == 3, 0, vals).sum(axis=1) % 3
    v = e[np.arange(len(e)), pick]
    rank = np.concatenate([[0], np.cumsum(g != 3)])
    return rank[v]


def _words(digests: list[bytes] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of each whole text's UTF-8 bytes; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"))


def _winners(d: DataFrame) -> DataFrame:
    return d.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def _sharded(d: DataFrame, shards: int) -> DataFrame:
    return d.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """Index rows (see INDEX) over a history of (doc_id, digest): one row a non-empty shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(list(pdf["digest"]))
        seed, g = build_mph(words)
        order = np.empty(len(words), np.int64)
        order[mph_slots(words, seed, g)] = np.arange(len(words))
        ids = pdf["winner"].fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
        return pd.DataFrame(
            {
                "shard": [int(pdf["shard"].iloc[0])],
                "seed": [seed],
                "n": [len(words)],
                "g": [g.tobytes()],
                "digests": [words[order].tobytes()],
                "winners": [ids[order].tobytes()],
                "counts": [pdf["n"].to_numpy().astype(np.int64)[order].tobytes()],
            }
        )

    return _sharded(_winners(history), shards).groupBy("shard").applyInPandas(build, INDEX)


def lookup(index: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, n, old_winner, old_n) for distinct incoming digests.

    old_n is 0 for digests the history lacks; those keep the incoming winner.
    """

    def probe(idx: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = new[["digest", "winner", "n"]].copy()
        old_w, old_n = np.full(len(new), np.iinfo(np.int64).min), np.zeros(len(new), np.int64)
        if len(idx) and len(new):
            row = idx.iloc[0]
            g, table = np.frombuffer(row["g"], np.uint8), np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
            words = _words(list(new["digest"]))
            slot = np.minimum(mph_slots(words, int(row["seed"]), g), int(row["n"]) - 1)
            hit = (table[slot] == words).all(axis=1)
            old_w[hit] = np.frombuffer(row["winners"], "<i8")[slot[hit]]
            old_n[hit] = np.frombuffer(row["counts"], "<i8")[slot[hit]]
        out["old_winner"] = pd.Series(old_w, index=out.index).astype("Int64").where(old_w != np.iinfo(np.int64).min)
        out["old_n"] = old_n
        out["winner"] = out["winner"].astype("Int64")
        return out

    new = _sharded(_winners(incoming), shards)
    return (
        index.groupBy("shard")
        .cogroup(new.groupBy("shard"))
        .applyInPandas(probe, "digest binary, winner long, n long, old_winner long, old_n long")
    )


def exact_dedup(
    docs: DataFrame, is_history=None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    `is_history` (a Column over `docs`) marks the documents of earlier batches, whose
    digests are indexed; the others look themselves up. Without it the lower half of the id
    range is the history. Of equal texts the largest doc_id stays, wherever it came from.
    A null text equals an empty one. A null doc_id loses to any other; if a group has no
    other, keep_id is null and its rows stay. Rows repeating a winning doc_id with its
    text are one document and all stay. Other columns of `docs` are ignored, so clashing
    names do no harm. An empty table gives no rows.
    """
    spark = docs.sparkSession
    if is_history is None:
        lo, hi = docs.agg(F.min(id_col), F.max(id_col)).first()
        is_history = F.coalesce(F.col(id_col) < F.lit(((lo or 0) + (hi or 0)) // 2), F.lit(True))
    old = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), is_history.alias("old"))
    d = materialize(
        old.select("doc_id", "old", F.unhex(F.sha2(text_or_empty("text").cast("binary"), 256)).alias("digest")), "digests"
    )
    shards = shards or max(parts(spark), d.count() // 1_000_000 + 1)
    history, incoming = d.where("old"), d.where("not old")
    index = materialize(build_index(history, shards), "mph")
    met = materialize(lookup(index, incoming, shards), "lookups")
    repeats = met.where("old_n > 0").select(
        "digest", F.greatest("winner", "old_winner").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("group_size")
    )
    strangers = met.where("old_n = 0").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))
    untouched = _winners(history).join(met.where("old_n > 0").select("digest"), "digest", "left_anti").select(
        "digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size")
    )
    groups = repeats.unionByName(strangers).unionByName(untouched)
    return d.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.expr("doc_id <=> keep_id").alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
