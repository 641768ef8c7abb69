"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are put in one order. The smallest shard capacity for which a greedy
left-to-right filling needs at most `n_shards` shards is found by binary search, and the
order is cut where that filling cuts. Sizes of all groups never meet in one place: the
driver holds sums over ranges of the order and asks for finer ones only where the search
cannot yet tell on which side of a cut they fall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scale import gapless_rank, materialize, parts, text_or_empty

KEY_BITS = 62
FIRST_BITS = 14
STEP_BITS = 8
#: A group over this part of a shard's mean share is placed on its own, ahead of the others.
LARGE_PART = 256
WHOLE_AT = 64


@dataclass
class Ranges:
    """Consecutive ranges of the key order: first key, key bits below it, bytes, groups."""

    start: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray

    def take(self, keep: np.ndarray) -> Ranges:
        return Ranges(self.start[keep], self.bits[keep], self.size[keep], self.groups[keep])


def _reach(ends: np.ndarray, exact: np.ndarray, at: float, capacity: float, low: bool) -> float:
    """End of the shard that starts at `at`: the last group end within the capacity.

    Inside a range of several groups only bounds are known: its start (`low`) or the target.
    """
    target = at + capacity
    i = int(np.searchsorted(ends, target, side="right"))
    last = ends[i - 1] if i else 0
    if i == len(ends) or exact[i] or low:
        return max(last, at)
    return target


def _chain(r: Ranges, n_shards: int, capacity: int, low: bool) -> np.ndarray:
    """Ends of the shards of a greedy filling, as bounds from below or above."""
    ends, exact = np.cumsum(r.size), r.groups <= 1
    out, at = [], 0
    for _ in range(n_shards):
        at = _reach(ends, exact, at, capacity, low)
        out.append(at)
    return np.array(out)


def smallest_capacity(r: Ranges, n_shards: int) -> tuple[int, int, np.ndarray]:
    """(largest capacity known to fail + 1, smallest known to do, ranges to resolve)."""
    total = int(r.size.sum())
    lo = max(-(-total // n_shards), int(r.size[r.groups <= 1].max(initial=0)), 1)

    def least(low: bool) -> int:
        a, b = lo, max(total, lo)
        while a < b:
            mid = (a + b) // 2
            if _chain(r, n_shards, mid, low)[-1] >= total:
                b = mid
            else:
                a = mid + 1
        return a

    can, sure = least(False), least(True)
    ends = np.cumsum(r.size)
    starts = ends - r.size
    open_ = np.zeros(len(ends), bool)
    for x, y in zip(np.r_[0, _chain(r, n_shards, can, True)] + can, np.r_[0, _chain(r, n_shards, sure, False)] + sure):
        open_ |= (ends > x) & (starts <= y)
    return can, sure, np.flatnonzero(open_ & (r.groups > 1))


def _refine(small: DataFrame, r: Ranges, which: np.ndarray) -> Ranges:
    """Split the ranges `which` by their next key bits; one aggregate of at most a few
    thousand rows reaches the driver."""
    spark = small.sparkSession
    step = [(int(r.start[i]), int(r.bits[i]), 0 if r.groups[i] <= WHOLE_AT else max(0, int(r.bits[i]) - STEP_BITS)) for i in which]
    # ranges are prefixes; look their keys up by prefix, one equality a prefix length
    found = []
    for bits in sorted({b for _, b, _ in step}):
        own = [(s, t) for s, b, t in step if b == bits]
        table = spark.createDataFrame([(s >> bits, t) for s, t in own], "p long, t int")
        found.append(
            small.withColumn("p", F.shiftright("key", bits)).join(F.broadcast(table), "p").select(
                F.expr("shiftleft(shiftright(key, t), t)").alias("start"), F.col("t").alias("bits"), "bytes", "key"
            )
        )
    df = found[0]
    for x in found[1:]:
        df = df.unionByName(x)
    new = df.groupBy("start", "bits").agg(F.sum("bytes").alias("size"), F.countDistinct("key").alias("groups")).collect()
    keep = np.ones(len(r.start), bool)
    keep[which] = False
    old = r.take(keep)
    start = np.r_[old.start, np.array([x["start"] for x in new], np.int64)]
    o = np.argsort(start, kind="stable")
    cat = lambda a, k: np.r_[a, np.array([x[k] for x in new], np.int64)][o]
    return Ranges(start[o], cat(old.bits, "bits"), cat(old.size, "size"), cat(old.groups, "groups"))


def minimax_cuts(small: DataFrame, large: list[int], n_shards: int) -> tuple[int, list[int], list[int]]:
    """Cut the order: `large` group sizes first, then the groups of `small` by key.

    `small`: (key long of KEY_BITS bits, bytes long), one row a group. Returns (capacity,
    shard of each large group, first keys of the shards that start among the small
    groups, as a list of (key, shard)). Large groups at or over the mean of what is left
    take a shard alone; else the capacity they force would empty the other shards.
    """
    bits = KEY_BITS - FIRST_BITS
    rows = (
        small.groupBy(F.shiftright("key", bits).alias("p"))
        .agg(F.sum("bytes").alias("size"), F.countDistinct("key").alias("groups"))
        .collect()
    )
    rows.sort(key=lambda x: x["p"])
    rest = sum(large) + sum(x["size"] for x in rows)
    own: list[int] = []
    while len(own) < len(large) and len(own) < n_shards - 1 and large[len(own)] * (n_shards - len(own)) >= rest:
        rest -= large[len(own)]
        own.append(len(own))
    left = large[len(own) :]
    r = Ranges(
        np.r_[np.arange(-len(left), 0), np.array([x["p"] << bits for x in rows], np.int64)].astype(np.int64),
        np.r_[np.zeros(len(left), np.int64), np.full(len(rows), bits)].astype(np.int64),
        np.r_[np.array(left, np.int64), np.array([x["size"] for x in rows], np.int64)].astype(np.int64),
        np.r_[np.ones(len(left), np.int64), np.array([x["groups"] for x in rows], np.int64)].astype(np.int64),
    )
    n = n_shards - len(own)
    while True:
        can, sure, which = smallest_capacity(r, n)
        if not len(which):
            break
        r = _refine(small, r, which)
    ends = _chain(r, n, sure, True)
    shard = np.searchsorted(ends, np.cumsum(r.size), side="left") + len(own)
    of_large = own + shard[: len(left)].tolist()
    firsts, seen = [], -1
    for k, s in zip(r.start[len(left) :].tolist(), shard[len(left) :].tolist()):
        if s != seen:
            firsts.append((k, s))
            seen = s
    return sure, of_large, firsts


def shard_documents(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, group_key, shard, slot, text_crc32 of every row of `docs`.

    size: UTF-8 bytes of the text, a null text has none, plus 1. Groups are equal texts (a
    null text groups with the empty one; two texts whose 62-bit keys agree also share a
    group) and stay in one shard, however large. slot numbers a shard's rows from 0 without
    gaps, in a shuffled but fixed order; repeated rows take consecutive slots. A null doc_id is a
    row like any other. Other columns are ignored. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    d = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.sha2(text.cast("binary"), 256)), 64 - KEY_BITS).alias("key"),
        ),
        "sizes",
    )
    total = d.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = materialize(d.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    bound = max(1, total // (n_shards * LARGE_PART))
    # at most n_shards * LARGE_PART groups can reach this size
    large = sorted(((x["bytes"], x["key"]) for x in groups.where(F.col("bytes") > bound).collect()), key=lambda x: (-x[0], x[1]))
    small = groups.where(F.col("bytes") <= bound)
    _, of_large, firsts = minimax_cuts(small, [b for b, _ in large], n_shards)
    shard: Column = F.lit(firsts[0][1] if firsts else 0)
    for k, s in firsts[1:]:
        shard = F.when(F.col("key") >= F.lit(k), F.lit(s)).otherwise(shard)
    table = d.sparkSession.createDataFrame([(k, s) for (_, k), s in zip(large, of_large)], "key long, own int")
    placed = d.join(F.broadcast(table), "key", "left").withColumn("shard", F.coalesce("own", shard).cast("int")).drop("own")
    return gapless_rank(placed, ["shard"], ["doc_id", "key"], max(1, 8 * parts(d.sparkSession) // n_shards), "slot")
