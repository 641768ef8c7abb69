"""Packing token documents into windows by non-negative least squares.

Documents longer than a window give whole windows; what remains of each document is a
piece. Piece lengths, rounded up to a small unit, form a histogram. Combinations of up to
`depth` units that fill a window exactly are the columns of a least-squares problem whose
non-negative solution says how often to use each. The counts are rounded down to what the
histogram holds, and the pieces left over are packed greedily, best fit first, still as
counts. The plan is a function of the histogram, so its size depends on the window and
unit alone; pieces find their place in it by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._scale import gapless_rank, parts
from .tokens import encoder, tidy, tokenizer_path

WINDOW = 2048
UNIT = 8
END_ID = 1


def token_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode and cut: rows (doc_id, start, length, ids_crc32, doc_tokens, ids).

    Each document's ids, then `end_id`, are cut every `window` ids. ids are little-endian
    unsigned 32-bit integers. A null or empty text is its end id alone. A null doc_id and
    repeated rows are documents of their own. Without `with_ids` the last column is left
    out and never leaves the task.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc(text.as_py()) + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s : 4 * (s + window)]
                    out.append((i, s, len(piece) // 4, zlib.crc32(piece), n) + ((piece,) if with_ids else ()))
                    held += len(piece) * with_ids
                    if held > 1 << 24:
                        yield batch(out)
                        out, held = [], 0
            yield batch(out)

    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.binary()] * with_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(cut, encodes=True), schema)


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most `depth` (1 to 3) positive units that add up to `units`."""
    out: list[tuple[int, ...]] = [(units,)]
    if depth >= 2:
        out += [(units - b, b) for b in range(1, units // 2 + 1)]
    if depth >= 3:
        out += [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
    """min |a x - y| over x >= 0 by active sets; `rounds` bounds the columns taken in."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(y).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (y - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= 1e-7 * scale:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], y, rcond=None)[0]
            if s.min(initial=1) > 0:
                break
            old = x[p]
            bad = s <= 0
            step = np.min(old[bad] / np.maximum(old[bad] - s[bad], 1e-300))
            x[p] = old + step * (s - old)
            passive[p[(x[p] <= 1e-9 * scale) & bad]] = False
            x[~passive] = 0
        x[:] = 0
        x[p] = s
    return x


@dataclass
class Plan:
    """Rows (combination of units, times used), in sequence-id order."""

    rows: list[tuple[tuple[int, ...], int]]

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By unit: first rank, first sequence id and slot of each run of equal places."""
        used: dict[int, int] = {}
        out: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for combo, times in self.rows:
            for slot, u in enumerate(combo):
                out.setdefault(u, []).append((used.get(u, 0), first, slot))
                used[u] = used.get(u, 0) + times
            first += times
        return {u: tuple(np.array(c, np.int64) for c in zip(*runs)) for u, runs in out.items()}


def finish(avail: np.ndarray, room: int) -> tuple[int, ...] | None:
    """At most three lengths still available that add up to `room`, the most plentiful such choice."""
    if avail[room]:
        return (room,)
    best, found = 0, None
    for c in [0, *np.flatnonzero(avail[1 : room // 3 + 1]) + 1]:
        rest = room - int(c)
        a = np.arange(max(1, int(c)), rest // 2 + 1)
        if not len(a):
            continue
        many = np.minimum(avail[a], avail[rest - a])
        same = a == rest - a
        many[same] = avail[a[same]] // 2
        if c:
            many = np.minimum(many, avail[c])
            many[(a == c) & (avail[c] < 2) | same & (a == c) & (avail[c] < 3)] = 0
        j = int(np.argmax(many))
        if many[j] > best:
            best, found = int(many[j]), (rest - int(a[j]), int(a[j])) + ((int(c),) if c else ())
        if not c and found:
            break
    return found


def greedy(left: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left of a histogram: the longest piece first, then a choice of up to three
    lengths that fills the window exactly, or else the longest that fits, and again.

    Works on counts: each step is repeated until it has used up one of its lengths.
    left[u]: pieces of u units.
    """
    left, rows = left.copy(), []
    while left.any():
        avail, combo, room = left.copy(), [], units
        while room:
            last = finish(avail, room) if combo else None
            if last:
                combo += last
                break
            fits = np.flatnonzero(avail[: room + 1])
            if not len(fits):
                break
            combo.append(int(fits[-1]))
            avail[fits[-1]] -= 1
            room -= int(fits[-1])
        lengths, per = np.unique(combo, return_counts=True)
        times = int((left[lengths] // per).min())
        left[lengths] -= times * per
        rows.append((tuple(combo), times))
    return rows


def solve(histogram: dict[int, int], units: int, depth: int = 3) -> Plan:
    """Plan for a histogram of piece lengths in units (1 to `units`)."""
    left = np.zeros(units + 1, np.int64)
    for u, n in histogram.items():
        left[u] = n
    combos = combinations(units, depth)
    # a combination can only be used if its lengths occur
    combos = [c for c in combos if len(c) > 1 and all(left[u] for u in c)]
    rows: list[tuple[tuple[int, ...], int]] = [((units,), int(left[units]))] if left[units] else []
    left[units] = 0
    if combos:
        a = np.zeros((units + 1, len(combos)))
        for j, c in enumerate(combos):
            for u in c:
                a[u, j] += 1
        x = nnls(a, left.astype(float), rounds=2 * units)
        for j in np.argsort(-x, kind="stable"):
            times = int(x[j] + 0.5)
            for u in set(combos[j]):
                times = min(times, int(left[u]) // combos[j].count(u))
            if times <= 0:
                continue
            for u in combos[j]:
                left[u] -= times
            rows.append((combos[j], times))
    return Plan(rows + greedy(left, units))


def pack_pieces(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = 3) -> DataFrame:
    """`pieces` (doc_id, start, length, ...) plus sequence_id and offset.

    No sequence holds more than `window` ids; offsets in a sequence run from 0 without
    gaps. Sequence ids run from 0. Ties (pieces of one length) are told apart by a hash of
    (doc_id, start); repeated rows take separate places. An empty table gives no rows.
    `pieces` is read twice, so it should be a stored table.
    """
    units = window // unit
    p = pieces.withColumn("unit", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["unit"]: r["n"] for r in p.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(histogram.values())
    places = solve(histogram, units, depth).places()

    @F.pandas_udf("sequence_id long, slot int")
    def place(u: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, slot = np.zeros(len(u), np.int64), np.zeros(len(u), np.int32)
        uu, rr = u.to_numpy(), rank.to_numpy()
        for v in np.unique(uu):
            m = uu == v
            first, sid, sl = places[int(v)]
            i = np.searchsorted(first, rr[m], side="right") - 1
            seq[m], slot[m] = sid[i] + rr[m] - first[i], sl[i]
        return pd.DataFrame({"sequence_id": seq, "slot": slot})

    # buckets of an eighth of a task's share of all pieces, whatever the commonest length's share
    buckets = max(1, max(histogram.values(), default=0) * 8 * parts(pieces.sparkSession) // max(1, total))
    ranked = gapless_rank(p, ["unit"], ["doc_id", "start"], buckets, "rank").withColumn("at", place("unit", "rank"))
    w = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranked.withColumn("sequence_id", F.col("at.sequence_id"))
        .withColumn("slot", F.col("at.slot"))
        .withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
        .drop("at", "unit", "rank", "slot")
    )


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Packed pieces with ids -> (sequence_id, n_tokens, ids array padded to `window`, doc ids and
    offsets of the pieces). A sequence whose ids number a power of two is not padded."""

    @F.pandas_udf("array<long>")
    def join(parts: pd.Series) -> pd.Series:
        def one(ps) -> np.ndarray:
            ids = np.frombuffer(b"".join(x["ids"] for x in ps), "<u4")
            n = len(ids)
            return ids.astype(np.int64) if n & (n - 1) == 0 else np.pad(ids.astype(np.int64), (0, window - n), constant_values=pad_id)

        return parts.map(one)

    g = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("parts")
    )
    return g.select(
        "sequence_id",
        "n_tokens",
        join("parts").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
