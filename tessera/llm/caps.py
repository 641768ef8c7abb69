"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter direction is a product of one random codeword for each of two halves of the
(randomly rotated) space, so c codewords a half make c * c directions, and the directions
whose cap holds a vector can be listed from two short lists of inner products without
looking at the others. A vector's caps are all directions whose inner product with it
exceeds a threshold: its largest one less `SLACK / sqrt(dimension)`, so that no vector is without a cap.
The number of codewords follows from the number of vectors, so that a direction holds some hundreds
of them at any size. Vectors that share a direction and a label meet and are verified in
double precision. A pair that shares several directions counts at the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import connected_components, materialize, parts

#: Inner products of a vector and its neighbour at cosine 0.98 differ by about this / sqrt(dimension) at most.
SLACK = 0.36
TABLES = 1
THRESHOLD = 0.98
#: Members that a direction is meant to have, if vectors lie evenly.
MEMBERS = 512
#: Members of a direction that meet in one block; larger directions are split into blocks.
BLOCK = 256
#: Blocks up to which a larger direction gets more blocks rather than larger ones, and the largest block.
MANY_BLOCKS, MAX_BLOCK = 64, 16_384
#: Over-full directions up to which their table is sent to every task (a row is 16 bytes).
FEW_FULL = 1_000_000
_SMALL = 48
_SEED = 20240711
#: Fills up lists of directions; no direction has it.
_PAD = np.int32((1 << 31) - 1)
#: Rows that a task gathers before it compares the groups among them.
_SLICE = 20_000


@lru_cache(maxsize=8)
def code(dim: int, table: int, codewords: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(rotation, codewords of each half): the same on every machine."""
    rng = np.random.default_rng([_SEED, dim, table])
    rotation, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    halves = [h for h in np.array_split(np.arange(dim), 2) if len(h)]
    words = []
    for h in halves:
        # few dimensions have few directions that differ much
        n = min(codewords, 2 * 4 ** min(len(h) - 1, 16))
        w = rng.standard_normal((n, len(h))) if len(h) > 1 else np.array([[1.0], [-1.0]])
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(halves)))
    return rotation, tuple(words)


def list_decode(x: np.ndarray, table: int, codewords: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction within `slack` of the row's best. x: unit rows."""
    rotation, words = code(x.shape[1], table, codewords)
    y = x @ rotation
    rows, dirs = [], []
    at, short = 0, []
    for w in words:
        s = y[:, at : at + w.shape[1]] @ w.T
        at += w.shape[1]
        short.append(s.max(axis=1, keepdims=True) - s)
    first = [np.flatnonzero(r <= slack) for r in short[0]]
    for i, a in enumerate(first):
        if len(short) == 1:
            f = a
        else:
            b = np.flatnonzero(short[1][i] <= slack)
            ok = short[0][i][a][:, None] + short[1][i][b][None, :] <= slack
            f = (a[:, None] * len(words[1]) + b[None, :])[ok]
        rows.append(np.full(len(f), i))
        dirs.append(f + table * codewords * codewords)
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(dirs) if dirs else np.zeros(0, int)


def _prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, key, label, vec): vec is null for rows that link with nothing."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, keys = [], []
            for i, v, lab in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = None
                if v.is_valid and lab is not None and i is not None and not v.values.null_count:
                    a = v.values.to_numpy(zero_copy_only=False).astype(dtype)
                    wide = a.astype(float)
                    if len(a) and np.isfinite(wide).all() and wide.any() and np.isfinite(wide @ wide) and wide @ wide > 0:
                        raw = (a + np.zeros(1, dtype)).tobytes()  # -0.0 becomes 0.0
                vecs.append(raw)
                keys.append(raw and hashlib.sha256(f"{lab}:".encode() + raw).digest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), b.column(2), pa.array(vecs, pa.binary())], ["vec_id", "key", "label", "vec"]
            )

    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    return d.mapInArrow(run, "vec_id long, key binary, label string, vec binary"), dtype


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def _compare(t: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, new links, root row) of a task's rows, which are sorted by group."""
    n = len(t["id"])
    links = np.zeros(n, np.int64)
    start = np.flatnonzero(np.r_[True, t["group"][1:] != t["group"][:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[start, n])
    la, lb = [], []

    def earlier(i: np.ndarray, j: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Whether rows i and j share a direction before f."""
        p, q = t["dirs"][i], t["dirs"][j]
        return ((p[:, :, None] == q[:, None, :]) & (p[:, :, None] < f[:, None, None])).any(axis=(1, 2))

    small = (size > 1) & (size <= _SMALL)
    for s in range(2, _SMALL + 1):
        st = start[small & (size == s)]
        if not len(st):
            continue
        i0, j0 = np.triu_indices(s, 1)
        for c in range(0, len(st), max(1, 200_000 // len(i0))):
            base = st[c : c + max(1, 200_000 // len(i0))]
            i, j = (base[:, None] + i0).ravel(), (base[:, None] + j0).ravel()
            ok = (np.einsum("ij,ij->i", t["x"][i], t["x"][j]) >= threshold) & t["meet"](i, j)
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 20_000):
                a, b = i[k : k + 20_000], j[k : k + 20_000]
                la.append(a)
                lb.append(b)
                new = ~earlier(a, b, t["dir"][a])
                np.add.at(links, a[new], t["n"][b[new]])
                np.add.at(links, b[new], t["n"][a[new]])
    for s, k in zip(start[size > _SMALL], size[size > _SMALL]):
        e, f = s + k, t["dir"][s]
        x, dirs = t["x"][s:e], t["dirs"][s:e]
        known = np.unique(dirs[dirs < f])
        member = np.zeros((k, len(known)), np.float32)
        r, c = np.nonzero(dirs < f)
        member[r, np.searchsorted(known, dirs[r, c])] = 1
        root = np.arange(k)
        for lo, to in ((a, b) for a in range(0, k, 1024) for b in range(0, k, 4096)):
            hi, end = min(lo + 1024, k), min(to + 4096, k)
            hit = x[lo:hi] @ x[to:end].T >= threshold
            hit &= t["meet"](np.arange(s + lo, s + hi)[:, None], np.arange(s + to, s + end)[None, :])
            own = np.arange(max(lo, to), max(max(lo, to), min(hi, end)))
            hit[own - lo, own - to] = False
            new = hit & ~(member[lo:hi] @ member[to:end].T > 0)
            links[s + lo : s + hi] += new @ t["n"][s + to : s + end]
            # a spanning set: each row to the lowest it touches, and rows that share one are joined by it
            rows, cols = np.nonzero(hit)
            lab = _roots(np.r_[rows + lo, np.arange(k)], np.r_[cols + to, root], k)
            root = lab
        moved = np.flatnonzero(root != np.arange(k))
        la.append(moved + s)
        lb.append(root[moved] + s)
    # rows of one vector in different groups are one node
    ids, node = np.unique(t["id"], return_inverse=True)
    a = np.concatenate(la) if la else np.zeros(0, int)
    b = np.concatenate(lb) if lb else np.zeros(0, int)
    root = ids[_roots(node[a], node[b], len(ids))]
    total = np.bincount(node, links, minlength=len(ids)).astype(np.int64)
    return ids, total, root


def codewords_for(vectors: int) -> int:
    """Codewords of each half for so many vectors of a label: a power of two, 8 to 4,096."""
    c = 8
    while c < 4096 and c * c * MEMBERS < 4 * vectors:
        c *= 2
    return c


def _decoded(raw: list[np.ndarray], tables: int, codewords: int, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, their directions in order, dimension) for each dimension."""
    dims = np.array([len(v) for v in raw])
    for d in np.unique(dims):
        pick = np.flatnonzero(dims == d)
        x = np.stack([raw[i] for i in pick])
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        rows, dirs = (np.concatenate(c) for c in zip(*(list_decode(x, t, codewords, slack / np.sqrt(d)) for t in range(tables))))
        o = np.lexsort((dirs, rows))
        yield pick[rows[o]], dirs[o].astype("<i4"), int(d)


def cap_links(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    codewords: int | None = None,
    slack: float = SLACK,
    tables: int = TABLES,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors`.

    Rows of equal, non-null labels are linked if their cosine is at least `threshold`;
    n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable. Rows that are null, zero or hold null or non-finite components, and rows
    without a label or id, link with nothing. Only vectors of one length are compared.
    Equal vectors of a label are one node with a count, so copies are never paired, yet
    counted. Other columns are ignored. An empty table gives no rows.

    `codewords` default to `codewords_for` the largest label. Recall depends on `slack`: with the
    default a pair at cosine 0.98 exactly is missed about once in 20,000 at 64 dimensions, nearer pairs less.
    """
    spark = vectors.sparkSession
    base, dtype = _prepare(vectors, id_col, vector_col, label_col)
    reps = base.where("vec is not null").groupBy("key").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    reps = materialize(reps, "vectors")
    if codewords is None:
        codewords = codewords_for(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0)

    def caps(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            raw = [np.frombuffer(v, dtype).astype(float) for v in b.column(3).to_pylist()]
            for row, dirs, d in _decoded(raw, tables, codewords, slack):
                take = pa.array(row)
                cols = [b.column(2).take(take), pa.array(np.full(len(row), d, np.int32)), pa.array(dirs)]
                names = ["label", "dim", "dir"]
                if whole:
                    cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
                    lists = [x.tobytes() for x in np.split(dirs, cuts[1:-1])]
                    own = pa.array(lists, pa.binary()).take(pa.array(np.repeat(np.arange(len(lists)), np.diff(cuts))))
                    cols, names = cols + [b.column(c).take(take) for c in (0, 1, 3)] + [own], names + ["id", "n", "vec", "dirs"]
                yield pa.RecordBatch.from_arrays(cols, names)

    listed = "label string, dim int, dir int"
    g = F.xxhash64("label", "dim", "dir").alias("g")
    source = reps.select("id", "n", "label", "vec")
    # directions with more members than a block, the only ones that need a look before vectors travel
    full = source.mapInArrow(lambda b: caps(b, False), listed).select(g).groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    wide = F.least(F.lit(MAX_BLOCK), F.greatest(F.lit(block), F.ceil(F.col("members") / MANY_BLOCKS)))
    full = materialize(full.where(F.col("members") > block).select("g", F.ceil(F.col("members") / wide).cast("int").alias("blocks")), "full")
    few = full.limit(FEW_FULL + 1).count() <= FEW_FULL
    rows = source.mapInArrow(lambda b: caps(b, True), listed + ", id long, n long, vec binary, dirs binary").select("id", "n", "vec", "dir", "dirs", g)
    rows = rows.join(F.broadcast(full) if few else full, "g", "left").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("case when blocks is null then array(cast(null as int)) else sequence(0, blocks - 1) end")))
    p, q = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select("id", "n", "vec", "dir", "dirs", "own", (p == q).alias("same"), F.xxhash64("g", p, q).alias("group"))

    def compared(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw, lists = t["vec"].to_pylist(), t["dirs"].to_pylist()
        # nulls: a direction that is not split, in which all meet
        own, same = t["own"].fill_null(-1).to_numpy(), t["same"].fill_null(True).to_numpy()
        length = np.array([len(v) for v in raw])
        for k in np.unique(length):
            pick = np.flatnonzero(length == k)
            x = np.frombuffer(b"".join(raw[i] for i in pick), dtype).reshape(len(pick), -1).astype(float)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            dirs = np.full((len(pick), max(len(lists[i]) for i in pick) // 4), _PAD)
            for r, i in enumerate(pick):
                dirs[r, : len(lists[i]) // 4] = np.frombuffer(lists[i], "<i4")
            o, s = own[pick], same[pick]
            part = {c: t[c].to_numpy()[pick] for c in ("id", "n", "group", "dir")}
            yield _compare(part | {"dirs": dirs, "x": x, "meet": lambda i, j, o=o, s=s: s[i] | (o[i] != o[j])}, threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups are worked on as soon as there are enough rows."""

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for ids, links, roots in compared(t):
                use = (links > 0) | (ids != roots)
                yield pa.RecordBatch.from_arrays([pa.array(c[use], pa.int64()) for c in (ids, links, roots)], ["id", "links", "root"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _SLICE:
                t = pa.Table.from_batches(held)
                group = t["group"].to_numpy()
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield from done(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), len(t) - cut
        if n:
            yield from done(pa.Table.from_batches(held))

    met = rows.repartition(parts(spark), "group").sortWithinPartitions("group")
    found = materialize(met.mapInArrow(compare, "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("id != root"), "id", "root")
    of = (
        reps.select("key", "id", "n")
        .join(counts, "id", "left")
        .join(comps, F.col("id") == F.col("node"), "left")
        .select("key", F.coalesce("component", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("l"))
    )
    # rows that link with nothing have keys of their own, so that they do not meet in one task
    own = base.select("vec_id", F.coalesce("key", F.hex(F.xxhash64("vec_id")).cast("binary")).alias("key"))
    return own.join(of, "key", "left").select(
        "vec_id",
        F.coalesce("l", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        F.expr("vec_id <=> coalesce(c, vec_id)").alias("kept"),
    )
