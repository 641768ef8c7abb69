"""Repeated-passage removal with a sparse suffix array sorted by deep-shallow sorting.

Every string of `match` bytes is owned by one of its k-byte grams: the one whose hash is
smallest. The owner depends on the string alone, so equal strings have equal owners at
equal places, and only suffixes that start at owners (anchors), about one byte in
eighteen, have to be compared. Strings owned by one occurrence are a run; a run with its
bytes is the anchor's context.

1. Anchors meet by gram. Runs equal to one in a smaller document are repeated as a whole.
2. Contexts that are the smallest of their kind but share their gram with others are
   brought together by gram. Their suffixes are put in order by deep-shallow sorting, with
   np.lexsort of groups by eight-byte symbols in place of multikey quicksort to a shallow depth
   (one library call for all groups), then blind tries for groups that still agree. Neighbours' common prefixes give, for each string length right of the
   anchor, the classes of equal suffixes; with the bytes left of it, those of equal strings.
   A gram with more than HOT distinct contexts is hot: its contexts are sent string by string,
   each as a context of its own that is dealt by the string, and only the smallest document's
   of each document group, so that no task gets them all.
3. Each string whose class has a smaller document is removed.

Texts are stored once, bucketed by a document group, and never shuffled again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import materialize, new_path, parts, text_or_empty

MATCH = 50
GRAM = 16
SHALLOW = 24
_SEGMENT = 1 << 16
_CHUNK = 1 << 17
#: Bytes of text whose anchors a task holds before it hands them on.
_FLUSH = 1 << 25
#: Distinct contexts from which a gram's strings are dealt one by one.
HOT = 4_096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0x5851F42D4C957F2D
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value of each byte, powers of the base, their inverses), modulo 2**64."""
    n = _CHUNK + _SEGMENT + 2 * MATCH + 2
    inverse = pow(_BASE, -1, 1 << 64)
    power, back = np.ones(n, np.uint64), np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        power[1:], back[1:] = np.uint64(_BASE), np.uint64(inverse)
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    values = np.random.default_rng(20240613).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return values, power, back


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _32)
    h *= _ODD
    h ^= h >> np.uint64(29)
    h *= _ODD2
    h ^= h >> _32
    return h


class Anchors:
    """Anchors of some texts: text index, owner `at`, first and last string start, gram and context hashes."""

    def __init__(self, texts: list[bytes], match: int = MATCH, gram: int = GRAM):
        self.match, self.gram = match, gram
        out: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            # string starts are cut into fixed segments, so any length costs the same memory
            for s in range(0, len(t) - match + 1, _SEGMENT):
                piece = t[s : s + _SEGMENT + match - 1]
                if size + len(piece) > _CHUNK and held:
                    out.append(self._scan(held))
                    held, size = [], 0
                held.append((i, s, piece))
                size += len(piece)
        if held:
            out.append(self._scan(held))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.text, self.at, self.first, self.last, self.grams, self.context = cols

    def _scan(self, held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        values, power, back = _tables()
        buf = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        n, w = len(buf), self.match - self.gram + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values[buf] * power[:n], out=total[1:])
            m = n - self.gram + 1
            g = _mix((total[self.gram :] - total[:m]) * back[:m])
            low = (g & (_LOW << _32)) | np.arange(m, dtype=np.uint64)
            span = 1
            while span * 2 <= w:
                low = np.minimum(low[: len(low) - span], low[span:])
                span *= 2
            if span < w:
                low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
            owner = (low & _LOW).astype(np.int64)
            ends = np.cumsum([len(p) for _, _, p in held])
            for e in ends[:-1]:
                owner[max(0, e - self.match + 1) : e] = -1
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            last = np.r_[first[1:], len(owner)] - 1
            real = owner[first] >= 0
            first, last = first[real], last[real]
            at = owner[first]
            context = (total[last + self.match] - total[first]) * back[first]
            context = _mix(context + (at - first).astype(np.uint64) * _ODD + (last - first).astype(np.uint64) * _ODD2)
            grams = _mix(g[at] + _ODD)
        which = np.searchsorted(ends, first, side="right")
        starts = np.r_[0, ends[:-1]]
        shift = np.array([s for _, s, _ in held])[which] - starts[which]
        text = np.array([i for i, _, _ in held])[which]
        return text, at + shift, first + shift, last + shift, grams, context


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of distinct byte strings by a blind trie: nodes keep a depth and branch on the byte there.

    A string goes down by branch bytes alone, is compared once with a leaf it meets, and
    is hung in at the depth where they differ. A string that ends sorts first.
    """
    byte = lambda s, d: s[d] if d < len(s) else -1
    root: list | int = 0  # a leaf is an index; a node is [depth, {byte: child}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(byte(s, node[0]), next(iter(node[1].values())))
        other, d = strings[node], 0
        top = min(len(s), len(other))
        while d < top and s[d] == other[d]:
            d += 1
        above, node = None, root
        while not isinstance(node, int) and node[0] < d:
            above, node = node, node[1][byte(s, node[0])]
        if not isinstance(node, int) and node[0] == d:
            node[1][byte(s, d)] = i
            continue
        new = [d, {byte(s, d): i, byte(other, d): node}]
        if above is None:
            root = new
        else:
            above[1][byte(s, above[0])] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(buf: np.ndarray, starts: np.ndarray, limit: int, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the suffixes of `buf` at `starts` by their first `limit` bytes; equal ones in input order.

    np.lexsort refines groups down to `shallow`, where the method's own sort is multikey quicksort.
    `buf` must reach `limit` bytes past every start.
    """
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(buf, limit) if len(buf) >= limit else np.zeros((0, limit), np.uint8)
    live = np.arange(n)  # places in `order` that are not yet alone in their group
    for depth in range(0, min(shallow, limit), 8):
        if not len(live):
            return order
        width = min(8, limit - depth)
        symbol = np.zeros((len(live), 8), np.uint8)
        symbol[:, :width] = view[starts[order[live]], depth : depth + width]
        key = symbol.view(">u8").ravel().astype(np.uint64)
        o = np.lexsort((key, group[live]))
        order[live] = order[live[o]]
        key, g = key[o], group[live]
        new = np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1])]
        group[live] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.r_[new[1:], True]
        live = live[~alone]
    if not len(live):
        return order
    cuts = np.flatnonzero(np.r_[True, group[live][1:] != group[live][:-1]])
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(live)]):
        places = live[lo:hi]
        own = order[places]
        tails: dict[bytes, list[int]] = {}
        for i in own.tolist():
            tails.setdefault(buf[starts[i] + shallow : starts[i] + limit].tobytes(), []).append(i)
        distinct = list(tails)
        if len(distinct) > 1:
            order[places] = [i for k in blind_trie(distinct) for i in tails[distinct[k]]]
    return order


def common_prefixes(buf: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to `limit`, of each suffix in order with the one before; 0 for the first."""
    out = np.zeros(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(buf, limit) if len(buf) >= limit else None
    for lo in range(1, len(starts), 100_000):
        hi = min(lo + 100_000, len(starts))
        differ = view[starts[lo:hi]] != view[starts[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
    return out


def repeated_strings(
    contexts: list[bytes], place: np.ndarray, runs: np.ndarray, docs: np.ndarray, match: int = MATCH, gram: int = GRAM
) -> np.ndarray:
    """For each context a 64-bit mask: bit l set if the string that starts l bytes before the
    anchor also occurs in a context of a smaller document.

    place: the anchor's offset in the context; runs: strings it owns, from the context's start.
    """
    n = len(contexts)
    buf = np.frombuffer(b"".join(contexts) + b"\0" * match, np.uint8)
    size = np.array([len(c) for c in contexts])
    start = np.r_[0, np.cumsum(size)[:-1]] + place
    order = deep_shallow(buf, start, match)
    prefix = common_prefixes(buf, start[order], match)
    mask = np.zeros(n, np.uint64)
    # hashes of the l bytes left of the anchor, longer by one each round
    left = np.zeros(n, np.uint64)
    s_place, s_runs, s_docs, s_start = place[order], runs[order], docs[order], start[order]
    values, _, _ = _tables()
    with np.errstate(over="ignore"):
        for l in range(match - gram + 1):
            if l:
                reach = s_place >= l
                left[reach] = left[reach] * np.uint64(_BASE) + values[buf[s_start[reach] - l]]
            own = np.flatnonzero((s_place >= l) & (s_place - l < s_runs))
            if not len(own):
                continue
            right = np.cumsum(prefix < match - l)[own]
            key = _mix(left[own] + right.astype(np.uint64) * _ODD2)
            o = np.lexsort((s_docs[own], key))
            k, d = key[o], s_docs[own][o]
            head = np.r_[True, k[1:] != k[:-1]]
            least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
            hit = order[own[o[d > least]]]
            mask[hit] |= np.uint64(1) << np.uint64(l)
    return mask


def _murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash of ints: Murmur3 (x86, 32 bits) of four bytes, seed 42."""
    rotate = lambda h, r: (h << np.uint32(r)) | (h >> np.uint32(32 - r))
    with np.errstate(over="ignore"):
        k = rotate(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotate(k ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return (h ^ (h >> np.uint32(16))).astype(np.int32)


def even_groups(p: int, each: int = 2) -> np.ndarray:
    """Numbers for `each` * p document groups, of which every one of Spark's p hash buckets gets `each`."""
    n = 32 * each * p
    while True:
        bucket = np.mod(_murmur(np.arange(n)), p)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(p))
        size = np.diff(np.r_[first, n])
        if size.min() >= each:
            return np.sort(np.concatenate([order[first + i] for i in range(each)]))
        n *= 2


def _ragged(docs: np.ndarray) -> tuple[bytes, bytes]:
    """(distinct neighbours, their counts) of a sorted id array, as bytes."""
    if not len(docs):
        return b"", b""
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    return docs[at].astype("<i8").tobytes(), np.diff(np.r_[at, len(docs)]).astype("<i4").tobytes()


def _flat(docs: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i4"))


def _by_group(docs: np.ndarray, groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document group, its rows in the order of docs)."""
    g = groups[docs % len(groups)]
    o = np.lexsort((docs, g))
    cuts = np.flatnonzero(np.r_[True, g[o][1:] != g[o][:-1]]) if len(o) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(o)]):
        yield int(g[o[lo]]), o[lo:hi]


_ANCHORS = "bucket int, docs binary, counts binary, grams binary, contexts binary"
_ANSWERS = "db int, kind int, docs binary, counts binary, contexts binary, masks binary"
_CONTEXTS = "bucket int, docs binary, hashes binary, place binary, runs binary, sizes binary, bytes binary"
#: Kinds of answers: a run is repeated as a whole; its strings must be looked at; here are its strings; they
#: must be looked at one by one, since very many contexts share the gram.
WHOLE, LOOK, STRINGS, LOOK_HOT = 1, 2, 3, 4


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields])


def _emit(buckets: int, groups: np.ndarray, match: int, gram: int):
    """Texts -> anchors by gram bucket (db rows of `_ANSWERS` for what the task settles itself)."""

    def flush(ids: list[int], texts: list[bytes]) -> Iterator[tuple]:
        a = Anchors(texts, match, gram)
        docs = np.array(ids, np.int64)[a.text] if len(ids) else np.zeros(0, np.int64)
        o = np.lexsort((docs, a.context))
        c, d = a.context[o], docs[o]
        fresh = np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])] if len(o) else np.zeros(0, bool)
        o, c, d = o[fresh], c[fresh], d[fresh]
        head = np.r_[True, c[1:] != c[:-1]] if len(o) else np.zeros(0, bool)
        # of equal runs only the smallest document's goes on; the others are repeated
        settled = np.flatnonzero(~head)
        for g, rows in _by_group(d[settled], groups):
            at = settled[rows]
            yield (-1 - g, *_ragged(d[at]), b"", c[at].astype("<u8").tobytes())
        o, c, d = o[head], c[head], d[head]
        grams = a.grams[o]
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        s = np.lexsort((d, bucket))
        cuts = np.flatnonzero(np.r_[True, bucket[s][1:] != bucket[s][:-1]]) if len(s) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(s)]):
            r = s[lo:hi]
            yield (int(bucket[r[0]]), *_ragged(d[r]), (grams[r] >> _32).astype("<u4").tobytes(), c[r].astype("<u8").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= _FLUSH:
                    yield _batch(_ANCHORS, list(flush(ids, texts)))
                    ids, texts, held = [], [], 0
        yield _batch(_ANCHORS, list(flush(ids, texts)))

    return run


def _settle(buckets: int, groups: np.ndarray, hot: int):
    """Anchors of some buckets -> what is repeated as a whole and what must be looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], []
        for b in batches:
            for bucket, docs, counts, grams, ctx in zip(*(b.column(i).to_pylist() for i in range(5))):
                if bucket < 0:
                    out.append((-1 - bucket, WHOLE, docs, counts, ctx, b""))
                else:
                    g = np.frombuffer(grams, "<u4").astype(np.uint64) | np.uint64(bucket) << _32
                    held.append((g, np.frombuffer(ctx, "<u8"), _flat(docs, counts)))
        if held:
            g, c, d = (np.concatenate(x) for x in zip(*held))
            o = np.lexsort((d, c, g))
            g, c, d = g[o], c[o], d[o]
            new_g = np.r_[True, g[1:] != g[:-1]]
            new_c = new_g | np.r_[True, c[1:] != c[:-1]]
            least = d[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
            kinds = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_g))[np.cumsum(new_g) - 1]
            whole = np.flatnonzero(d > least)
            look = (d == least) & (kinds > 1) & new_c
            for kind, rows in ((WHOLE, whole), (LOOK, np.flatnonzero(look & (kinds <= hot))), (LOOK_HOT, np.flatnonzero(look & (kinds > hot)))):
                for db, r in _by_group(d[rows], groups):
                    at = rows[r]
                    out.append((db, kind, *_ragged(d[at]), c[at].astype("<u8").tobytes(), b""))
        yield _batch(_ANSWERS, out)

    return run


def _answers(table: pa.Table, *kinds: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By document: context hashes in order, kinds and masks; masks of one context are joined."""
    parts_ = []
    for kind, docs, counts, ctx, masks in zip(*(table[c].to_pylist() for c in ("kind", "docs", "counts", "contexts", "masks"))):
        if kind in kinds:
            d, c = _flat(docs, counts), np.frombuffer(ctx, "<u8")
            m = np.frombuffer(masks, "<u8") if kind == STRINGS else np.zeros(len(c), np.uint64)
            parts_.append((d, c, np.full(len(c), kind, np.int8), m))
    if not parts_:
        return {}
    d, c, k, m = (np.concatenate(x) for x in zip(*parts_))
    o = np.lexsort((k, c, d))
    d, c, k, m = d[o], c[o], k[o], m[o]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
    d, c, k, m = d[head], c[head], k[head], np.bitwise_or.reduceat(m, head)
    cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    return {int(d[lo]): (c[lo:hi], k[lo:hi], m[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(d)])}


def _look_up(wanted: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of `have` that are in sorted `wanted`, their places there)."""
    at = np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == have)
    return hit, at[hit]


def _gather(buckets: int, groups: np.ndarray, match: int, gram: int):
    """(texts, answers) of a document group -> contexts to look at, by gram bucket; rows of
    `_strings`' answers, with the group below 0 as bucket, for strings of hot grams that are settled here."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[int, list[tuple]] = {}
        hot: dict[tuple[int, bytes], list[tuple[int, int]]] = {}  # (place, string) -> (document, context)
        todo = _answers(answers, LOOK, LOOK_HOT)
        for i, t in zip(texts["doc_id"].to_pylist(), texts["bytes"]):
            if i not in todo:
                continue
            text = t.as_py()
            a = Anchors([text], match, gram)
            hit, at = _look_up(todo[i][0], a.context)
            _, once = np.unique(a.context[hit], return_index=True)
            for h, kind in zip(hit[once].tolist(), todo[i][1][at[once]].tolist()):
                f, l, c, place = int(a.first[h]), int(a.last[h]), int(a.context[h]), int(a.at[h]) - int(a.first[h])
                if kind == LOOK:
                    rows.setdefault(int(a.grams[h] % np.uint64(buckets)), []).append((i, c, place, l - f + 1, text[f : l + match]))
                else:
                    for s in range(l - f + 1):
                        hot.setdefault((place - s, text[f + s : f + s + match]), []).append((i, c))
        out, known = [], {}
        for (place, string), where in hot.items():
            first = min(where)[0]
            bucket = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little") % buckets
            for j, c in where:
                if j == first:  # it may have the string in several contexts
                    rows.setdefault(bucket, []).append((j, c, place, 1, string))
                else:
                    known[j, c] = known.get((j, c), 0) | 1 << place
        for b, r in rows.items():
            i, c, p, n, s = zip(*r)
            out.append(
                (b, np.array(i, "<i8").tobytes(), np.array(c, "<u8").tobytes(), np.array(p, "u1").tobytes(), np.array(n, "u1").tobytes(), np.array(list(map(len, s)), "u1").tobytes(), b"".join(s))
            )
        if known:
            db = int(groups[next(iter(known))[0] % len(groups)])
            j, c = zip(*known)
            out.append((-1 - db, np.array(j, "<i8").tobytes(), np.array(c, "<u8").tobytes(), b"", b"", b"", np.array(list(known.values()), "<u8").tobytes()))
        return pa.Table.from_batches([_batch(_CONTEXTS, out)])

    return run


def _strings(groups: np.ndarray, match: int, gram: int):
    """Contexts of some buckets -> masks of their repeated strings, by document group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, hashes, place, runs, bodies, out = [], [], [], [], [], []
        for b in batches:
            for bucket, d, h, p, n, s, body in zip(*(b.column(i).to_pylist() for i in range(7))):
                if bucket < 0:
                    out.append((-1 - bucket, STRINGS, d, np.ones(len(d) // 8, "<i4").tobytes(), h, body))
                    continue
                docs.append(np.frombuffer(d, "<i8"))
                hashes.append(np.frombuffer(h, "<u8"))
                place.append(np.frombuffer(p, "u1").astype(np.int64))
                runs.append(np.frombuffer(n, "u1").astype(np.int64))
                ends = np.cumsum(np.frombuffer(s, "u1").astype(np.int64)).tolist()
                bodies += [body[x:y] for x, y in zip([0, *ends], ends)]
        if bodies:
            d, h, p, n = (np.concatenate(x) for x in (docs, hashes, place, runs))
            mask = repeated_strings(bodies, p, n, d, match, gram)
            some = np.flatnonzero(mask)
            for db, r in _by_group(d[some], groups):
                at = some[r]
                out.append((db, STRINGS, *_ragged(d[at]), h[at].astype("<u8").tobytes(), mask[at].astype("<u8").tobytes()))
        yield _batch(_ANSWERS, out)

    return run


def covered(text: bytes, answers: tuple[np.ndarray, np.ndarray, np.ndarray], match: int = MATCH, gram: int = GRAM) -> np.ndarray:
    """Which bytes of a text lie in a repeated string, by what was answered for its contexts."""
    a = Anchors([text], match, gram)
    ctx, kind, masks = answers
    hit, at = _look_up(ctx, a.context)
    step = np.zeros(len(text) + 1, np.int64)
    w = hit[kind[at] == WHOLE]
    np.add.at(step, a.first[w], 1)
    np.add.at(step, a.last[w] + match, -1)
    s = kind[at] == STRINGS
    hit, m = hit[s], masks[at[s]]
    for l in range(match - gram + 1):
        p = a.at[hit[(m >> np.uint64(l)) & np.uint64(1) > 0]] - l
        np.add.at(step, p, 1)
        np.add.at(step, p + match, -1)
    return np.cumsum(step[:-1]) > 0


_RESULT = "doc_id long, digest string, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _remove(match: int, gram: int):
    """(texts, answers) of a document group -> what is removed from each text that has repeats."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        todo, out = _answers(answers, WHOLE, STRINGS), []
        for i, digest, t in zip(texts["doc_id"].to_pylist(), texts["digest"].to_pylist(), texts["bytes"]):
            if i not in todo:
                continue
            text = t.as_py()
            gone = covered(text, todo[i], match, gram)
            if not gone.any():
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((i, digest, int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.astype("<i8").tobytes()))
        return pa.Table.from_batches([_batch(_RESULT, out)])

    return run


def _dealt(rows: DataFrame, p: int) -> DataFrame:
    """A task a bucket. Hashing the p buckets to p tasks would leave a third of them idle and give some four."""
    return rows.repartitionById(p, F.pmod("bucket", F.lit(p)).cast("int"))


def remove_repeats(
    docs: DataFrame, match: int = MATCH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row of `docs`.

    Texts are UTF-8 bytes, a null text is empty. Removed is each byte covered by a string of
    `match` bytes that also starts in a document with a smaller doc_id; strings never
    cross documents and are judged on the input. spans (start and end of each removed run,
    little-endian longs) is null where nothing is removed or all of a copy is. A row
    with a null doc_id has no place in the order: it loses nothing and costs others
    nothing. Rows that share a doc_id are judged alike and don't count against each other.
    Other columns are ignored; an empty table gives no rows.
    """
    if not 8 <= gram < match <= 64 + gram - 1:
        raise ValueError("a string's owner must be one of at most 64 grams")
    spark = docs.sparkSession
    p = parts(spark)
    groups = even_groups(p)
    group_of = lambda c: F.element_at(F.expr(f"array({', '.join(map(str, groups))})"), (F.pmod(c, F.lit(len(groups))) + 1).cast("int"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("bytes"))
    d = d.withColumn("digest", F.sha2("bytes", 256))
    meta = materialize(d.select("doc_id", "digest", F.octet_length("bytes").cast("long").alias("n_bytes")), "digests")
    firsts = meta.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_bytes").alias("n"))
    firsts = materialize(firsts, "firsts")
    own = firsts.where(F.col("n") >= match).select(group_of("first_id").alias("db"), F.col("first_id").alias("doc_id"), "digest")
    texts = d.where(F.octet_length("bytes") >= match).select(group_of("doc_id").alias("db"), "doc_id", "digest", "bytes")
    name = f"tessera_texts_{uuid.uuid4().hex}"
    # both sides are dealt by db alone, which the join may use as it is: texts are shuffled once
    # (a semi-join would be pushed below the repartition and shuffle them again)
    strict = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(strict)
    spark.conf.set(strict, "false")
    try:
        texts.repartition(p, "db").join(own.repartition(p, "db"), ["db", "doc_id", "digest"]).write.bucketBy(p, "db").option(
            "path", new_path(spark, "texts")
        ).saveAsTable(name)
    finally:
        spark.conf.set(strict, before)
    stored = spark.table(name)
    anchors = stored.select("doc_id", "bytes").mapInArrow(_emit(p, groups, match, gram), _ANCHORS)
    answers = materialize(_dealt(anchors, p).mapInArrow(_settle(p, groups, hot), _ANSWERS), "answers", release=True)
    looks = answers.where(F.col("kind").isin(LOOK, LOOK_HOT))
    contexts = stored.groupBy("db").cogroup(looks.groupBy("db")).applyInArrow(_gather(p, groups, match, gram), _CONTEXTS)
    strings = _dealt(contexts, p).mapInArrow(_strings(groups, match, gram), _ANSWERS)
    strings = materialize(strings, "strings", release=True)
    final = answers.where(F.col("kind") == WHOLE).unionByName(strings)
    removed = stored.groupBy("db").cogroup(final.groupBy("db")).applyInArrow(_remove(match, gram), _RESULT)
    removed = materialize(removed, "removed", release=True)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # its entry; nothing reads it any more
    removed = removed.dropDuplicates(["doc_id", "digest"]).select(
        F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "n_removed", "n_spans", "kept_sha256", "spans"
    )
    m = meta.join(firsts.select("digest", "first_id"), "digest", "left")
    m = m.join(removed, (F.col("doc_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= match), F.lit(False))
    return m.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(~copy, F.col("spans")).alias("spans"),
    )
