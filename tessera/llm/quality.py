"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees character n-grams of the text, hashed; the metadata view sees what
a page is described by: language, source, stated length, and statistics of its layout
(lines, casing, symbols, separators). Each view has a classifier of its own. In every round
each labels all unlabelled rows, and what it is most confident about joins the other's
training set. At the end both views are calibrated on labelled rows that no round has
used, and their log-odds combined.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import logistic, platt, sigmoid
from ._scale import TEXT_ROWS, materialize
from .tokens import forget, tidy, trim
from .toxicity import labelled_sample

#: Labelled rows a fit uses, per class, chosen by a hash of doc_id.
MAX_PER_CLASS = 3_000
ROUNDS = 4
#: Share of the unlabelled rows each view may label for the other in a round, per class; over all
#: rounds these are at most as many as the labelled rows.
SHARE = 0.02
#: Log-odds from which a view counts as confident (0.95).
SURE = 3.0
THRESHOLD = 0.5
#: Labelled ids up to which they are sent to every task (8 bytes each).
FEW_KNOWN = 1_000_000
#: Characters of an n-gram, and the slots n-grams are hashed to.
ORDERS = (1, 2, 3)
SLOTS = 256
#: Characters that every text is taken to have besides, spread over all slots: short texts say little.
PAD_CHARS = 200
CONTENT_FEATURES = SLOTS + 4
_META_SLOTS = 32
_RUN = re.compile(r"[^\w\s.,;:'\"()?!-]")
_SHOUT = re.compile(r"[!?]{2,}")
LAYOUT_FEATURES = 15
_CHUNK = 1 << 20


def repetition(text: str) -> tuple[int, list[float]]:
    """Number of words, and how they repeat: share equal to the word before and its root, distinct share, and its logs' ratio."""
    words = text.split()
    k = len(words)
    if not k:
        return 0, [0.0] * 4
    same, distinct = sum(map(str.__eq__, words, words[1:])), len(set(words))
    return k, [same / k, (same / k) ** 0.5, distinct / k, math.log(distinct + 1) / math.log(k + 1.5)]


def text_features(text: str | None, words: tuple[int, list[float]] | None = None) -> np.ndarray:
    """What a whole text says, in steps of 1/127: square roots of its n-grams' shares in each slot, and
    how its words repeat. Zeros for an empty one."""
    text, count, lap = text or "", np.zeros(SLOTS, np.int64), max(ORDERS) - 1
    for at in range(0, len(text), _CHUNK):
        c = np.frombuffer(text[at : at + _CHUNK + lap].encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = min(_CHUNK, len(text) - at)
        c = np.maximum(c, np.uint32(32))  # any control sign counts as a blank
        h = c
        for n in ORDERS:
            if n > 1:
                h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
            if not len(h):
                break
            count += np.bincount((h[:starts] * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=SLOTS)
    said = np.minimum(1.0, (words or repetition(text))[1])
    return np.rint(127 * np.r_[np.sqrt(count / (count.sum() + len(ORDERS) * PAD_CHARS)), said]).astype(np.int8)


def layout(text: str | None, words: tuple[int, list[float]] | None = None) -> np.ndarray:
    """Shares and ratios of a whole text's lines and signs; one without words gives zeros and a flag."""
    text = text or ""
    k, repeats = words or repetition(text)
    n = len(text)
    if not k:
        return np.r_[np.zeros(LAYOUT_FEATURES - 1), 1.0]
    lines = text.split("\n")
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    upper, lower, digit = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    symbols = len(_RUN.findall(text))
    return np.array(
        [
            symbols / n,
            (symbols / n) ** 0.5,
            int(byte[124]) / n,
            *repeats,
            upper / (upper + lower + 1),
            digit / n,
            len(_SHOUT.findall(text)) / k if byte[33] or byte[63] else 0.0,
            len(set(lines)) / len(lines),
            math.log1p(k) / 10,
            min(n / k, 30) / 10,
            int(byte[46] + byte[44]) / k,
            0.0,
        ]
    )


META_FEATURES = _META_SLOTS + 3 + LAYOUT_FEATURES


def meta_features(text: str | None, lang: str | None, source: str | None, n_chars: int | None, slots: int = _META_SLOTS, words: tuple[int, list[float]] | None = None) -> np.ndarray:
    """One slot each for the language and the source (hashed; null is a value), the stated length, and the layout."""
    out = np.zeros(slots + 3 + LAYOUT_FEATURES, np.float32)
    out[zlib.crc32(f"l:{lang}".encode()) % slots] += 1
    out[zlib.crc32(f"s:{source}".encode()) % slots] += 1
    size = np.log1p(max(0.0, float(n_chars or 0))) / 10
    out[slots : slots + 3] = size, size * size, float(n_chars is None)
    out[slots + 3 :] = layout(text, words)
    return out


def both_views(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    words = repetition(text or "")
    return text_features(text, words), meta_features(text, lang, source, n_chars, words=words)


@dataclass
class View:
    """A standardised logistic model and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, l2: float) -> View:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        return View(mean, scale, logistic(np.clip((x - mean) / scale, -8, 8), y, l2=l2))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.offset


@dataclass
class Quality:
    """Two calibrated views; log-odds add up, less the prior that both contain."""

    text: View | None
    meta: View | None
    prior: float
    history: list[dict] = field(default_factory=list)

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        if self.text is None or self.meta is None:
            return np.full(len(xt), sigmoid(np.array(self.prior)))
        return sigmoid(self.text.log_odds(xt) + self.meta.log_odds(xm) - self.prior)


#: What a view is most confident about: (doc_id, t, m) of rows for a label, surest first.
Sure = tuple[int, np.ndarray, np.ndarray]


def co_train(
    xt: np.ndarray, xm: np.ndarray, y: np.ndarray, surest: Callable[[dict[str, View], dict[str, set[int]]], dict[tuple[str, int], list[Sure]]] | None, prior: float, rounds: int = ROUNDS
) -> Quality:
    """Fit both views. Every fifth labelled row of a class is kept for calibration alone; where a
    class has under five, all rows both fit and calibrate.

    `surest` finds, among all unlabelled rows, what each view is most confident about, without
    the doc_ids it has labelled already; None if there are no such rows.
    `prior` is the share of label 1 among all labelled rows (the sample may be balanced);
    without both classes every score is that share, smoothed.
    """
    p = min(max(prior, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return Quality(None, None, base)
    keep = np.zeros(len(y), bool)
    for label in (0, 1):
        keep[np.flatnonzero(y == label)[4::5]] = True
    train = ~keep
    if len(np.unique(y[keep])) < 2:
        train[:] = keep[:] = True
    data = {"text": xt, "meta": xm}
    extra: dict[str, list[tuple[np.ndarray, int]]] = {"text": [], "meta": []}  # pseudo-labelled rows a view learns from
    given: dict[str, set[int]] = {"text": set(), "meta": set()}  # doc_ids a view has labelled
    views: dict[str, View] = {}
    history = []
    weight = np.where(y > 0, p / max(y.mean(), 1e-9), (1 - p) / max(1 - y.mean(), 1e-9))
    for r in range(rounds + 1):
        for v, x in data.items():
            xx = np.vstack([x[train], *(f for f, _ in extra[v])])
            yy = np.r_[y[train], [label for _, label in extra[v]]]
            views[v] = View.fit(xx, yy, l2=1e-2)
            # confident: by the odds that rows no round trains on give such margins
            views[v].slope, views[v].offset = platt(views[v].margin(x[keep]), y[keep].astype(float), weight[keep])
        if r == rounds or surest is None:
            break
        found = surest(views, given)
        for v, other in (("text", "meta"), ("meta", "text")):
            before = len(given[v])
            for label in (0, 1):
                for i, t, m in found.get((v, label), []):
                    if i not in given[v]:
                        given[v].add(i)
                        extra[other].append((m if v == "text" else t, label))
            history.append({"round": r, "from": v, "labels": len(given[v]) - before})
        if not any(h["labels"] for h in history[-2:]):
            break  # the same fits would follow
    return Quality(views["text"], views["meta"], base, history)


def _lists(rows: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Rows of one width as a list column."""
    width = len(rows[0]) if len(rows) else 0
    return pa.ListArray.from_arrays(np.arange(0, len(rows) * width + 1, max(width, 1), dtype=np.int32)[: len(rows) + 1], pa.array(np.concatenate(rows), kind))


def _features(docs: DataFrame, extra: str = "") -> DataFrame:
    """doc_id, t, m (feature arrays) and the columns named in `extra` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            t, m = zip(*(both_views(text.as_py(), *page) for text, *page in zip(b.column(1), *(b.column(i).to_pylist() for i in (2, 3, 4)))))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(t, pa.int8()), _lists(m, pa.float32()), *b.columns[5:]], ["doc_id", "t", "m", *b.schema.names[5:]])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]
    names = [x.split()[0] for x in extra.split(", ") if x]
    return docs.select(*cols, *names).mapInArrow(tidy(run), f"doc_id long, {_FEATURES}" + (", " + extra if extra else ""))


#: A row's two views: 260 bytes and 50 floats.
_FEATURES = "t array<tinyint>, m array<float>"


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _surest(free: DataFrame, k: int, views: dict[str, View], given: dict[str, set[int]]) -> dict[tuple[str, int], list[Sure]]:
    """For each view and label the `k` rows of `free` (doc_id, t, m) with the largest log-odds over SURE.

    A task hands on at most `k` of each, and the driver gets at most `k` of each.
    """
    shared = free.sparkSession.sparkContext.broadcast((views, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, done = shared.value
        best: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
        skip = {v: np.array(sorted(d), np.int64) for v, d in done.items()}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            x = {"text": _matrix(b.column(1)), "meta": _matrix(b.column(2))}
            for v, model in models.items():
                odds = model.log_odds(x[v])
                new = ~np.isin(ids, skip[v])
                for label in (0, 1):
                    side = odds if label else -odds
                    at = np.flatnonzero((side > SURE) & new)
                    if not len(at):
                        continue
                    rows = (ids[at], side[at], x["text"][at], x["meta"][at])
                    if (v, label) in best:
                        rows = tuple(np.concatenate(c) for c in zip(best[v, label], rows))
                    # a repeated doc_id counts once
                    o = np.lexsort((rows[0], -rows[1]))
                    o = o[np.sort(np.unique(rows[0][o], return_index=True)[1])][:k]
                    best[v, label] = tuple(c[o] for c in rows)
        for (v, label), (ids, side, t, m) in best.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * n), pa.array([label] * n, pa.int32()), pa.array(ids), pa.array(side), _lists(t, pa.float64()), _lists(m, pa.float64())], ["view", "label", "doc_id", "side", "t", "m"]
            )

    sure = materialize(free.mapInArrow(tidy(run), "view string, label int, doc_id long, side double, t array<double>, m array<double>"), "sure", batch_rows=TEXT_ROWS)
    out = {}
    for v in views:
        for label in (0, 1):
            mine = sure.where((F.col("view") == v) & (F.col("label") == label)).groupBy("doc_id").agg(F.max(F.struct("side", "t", "m")).alias("x"))
            rows = mine.select("doc_id", "x.*").orderBy(F.desc("side"), "doc_id").limit(k).toArrow()
            out[v, label] = list(zip(rows["doc_id"].to_pylist(), _matrix(rows["t"]), _matrix(rows["m"]))) if len(rows) else []
    return out


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, rounds: int = ROUNDS, share: float = SHARE) -> Quality:
    """Fit on at most `per_class` labelled rows a class and what the views label for each other.

    Features of all unlabelled rows are written to the shared folder once; each round reads them
    all. Rows without an id or a label teach nothing; an id labelled twice has the larger label, and of
    rows that share an id the one with the smallest features is learnt from, so reruns agree.
    Null texts are empty, nulls in lang, source and n_chars are values. Without both classes
    (an empty table, too) there is no model, and every score is the share of label 1.
    """
    sample, prior = labelled_sample(labels.select("doc_id", "quality"), "quality", per_class)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = _features(own.join(F.broadcast(sample.select("doc_id", F.col("y").cast("int").alias("y"))), "doc_id"), "y int")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("t", "m")).alias("x")).select("doc_id", "y", "x.*").toArrow()
    ids = rows["doc_id"].to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i])), int)
    stack = lambda k, d: _matrix(rows[k])[order] if len(ids) else np.zeros((0, d))
    y = rows["y"].to_numpy()[order].astype(int)
    surest = None
    if len(np.unique(y)) == 2 and rounds:
        pool = own.where("doc_id is not null")
        if known.limit(FEW_KNOWN + 1).count() <= FEW_KNOWN:
            free = _features(pool.join(F.broadcast(known), "doc_id", "left_anti"))
        else:  # features are moved rather than texts
            free = _features(pool).join(known, "doc_id", "left_anti")
        free = materialize(free, "free", batch_rows=TEXT_ROWS)
        n = free.count()
        k = min(max(1, int(share * n)), max(1, per_class // rounds))
        surest = (lambda views, given: _surest(free, k, views, given)) if n else None
    return co_train(stack("t", CONTENT_FEATURES), stack("m", META_FEATURES), y, surest, prior, rounds)


def score_quality(docs: DataFrame, model: Quality, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` with all its columns, plus quality_score and quality_keep.

    quality_score (0 to 1, higher: label 1 likelier) comes from both views; rows below
    `threshold` are not kept; without a fitted model all are. Null texts count as empty, nulls in lang, source and n_chars
    are values of their own. Existing columns named like the two are replaced. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    # one column out of four: the other columns stay in the JVM; a text is a Python string while it is looked at only
    @F.arrow_udf("double")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        forget()
        out = [np.zeros(0)]
        for at in range(0, len(text), 1000):
            page = (c.slice(at, 1000).to_pylist() for c in (lang, source, n_chars))
            t, m = zip(*(both_views(x.as_py(), *p) for x, *p in zip(text.slice(at, 1000), *page)))
            out.append(shared.value.score(np.stack(t).astype(float), np.stack(m).astype(float)))
        trim()
        return pa.array(np.concatenate(out))

    d = docs.drop("quality_score", "quality_keep")
    return d.withColumn("quality_score", score(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))).withColumn(
        "quality_keep", F.lit(True) if model.text is None or model.meta is None else F.col("quality_score") >= threshold
    )
