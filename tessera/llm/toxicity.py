"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._linear import logistic_sparse, platt, sigmoid
from ._scale import materialize

ORDERS = (3, 4, 5)
BITS = 19
#: Labelled rows a fit uses, per class, chosen by a hash of doc_id. Bounds the driver's work.
MAX_PER_CLASS = 2_000
#: Standard errors by which a slot's counts must differ between the classes for it to have a weight.
LEAST = 3.0
THRESHOLD = 0.3
_CHUNK = 1 << 20


class Grams:
    """Distinct n-gram slots of a whole text, lower-cased, any white space as one blank."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS):
        self.orders, self.bits = orders, bits
        self.last = np.zeros(1 << bits, np.int32)

    def hashes(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c <= 32, np.uint32(32), c) + np.uint32(1)
        out = []
        with np.errstate(over="ignore"):
            h = np.zeros(len(c), np.uint32)
            for n in range(1, max(self.orders) + 1):
                if len(c) < n:
                    break
                m = len(c) - n + 1
                h = h[:m] * np.uint32(0x01000193) + c[n - 1 :]
                if n in self.orders:
                    x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                    x ^= x >> np.uint32(15)
                    x *= np.uint32(0xC2B2AE35)
                    out.append(x >> np.uint32(32 - self.bits))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def __call__(self, text: str | None) -> np.ndarray:
        """Each slot once. Very long texts are taken in overlapping chunks."""
        text = text or ""
        lap = max(self.orders) - 1
        if len(text) > _CHUNK:
            got = [self(text[i : i + _CHUNK]) for i in range(0, max(1, len(text) - lap), _CHUNK - lap)]
            return np.unique(np.concatenate(got))
        h = self.hashes(text)
        at = np.arange(len(h), dtype=np.int32)
        self.last[h] = at
        return h[self.last[h] == at]


@dataclass
class Toxicity:
    """A text's distinct n-grams, each scaled by its log-count ratio, make a vector of length one.

    score = sigmoid(slope * (weights . vector + bias) + offset). `ratios` and `weights` (of the ratio
    times the regression's weight) are indexed by n-gram slot.
    """

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def score(self, slots: np.ndarray) -> float:
        r = self.ratios[slots]
        z = float(self.weights[slots].sum()) / max(float(np.sqrt((r * r).sum())), 1e-6) + self.bias
        return float(sigmoid(np.array(self.slope * z + self.offset)))


def evidence(count: np.ndarray, alpha: float = 0.5, least: float = LEAST) -> np.ndarray:
    """Log-count ratio of each slot; 0 where the two classes' counts do not differ by `least` standard
    errors from what their totals let expect. Where no slot does, all that were seen keep theirs."""
    seen = count.sum(axis=0)
    ratio = np.log((count[1] + alpha) / (count[1] + alpha).sum()) - np.log((count[0] + alpha) / (count[0] + alpha).sum())
    share = count[1].sum() / max(seen.sum(), 1.0)
    sure = (seen > 0) & (np.abs(count[1] - seen * share) >= least * np.sqrt(seen * share * (1 - share)))
    return np.where(sure if sure.any() else seen > 0, ratio, 0.0)


def fit(ratio: np.ndarray, slots: list[np.ndarray], y: np.ndarray, train: np.ndarray, prior: float, l2: float = 1e-5) -> Toxicity:
    """Fit on rows given by their slots with a ratio; `prior` is the share of label 1 among all labelled rows.

    Rows outside `train` are only used for calibration.
    """
    chosen = np.flatnonzero(ratio)
    index = np.zeros(len(ratio), np.int32)
    index[chosen] = np.arange(len(chosen))
    rows, flat = np.repeat(np.arange(len(y)), [len(s) for s in slots]), index[np.concatenate(slots)].astype(np.int64)
    vals = ratio[chosen][flat]
    vals = vals / np.maximum(np.sqrt(np.bincount(rows, vals * vals, minlength=len(y))), 1e-6)[rows]
    class_weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    w = logistic_sparse(rows, flat, vals, len(y), len(chosen), y, class_weight * train, l2)
    z = np.bincount(rows, w[flat] * vals, minlength=len(y)) + w[-1]
    check = ~train if (~train).any() else train
    slope, offset = platt(z[check], y[check], class_weight[check])
    weights, ratios = np.zeros(len(ratio), np.float32), np.zeros(len(ratio), np.float32)
    ratios[chosen] = ratio[chosen]
    weights[chosen] = w[:-1] * ratio[chosen]
    return Toxicity(weights, ratios, float(w[-1]), slope, offset)


def constant(prior: float, rows: int) -> Toxicity:
    """What one class, or no labelled row, gives: the smoothed prior as every score."""
    p = (prior * rows + 0.5) / (rows + 1)
    none = np.zeros(1 << BITS, np.float32)
    return Toxicity(none, none, 0.0, 0.0, float(np.log(p / (1 - p))))


def labelled_sample(labels: DataFrame, label: str, per_class: int, where: Column | None = None) -> tuple[DataFrame, float]:
    """Bounded sample of (doc_id, y), at most `per_class` rows a class, and the share of y = 1.

    Rows without an id or label are left out; an id labelled twice takes the larger label.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    lab = (lab if where is None else lab.where(where)).groupBy("doc_id").agg(F.max(label).alias("y"))
    n, p = lab.agg(F.count(F.lit(1)), F.avg(F.col("y").cast("double"))).first()
    order = F.xxhash64("doc_id")
    pick = [lab.where(F.col("y") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    return pick[0].union(pick[1]), float(p or 0.0)


def held_out(c: str = "doc_id") -> Column:
    """True for ids whose crc32 (as text) leaves remainder 2 by 4; such labels are not learnt."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2


def _slots(docs: DataFrame) -> DataFrame:
    """(doc_id, y, slots): the distinct n-gram slots of each row (doc_id, y, text), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in batches:
            s = [np.sort(grams(t.as_py())).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.binary())], ["doc_id", "y", "slots"])

    return docs.mapInArrow(run, "doc_id long, y int, slots binary")


def _counts(rows: DataFrame) -> np.ndarray:
    """(2, slots): in how many `rows` of each label a slot is. The driver gets a row a slot at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for y, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                count[y, np.frombuffer(s, "<u4")] += 1
        some = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[0, some]), pa.array(count[1, some])], ["slot", "a", "b"])

    t = rows.select("y", "slots").mapInArrow(run, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    count = np.zeros((2, 1 << BITS))
    for label, c in enumerate("ab"):
        count[label, t["slot"].to_numpy()] = t[c].to_numpy()
    return count


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, where: Column | None = None) -> Toxicity:
    """Fit on the labelled rows that `where` (default: not `held_out`) lets through.

    Rows without an id or a label teach nothing; an id labelled twice has the larger label, and of
    rows that share an id the one whose slots sort first is learnt from, so reruns agree. A null text
    is an empty one. A fifth of the rows, by a hash of their ids, only calibrates, unless a class
    is then missing on either side. Without both classes (an empty table, too) every score is the
    smoothed share of label 1. No text goes to the driver: it gets a count a slot, and of each row
    to learn from the slots that have evidence.
    """
    sample, prior = labelled_sample(labels.select("doc_id", "toxic"), "toxic", per_class, ~held_out() if where is None else where)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample.select("doc_id", F.col("y").cast("int").alias("y"))), "doc_id").select("doc_id", "y", "text")
    rows = materialize(_slots(rows).groupBy("doc_id", "y").agg(F.min("slots").alias("slots")), "grams")
    part = F.crc32(F.concat(F.lit("part:"), F.col("doc_id")).cast("binary")) % 5 != 4
    rows = rows.withColumn("train", part)
    sides = {(r["train"], r["y"]): r["count"] for r in rows.groupBy("train", "y").count().collect()}
    n = sum(sides.values())
    if len({y for _, y in sides}) < 2:
        return constant(prior, n)
    if len(sides) < 4:
        rows = rows.withColumn("train", F.lit(True))
    ratio = evidence(_counts(rows.where("train")))
    shared = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.frombuffer(x, "<u4") for x in b.column(3).to_pylist()]
            s = [x[shared.value[x]].tobytes() for x in s]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s, pa.binary())], ["doc_id", "y", "train", "slots"])

    got = rows.select("doc_id", "y", "train", "slots").mapInArrow(told, "doc_id long, y int, train boolean, slots binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    slots = [np.frombuffer(r["slots"], "<u4") for r in got]
    return fit(ratio, slots, np.array([r["y"] for r in got], float), np.array([r["train"] for r in got], bool), prior)


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row and whole text.

    A null text scores as an empty one; a null doc_id is not held out. Repeated rows score
    alike. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        grams = Grams(m.orders, m.bits)
        for b in batches:
            s = [m.score(grams(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
