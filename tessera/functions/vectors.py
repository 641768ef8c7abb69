"""Vector expressions on array<double> columns and a batched kernel for large products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0 or not a number."""
    d = norm(a) * norm(b)
    return F.when((d > 0) & ~F.isnan(d), dot(a, b) / d).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length one, as doubles; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


#: How stores turn a cosine into a score.
SCORE_MODES = {
    "cosine": lambda s: s,
    "inverse_distance": lambda s: F.lit(1.0) / (F.lit(2.0) - s),
    "one_minus_distance": lambda s: s,
}


def score_from_cosine(similarity: Column, mode: str = "cosine") -> Column:
    """`cosine`: as is; `inverse_distance`: 1 / (1 + d) with d = 1 - cosine; `one_minus_distance`: 1 - d."""
    if mode not in SCORE_MODES:
        raise ValueError(f"score_mode must be one of {sorted(SCORE_MODES)}")
    return SCORE_MODES[mode](similarity)
