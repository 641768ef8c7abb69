"""SimHash near-dedup with multi-index hashing.

A fingerprint is cut into two 32-bit segments. Of two fingerprints at most two bits
apart, one segment differs in at most one bit. So each fingerprint is put into a table
under both segments and looks up the ball of radius one around each of its segments;
what it meets is verified on all 64 bits. Radius-one balls are halved: a flipped bit is
looked up only from the side that has a zero there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import TEXT_ROWS, connected_components, materialize
from .tokens import tidy

SHINGLE = 3
SEED = 42
MAX_BITS = 2
_BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text; a bit is one if it is set in over half of the hashes.

    A-Z are lower-cased; words are runs of anything but the six ASCII white-space bytes;
    features are `width`-word shingles with repeats, or all words if there are fewer. No
    words: 0.
    """
    import xxhash

    # bytes.lower and bytes.split know exactly A-Z and the six white-space bytes
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        n = len(words) - width + 1
    one, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    while True:
        block = b"".join([one(s, seed) for _, s in zip(range(_BLOCK), shingles)])
        if not block:
            break
        votes += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id long, fp long"
    )


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of ids of distinct fingerprints (id, fp) at most `max_bits` (0 to 3) bits apart.

    A pair may come twice, once from each segment. Neither side is broadcast: Spark takes an exploded table
    to be as large as what it is made from, here about 34 times too small.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments and balls of radius one find up to three differing bits")
    segments = F.array(
        *[
            F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"))
            for s in (0, 1)
        ]
    )
    seg = distinct.select("id", "fp", F.explode(segments).alias("x")).select("id", "fp", "x.s", "x.v")
    address = lambda v: F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(v)
    table = seg.select(address(F.col("v")).alias("k"), F.col("id").alias("b"), F.col("fp").alias("fb"))
    ball = F.expr("concat(array(v), transform(filter(sequence(0, 31), i -> (shiftright(v, i) & 1) = 0), i -> v | shiftleft(1L, i)))")
    probes = seg.select("id", "fp", "v", "s", F.explode(ball).alias("w")).select(
        address(F.col("w")).alias("k"), F.col("id").alias("a"), F.col("fp").alias("fa"), (F.col("w") == F.col("v")).alias("same")
    )
    hit = probes.hint("merge").join(table.hint("merge"), "k").where(
        (~F.col("same") | (F.col("fa") < F.col("fb"))) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)
    )
    return hit.select("a", "b")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Documents whose fingerprints are at most `max_bits` bits apart are linked;
    component_id is the smallest doc_id reachable. Equal fingerprints (those of null and
    empty texts, which are 0, included) are one node, so copies are never paired. A row
    with a null doc_id links nothing and takes the component of its fingerprint, or null if
    no other row has that. Rows sharing a doc_id are one node. Other columns are ignored; an
    empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints", batch_rows=TEXT_ROWS)
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null")
    nodes = materialize(nodes, "nodes")
    links = connected_components(near_pairs(nodes, max_bits), "a", "b")
    of = nodes.join(links, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(of, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
