"""Mixing sources to target weights by Efraimidis-Spirakis sampling, natively in Spark.

Every document draws an exponential key with its quality weight as rate. Within a source
the documents sorted by key are taken up to the source's token budget; whole epochs of a
source come before the fractional selection. The order is not built by sorting a source
in one task: keys fall into ranges, range totals are prefix-summed, and only the one range
of a source in which its budget ends is sorted. Ranges are equal steps of the key's logarithm,
in which an exponential variable of any rate has a density of at most 1/e: whatever the
weights, a range of 1/1024 expects at most 0.04 % of a source's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._scale import boxed, materialize, unboxed

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
MAX_EPOCHS = 3
#: Sources up to which the table of sources is sent to every executor (a row is under 100 bytes).
FEW_SOURCES = 10_000


def word_count(c: str) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(c), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(c: str, size: Column) -> Column:
    """Weight in (0, 1] of a text: high where words are of ordinary mean length (UTF-8 bytes).

    1 / (1 + |bytes per word - 6.5| / 6.5); a text without words weighs as if its mean were 0.
    """
    mean = F.octet_length(F.coalesce(F.col(c), F.lit(""))).cast("double") / F.greatest(size, F.lit(1)).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.5)) / F.lit(6.5))


def exponential_key(id_col: str, text_col: str, seed: str = SEED) -> Column:
    """-ln(u), u in (0, 1) from an MD5 of the seed and the id: the same in every run.

    Without an id the MD5 of the text stands in for it.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    text = F.concat(F.lit(seed + ":"), own)
    n = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return -F.ln((n + F.lit(0.5)) / F.lit(float(1 << 48)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size) -> plus target: shares of all sizes, capped, excess reshared.

    Sources by code point, null last, weigh `weights`, repeating. Resharing the excess by
    weight until no source is above its cap gives min(cap, level * weight) with one level
    for all, which is solved for directly: sources are capped in the order of cap / weight.
    """
    one = F.lit(1)
    w = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(w) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = W.partitionBy(one).orderBy((F.col("cap").cast("double") / F.col("w")).asc(), "i")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(one)
    s = (
        s.withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # the first source, in this order, that the level of those from it on does not cap
        .withColumn("open", F.col("cap") * F.col("left_w") >= F.col("left_size") * F.col("w"))
        .withColumn("at", F.min(F.when(F.col("open"), F.row_number().over(by_cap))).over(whole))
        .withColumn("r", F.row_number().over(by_cap))
    )
    level_size = F.max(F.when(F.col("r") == F.col("at"), F.col("left_size"))).over(whole)
    level_w = F.max(F.when(F.col("r") == F.col("at"), F.col("left_w"))).over(whole)
    return s.withColumn("ls", level_size).withColumn("lw", level_w).select(
        "source",
        "source_size",
        F.when(F.col("r") < F.col("at"), F.col("cap").cast("double"))
        .otherwise((F.col("w") * F.col("ls")).cast("double") / F.col("lw"))
        .alias("target"),
    )


def _draws(docs: DataFrame, seed: str, ranges: int, cols: tuple[str, str, str], weight: Column | None, keep: bool) -> DataFrame:
    """size, key and key range of each row, beside (doc_id, source) or, with `keep`, all of `docs`."""
    doc_id, text, source = cols
    own = [] if weight is None else [weight.alias("_weight")]
    d = docs if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"), *own)
    if not keep:
        doc_id, text, source = "doc_id", "text", "source"
    size = word_count(text)
    key = exponential_key(doc_id, text, seed) / (quality_weight(text, size) if weight is None else F.col("_weight"))
    d = d.withColumn("_size", size).withColumn("_key", key)
    rng = F.floor(F.ln("_key") * ranges).cast("int")
    d = d.withColumn("_rng", rng).withColumn("_id", F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))).withColumn("_source", F.col(source))
    return d if keep else d.drop("text", "_weight")


def mix_plan(draws: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: s, source_size, target, full epochs, and where the fractional selection ends.

    Documents of a range before `cut`, and of `cut` up to (cut_key, cut_id), are taken once more.
    Rows with one key and id are one row by the time a range is sorted.
    """
    per = materialize(draws.groupBy("_source", "_rng").agg(F.sum("_size").alias("n")), "ranges")
    sizes = per.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("source_size"))
    plan = source_targets(sizes, weights, max_epochs).withColumnRenamed("source", "s")
    plan = plan.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "plan")
    before = W.partitionBy("_source").orderBy("_rng").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(plan, F.expr("_source <=> s"))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
        .groupBy("s")
        .agg(F.max_by("_rng", "before").alias("cut"), F.max("before").alias("cut_before"))
    )
    plan = materialize(plan.alias("p").join(cut.alias("c"), F.expr("p.s <=> c.s"), "left").select("p.*", "cut", "cut_before"), "cuts")
    inside = W.partitionBy("s").orderBy("_key", "_id").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        _with_plan(draws, plan)
        .where(F.col("_rng") == F.col("cut"))
        .groupBy("s", "_key", "_id")
        .agg(F.sum("_size").alias("_sum"), F.min("_size").alias("_least"), F.first("cut_before").alias("cut_before"), F.first("rest").alias("rest"))
        .withColumn("at", F.col("cut_before") + F.coalesce(F.sum("_sum").over(inside), F.lit(0)) + F.col("_least") / 2)
        .where(F.col("at") <= F.col("rest"))
        .groupBy(F.col("s").alias("e"))
        .agg(F.max(F.struct("_key", "_id")).alias("last"))
    )
    return materialize(
        plan.join(edge, F.expr("s <=> e"), "left").select(
            "s", "source_size", "target", "full", "rest", "cut", "cut_before", F.col("last._key").alias("cut_key"), F.col("last._id").alias("cut_id")
        ),
        "mix",
    )


def _with_plan(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row beside its source's; a plan of few sources is sent to the rows, a longer one joined."""
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    return draws.join(F.broadcast(plan) if few else plan, F.expr("_source <=> s"))


def _epochs() -> Column:
    upto = F.struct("_key", "_id") <= F.struct(F.col("cut_key").alias("_key"), F.col("cut_id").alias("_id"))
    once = (F.col("_rng") < F.col("cut")) | ((F.col("_rng") == F.col("cut")) & F.col("cut_key").isNotNull() & upto)
    # without a cut the fraction is nothing
    return F.col("full") + F.coalesce(once, F.lit(False)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    ranges: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken of every row of `docs`.

    A document is taken whole: epochs times, size words each. All documents of a source
    are taken floor(target / source_size) times and those first by key once more, as long
    as less than half of a document lies past the target. Keys depend on doc_id
    and weight only, so reruns agree; equal keys go by doc_id. A null text has size 0, a null
    source is a source of its own (last), rows with a null doc_id draw by their text, and
    rows that repeat an id (or, without one, a text) are taken alike. `ranges` are key ranges
    for each factor of e. A source without words has target 0. `weight` (a positive
    Column over `docs`) replaces `quality_weight`. Other columns are ignored. An empty table
    gives no rows.
    """
    draws = materialize(_draws(docs, seed, ranges, (id_col, text_col, source_col), weight, False), "draws")
    x = _with_plan(draws, mix_plan(draws, weights, max_epochs))
    x = x.withColumn("epochs", _epochs()).withColumn("size", F.col("_size"))
    return x.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED, ranges: int = 1024
) -> DataFrame:
    """The mix itself: each row of `docs` (doc_id, text, source and others) as often as it is taken.

    Rows are as in `docs`, in no order. Decisions are those of `mix_sources`; texts are not shuffled.
    """
    cols = ("doc_id", "text", "source")
    draws = materialize(_draws(docs, seed, ranges, cols, None, False), "draws")
    rows = boxed(docs, doc_id="doc_id", text="text", source="source")
    x = _with_plan(_draws(rows, seed, ranges, cols, None, True), mix_plan(draws, weights, max_epochs))
    x = x.withColumn("_epochs", _epochs()).where("_epochs > 0")
    return unboxed(x.select("_row", F.explode(F.expr("sequence(1, _epochs)")).alias("_copy")))


#: DuckDB SQL for `mix_sources` with its defaults over table `documents` ({docs}).
MIX_SQL = r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) AS e,
               strlen(coalesce(text, ''))::DOUBLE AS bytes
        FROM {docs}
    ), k AS (
        SELECT doc_id, source, size,
               e / (1.0 / (1.0 + abs(bytes / greatest(size, 1)::DOUBLE - 6.5) / 6.5)) AS key
        FROM d
    ), s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
        FROM k GROUP BY source
    ), w AS (
        SELECT *, (i % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM s
    ), o AS (
        SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, i) AS r,
               sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
               sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
        FROM w
    ), l AS (
        SELECT r AS first_open, left_size AS ls, left_w AS lw FROM o WHERE cap * left_w >= left_size * w ORDER BY r LIMIT 1
    ), t AS (
        SELECT source, source_size,
               CASE WHEN r < first_open THEN cap::DOUBLE ELSE (w * ls)::BIGINT::DOUBLE / lw::BIGINT::DOUBLE END AS target
        FROM o, l
    ), p AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS epochs FROM t
    ), m AS (
        SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
               coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
    )
    SELECT doc_id, size, source_size, target,
           ((epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
    FROM m
"""
