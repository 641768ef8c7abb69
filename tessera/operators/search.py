"""Retrieval: vector and keyword search, fusion, hierarchical and graph-aware variants.

Every operator takes a DataFrame of queries (query_id, and text or embedding) and returns
rows (query_id, chunk_id, score, source, rank): one job answers all queries. Ties go to
the smaller chunk id, after rounding nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.layout import cut, few
from ..functions.vectors import cosine, score_from_cosine

#: Bytes of query vectors that are sent to every task that scans chunks.
QUERY_BYTES = 64 << 20
#: Query terms up to which they are sent to every part of an index (a row is under 100 bytes).
FEW_TERMS = 500_000
#: Terms of queries, a row a query and term, up to which a task scores its chunks for all of them at once.
FEW_ASKED = 100_000
#: Distinct terms up to which a stored index is read by a list of them.
FEW_WORDS = 200


def top_k(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each group, numbered from 1. Spark limits each task's groups before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc())
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_source(hits: DataFrame, source: str) -> DataFrame:
    return hits.withColumn("source", F.lit(source))


class _Best:
    """Of scored pairs of a query and a chunk, those that can be among each query's k best; ties go to the smaller id.

    `least` is what each query's k-th best has so far. `slack` keeps what rounding could bring level with it.
    """

    def __init__(self, queries: int, k: int, slack: float):
        import numpy as np

        self.n, self.k, self.slack, self.least, self.pool, self.held, self.room = queries, k, slack, np.full(queries, -np.inf), [], 0, 0

    def add(self, query, score, ids: pa.Array) -> None:
        if len(query):
            self.pool.append(pa.table([pa.array(query, pa.int64()), pa.array(score, pa.float64()), ids], ["q", "s", "id"]))
            self.held += len(query)
            if self.held > self.room:
                self.prune()

    def prune(self) -> None:
        import numpy as np
        import pyarrow.compute as pc

        t = pa.concat_tables(self.pool).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")]))
        q, s = t["q"].to_numpy(), t["s"].to_numpy()
        first = np.searchsorted(q, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = s[first[full] + self.k - 1]
        keep = np.arange(len(q)) - first[q] < self.k
        if self.slack:
            keep |= s >= self.least[q] - self.slack
        self.pool = [t.filter(pa.array(keep))]
        self.held = self.pool[0].num_rows
        self.room = 2 * self.held + 1000

    def hits(self) -> tuple:
        """(place of the query, chunk id, score)"""
        if not self.pool:
            return [], None, None
        self.prune()
        t = self.pool[0].combine_chunks()
        return t["q"].to_numpy(), t["id"].combine_chunks(), t["s"].combine_chunks()


#: Pairs of a query and a chunk that are scored exactly at once.
PAIRS = 20_000


def _nearest(queries: pa.Table, k: int, slack: float):
    """Arrow batches (id, embedding) -> (query_id, chunk_id, score) that hold every query's k best chunks of a task.

    One matrix product for all queries and the batch's vectors of each length; what may be among the best is
    scored once more by itself, so that equal vectors have equal scores wherever they lie.
    """
    import numpy as np

    def matrix(column, length: int):
        rows = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == length)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), length)
        with np.errstate(all="ignore"):
            n = np.sqrt(np.einsum("ij,ij->i", x, x))
            # a zero vector, or one with a null or a NaN, is at cosine 0 to all
            good = (n > 0) & np.isfinite(n)
            return rows, np.where(good[:, None], x / np.where(good, n, 1.0)[:, None], 0.0)

    ids, vectors = queries["query_id"].combine_chunks(), queries["embedding"].combine_chunks()
    blocks = {int(n): matrix(vectors, int(n)) for n in np.unique(np.asarray(vectors.value_lengths().fill_null(-1))) if n >= 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: _Best(len(q), k, slack) for n, (q, _) in blocks.items()}
        for b in batches:
            for n, (q, qm) in blocks.items():
                (rows, x), best = matrix(b.column(1), n), held[n]
                step = max(1, 1_000_000 // max(1, len(rows)))
                for at in range(0, len(q) if len(rows) else 0, step):
                    s = qm[at : at + step] @ x.T
                    least = best.least[at : at + step]
                    if len(rows) > k and np.isinf(least).any():
                        least = np.maximum(least, np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k])
                    i, j = np.nonzero(s >= (least - slack - 1e-12)[:, None])
                    for c in range(0, len(i), PAIRS):
                        u, v = at + i[c : c + PAIRS], j[c : c + PAIRS]
                        best.add(u, np.einsum("ij,ij->i", qm[u], x[v]), b.column(0).take(pa.array(rows[v])))
        for n, (q, _) in blocks.items():
            u, chunk, score = held[n].hits()
            if len(u):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[u])), chunk, score], ["query_id", "chunk_id", "score"])

    return run


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 5, threshold: float = 0.0, score_mode: str = "cosine", digits: int | None = None) -> DataFrame:
    """Exact nearest chunks by cosine for each query; chunks without an embedding are skipped.

    A vector of zeros, or with a null or NaN in it, has cosine 0 to every other; chunks whose vectors
    are of another length than a query's are not compared with it. `digits` rounds scores
    before ranking, for comparisons between engines.

    The stated query set is what meets all chunks: queries go out in blocks of at most
    `QUERY_BYTES`, a block is a pass over the chunks; a task keeps only its k best for each query.
    """
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * 8 * max(1, width or 1) // QUERY_BYTES))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['id'].dataType.simpleString()}, score double"
    rows, out = chunks.select("id", "embedding"), None  # a filter on embeddings would have them made twice
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = own.select("query_id", "embedding").toArrow()
        hits = rows.mapInArrow(_nearest(block, k, 0.0 if digits is None else 2 * 10.0**-digits), kinds)
        score = score_from_cosine(F.col("score"), score_mode)
        hits = hits.withColumn("score", score if digits is None else F.round(score, digits))
        hits = top_k(hits, k).where(F.col("score") >= threshold)
        out = hits if out is None else out.unionByName(hits)
    return with_source(out, "vector")


# --- keyword search -----------------------------------------------------------------------


def term_counts(tokens: Column) -> Column:
    """Array of (term, tf) of a token array, by sorting it: rows are counted where they lie."""

    def counted(s: Column) -> Column:
        n = F.size(s)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        pair = lambda h: lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(h, j + 1), n) - i).alias("tf"))
        return tx.let(heads, lambda h: F.transform(h, pair(h)))

    return F.when(F.size(tokens) > 0, tx.let(F.sort_array(tokens), counted))


def _places(words: pa.Array):
    """Arrow batches (chunk_id, tokens) -> (chunk_id, dl, p): p has the places in `words` of the tokens found there, in order."""
    import numpy as np
    import pyarrow.compute as pc

    kind = np.uint16 if len(words) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, n = b.column(1), b.num_rows
            dl = np.asarray(t.value_lengths().fill_null(0)).astype(np.int64)
            at = pc.index_in(t.flatten(), value_set=words.cast(t.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = at >= 0
            key = np.sort(np.repeat(np.arange(n), dl)[hit] * len(words) + at[hit])
            own = key // len(words)
            ends = np.searchsorted(own, np.arange(n + 1)).astype(np.int32) * np.int32(kind().itemsize)
            p = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer((key - own * len(words)).astype(kind))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl, pa.int32()), p], ["chunk_id", "dl", "p"])

    return run


def _counted(b: pa.RecordBatch, words: int):
    """(row, place, tf) of each row's distinct places, in order, of a batch that `_places` made."""
    import numpy as np

    p, kind = b.column(2).cast(pa.binary()), np.uint16 if words <= 1 << 16 else np.uint32
    _, ends, data = p.buffers()
    ends = np.frombuffer(ends, np.int32)[p.offset : p.offset + len(p) + 1].astype(np.int64)
    at = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).astype(np.int64) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(p)), np.diff(ends) // kind().itemsize)
    key = row * words + at
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return row[heads], at[heads], np.diff(np.append(heads, len(key)))


def _spread(first, size):
    """Indexes first[i], first[i] + 1, ... of size[i] each, one after another, and the i of each."""
    import numpy as np

    i = np.repeat(np.arange(len(size)), size)
    return np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + first[i], i


def _seen(words: int):
    """Batches of `_places` -> (place, n): chunks that have the word; at -1 all chunks, at -2 all tokens."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, tokens = np.zeros(words, np.int64), 0, 0
        for b in batches:
            df += np.bincount(_counted(b, words)[1], minlength=words)
            n, tokens = n + b.num_rows, tokens + int(np.asarray(b.column(1)).astype(np.int64).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(df[at], [n, tokens]), pa.int64())], ["place", "n"])

    return run


def _bm25(ids: pa.Array, words: int, place, query, idf, avgdl: float, bs: tuple[float, ...], k: int, k1: float, least: float, slack: float):
    """Batches of `_places` -> (query_id, chunk_id, arm, score) that hold every query's k best chunks of a task.

    `place`, `query` and `idf` are sorted. A product of single precision gives all scores nearly; what may be among
    the best is added up exactly, term by term in order. All parts are positive, so the error is a share of the score.
    """
    import numpy as np

    n, asked = len(ids), np.bincount(place, minlength=words)
    often = asked >= 8
    slot, m = np.cumsum(often) - 1, often[place]
    dense = np.zeros((int(often.sum()), n), np.float32)
    dense[slot[place[m]], query[m]] = idf[m]
    rq, rw, rare = query[~m], idf[~m], np.where(often, 0, asked)
    start, pair, share = np.cumsum(rare) - rare, place * n + query, 1 - (len(dense) + 64) * 2.0**-22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [_Best(n, k, slack) for _ in bs], max(1, min(2000, 500_000 // n))
        for whole in batches:
            for from_ in range(0, whole.num_rows, rows):
                b = whole.slice(from_, rows)
                row, at, tf = _counted(b, words)
                length, first = np.asarray(b.column(1)).astype(float), np.searchsorted(row, np.arange(b.num_rows + 1))
                for x, best in zip(bs, held):
                    part = (tf * (k1 + 1)) / (tf + k1 * ((1 - x) + x * length[row] / avgdl))
                    o = often[at]
                    a = np.zeros((b.num_rows, len(dense)), np.float32)
                    a[row[o], slot[at[o]]] = part[o]
                    near = a @ dense
                    i, j = _spread(start[at], rare[at])
                    near += np.bincount(row[j] * n + rq[i], part[j] * rw[i], near.size).reshape(near.shape)
                    low = best.least
                    if b.num_rows > k and np.isinf(low).any():
                        low = np.maximum(low, np.partition(near, b.num_rows - k, axis=0)[b.num_rows - k] * share)
                    r, q = np.nonzero((near > 0) & (near >= ((np.maximum(low, least) - slack) * share)[None, :]))
                    for c in range(0, len(r), PAIRS):
                        u, v = r[c : c + PAIRS], q[c : c + PAIRS]
                        i, j = _spread(first[u], first[u + 1] - first[u])
                        key = at[i] * n + v[j]
                        to = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
                        hit = pair[to] == key
                        s = np.bincount(j[hit], idf[to[hit]] * part[i[hit]], len(u))
                        best.add(v, s, b.column(0).take(pa.array(u)))
        for arm, best in enumerate(held):
            q, chunk, score = best.hits()
            if len(q):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), chunk, pa.array([arm] * len(q), pa.int32()), score], ["query_id", "chunk_id", "arm", "score"])

    return run


class KeywordIndex:
    """Index partitioned by chunk: postings (chunk_id, term, tf, dl) and corpus statistics.

    Build once and store. Query terms, few, go to all parts; each part adds up its own chunks'
    scores and keeps its best, so only those are shuffled. `df` (term, df) is there in a stored index; without it
    a search counts the documents of its own terms. An index that is only a plan also has its `rows` (chunk_id, dl, p), a chunk
    each, where they lie: a search counts in them and deals out by chunk what it asks for, not all postings. Up to `FEW_ASKED` terms it
    reads `tokens` (chunk_id, t) once instead, keeps the places of its terms on disk meanwhile and scores a task's chunks for all queries at once.
    """

    def __init__(self, postings: DataFrame, stats: DataFrame, tokenize: Callable[[Column], Column], df: DataFrame | None = None, rows: DataFrame | None = None, tokens: DataFrame | None = None):
        self.postings, self.stats, self.tokenize, self.df, self.rows, self.tokens = postings, stats, tokenize, df, rows, tokens

    @staticmethod
    def build(chunks: DataFrame, tokenize: Callable[[Column], Column] = tx.words_cjk, content: str = "content") -> KeywordIndex:
        """Terms are counted in their rows; what is dealt by chunk, for searches to move no postings, is a row a chunk."""
        t = chunks.select(F.col("id").alias("chunk_id"), tokenize(F.coalesce(F.col(content), F.lit(""))).alias("t"))
        tokens, t = t, t.select("chunk_id", F.size("t").alias("dl"), term_counts(F.col("t")).alias("p"))
        n = F.count(F.lit(1)).cast("double")
        stats = t.agg(n.alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.nullif(n, F.lit(0.0))).alias("avgdl"))
        return KeywordIndex(KeywordIndex._postings(t.repartition("chunk_id")), stats, tokenize, rows=t, tokens=tokens)

    @staticmethod
    def _postings(rows: DataFrame) -> DataFrame:
        """A chunk without tokens has one posting of no term, so that it counts in the corpus; the
        length comes with every posting, so statistics need no second reading of the texts."""
        return rows.select("chunk_id", "dl", F.explode_outer("p").alias("p")).select("chunk_id", "p.term", "p.tf", "dl")

    @staticmethod
    def _stats(postings: DataFrame) -> DataFrame:
        """(n, avgdl): a chunk's shares tf / dl add up to one."""
        s = postings.agg(
            F.round(F.sum(F.when(F.col("term").isNull(), 1.0).otherwise(F.col("tf") / F.col("dl")))).alias("n"),
            F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).alias("tokens"),
        )
        return s.select("n", (F.coalesce("tokens", F.lit(0)) / F.col("n")).alias("avgdl"))

    def cached(self) -> KeywordIndex:
        """The same index with its postings kept by the executors; a lost part is made again."""
        kept = self.postings.persist()
        return KeywordIndex(kept, KeywordIndex._stats(kept), self.tokenize, self.df)

    def save(self, path: str) -> None:
        """Postings sorted by term within each part, so that a search for few terms skips most row groups."""
        self.postings.sortWithinPartitions("term").write.parquet(f"{path}/postings")
        self.stats.coalesce(1).write.parquet(f"{path}/stats")
        spark = self.postings.sparkSession
        df = spark.read.parquet(f"{path}/postings").where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df.sortWithinPartitions("term").write.parquet(f"{path}/df")

    @staticmethod
    def load(spark, path: str, tokenize: Callable[[Column], Column] = tx.words_cjk) -> KeywordIndex:
        return KeywordIndex(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "stats")), tokenize, spark.read.parquet(f"{path}/df"))

    def search(self, queries: DataFrame, k: int = 5, threshold: float = 0.0, k1: float = 1.5, b: float = 0.75, text: str = "query", digits: int | None = None) -> DataFrame:
        """BM25. A term that a query repeats counts as often. Only scores above 0 and at least `threshold`.

        `digits` rounds scores before ranking, for comparisons between engines.
        """
        return self.search_arms(queries, (b,), k, threshold, k1, text, digits).drop("arm")

    def search_arms(self, queries: DataFrame, bs: tuple[float, ...], k: int = 5, threshold: float = 0.0, k1: float = 1.5, text: str = "query", digits: int | None = None) -> DataFrame:
        """`search` for several `b` in one pass over the postings; `arm` is the place in `bs`."""
        terms = queries.select("query_id", F.explode(self.tokenize(F.coalesce(F.col(text), F.lit("")))).alias("term"))
        terms = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
        if self.tokens is not None and few(terms, FEW_ASKED) is F.broadcast:
            return self._search_tokens(terms, bs, k, threshold, k1, digits)
        small, postings, known = few(terms, FEW_TERMS), self.postings, self.df
        if known is not None and small is F.broadcast:
            words = [r["term"] for r in terms.select("term").distinct().limit(FEW_WORDS + 1).collect()]
            if len(words) <= FEW_WORDS:  # what the files can skip by
                postings, known = postings.where(F.col("term").isin(words)), known.where(F.col("term").isin(words))
        found = postings
        if self.rows is not None and small is F.broadcast:
            found = self._postings(self.rows)
            postings = found.join(small(terms.select("term").distinct()), "term", "left_semi").repartition("chunk_id")
        if known is None:
            known = found.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        n = F.col("n")
        # all that a query term brings to a posting, in one table of a row a query and term
        asked = small(terms).join(known, "term").crossJoin(F.broadcast(self.stats)).select(
            "query_id", "term", (F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("qf")).alias("idf"), "avgdl"
        )
        hit = postings.join(small(asked), "term")
        part = lambda b: F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
        scored = hit.groupBy("query_id", "chunk_id").agg(*[F.sum(part(b)).alias(f"s{i}") for i, b in enumerate(bs)])
        arms = F.array(*[F.struct(F.lit(i).alias("arm"), F.col(f"s{i}").alias("score")) for i in range(len(bs))])
        scored = scored.select("query_id", "chunk_id", F.inline(arms)) if len(bs) > 1 else scored.select("query_id", "chunk_id", F.lit(0).alias("arm"), F.col("s0").alias("score"))
        if digits is not None:
            scored = scored.withColumn("score", F.round("score", digits))
        return with_source(top_k(scored.where((F.col("score") > 0) & (F.col("score") >= threshold)), k, ("arm", "query_id")), "keyword")

    def _search_tokens(self, terms: DataFrame, bs: tuple[float, ...], k: int, threshold: float, k1: float, digits: int | None) -> DataFrame:
        import numpy as np
        import pyarrow.compute as pc

        asked = terms.toArrow().combine_chunks()
        words = pc.unique(asked["term"]).sort().cast(pa.string())
        chunk = f"chunk_id {self.tokens.schema['chunk_id'].dataType.simpleString()}"
        kinds = f"query_id {terms.schema['query_id'].dataType.simpleString()}, {chunk}, arm int, score double"
        if not len(words):
            hits = terms.sparkSession.createDataFrame([], kinds)
        else:
            kept = self.tokens.mapInArrow(_places(words), f"{chunk}, dl int, p binary").persist(StorageLevel.DISK_ONLY)
            seen = {r["place"]: r["n"] for r in kept.mapInArrow(_seen(len(words)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
            n = float(seen.get(-1, 0))
            ids = pc.unique(asked["query_id"])
            place, query = (pc.index_in(asked[c], value_set=v).to_numpy().astype(np.int64) for c, v in (("term", words), ("query_id", ids)))
            df = np.array([seen.get(i, 0) for i in range(len(words))], float)[place]
            idf = np.array([math.log(x) for x in (n - df + 0.5) / (df + 0.5) + 1]) * asked["qf"].to_numpy()
            order = np.lexsort((query, place))
            avgdl = seen.get(-2, 0) / n if n else 0.0
            slack = 0.0 if digits is None else 2 * 10.0**-digits
            hits = kept.mapInArrow(_bm25(ids, len(words), place[order], query[order], idf[order], avgdl, bs, k, k1, threshold, slack), kinds)
        if digits is not None:
            hits = hits.withColumn("score", F.round("score", digits))
        hits = top_k(hits.where((F.col("score") > 0) & (F.col("score") >= threshold)), k, ("arm", "query_id"))
        if len(words):
            hits = cut(hits)
            hits.count()
            kept.unpersist()
        return with_source(hits, "keyword")


# --- fusion -------------------------------------------------------------------------------


def minmax(hits: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1: a single hit gives 1, equal scores 0.5."""
    w = W.partitionBy("query_id")
    lo, hi, n = F.min("score").over(w), F.max("score").over(w), F.count(F.lit(1)).over(w)
    return hits.withColumn("score", F.when(n == 1, 1.0).when(hi == lo, 0.5).otherwise((F.col("score") - lo) / (hi - lo)))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 5, vector_weight: float = 0.5, keyword_weight: float = 0.5, threshold: float = 0.0) -> DataFrame:
    """Weighted sum of both arms' scaled scores by chunk. Arms should hold 2k hits a query."""
    arms = [
        minmax(a).select("query_id", "chunk_id", (F.col("score") * w).alias("score"))
        for a, w in ((vector, vector_weight), (keyword, keyword_weight))
    ]
    s = arms[0].unionByName(arms[1]).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    return with_source(top_k(s.where(F.col("score") >= threshold), k), "fusion")


def rrf(arms: list[DataFrame], k: int = 5, constant: int = 60, threshold: float = 0.0) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (constant + rank) over the arms; a repeat in an arm counts again."""
    u = None
    for a in arms:
        p = a.select("query_id", "chunk_id", (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"))
        u = p if u is None else u.unionByName(p)
    s = u.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    return with_source(top_k(s.where(F.col("score") >= threshold), k), "fusion")


# --- structure-aware search ---------------------------------------------------------------


def small_to_big(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Child hits -> their parents, each once with its best child's score.

    A hit whose parent is unknown is dropped, one without a parent stays. `chunks`: (id, parent_id);
    `parents`: (id).
    """
    h = hits.join(chunks.select(F.col("id").alias("chunk_id"), "parent_id"), "chunk_id", "left")
    h = h.join(parents.select(F.col("id").alias("_p")), F.col("parent_id") == F.col("_p"), "left")
    h = h.where(F.col("parent_id").isNull() | F.col("_p").isNotNull())
    g = h.groupBy("query_id", F.coalesce("parent_id", "chunk_id").alias("chunk_id")).agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("_r"))
    w = W.partitionBy("query_id").orderBy("_r")
    return g.withColumn("rank", F.row_number().over(w)).withColumn("source", F.lit("vector")).drop("_r")


def hierarchical(
    queries: DataFrame, summaries: DataFrame, details: DataFrame, summary_k: int = 3, content_k: int = 3, k: int = 5, prefilter: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Best summaries choose documents; best details of those documents, at most `content_k` each.

    Details are searched first (summary_k * content_k a query) and then filtered, so a
    document's details can miss out; `prefilter` ranks only details of the chosen documents.
    """
    chosen = vector_search(queries, summaries, summary_k, digits=digits).join(
        summaries.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id"
    ).select("query_id", "document_id").distinct()
    own = details.select(F.col("id").alias("chunk_id"), "document_id")
    if prefilter:
        q = queries.select("query_id", F.col("embedding").alias("qv")).join(chosen, "query_id")
        d = details.select(F.col("id").alias("chunk_id"), "document_id", "embedding")
        hits = q.join(d, "document_id").select("query_id", "chunk_id", "document_id", cosine(F.col("qv"), F.col("embedding")).alias("score"))
    else:
        hits = vector_search(queries, details, summary_k * content_k, digits=digits).drop("rank", "source").join(own, "chunk_id").join(chosen, ["query_id", "document_id"], "left_semi")
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    best = top_k(hits, content_k, ("query_id", "document_id")).drop("rank")
    return with_source(top_k(best, k), "vector")


# --- routing and query transforms -----------------------------------------------------------


def route(queries: DataFrame, rules: list[tuple[str, Column]], default: str = "default") -> DataFrame:
    """Adds route: the name of the first rule that holds. Rules are (name, condition)."""
    c = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        c = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(c)
    return queries.withColumn("route", F.coalesce(c, F.lit(default)))


def llm_rule(llm, question: str, text: str = "query") -> Column:
    """A condition that a model decides: it holds if the answer starts with yes."""
    from .providers import chat_column

    ask = F.concat(F.lit(question + "\n"), F.col(text), F.lit("\nyes / no"))
    return F.startswith(F.lower(tx.trim(chat_column(llm, ask))), F.lit("yes"))


def routed(queries: DataFrame, retrievers: dict[str, Callable[[DataFrame], DataFrame]], default: str = "default") -> DataFrame:
    """Each route's queries to its retriever; results together. An unknown route takes the default."""
    out = None
    known = [r for r in retrievers if r != default]
    for name, retrieve in retrievers.items():
        own = F.col("route") == name if name != default else ~F.col("route").isin(*known) if known else F.lit(True)
        got = retrieve(queries.where(own))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def parse_list(answer: Column, limit: int) -> Column:
    """A model's list: a JSON array of strings, or its non-blank lines without numbering; at most `limit`."""
    from .providers import json_body

    listed = F.from_json(json_body(answer), "array<string>")
    lines = F.filter(
        F.transform(F.split(answer, "\n"), lambda x: tx.trim(F.regexp_replace(tx.trim(x), r"^(\d+[.)]|[-*])\s*", ""))), lambda x: F.length(x) > 0
    )
    found = F.filter(F.coalesce(listed, lines), lambda x: F.length(tx.trim(x)) > 0)
    return F.slice(found, 1, limit)


def expand_queries(queries: DataFrame, llm, kind: str, limit: int = 3, text: str = "query") -> DataFrame:
    """1 -> n: (query_id, sub_index, query). kind: `multi` (paraphrases) or `decompose` (sub-questions).

    Where the model gives nothing the query itself is the only one.
    """
    from .providers import chat_column

    ask = {"multi": f"请从不同角度改写查询，生成 {limit} 个，以 JSON 数组返回：\n", "decompose": f"请把问题拆成至多 {limit} 个子问题，以 JSON 数组返回：\n"}[kind]
    got = parse_list(chat_column(llm, F.concat(F.lit(ask), F.col(text))), limit)
    subs = F.when(F.size(got) > 0, got).otherwise(F.array(F.col(text)))
    return queries.select(*[c for c in queries.columns if c != text], F.posexplode(subs).alias("sub_index", text))


def rewrite_queries(queries: DataFrame, llm, kind: str = "rewrite", text: str = "query") -> DataFrame:
    """1 -> 1: `rewrite` for search, or `hyde` for a made-up answer. Where the model fails the query stays."""
    from .providers import chat_column

    ask = {"rewrite": "请把问题改写为适合检索的查询：\n", "hyde": "请写一段可能回答问题的文字：\n"}[kind]
    got = tx.trim(chat_column(llm, F.concat(F.lit(ask), F.col(text))))
    return queries.withColumn(text, F.coalesce(F.when(F.length(got) > 0, got), F.col(text)))


def transform_queries(queries: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps one after another; each may return one or several rows a query. Adds the final sub_index."""
    q = queries
    for step in steps:
        if "sub_index" in q.columns:
            q = step(q.withColumnRenamed("sub_index", "_outer"))
            inner = F.col("sub_index") if "sub_index" in q.columns else F.lit(0)
            w = W.partitionBy("query_id").orderBy("_outer", "_inner")
            q = q.withColumn("_inner", inner).withColumn("sub_index", F.row_number().over(w) - 1).drop("_outer", "_inner")
        else:
            q = step(q)
    return q if "sub_index" in q.columns else q.withColumn("sub_index", F.lit(0))
