"""Document operators: cleaning, metadata, augmentation, dedup and chunking.

Documents are rows (id, content, metadata columns, ord); every operator is a DataFrame
transform and keeps columns it does not know.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.layout import cut, few


# --- cleaning -----------------------------------------------------------------------------


def clean_documents(
    docs: DataFrame,
    content: str = "content",
    html: bool = True,
    header_footer: bool = False,
    special_chars: bool = False,
    whitespace: bool = True,
    stamp: bool = True,
) -> DataFrame:
    """The chosen steps in a fixed order: html, header and footer, special characters, white space."""
    c = F.col(content)
    for on, step in (
        (html, tx.strip_html),
        (header_footer, tx.strip_header_footer),
        (special_chars, tx.strip_special),
        (whitespace, tx.normalize_space),
    ):
        c = step(c) if on else c
    out = docs.withColumn(content, c)
    return out.withColumn("cleaned", F.lit(True)).withColumn("cleaned_at", F.current_timestamp()) if stamp else out


# --- metadata -----------------------------------------------------------------------------

UNTITLED = "未命名"
FAILED = "提取失败"


def base_metadata(docs: DataFrame, content: str = "content") -> DataFrame:
    """Adds title, language, char_count, word_count, line_count.

    title: the first non-blank line without leading #; language: zh if Han characters are
    over 30% of Han and Latin letters, en if there are any letters, else unknown;
    word_count: Han characters plus Latin-letter runs.
    """
    c = F.col(content)
    lines = F.split(c, "\n")
    first = F.get(F.filter(F.transform(lines, tx.trim), lambda x: F.length(x) > 0), F.lit(0))
    title = tx.trim(F.regexp_replace(first, r"^#+\s*", ""))
    han = F.regexp_count(c, F.lit("[一-龥]")).cast("long")
    latin = F.regexp_count(c, F.lit("[a-zA-Z]")).cast("long")
    runs = F.regexp_count(c, F.lit("[a-zA-Z]+")).cast("long")
    return docs.withColumns(
        {
            "title": F.coalesce(F.when(F.length(title) > 0, title), F.lit(UNTITLED)),
            "language": F.when(han + latin == 0, "unknown").when(han / (han + latin) > 0.3, "zh").otherwise("en"),
            "char_count": F.length(c).cast("long"),
            "word_count": han + runs,
            "line_count": F.size(lines).cast("long"),
        }
    )


def _chat_json(docs: DataFrame, llm, prompt: Column, schema: T.StructType, out: str) -> DataFrame:
    """One model call a row; the answer parsed in SQL, null where it is not what `schema` says."""
    from .providers import chat_column, json_body

    return docs.withColumn(out, F.from_json(json_body(chat_column(llm, prompt)), schema, {"mode": "PERMISSIVE"}))


def llm_metadata(docs: DataFrame, llm, categories: list[str] | None = None, content: str = "content") -> DataFrame:
    """Adds topic, keywords (at most five) and summary from a model that reads the first 2000
    characters; where it fails topic is a fixed mark, keywords are empty and summary is ''."""
    ask = "请提取文档的主题、关键词和摘要，以 JSON 返回 topic、keywords、summary。" + (
        f"主题从以下类别中选择：{'、'.join(categories)}。" if categories else ""
    )
    schema = T.StructType().add("topic", "string").add("keywords", T.ArrayType(T.StringType())).add("summary", "string")
    d = _chat_json(docs, llm, F.concat(F.lit(ask + "\n"), F.substr(content, F.lit(1), F.lit(2000))), schema, "_m")
    return d.withColumns(
        {
            "topic": F.coalesce("_m.topic", F.lit(FAILED)),
            "keywords": F.coalesce(F.slice("_m.keywords", 1, 5), F.array().cast("array<string>")),
            "summary": F.coalesce("_m.summary", F.lit("")),
        }
    ).drop("_m")


def augment_documents(
    docs: DataFrame, llm, summary: bool = True, keywords: bool = True, qa_pairs: int = 0, content: str = "content"
) -> DataFrame:
    """Appends model-made blocks to the content behind a rule: summary, keywords, questions with answers."""
    c = F.col(content)
    d, blocks = docs, []
    if summary:
        d = _chat_json(d, llm, F.concat(F.lit("请总结，以 JSON 返回 summary。\n"), F.substr(c, F.lit(1), F.lit(3000))), T.StructType().add("summary", "string"), "_s")
        blocks.append(F.when(F.length("_s.summary") > 0, F.concat(F.lit("[摘要] "), F.col("_s.summary"))))
    if keywords:
        d = _chat_json(d, llm, F.concat(F.lit("请提取关键词，以 JSON 返回 keywords。\n"), F.substr(c, F.lit(1), F.lit(2000))), T.StructType().add("keywords", T.ArrayType(T.StringType())), "_k")
        blocks.append(F.when(F.size("_k.keywords") > 0, F.concat(F.lit("[关键词] "), F.array_join("_k.keywords", ", "))))
    if qa_pairs:
        pair = T.StructType().add("question", "string").add("answer", "string")
        d = _chat_json(d, llm, F.concat(F.lit(f"请生成 {qa_pairs} 个问答对，以 JSON 返回 pairs。\n"), F.substr(c, F.lit(1), F.lit(3000))), T.StructType().add("pairs", T.ArrayType(pair)), "_q")
        lines = F.transform(F.slice("_q.pairs", 1, qa_pairs), lambda p: F.concat(F.lit("[Q] "), p["question"], F.lit("\n[A] "), p["answer"]))
        blocks.append(F.when(F.size("_q.pairs") > 0, F.array_join(lines, "\n")))
    tail = F.array_join(F.array_compact(F.array(*blocks)), "\n\n") if blocks else F.lit("")
    d = d.withColumn(content, F.when(F.length(tail) > 0, F.concat(c, F.lit("\n\n---\n"), tail)).otherwise(c))
    return d.drop("_s", "_k", "_q").withColumn("augmented_at", F.current_timestamp())


# --- dedup --------------------------------------------------------------------------------


def dedup_hash(docs: DataFrame, content: str = "content", order: str = "ord") -> DataFrame:
    """The first document, by `order`, of each content (white space normalised).

    The survivor of a group is found with a partial aggregate, so copies meet as one row a
    task; documents then join on their own order key.
    """
    keyed = docs.withColumn("_hash", tx.content_hash(F.coalesce(F.col(content), F.lit(""))))
    first = keyed.groupBy("_hash").agg(F.min(order).alias("_first")).select("_first")
    return keyed.join(first, F.col(order) == F.col("_first"), "left_semi").drop("_hash")


#: Bytes of vectors in one block of `similar_pairs`.
BLOCK_BYTES = 64 << 20


def similar_pairs(docs: DataFrame, threshold: float, vector: str = "embedding", block: str | None = None, order: str = "ord") -> DataFrame:
    """Pairs (a, b), a < b by `order`, with cosine >= threshold, exactly.

    Rows that agree in `block` (all, without one) are dealt to blocks so that a pair of blocks is one
    task's product of two matrices. There are as many blocks as the cores need, about two square
    roots of their number, and more only where a block would pass `BLOCK_BYTES`: a row is sent to each.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(order).alias("o"), F.transform(vector, lambda x: x.cast("double")).alias("v"), (F.col(block).cast("string") if block else F.lit("")).alias("k"))
    d = d.where("v is not null")
    n, width = d.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    wanted = max(math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism)), -(-n * 8 * (width or 1) // BLOCK_BYTES))
    own = d.groupBy(F.col("k").alias("k2")).agg(F.ceil(F.count(F.lit(1)) / max(256, -(-n // wanted))).cast("int").alias("g"))
    d = d.join(few(own, 100_000)(own), F.expr("k <=> k2"))
    d = d.withColumn("own", F.pmod(F.xxhash64("o"), F.col("g")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    d = d.select("o", "v", "k", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        o, mine = pdf["o"].to_numpy(), pdf["own"].to_numpy()
        same = pdf["p"].iloc[0] == pdf["q"].iloc[0]
        out = []
        for lo in range(0, len(x), 2048):
            for at in range(0, len(x), 8192):
                s = x[lo : lo + 2048] @ x[at : at + 8192].T
                ok = (s >= threshold) & (o[lo : lo + 2048, None] < o[None, at : at + 8192])
                if not same:
                    ok &= mine[lo : lo + 2048, None] != mine[None, at : at + 8192]
                i, j = np.nonzero(ok)
                out.append(pd.DataFrame({"a": o[lo + i], "b": o[at + j], "cosine": s[i, j]}))
        return pd.concat(out)

    kind = docs.schema[order].dataType.simpleString()
    return d.groupBy("k", "p", "q").applyInPandas(run, f"a {kind}, b {kind}, cosine double")


#: Pairs of a component up to which one task decides on it.
SMALL_COMPONENT = 200_000


def dedup_embedding(docs: DataFrame, threshold: float = 0.95, vector: str = "embedding", content: str = "content", order: str = "ord", block: str | None = None, small: int = SMALL_COMPONENT) -> DataFrame:
    """Near-dedup in `order`: each document that is still there looks at the later ones near it, in
    order, and drops those that are not longer; the first longer one drops it instead.

    Decisions interact only through near pairs. A component of up to `small` pairs is decided in one
    task. In larger ones, round by round, all documents act that come first among what is left
    within two steps of them: no other can change what they see. Rounds go on until no pair is left.
    """
    pairs = cut(similar_pairs(docs, threshold, vector, block, order).select("a", "b"))
    size = docs.select(F.col(order).alias("o"), F.coalesce(F.length(content), F.lit(0)).alias("len"))
    for end in ("a", "b"):
        pairs = pairs.join(size.select(F.col("o").alias(end), F.col("len").alias(f"len_{end}")), end)
    comps = _components(pairs)
    edges = pairs.join(comps.withColumnRenamed("o", "a"), "a").select("c", "a", "b", "len_a", "len_b")
    large = cut(edges.groupBy("c").count().where(F.col("count") > small).select("c"))

    def greedy(e: pd.DataFrame) -> pd.DataFrame:
        length = dict(zip(e["a"], e["len_a"])) | dict(zip(e["b"], e["len_b"]))
        later: dict = {}
        for a, b in zip(e["a"], e["b"]):
            later.setdefault(a, []).append(b)
        gone = set()
        for a in sorted(later):
            for b in sorted(later[a]) if a not in gone else ():
                if b in gone:
                    continue
                if length[a] < length[b]:
                    gone.add(a)
                    break
                gone.add(b)
        return pd.DataFrame({"o": sorted(gone)})

    kind = docs.schema[order].dataType.simpleString()
    dropped = edges.join(few(large, 100_000)(large), "c", "left_anti").groupBy("c").applyInPandas(greedy, f"o {kind}")
    if not large.isEmpty():
        dropped = dropped.union(_by_rounds(edges.join(few(large, 100_000)(large), "c", "left_semi").drop("c")))
    return docs.join(dropped.withColumnRenamed("o", order), order, "left_anti")


def _by_rounds(edges: DataFrame) -> DataFrame:
    """(o) of the documents that the rule of `dedup_embedding` drops; edges: (a, b, len_a, len_b), a < b."""
    e, out = cut(edges), None
    while not e.isEmpty():
        both = e.select("a", "b").union(e.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("o"), F.least("a", "m").alias("m"))
        far = both.join(near.withColumnRenamed("o", "b"), "b").groupBy("a").agg(F.min("m").alias("m2"))
        act = e.join(far, "a").where("m2 = a").drop("m2")
        # the first longer one stops it
        stop = act.groupBy("a").agg(F.min(F.when(F.col("len_b") > F.col("len_a"), F.col("b"))).alias("stop"))
        act = cut(act.join(stop, "a").select("a", "b", "stop"))
        gone = act.where("stop is null or b < stop").select(F.col("b").alias("o")).union(act.where("stop is not null").select("a")).distinct()
        gone = cut(gone)
        settled = cut(gone.union(act.select("a")).distinct())
        for end in ("a", "b"):
            e = e.join(settled.withColumnRenamed("o", end), end, "left_anti")
        e = cut(e.select("a", "b", "len_a", "len_b"))
        out = gone if out is None else out.union(gone)
    return out


def deduplicate(docs: DataFrame, mode: str = "hash", embedding=None, threshold: float = 0.95, content: str = "content", order: str = "ord") -> DataFrame:
    """`hash` (equal contents), `embedding` (near ones, by a provider's embeddings of the first 2,000 characters) or `both`."""
    if mode not in ("hash", "embedding", "both"):
        raise ValueError("mode must be hash, embedding or both")
    if mode != "hash" and embedding is None:
        raise ValueError("embedding and both need an embedding provider")
    d = docs if mode == "embedding" else dedup_hash(docs, content, order)
    if mode == "hash":
        return d
    from .providers import embed_column

    head = d.withColumn("_head", F.substr(F.coalesce(F.col(content), F.lit("")), F.lit(1), F.lit(2000)))
    d = cut(head.withColumn("_vector", embed_column(embedding, "_head")).drop("_head"))
    return dedup_embedding(d, threshold, "_vector", content, order).drop("_vector")


def _components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(o, c): smallest order key reachable, for every row that has a pair.

    Large-star and small-star rounds in turn, as many as the logarithm of a component asks for
    and not its diameter. Neither parts what is connected, so once every row points at one root
    the roots are exact; if `rounds` do not get there it raises.
    """
    e = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    for _ in range(rounds):
        ends = e.select(F.col("a").alias("o"), F.lit(1).alias("up"), F.lit(0).alias("root"))
        ends = ends.union(e.select("b", F.lit(0), F.lit(1))).groupBy("o").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if not ends.where("up + root > 1").limit(1).count():
            return e.select(F.col("a").alias("o"), F.col("b").alias("c")).union(e.select("b", "b").distinct())
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        e = cut(small.select("x.a", F.col("x.m").alias("b")).where("a > b").distinct())
    raise RuntimeError("components did not settle")


# --- chunking -----------------------------------------------------------------------------

Pieces = list[tuple[str, dict]]


#: Chunks that a worker holds before it hands them on; those of a whole batch of documents are many times its size.
OUT_ROWS = 4096


def _row_chunks(docs: DataFrame, pieces: Callable[[str], list[tuple]], id_col: str, content: str, extra: str = "") -> DataFrame:
    """Apply a per-text cutter: rows (chunk_id, document_id, content, chunk_index, extras), in one narrow stage."""
    columns = ["chunk_id", "document_id", "content", "chunk_index", *[x.split()[0] for x in extra.split(", ") if x]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["content"]):
                out += [(f"{i}_chunk_{n}", i, p[0], n, *p[1:]) for n, p in enumerate(pieces(t or ""))]
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(content).alias("content"))
    return d.mapInPandas(run, "chunk_id string, document_id string, content string, chunk_index int" + (", " + extra if extra else ""))


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk_size must be positive, got {size}")
    if overlap < 0:
        raise ValueError(f"overlap must be non-negative, got {overlap}")
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be less than chunk_size ({size})")


def fixed_size_cut(t: str, size: int, overlap: int, separator: str, strict: bool = False) -> list[tuple[str]]:
    """Windows that end at the last separator, else the last blank, in their second half.

    The next window starts the trimmed piece's length less `overlap` on, and a piece no longer than
    the overlap ends the document. `strict` goes by the piece's length before trimming instead, so
    that nothing is lost or repeated beyond the overlap.
    """
    if not t.strip():
        return []
    if len(t) <= size:
        return [(t.strip(),)]
    out, at = [], 0
    while at < len(t):
        window = t[at : at + size]
        if at + size >= len(t):
            if window.strip():
                out.append((window.strip(),))
            break
        ends = (window.rfind(separator), window.rfind(" "))
        end = next((e for e in ends if e > size * 0.5), len(window))
        piece = window[:end].strip()
        if piece:
            out.append((piece,))
        step = (end if strict else len(piece)) - overlap
        if step <= 0 and not strict:
            break
        at += step if step > 0 else end
    return out


def chunk_fixed_size(docs: DataFrame, chunk_size: int = 500, overlap: int = 50, separator: str = "\n", strict: bool = False, id_col: str = "id", content: str = "content") -> DataFrame:
    _check(chunk_size, overlap)
    return _row_chunks(docs, lambda t: fixed_size_cut(t, chunk_size, overlap, separator, strict), id_col, content)


#: From paragraphs down to single characters.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "!", "？", "?", "；", ";", " ", "")


def recursive_cut(t: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str]]:
    """Merge pieces up to `size` at each separator; a longer piece is cut at the next one. Then
    each chunk is led by the last `overlap` characters of the one before, as it then reads."""
    if not t.strip():
        return []

    def split(part: str, level: int) -> Iterator[str]:
        if len(part) <= size:
            yield part
            return
        sep = separators[level] if level < len(separators) else ""
        if not sep:
            yield from (part[i : i + size] for i in range(0, len(part), size))
            return
        pieces = part.split(sep)
        if len(pieces) == 1:
            yield from split(part, level + 1)
            return
        held = ""
        for p in pieces:
            joined = held + sep + p if held else p
            if len(joined) <= size:
                held = joined
                continue
            if held:
                yield held
            held = ""
            if len(p) > size:
                yield from split(p, level + 1)
            else:
                held = p
        if held:
            yield held

    out: list[str] = []
    for piece in filter(None, (p.strip() for p in split(t, 0))):
        out.append(f"{out[-1][-overlap:]} {piece}" if out and overlap else piece)
    return [(x,) for x in out]


def chunk_recursive(docs: DataFrame, chunk_size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, id_col: str = "id", content: str = "content") -> DataFrame:
    _check(chunk_size, overlap)
    return _row_chunks(docs, lambda t: recursive_cut(t, chunk_size, overlap, separators), id_col, content)


def pack_sentences(parts: list[str], longest: int) -> list[list[str]]:
    """Greedy groups whose sentences add up to at most `longest` characters (one may be longer)."""
    out: list[list[str]] = []
    held = 0
    for s in parts:
        if not out or held + len(s) > longest:
            out.append([])
            held = 0
        out[-1].append(s)
        held += len(s)
    return out


def _sentences(t: str) -> list[str]:
    import re

    return [s for s in re.split(r"(?<=[。！？.!?\n])\s*", t) if s.strip()]


def _slices(t: str, n: int) -> list[str]:
    return [t[i : i + n] for i in range(0, len(t), n)]


def sentence_cut(t: str, longest: int) -> list[tuple[str]]:
    parts = _sentences(t)
    if len(parts) == 1 and len(parts[0].strip()) > longest:
        return [(x,) for x in _slices(parts[0].strip(), longest)]
    return [(" ".join(g).strip(),) for g in pack_sentences(parts, longest)]


def chunk_sentences(docs: DataFrame, max_chunk_size: int = 1000, id_col: str = "id", content: str = "content") -> DataFrame:
    """Sentences packed up to a size: the semantic chunker without embeddings."""
    return _row_chunks(docs, lambda t: sentence_cut(t, max_chunk_size), id_col, content)


def semantic_cut(t: str, embed: Callable[[list[str]], list], threshold: float, shortest: int, longest: int) -> list[tuple[str]]:
    """Break where neighbouring sentences' embeddings have a cosine under `threshold`; short groups
    join the one before, long ones are packed anew."""
    import numpy as np

    parts = _sentences(t)
    if len(parts) < 2:
        return sentence_cut(t, longest)
    x = np.asarray(embed(parts), float)
    n = np.sqrt((x * x).sum(axis=1))
    d = n[1:] * n[:-1]
    sim = np.where(d > 0, (x[1:] * x[:-1]).sum(axis=1) / np.where(d > 0, d, 1), 0.0)
    groups: list[list[str]] = [[parts[0]]]
    for s, c in zip(parts[1:], sim):
        if c < threshold:
            groups.append([])
        groups[-1].append(s)
    out: list[list[str]] = []
    for g in groups:
        size = len(" ".join(g))
        if size < shortest and out:
            out[-1] = out[-1] + g
        elif size > longest:
            out += pack_sentences(g, longest)
        else:
            out.append(g)
    return [(" ".join(g).strip(),) for g in out]


def chunk_semantic(docs: DataFrame, embedding, threshold: float = 0.5, min_chunk_size: int = 50, max_chunk_size: int = 1000, id_col: str = "id", content: str = "content") -> DataFrame:
    return _row_chunks(docs, lambda t: semantic_cut(t, embedding.embed_batch, threshold, min_chunk_size, max_chunk_size), id_col, content)


def markdown_cut(t: str, size: int, max_level: int, include_headings: bool) -> list[tuple[str, str, int]]:
    """Blocks under headings up to `max_level`; long ones are packed by paragraphs, each under its heading.

    A heading with no line before the next one is lost, fenced code is not told apart and
    a long paragraph stays whole, as the behaviour that is matched has it.
    """
    import re

    if not t.strip():
        return []
    blocks: list[tuple[int, str, list[str]]] = [(0, "", [])]
    for line in t.split("\n"):
        m = re.match(r"(#{1,6})\s+(.+)$", line)
        if m and len(m[1]) <= max_level:
            blocks.append((len(m[1]), m[2].strip(), []))
        else:
            blocks[-1][2].append(line)
    filled = [b for b in blocks if b[2]] or blocks[-1:]
    if not blocks[-1][2] and not any(b[2] for b in blocks):
        filled = blocks[-1:]
    bodies = [(lv, h, "\n".join(ls).strip()) for lv, h, ls in filled]
    out = []
    for n, (level, heading, body) in enumerate(bodies):
        if n and not body:
            continue
        lead = f"{'#' * level} {heading}\n" if include_headings and heading else ""
        pieces = [body]
        if len(body) > size:
            pieces, held = [], ""
            for p in re.split(r"\n\s*\n", body):
                if held and len(held) + len(p) + 2 > size:
                    pieces.append(held.strip())
                    held = ""
                held += ("\n\n" if held else "") + p
            if held.strip():
                pieces.append(held.strip())
        out += [((lead + p).strip(), heading, level) for p in pieces]
    return out


def chunk_markdown(docs: DataFrame, chunk_size: int = 500, max_heading_level: int = 2, include_headings: bool = True, id_col: str = "id", content: str = "content") -> DataFrame:
    return _row_chunks(docs, lambda t: markdown_cut(t, chunk_size, max_heading_level, include_headings), id_col, content, "heading string, heading_level int")


def chunk_with_headers(chunks: DataFrame, docs: DataFrame, llm, template: str = "[摘要: {summary}]", id_col: str = "id", content: str = "content") -> DataFrame:
    """Each chunk led by a model's summary of it in its document (first 500 characters as context).

    A failed call gives an empty summary. {title} and {section} are filled where the columns exist.
    """
    from .providers import chat_column

    head = docs.select(F.col(id_col).cast("string").alias("document_id"), F.substr(content, F.lit(1), F.lit(500)).alias("_head"))
    d = chunks.join(head, "document_id", "left")
    ask = F.concat(F.lit("文档：\n"), F.coalesce("_head", F.lit("")), F.lit("\n\n片段：\n"), F.col("content"), F.lit("\n\n请用一句话说明片段内容。"))
    d = d.withColumn("_summary", tx.trim(F.coalesce(chat_column(llm, ask), F.lit(""))))
    header = F.replace(F.lit(template), F.lit("{summary}"), F.col("_summary"))
    for name, column in (("title", "title"), ("section", "heading")):
        value = F.coalesce(F.col(column), F.lit("")) if column in chunks.columns else F.lit("")
        header = F.replace(header, F.lit("{" + name + "}"), value)
    return d.withColumn("context_header", header).withColumn("content", F.concat("context_header", F.lit("\n"), "content")).drop("_head", "_summary")
