"""A typed property graph on two tables: entities (id, name, type, metadata map, ord) and
relations (source, target, type, metadata map, ord).

Walks are undirected and hop-bounded joins; each hop keeps what it has reached as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions.layout import cut, few
from .search import top_k, with_source

#: Default types of an extraction, fixed values.
ENTITY_TYPES = ("人物", "组织", "地点", "产品", "技术", "概念", "事件")
RELATION_TYPES = ("属于", "位于", "开发", "使用", "合作", "创建", "相关")


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity_"), F.regexp_replace(F.lower(tx.trim(name)), f"{tx.SPACE}+", "_"))


_EXTRACT = (
    T.StructType()
    .add("entities", T.ArrayType(T.StructType().add("name", "string").add("type", "string")))
    .add("relations", T.ArrayType(T.StructType().add("source", "string").add("target", "string").add("type", "string")))
)


def extract_graph(docs: DataFrame, llm, entity_types: tuple[str, ...] = ENTITY_TYPES, relation_types: tuple[str, ...] = RELATION_TYPES, content: str = "content") -> DataFrame:
    """(document_id, entities, relations, error) a document by a model; a failed call fills error only."""
    from .providers import chat_column, json_body

    ask = F.concat(F.lit(f"请抽取实体（类型：{'、'.join(entity_types)}）和关系（类型：{'、'.join(relation_types)}），以 JSON 返回 entities、relations。\n"), F.col(content))
    d = docs.select(F.col("id").cast("string").alias("document_id"), "ord", F.from_json(json_body(chat_column(llm, ask)), _EXTRACT).alias("x"))
    bad = F.col("x.entities").isNull()
    return d.select("document_id", "ord", "x.entities", "x.relations", F.when(bad, F.lit("extraction failed")).alias("error"))


def graph_tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of extractions; relations with an end that was not extracted go."""
    e = extracted.select("document_id", "ord", F.posexplode("entities").alias("i", "e"))
    key = (F.col("ord").cast("decimal(19,0)") * F.lit(10**10) + F.col("i")).alias("ord")  # a document has fewer than 10**10 of them
    meta = F.create_map(F.lit("sourceDocumentId"), F.col("document_id")).alias("metadata")
    entities = e.select(entity_id(F.col("e.name")).alias("id"), F.col("e.name").alias("name"), F.col("e.type").alias("type"), meta, key, "document_id")
    r = extracted.select("document_id", "ord", F.posexplode("relations").alias("i", "r"))
    relations = r.select(entity_id(F.col("r.source")).alias("source"), entity_id(F.col("r.target")).alias("target"), F.col("r.type").alias("type"), meta, key, "document_id")
    own = entities.select("document_id", "id").distinct()
    for end in ("source", "target"):
        relations = relations.join(own.withColumnRenamed("id", end), ["document_id", end], "left_semi")
    return merge_entities(entities.drop("document_id")), dedup_relations(relations.select("source", "target", "type", "metadata", "ord"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """A row an id: name and type of the first, metadata of all, later values winning."""
    entries = F.col("metadata")
    flat = entities.select("id", "name", "type", "ord", F.explode_outer(entries).alias("k", "v"))
    last = flat.where("k is not null").groupBy("id", "k").agg(F.max_by("v", "ord").alias("v"))
    last = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    first = entities.groupBy("id").agg(F.min_by("name", "ord").alias("name"), F.min_by("type", "ord").alias("type"), F.min("ord").alias("ord"))
    return first.join(last, "id", "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>"))).select("id", "name", "type", "metadata", "ord")


def dedup_relations(relations: DataFrame) -> DataFrame:
    """A row a (source, target, type): the first."""
    return relations.groupBy("source", "target", "type").agg(F.min_by("metadata", "ord").alias("metadata"), F.min("ord").alias("ord"))


def arcs(relations: DataFrame) -> DataFrame:
    """Both directions of each relation: (here, there, type, way, ord); way 0 goes out, 1 comes in."""
    out = relations.select(F.col("source").alias("here"), F.col("target").alias("there"), "source", "target", "type", F.lit(0).alias("way"), "ord")
    back = relations.select(F.col("target").alias("here"), F.col("source").alias("there"), "source", "target", "type", F.lit(1).alias("way"), "ord")
    return out.unionByName(back)


def neighbors(seeds: DataFrame, entities: DataFrame, relations: DataFrame, hops: int = 1, limit: int | None = None, relation_types: list[str] | None = None, entity_types: list[str] | None = None) -> DataFrame:
    """(seed, id, hop, source, target, type, place) of what a breadth-first walk of `hops` meets.

    Each entity comes once, with the relation that found it: lowest parent, outgoing before
    incoming, then relation order. Types that are filtered out are not walked through. `limit`
    keeps the first found. `seeds`: (seed). The seed itself is not returned.
    """
    a = arcs(relations if relation_types is None else relations.where(F.col("type").isin(relation_types)))
    known = entities if entity_types is None else entities.where(F.col("type").isin(entity_types))
    a = a.join(known.select(F.col("id").alias("there")), "there", "left_semi")
    if hops > 1:
        a = cut(a)
    kind = dict(entities.dtypes)["id"]
    start = seeds.select("seed", F.col("seed").alias("id")).distinct()
    start = start.select("seed", "id", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in (("source", kind), ("target", kind), ("type", "string"))])
    reached = front = cut(start) if hops > 1 else start
    for h in range(1, hops + 1):
        edge = front.select("seed", F.col("id").alias("here"), F.col("place").alias("parent"))
        step = edge.join(a, "here").select("seed", F.col("there").alias("id"), "source", "target", "type", F.struct("parent", "way", "ord").alias("how"))
        step = step.groupBy("seed", "id").agg(F.min("how").alias("how"), F.min_by(F.struct("source", "target", "type"), "how").alias("r"))
        step = step.join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        base = reached.groupBy("seed").agg(F.max("place").alias("base"))
        w = W.partitionBy("seed").orderBy("how", "id")
        new = step.join(base, "seed").select("seed", "id", F.lit(h).alias("hop"), (F.col("base") + F.row_number().over(w)).alias("place"), "r.source", "r.target", "r.type")
        new = new if limit is None else new.where(F.col("place") <= limit)
        front = cut(new) if h < hops else new
        reached = reached.unionByName(front)
        if limit is not None and h < hops:
            # a seed that has its limit goes no further
            full = front.groupBy("seed").agg(F.max("place").alias("last")).where(F.col("last") >= limit)
            front = front.join(full, "seed", "left_anti")
    return reached.where("hop > 0")


def shortest_paths(pairs: DataFrame, entities: DataFrame, relations: DataFrame, max_hops: int = 6) -> DataFrame:
    """(source_id, target_id, path, hops) of a shortest undirected path for each pair that has one.

    Walks from the sources; an entity keeps one path to each source (the smallest). Relations to entities
    that do not exist are not walked. Where a path can only end, at an entity with fewer than two neighbours, a walk goes
    only if that is a goal of its own source: a hub's many such neighbours are looked up by goal and never listed by source.
    So a hop adds at most a row for each source and entity with two neighbours, and for each pair; the last hop keeps goals alone.
    """
    known = entities.select(F.col("id").alias("there")).distinct()
    a = arcs(relations).where("source != target").select("here", "there").distinct()
    a = cut(a.join(known, "there", "left_semi").join(known.withColumnRenamed("there", "here"), "here", "left_semi").select("here", "there"))
    through = a.groupBy("here").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("here").alias("there"))
    inner = cut(a.join(through, "there", "left_semi").select("here", "there"))
    goals = cut(pairs.select("source_id", "target_id").distinct().join(known.withColumnRenamed("there", "source_id"), "source_id", "left_semi"))
    # goals with one neighbour, by that neighbour; the others are met on the way
    ends = a.join(through, "there", "left_anti")
    doors = cut(goals.join(ends, F.col("target_id") == F.col("there")).select("source_id", "here", "there"))
    front = goals.select("source_id").distinct().select("source_id", F.col("source_id").alias("id"), F.array("source_id").alias("path"))
    seen = front.select("source_id", "id", "path")
    for h in range(1, max_hops + 1):
        # only sources with a goal not yet met go on
        open_ = goals.join(seen.select("source_id", F.col("id").alias("target_id")), ["source_id", "target_id"], "left_anti").select("source_id").distinct()
        going = front.join(open_, "source_id", "left_semi").withColumnRenamed("id", "here")
        step = going.join(doors, ["source_id", "here"]).select("source_id", "there", "path")
        walk = going.join(inner, "here").select("source_id", "there", "path")
        if h == max_hops:
            walk = walk.join(goals.withColumnRenamed("target_id", "there"), ["source_id", "there"], "left_semi")
        step = step.unionByName(walk)
        step = step.groupBy("source_id", "there").agg(F.min("path").alias("path"))
        step = step.select("source_id", F.col("there").alias("id"), F.concat("path", F.array("there")).alias("path"))
        front = cut(step.join(seen.select("source_id", "id"), ["source_id", "id"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    got = goals.join(seen.withColumnRenamed("id", "target_id"), ["source_id", "target_id"])
    return got.select("source_id", "target_id", "path", (F.size("path") - 1).alias("hops"))


def _grams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def keyword_entities(queries: DataFrame, entities: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, id) of entities whose name or type contains a word of the query (lower-cased, cut at white space).

    Words meet entities by their first three characters (all, if they have fewer), an equality, and what
    meets is looked at in full; a blank query matches nothing.
    """
    kw = queries.select("query_id", F.explode(F.filter(F.split(F.lower(F.col(text)), f"{tx.SPACE}+"), lambda w: F.length(w) > 0)).alias("kw")).distinct()
    kw = kw.withColumn("gram", F.substr("kw", F.lit(1), F.lit(3)))
    hay = entities.select("id", F.concat_ws("\n", F.lower("name"), F.lower("type")).alias("hay"))
    hay = hay.select("id", "hay", F.explode(F.concat(*[_grams(F.col("hay"), n) for n in (1, 2, 3)])).alias("gram"))
    return hay.join(few(kw, 100_000)(kw), "gram").where(F.contains("hay", "kw")).select("query_id", "id").distinct()


def keyword_relations(matched: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations both of whose ends matched, for each query."""
    s = matched.select("query_id", F.col("id").alias("source"))
    t = matched.select("query_id", F.col("id").alias("target"))
    return relations.join(s, "source").join(t, ["query_id", "target"]).select("query_id", "source", "target", "type")


def graph_texts(found: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, chunk_id, document_id, content, score) of entities (query_id, id) with their relations (query_id, source, target, type).

    score: 0.3 plus 0.1 a relation, at most 1; a relation from an entity to itself counts once.
    """
    names = entities.select("id", "name", "type")
    rel = links.distinct()
    ends = rel.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("id"))
    for end in ("source", "target"):
        ends = ends.join(names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end, "left")
    line = F.concat(F.coalesce("source_name", F.col("source").cast("string")), F.lit(" --["), F.col("type"), F.lit("]--> "), F.coalesce("target_name", F.col("target").cast("string")))
    per = ends.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))
    d = found.select("query_id", "id").distinct().join(names, "id").join(per, ["query_id", "id"], "left")
    n = F.coalesce("n", F.lit(0))
    head = F.concat(F.lit("实体："), F.col("name"), F.lit("（类型："), F.col("type"), F.lit("）"))
    body = F.when(n > 0, F.concat(head, F.lit("\n关系：\n"), F.array_join("lines", "\n"))).otherwise(head)
    return d.select(
        "query_id", F.concat(F.lit("graph_"), F.col("id").cast("string")).alias("chunk_id"), F.col("id").alias("document_id"), body.alias("content"),
        F.least(F.lit(1.0), 0.3 + n * 0.1).alias("score"), n.alias("relation_count"),
    )


def graph_retrieve(mentions: DataFrame, entities: DataFrame, relations: DataFrame, max_hops: int = 2, max_entities: int = 10, k: int = 5) -> DataFrame:
    """Results from entities that queries mention (query_id, id), widened by a walk from each."""
    walk = neighbors(mentions.select(F.col("id").alias("seed")).distinct(), entities, relations, max_hops, max_entities)
    far = mentions.withColumnRenamed("id", "seed").join(walk, "seed")
    found = mentions.select("query_id", "id").union(far.select("query_id", "id"))
    return with_source(top_k(graph_texts(found, far.select("query_id", "source", "target", "type"), entities), k), "graph")


def mentions(queries: DataFrame, entities: DataFrame, llm=None, text: str = "query") -> DataFrame:
    """(query_id, id) of the entities a query names: by a model's list of names, else by words."""
    if llm is None:
        return keyword_entities(queries, entities, text)
    from .providers import chat_column, json_body

    schema = T.StructType().add("entities", T.ArrayType(T.StringType()))
    ask = F.concat(F.lit("请提取问题中提到的实体名称，以 JSON 返回 entities。\n"), F.col(text))
    names = queries.select("query_id", F.explode(F.from_json(json_body(chat_column(llm, ask)), schema)["entities"]).alias("query"))
    return keyword_entities(names, entities)


def scaled_by_max(results: DataFrame, weight: float) -> DataFrame:
    top = F.max("score").over(W.partitionBy("query_id"))
    return results.withColumn("score", F.when(top > 0, F.col("score") / top * weight).otherwise(0.0))


def graph_enhanced(vector: DataFrame, graph: DataFrame, expanded: DataFrame | None = None, vector_weight: float = 0.6, graph_weight: float = 0.4, k: int = 5) -> DataFrame:
    """Both arms divided by their best, weighted and added by chunk.

    The graph arm is `graph`, then of `expanded` what it lacks, first place first.
    """
    g = graph.select("query_id", "chunk_id", "score", F.lit(0).alias("arm"), "rank")
    if expanded is not None:
        g = g.unionByName(expanded.select("query_id", "chunk_id", "score", F.lit(1).alias("arm"), "rank"))
        w = W.partitionBy("query_id", "chunk_id").orderBy("arm", "rank")
        g = g.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    arms = scaled_by_max(vector.select("query_id", "chunk_id", "score"), vector_weight).unionByName(scaled_by_max(g.select("query_id", "chunk_id", "score"), graph_weight))
    s = arms.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    return with_source(top_k(s, k), "fusion")


def expand_hits(hits: DataFrame, entities: DataFrame, relations: DataFrame, content: str = "content") -> DataFrame:
    """Entities named in hits' contents, with up to five neighbours, at 0.8 of the hit's score."""
    named = hits.select("query_id", "score", "rank", content).withColumn("_k", F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("rank").cast("string")))
    found = keyword_entities(named.select(F.col("_k").alias("query_id"), F.col(content).alias("query")), entities).withColumnRenamed("query_id", "_k")
    d = named.join(found, "_k")
    near = neighbors(found.select(F.col("id").alias("seed")).distinct(), entities, relations, 1, 5)
    near = near.join(entities.select("id", "name"), "id").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("_n"))
    d = d.join(near, F.col("id") == F.col("seed")).join(entities.select("id", "name", "type"), "id")
    text = F.concat(F.lit("实体："), F.col("name"), F.lit("（类型："), F.col("type"), F.lit("）\n关联实体："), F.array_join("_n.name", "、"))
    return d.select("query_id", F.concat(F.lit("graph_expanded_"), F.col("id").cast("string")).alias("chunk_id"), (F.col("score") * 0.8).alias("score"), "rank", text.alias("content"))


class GraphStore:
    """Entities and relations with replace-on-write additions."""

    def __init__(self, entities: DataFrame, relations: DataFrame):
        self.entities, self.relations = merge_entities(entities), dedup_relations(relations)

    def add_entities(self, entities: DataFrame) -> GraphStore:
        return GraphStore(self.entities.unionByName(entities), self.relations)

    def add_relations(self, relations: DataFrame) -> GraphStore:
        return GraphStore(self.entities, self.relations.unionByName(relations))

    def entity(self, key) -> DataFrame:
        return self.entities.where(F.col("id") == F.lit(key))

    def neighbors(self, seeds: DataFrame, **options) -> DataFrame:
        return neighbors(seeds, self.entities, self.relations, **options)

    def paths(self, pairs: DataFrame, **options) -> DataFrame:
        return shortest_paths(pairs, self.entities, self.relations, **options)

    def query(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = keyword_entities(queries, self.entities)
        return found, keyword_relations(found, self.relations)

    def stats(self) -> DataFrame:
        e = self.entities.agg(F.count(F.lit(1)).alias("entity_count"))
        return e.crossJoin(self.relations.agg(F.count(F.lit(1)).alias("relation_count")))


class Neo4jGraphStore:
    """Not offered: a graph is two tables here."""

    def __init__(self, *args, **options):
        raise NotImplementedError("no Neo4j store; use GraphStore")


def build_graph(docs: DataFrame, llm, **options) -> tuple[GraphStore, DataFrame]:
    """(graph, one-row report): documents, errors, entities, relations."""
    x = cut(extract_graph(docs, llm, **options))
    entities, relations = graph_tables(x)
    store = GraphStore(entities, relations)
    seen = x.agg(F.count(F.lit(1)).alias("document_count"), F.count("error").alias("error_count"))
    return store, seen.crossJoin(store.stats())
