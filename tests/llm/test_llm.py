"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _scale, packing, quality, suffixes, tokens
from tessera.llm.arrow_stream import SequenceFile, read_documents, write_tokens
from tessera.llm.caps import cap_links
from tessera.llm.exact import build_mph, exact_dedup, mph_slots
from tessera.llm.mixing import MIX_SQL, mix_sources, mixed_documents
from tessera.llm.quality import score_quality, train_quality
from tessera.llm.sharding import shard_documents
from tessera.llm.simhash import fingerprints, near_pairs, simhash_dedup
from tessera.llm.tokens import CUTS, Encoder, tokenizer_path
from tessera.llm.toxicity import score_toxicity, train_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, key int, _size string, y string, rank int, quality_keep string"
WORDS = "the of and lorem ipsum dolor sit amet tion ing he onan stre".split()


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls everywhere, empty and long texts, copies, near copies, repeated rows, shared passages."""
    r = random.Random(5)
    passage, long_ = sentence(r, 30), sentence(r, 9000)
    out = []
    for i in range(120):
        t = sentence(r, r.randint(1, 80))
        if i % 7 == 0:
            t = t + "\n" + passage + "\n" + sentence(r, 5)
        if i % 11 == 0:
            t = "common copy text " * 6
        if i and i % 17 == 0:
            t = (out[-1][1] or "") + " changed"
        out.append((i * 3, t, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None]), len(t)))
    out += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \n\t", "en", "a", 3), (1003, long_, "en", "b", 9), (1004, long_[5:], "en", "b", 9)]
    out += [(None, "no id here " * 9, "en", "a", 5), (None, None, None, None, None), out[3], out[3], (2000, "ünïcode — 漢字 ‘quotes’ 😀 <|endoftext|> " * 3, "xx", "z", 1)]
    return [x + ("t", 1, "s", "y", 2, "q") for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(x):
    return x[1] or ""


def test_many_drops_are_not_broadcast(spark, monkeypatch):
    import corpus_pipeline as cp

    docs = _scale.materialize(spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string"), "docs")
    drops = docs.where("doc_id % 3 = 0").select("doc_id")
    for few in (cp.FEW_DROPS, 5):
        monkeypatch.setattr(cp, "FEW_DROPS", few)
        left = cp._without(_scale.boxed(docs, doc_id="doc_id"), drops, ["doc_id"])
        assert ("Broadcast" in left._jdf.queryExecution().executedPlan().toString()) == (few > 5)
        assert sorted(x["doc_id"] for x in left.collect()) == [i for i in range(50) if i % 3]


# --- shared pieces ---------------------------------------------------------------------------------


def test_nothing_exploded_or_large_is_broadcast(spark, monkeypatch):
    # files of a few KB, which Spark would broadcast, and what is made of them too
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    r = random.Random(3)
    prints = list({r.randrange(1 << 62) for _ in range(200)})
    prints += [x ^ 5 for x in prints[:20]] + [x ^ (1 << 40) for x in prints[20:30]]
    nodes = _scale.materialize(spark.createDataFrame(list(enumerate(prints)), "id long, fp long"), "nodes")
    found = near_pairs(nodes)
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)
    assert {tuple(sorted(x)) for x in found.collect()} == {(i, j) for j, y in enumerate(prints) for i, x in enumerate(prints[:j]) if (x ^ y).bit_count() <= 2}
    monkeypatch.setattr(_scale, "FEW_EDGES", 0)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    links = _scale.connected_components(chain, "a", "b")
    assert dict(map(tuple, links.collect())) == {i: 0 for i in range(1, 41)}
    assert "Broadcast" not in plan(nodes.join(links, nodes.id == links.node, "left"))


def test_components_and_ranks(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5), (7, None)]
    got = dict(map(tuple, _scale.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()))
    root = {x: x for p in pairs for x in p if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for p in pairs if None not in p for x in p if find(x) != x}
    d = spark.createDataFrame([(i % 2, i) for i in range(500)] + [(0, 4)], "k int, v long")
    g = _scale.gapless_rank(d, ["k"], ["v"], 7).toPandas()
    for _, x in g.groupby("k"):
        assert sorted(x["rank"]) == list(range(len(x)))


@pytest.mark.parametrize("name", list(CUTS))
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    enc, lib = Encoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    texts = [f"{a}{chr(c)}{b}" for c in [*range(0x180), *range(0x2010, 0x205F), 0x20AC, 0x3042, 0x1F600, 0x301] for a, b in (("a", "b"), (" ", " "), ("1", "2"), ("x ", "  y"), ("'s", "'T"))]
    texts += ["", " ", "It's  a\n\n test'LL do <|endoftext|> 123 ¾", "été ΣΑΣ İI", "x" * 300 + " " * 200]
    for t in texts:
        assert enc(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


# --- 1 packing, 2 files ------------------------------------------------------------------------------


def encoded(rows, name):
    enc = Encoder(tokenizer_path(name))
    return [(x[0], np.frombuffer(enc(x[1]), "<u4").tolist() + [1]) for x in rows]


def test_packing(spark, docs, rows, none):
    pieces = _scale.materialize(packing.token_pieces(docs), "t")
    p = packing.pack_pieces(pieces).collect()
    want = Counter((i, len(ids)) for i, ids in encoded(rows, "byte_bpe_50k.json"))
    assert Counter((x["doc_id"], x["doc_tokens"]) for x in p if x["start"] == 0) == want
    assert sum(x["length"] for x in p) == sum(n * c for (_, n), c in want.items())
    by = {}
    for x in p:
        assert x["ids_crc32"] == zlib.crc32(x["ids"]) and len(x["ids"]) == 4 * x["length"]
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    q = packing.sequences(packing.pack_pieces(pieces)).collect()
    assert sum(x["n_tokens"] for x in q) == sum(x["length"] for x in p)
    assert all(len(x["ids"]) == 2048 or len(x["ids"]) == x["n_tokens"] for x in q)
    # the ids of each document can be read back from the sequences
    whole = {x["sequence_id"]: x["ids"] for x in q}
    for x in p:
        got = whole[x["sequence_id"]][x["offset"] : x["offset"] + x["length"]]
        assert np.array(got, "<u4").tobytes() == bytes(x["ids"])
    assert packing.pack_pieces(packing.token_pieces(none)).count() == 0


def test_packing_plan_uses_every_piece_once():
    r = random.Random(3)
    for top in (256, 40):
        h = Counter(r.randint(1, top) for _ in range(3000))
        h[5] += 2000
        plan = packing.solve(dict(h), 256)
        used = Counter()
        for combo, times in plan.rows:
            assert sum(combo) <= 256 and times > 0
            for u in combo:
                used[u] += times
        assert used == h
        full = sum(t * 256 for _, t in plan.rows)
        assert sum(u * n for u, n in h.items()) / full > 0.97
    x = packing.nnls(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([3.0, 5.0]), 10)
    assert x.min() >= 0 and np.allclose([x[0] + x[2], x[1] + x[2]], [3, 5])


def test_token_files(spark, docs, rows, none):
    files = write_tokens(docs, batch=2)
    got = read_documents(files).collect()
    at, want = 0, []
    for i, ids in sorted(encoded(rows, "word_bpe_49k.json"), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == Counter(want)
    for x in sorted(got, key=lambda x: x["start"]):
        assert x["start"] == at
        at += x["n_tokens"]
    ids = [x["doc_id"] or -1 for x in sorted(got, key=lambda x: x["start"])]
    assert ids == sorted(ids)
    f = SequenceFile(files.where("n_tokens > 2048").first()["path"] + ".arrow")
    a, m = f.sequence(0)
    assert len(a) == 2048 and all(m.to_pylist()) and a.base is not None
    lo = f.source.address
    for at in (a.ctypes.data, m.buffers()[1].address):
        assert lo <= at < lo + f.source.size  # no copy of ids or mask
    assert read_documents(write_tokens(none)).count() == 0


# --- 3 sharding ----------------------------------------------------------------------------------------


def best_capacity(sizes, n):
    def fits(c):
        k, at = 1, 0
        for s in sizes:
            if at + s > c:
                k, at = k + 1, 0
            at += s
        return k <= n

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("hot", [0, 400])
def test_sharding(spark, docs, rows, none, hot):
    extra = spark.createDataFrame([(5000 + i, "hot text " * 40) + (None,) * 9 for i in range(hot)], SCHEMA)
    r = shard_documents(docs.union(extra), 6).toPandas()
    assert len(r) == len(rows) + hot
    assert (r.groupby("key")["shard"].nunique() == 1).all()
    for _, s in r.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    want = Counter((x[0] if x[0] is not None else -1, len(text(x).encode()) + 1, zlib.crc32(text(x).encode())) for x in rows)
    real = r[~(r["doc_id"] >= 5000)]
    assert Counter(zip(real["doc_id"].fillna(-1).astype(int), real["size"], real["text_crc32"])) == want
    # the cut of the same order by exhaustive search
    g = r.groupby("key")["size"].sum()
    bound = max(1, g.sum() // (6 * 256))
    order = [s for s, _ in sorted(((s, k) for k, s in g.items() if s > bound), key=lambda x: (-x[0], x[1]))] + g[g <= bound].sort_index().tolist()
    own = 0
    while own < 5 and order[own] * (6 - own) >= sum(order[own:]):
        own += 1
    loads = sorted(r.groupby("shard")["size"].sum(), reverse=True)
    assert loads[own] == best_capacity(order[own:], 6 - own)
    assert shard_documents(none, 6).count() == 0


# --- 4 caps ---------------------------------------------------------------------------------------------


def test_caps(spark):
    g = np.random.default_rng(2)
    base = g.standard_normal((60, 64))
    v = [base[i % 60] + g.standard_normal(64) * g.choice([0.05, 0.2, 1.0]) for i in range(500)]
    v += [v[3]] * 30 + [base[1] + g.standard_normal(64) * 0.03 for _ in range(200)]
    data = [(i, x.astype(np.float32).tolist(), int(i % 3)) for i, x in enumerate(v)]
    data += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [1.0, None], 1), (904, v[3].tolist(), None), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 0), (None, v[3].tolist(), 0), data[5]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as links", "3 as component")
    got = {}
    for x in cap_links(df, block=24).collect():
        got.setdefault(x["vec_id"], []).append((x["n_links"], x["component_id"], x["kept"]))
    # the same with many directions
    assert {(x["vec_id"], x["n_links"], x["component_id"]) for x in cap_links(df, codewords=64, tables=2).collect()} == {(i, n, c) for i, v in got.items() for n, c, _ in v}
    f = lambda e: np.array([np.float32(x) for x in e], float)
    good = [(i, f(e), lab) for i, e, lab in data if i is not None and lab is not None and e and None not in e and np.isfinite(f(e)).all() and np.any(f(e))]
    links, root = Counter(), {i: i for i, _, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a] += 1
                links[b] += 1
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    assert sum(map(len, got.values())) == len(data)
    for a, (i, _, _) in enumerate(good):
        assert (links[a], find(i), i == find(i)) in got[i], i
    for i in (900, 901, 902, 903, 904, 907):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(0, None, True)]
    assert cap_links(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 384, 1024])
def test_caps_recall(spark, dim):
    """Pairs just over the threshold are found, in any number of dimensions."""
    from tessera.llm.caps import codewords_for

    assert [codewords_for(n) for n in (0, 500, 10**5, 10**9)] == [8, 8, 32, 4096]
    g = np.random.default_rng(dim)
    x = g.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = g.standard_normal((400, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    data = [(i, v.tolist(), 1) for i, v in enumerate(np.stack([x, y], axis=1).reshape(800, dim))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    v = np.array([d[1] for d in data])
    cos = (v @ v.T) / np.sqrt((v * v).sum(axis=1)[:, None] * (v * v).sum(axis=1))
    want = (cos >= 0.98).sum() - len(v)
    for c in (None, 64):
        got = sum(r["n_links"] for r in cap_links(df, codewords=c).collect())
        assert 0.99 * want <= got <= want and want >= 800


# --- 5 mixing --------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, none):
    import duckdb

    r = mix_sources(docs).toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter(zip(r["doc_id"].fillna(-1), r["size"])) == Counter((x[0] if x[0] is not None else -1, size(x[1])) for x in rows)
    names = sorted({x[3] for x in rows if x[3] is not None}) + [None]
    total = {n: sum(size(x[1]) for x in rows if x[3] == n) for n in names}
    open_, left, target = {n: i % 3 + 1 for i, n in enumerate(names)}, float(sum(total.values())), {}
    while True:
        over = [n for n, w in open_.items() if left * w / sum(open_.values()) > 3 * total[n]]
        if not over:
            break
        for n in over:
            target[n] = 3.0 * total[n]
        left -= sum(target[n] for n in over)
        open_ = {n: w for n, w in open_.items() if n not in over}
    target |= {n: left * w / sum(open_.values()) for n, w in open_.items()}
    for n in names:
        own = r[r["source"].isna()] if n is None else r[r["source"] == n]
        assert (own["source_size"] == total[n]).all() and np.allclose(own["target"], target[n])
        assert abs(own["taken"].sum() - target[n]) <= own["size"].max()
        assert (own["taken"] <= 3 * own["size"]).all()
    assert sorted(map(str, mix_sources(docs.repartition(3)).collect())) == sorted(map(str, mix_sources(docs).collect()))
    m = mixed_documents(docs)
    assert m.columns == docs.columns
    counts = Counter(x["doc_id"] for x in m.collect())
    taken = r.groupby(r["doc_id"].fillna(-1))["epochs"].sum()
    assert all(counts.get(int(i) if i >= 0 else None, 0) == n for i, n in taken.items())
    # unique ids: the SQL form agrees row by row
    plain = [x for x in {x[0]: x for x in rows if x[0] is not None}.values()]
    d = spark.createDataFrame(plain, SCHEMA)
    con = duckdb.connect()
    con.register("u", d.select("doc_id", "text", "source").toPandas())
    want = con.sql("SELECT * FROM (" + MIX_SQL.replace("{docs}", "u") + ")").fetchall()
    got = [(x["doc_id"], x["size"], x["source_size"], x["target"], x["taken"]) for x in mix_sources(d).collect()]
    assert sorted(got) == sorted(want)
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


def test_mixing_ranges_and_odd_ids(spark):
    """Unspaced text, tiny weights: no key range is large. Rows without an id draw one by one."""
    from pyspark.sql import functions as F

    from tessera.llm.mixing import _draws

    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("汉字文本"), 50), F.col("id")).alias("text"), F.lit("zh").alias("source"), F.lit(0.001).alias("w"))
    for weight in (None, F.col("w")):
        x = _draws(d, "mix-1", 1024, ("doc_id", "text", "source"), weight, False)
        assert x.groupBy("_rng").count().agg(F.max("count")).first()[0] < 200
        r = mix_sources(d.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")), weight=weight).toPandas()
        for _, own in r.groupby("source"):
            assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1
    odd = [(None, f"text number {i}", s) for i in range(400) for s in "ab"] + [(7, "x " * 5, "a")] * 300
    r = mix_sources(spark.createDataFrame(odd, "doc_id long, text string, source string")).toPandas()
    assert (r[r["doc_id"] == 7].groupby("doc_id")["epochs"].nunique() == 1).all()
    b = r[r["source"] == "b"]
    assert abs(b["taken"].sum() - b["target"].iloc[0]) <= 3 and b["epochs"].nunique() == 2


# --- 6 and 10 classifiers ----------------------------------------------------------------------------------


SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark, docs, none):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train_toxicity(d, lab)
    r = score_toxicity(d, model).join(lab, "doc_id").where("held_out").toPandas()
    hit = ((r["predicted"] == 1) & (r["toxic"] == 1)).sum()
    assert hit / r["toxic"].sum() > 0.7 and hit / r["predicted"].sum() > 0.85
    auc = (r[r["toxic"] == 1]["score"].to_numpy()[:, None] > r[r["toxic"] == 0]["score"].to_numpy()[None, :]).mean()
    assert auc > 0.9
    s = score_toxicity(docs, model).toPandas()
    assert len(s) == docs.count() and s["score"].between(0, 1).all() and s["held_out"].notna().all()
    assert score_toxicity(none, model).count() == 0
    flat = train_toxicity(none, lab.where("false"))
    assert score_toxicity(docs, flat).where("score between 0 and 1").count() == docs.count()


def test_toxicity_odd_training_rows(spark):
    """Repeated, null and conflicting labels and rows; ties at the threshold; texts longer than a chunk."""
    from tessera.llm import toxicity

    ok, bad = "a plain note about the weather in town number {}", "you awful horrid wretch number {} be gone"
    rows = [(i, (bad if i % 4 == 0 else ok).format(i)) for i in range(200)] + [(8, bad.format(8)), (8, "another text"), (None, bad), (301, None), (302, "")]
    lab = [(i, int(i % 4 == 0)) for i in range(200)] + [(8, 0), (None, 1), (301, 0), (302, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(lab, "doc_id long, toxic int")
    a, b = train_toxicity(d, labels), train_toxicity(d.repartition(7), labels.repartition(3))
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)
    got = score_toxicity(d, a).collect()
    assert len(got) == len(rows)
    hit = {r["doc_id"] for r in got if r["predicted"]}
    assert {i for i in range(200) if i % 4 == 0} <= hit and not hit & {i for i in range(200) if i % 4}
    cut = got[0]["score"]
    assert [r["predicted"] for r in score_toxicity(d, a, cut).collect()] == [int(r["score"] >= cut) for r in got]
    g, t = toxicity.Grams(), "".join(random.Random(1).choice("abcdef ") for _ in range(5000))
    whole = set(g(t))
    chunk, toxicity._CHUNK = toxicity._CHUNK, 700
    try:
        assert set(g(t)) == whole
    finally:
        toxicity._CHUNK = chunk


def test_evidence_by_hand():
    from tessera.llm.toxicity import evidence

    count = np.array([[0, 50, 3, 0, 9.0], [20, 50, 3, 0, 9.0]])
    r = evidence(count)
    assert r[0] > 0 and (r[[2, 3, 4]] == 0).all()
    assert np.isclose(r[0], np.log(20.5 / 84.5) - np.log(0.5 / 64.5))
    few = evidence(np.array([[1, 0.0], [0, 1.0]]))
    assert few[0] < 0 < few[1]


def test_quality_held_out(spark, docs, none):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = train_quality(d, lab.where("doc_id % 2 = 0"))
    # each view teaches the other in every round
    assert [(h["round"], h["from"]) for h in model.history] == [(r, v) for r in range(4) for v in ("text", "meta")]
    assert all(h["labels"] for h in model.history) and model.text.slope > 0 and model.meta.slope > 0
    r = score_quality(d, model).join(lab, "doc_id").where("doc_id % 2 = 1").toPandas()
    assert r[r["quality"] == 1]["quality_keep"].mean() > 0.99
    assert r[r["quality"] == 0]["quality_keep"].mean() < 0.1
    s = score_quality(docs, model)
    assert s.count() == docs.count() and set(docs.columns) <= set(s.columns)
    assert score_quality(none, model).count() == 0
    flat = train_quality(none, lab.where("false"))
    assert score_quality(docs, flat).where("quality_score between 0 and 1").count() == docs.count()


def test_quality_odd_training_rows(spark, monkeypatch):
    """Repeated and null ids and labels: reruns agree. Features of texts longer than a chunk. Ties at the threshold."""
    clean, junk = "A calm line of words about town {}, with some more of them.", "BUY || NOW {} $$$ !!!! BUY BUY"
    rows = [(i, (junk if i % 3 == 0 else clean).format(i), "en", "web", 50) for i in range(300)] + [(9, "other", None, None, None), (9, junk, "en", "web", 1), (None, junk, "en", "web", 1), (400, None, None, None, None)]
    lab = [(i, int(i % 3 > 0)) for i in range(90)] + [(9, 1), (None, 0), (400, None)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(lab, "doc_id long, quality int")
    a, b = train_quality(d, labels), train_quality(d.repartition(9), labels.repartition(2))
    assert (a.text.w == b.text.w).all() and (a.meta.w == b.meta.w).all() and a.history == b.history
    got = score_quality(d, a).collect()
    assert len(got) == len(rows)
    cut = got[0]["quality_score"]
    assert all(r["quality_keep"] == (r["quality_score"] >= cut) for r in score_quality(d, a, cut).collect())
    r = random.Random(2)
    t = "".join(r.choice("abc |\n") for _ in range(3000))
    whole = quality.text_features(t)
    monkeypatch.setattr(quality, "_CHUNK", 256)
    assert (quality.text_features(t) == whole).all()
    assert not quality.text_features(None).any() and not quality.text_features("").any()


def test_quality_labels_whole_pool(spark):
    """Every unlabelled row may be picked, however many there are, and none twice by a view."""
    from pyspark.sql import functions as F

    n = 20_000
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("The members met again in spring and wrote report "), F.col("id"))).otherwise(F.lit("WIN $$$ || !!!! buy buy buy ### 999"))
    d = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(99).alias("n_chars"))
    lab = spark.range(400).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).alias("quality"))
    history = train_quality(d, lab).history
    for view in ("text", "meta"):
        assert sum(h["labels"] for h in history if h["from"] == view) == 4 * 2 * int(0.02 * (n - 400))
    free = spark.range(0, n, 1, 7).select(F.col("id").alias("doc_id"), F.array(F.col("id") / 1000.0).alias("t"), F.array(F.lit(0.0)).alias("m"))
    view = lambda w: quality.View(np.zeros(1), np.full(1, 2.0), np.array([w, 0.0]))
    views, given = {"text": view(1.0), "meta": view(1.0)}, {"text": {n - 1, n - 3}, "meta": set()}
    got = quality._surest(free, 5, views, given)
    # scaled values are cut at 8: the smaller id goes first among equals
    assert [i for i, _, _ in got["text", 1]] == [16_000 + i for i in range(5)] and got["text", 0] == got["meta", 1] == []
    given["text"] = set(range(16_000, n))
    assert [i for i, _, _ in quality._surest(free, 5, views, given)["text", 1]] == [15_999 - i for i in range(5)]


@pytest.mark.parametrize("good,bad", [(6, 12), (3, 60), (0, 8)])
def test_quality_few_labels(spark, good, bad):
    """Few labels or a rare class still give a model; one class alone gives none, and rejects nothing."""
    clean = "The committee met again in spring, and its members agreed on number {}. They wrote a short report for the town."
    junk = "CLICK {} || $$$ WIN WIN WIN !!!! ### buy buy buy buy |||| @@@ 99999 %%%% !!!!"
    rows = [(i, (clean if i < good + 20 else junk).format(i), "en", "web", 100) for i in range(good + 20 + bad + 20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = [(i, 1) for i in range(good)] + [(good + 20 + i, 0) for i in range(bad)]
    kept = score_quality(d, train_quality(d, spark.createDataFrame(lab, "doc_id long, quality int"))).where("quality_keep")
    want = range(good + 20) if good else range(len(rows))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(want)


# --- 7 exact -------------------------------------------------------------------------------------------------


def test_minimal_perfect_hash():
    for n in (1, 2, 3, 17, 5000):
        words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), "<u8").reshape(-1, 4)
        seed, g = build_mph(words)
        assert sorted(mph_slots(words, seed, g)) == list(range(n))


def test_exact_dedup(spark, docs, rows, none):
    from pyspark.sql import functions as F

    best, size = {}, Counter()
    for x in rows:
        t = text(x)
        size[t] += 1
        best[t] = max((i for i in (best.get(t), x[0]) if i is not None), default=None)
    want = Counter((x[0], best[text(x)], size[text(x)], x[0] == best[text(x)], hashlib.sha256(text(x).encode()).hexdigest()) for x in rows)
    for history in (None, F.lit(False), F.lit(True), F.col("doc_id") > 500):
        if history is not None:
            history = F.coalesce(history, F.lit(False))
        got = Counter(map(tuple, exact_dedup(docs, history, shards=3).collect()))
        assert got == want
    assert exact_dedup(none).count() == 0


# --- 8 simhash -------------------------------------------------------------------------------------------------


def test_simhash(spark, docs, rows, none):
    import xxhash

    def fp(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash_dedup(docs).collect()
    prints = {x[0]: fp(text(x)) for x in rows if x[0] is not None}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] is not None:
            assert (x["fingerprint"], x["component_id"]) == (f"{prints[x['doc_id']]:016x}", find(x["doc_id"]))
    assert len({find(i) for i in ids}) < len(ids)
    assert simhash_dedup(none).count() == 0


# --- 9 repeats ---------------------------------------------------------------------------------------------------


def removed(rows, match):
    out = []
    for x in rows:
        b = text(x).encode()
        gone = np.zeros(len(b), bool)
        if x[0] is not None:
            smaller = {text(y).encode() for y in rows if y[0] is not None and y[0] < x[0]}
            seen = {s[p : p + match] for s in smaller for p in range(len(s) - match + 1)}
            for p in range(len(b) - match + 1):
                if b[p : p + match] in seen:
                    gone[p : p + match] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((x[0], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, docs, rows, none):
    got = suffixes.remove_repeats(docs).collect()
    assert Counter(tuple(x)[:5] for x in got) == Counter(removed(rows, 50))
    # every gram that two contexts share taken as hot
    assert Counter(tuple(x)[:5] for x in suffixes.remove_repeats(docs, hot=1).collect()) == Counter(removed(rows, 50))
    assert any(x["n_spans"] for x in got if x["doc_id"] == 1004)
    assert suffixes.remove_repeats(none).count() == 0


def test_even_groups(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(500).select(F.hash(F.col("id").cast("int"))).collect()]
    assert got == suffixes._murmur(np.arange(500)).tolist()
    for p in (1, 7, 211):
        g = suffixes.even_groups(p)
        assert len(set(g.tolist())) == 2 * p and set(np.bincount(np.mod(suffixes._murmur(g), p), minlength=p)) == {2}


def test_repeats_of_a_hot_gram(spark):
    """One passage in many surroundings, several times in some documents."""
    r = random.Random(11)
    passage = sentence(r, 12)
    around = lambda: sentence(r, 3)[:20]
    some = ["".join(around() + passage[r.randint(0, 30) :] + around() for _ in range(r.choice([1, 1, 2, 4]))) for _ in range(150)]
    rows = list(enumerate(some))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter(removed(rows, 50))
    for hot in (1, 20, 10**6):
        assert Counter(tuple(x)[:5] for x in suffixes.remove_repeats(d, hot=hot).collect()) == want


def test_repeats_across_segments(spark, monkeypatch):
    """Low-entropy texts, other lengths, and a text longer than a segment of the scan."""
    r = random.Random(9)
    some = ["".join(r.choice("ab") for _ in range(r.randint(1, 300))) for _ in range(60)] + ["ab" * 200, "a" * 300, "ab" * 150 + "c"]
    rows = [(i, t) for i, t in enumerate(some)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), match=20, gram=8).collect()
    assert Counter(tuple(x)[:5] for x in got) == Counter(removed(rows, 20))
    for hot in (1, 3):
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), match=20, gram=8, hot=hot).collect()
        assert Counter(tuple(x)[:5] for x in got) == Counter(removed(rows, 20))
    long_ = "".join(r.choice("abcdefgh ") for _ in range(3 * (1 << 16)))
    rows = [(1, long_), (2, "x" * 77 + long_[100:-100] + "y"), (3, long_[1 << 16 : (1 << 16) + 500])]
    x = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert x[2]["n_removed"] == len(long_) - 200 and x[3]["n_removed"] == 500 and x[1]["n_removed"] == 0


def test_deep_shallow_and_tries():
    r = random.Random(4)
    t = ("".join(r.choice("ab") for _ in range(400)) + "abcabcabc" * 60).encode()
    starts = np.arange(len(t) - 60)
    o = suffixes.deep_shallow(np.frombuffer(t, np.uint8), starts, 50, 16)
    keys = [t[s : s + 50] for s in starts[o]]
    assert keys == sorted(keys)
    lcp = suffixes.common_prefixes(np.frombuffer(t, np.uint8), starts[o], 50)
    for i in range(1, len(keys)):
        n = next((k for k in range(50) if keys[i][k] != keys[i - 1][k]), 50)
        assert lcp[i] == n
    s = list({bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(200)})
    assert [s[i] for i in suffixes.blind_trie(s)] == sorted(s)


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    data = docs.toPandas()
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in cp.STAGES:
        out = _scale.materialize(stage(spark, kept, src), name)
        if name != "packing":
            assert out.columns == columns
        seen.append(out.toPandas())
        kept = out
    lab = spark.read.parquet(f"{src}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    q = set(seen[0]["doc_id"])
    assert q <= set(data["doc_id"]) and all(i in q for i, v in lab.items() if v == 1)
    model = train_quality(docs, spark.read.parquet(f"{src}/labels.parquet"))
    views = [np.stack([f(*x) for x in data[c].itertuples(index=False)]).astype(float) for f, c in ((quality.text_features, ["text"]), (quality.meta_features, ["text", "lang", "source", "n_chars"]))]
    assert q == set(data["doc_id"][model.score(*views) >= 0.5])
    best = seen[0].groupby("text")["doc_id"].max()
    assert set(seen[1]["doc_id"]) == set(best)
    comp = {x["doc_id"]: x["component_id"] for x in simhash_dedup(spark.createDataFrame(seen[1])).collect()}
    assert set(seen[2]["doc_id"]) == {i for i, c in comp.items() if i == c}
    epochs = {x["doc_id"]: x["epochs"] for x in mix_sources(spark.createDataFrame(seen[2])).collect()}
    assert Counter(seen[3]["doc_id"]) == {i: n for i, n in epochs.items() if n}
    enc = Encoder(tokenizer_path("byte_bpe_50k.json"))
    want = Counter((i, len(enc(t)) // 4 + 1) for i, t in zip(seen[3]["doc_id"], seen[3]["text"]))
    heads = seen[4][seen[4]["start"] == 0]
    assert Counter(zip(heads["doc_id"], heads["doc_tokens"])) == want
    assert seen[4]["length"].sum() == sum(n * k for (_, n), k in want.items())
    again = cp.run(spark, src).toPandas()
    assert Counter(again.itertuples(index=False, name=None)) == Counter(seen[4].itertuples(index=False, name=None))


def test_stages_send_workers_few_texts_at_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    import corpus_pipeline as cp

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, write, seen = spark.conf.get(rows), DataFrameWriter.parquet, {}

    def parquet(self, path, *a, **b):
        seen[re.search(r"tessera-(\w+)-", path)[1]] = int(spark.conf.get(rows))
        return write(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    cp.run(spark, "/root/testdata/sf0.001")
    assert {seen[x] for x in ("free", "sure", "kept", "fingerprints", "pieces")} == {1000}
    assert spark.conf.get(rows) == before
    sizes = spark.range(5000, numPartitions=1).mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), "id long")
    assert _scale.materialize(sizes, "sizes", batch_rows=1000).count() == 5


def test_workers_drop_what_other_operators_left(spark, docs):
    path = tokenizer_path("byte_bpe_50k.json")
    tokens.encoder(path)
    assert list(tokens.tidy(iter, encodes=True)([1])) == [1] and len(tokens._ENCODERS) == 1
    assert list(tokens.tidy(iter)([1, 2])) == [1, 2] and not tokens._ENCODERS

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(sys.modules["tessera.llm.tokens"]._ENCODERS)]})

    # one worker: packing leaves an encoder, fingerprints or features take it away
    d = spark.createDataFrame([(1, "some text", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for other in (fingerprints(d), quality._features(d)):
        packing.token_pieces(d, with_ids=False).collect()
        other.collect()
        assert [x["n"] for x in d.select("doc_id").mapInArrow(held, "n long").collect()] == [0]


def test_stages_take_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        for _, stage in cp.STAGES:
            out = stage(spark, start, str(tmp_path)).collect()
            assert start is docs or not out


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
