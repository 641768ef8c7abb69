"""Every registered training-data query over a whole small table, against brute force or its SQL."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return lambda name: duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def texts(table):
    d = table("documents")
    return {int(i): t or "" for i, t in zip(d["doc_id"], d["text"])}


@pytest.fixture(scope="module")
def run(spark):
    names = __spark_entry__.queries()

    def call(n):
        (name,) = [x for x in names if x.startswith(f"op{n}_")]
        return names[name](spark, SF).toPandas()

    return call


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(run, texts):
    t = library("byte_bpe_50k.json")
    ids = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in texts.items()}
    got, at, seq = run(1), defaultdict(int), defaultdict(int)
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : at[r.doc_id]])
    assert at == {i: len(x) for i, x in ids.items()}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.offset == seq[r.sequence_id]
        seq[r.sequence_id] += r.length
    assert max(seq.values()) <= 2048 and sorted(seq) == list(range(len(seq)))
    assert 1 - sum(at.values()) / (2048 * len(seq)) < 0.02


def test_op2(run, texts):
    t, at = library("word_bpe_49k.json"), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(2).itertuples()}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [1]
        assert got.pop(i) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_op3(run, texts):
    got = run(3)
    assert sorted(got["doc_id"]) == sorted(texts) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(16))
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    of = defaultdict(set)
    for r in got.itertuples():
        of[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    largest = max(Counter({x: sum(len(y.encode()) + 1 for y in texts.values() if y == x) for x in set(texts.values())}).values())
    assert load.max() <= max(load.sum() / 16 + largest, largest)


def test_op4(run, table):
    e = table("embeddings")
    ids, labels = e["vec_id"].to_numpy(), e["label"].to_numpy()
    v = np.stack([np.array(x, float) for x in e["embedding"]])
    cos = (v @ v.T) / np.sqrt((v * v).sum(axis=1)[:, None] * (v * v).sum(axis=1))
    hit = (cos >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(v), dtype=bool)
    comp = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit))])
    want = {(i, int(n), comp[i], i == comp[i]) for i, n in zip(ids, hit.sum(axis=1))}
    assert {tuple(r) for r in run(4).itertuples(index=False)} == want


@pytest.mark.parametrize("n", [4, 5, 7, 9])
def test_sql(run, n):
    (name,) = [x for x in __spark_entry__.oracle_sql() if x.startswith(f"op{n}_")]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(__spark_entry__.oracle_sql()[name]).df(), run(n)
    assert sorted(want.columns) == sorted(got.columns)
    cells = lambda f: sorted(tuple(map(repr, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert cells(want) == cells(got)


def test_op6(run, texts):
    got = run(6)
    assert sorted(got["doc_id"]) == sorted(texts) and got["score"].between(0, 1).all()
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_op8(run, texts):
    import xxhash

    prints = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    comp = roots(ids, [(i, j) for i in ids for j in ids if i < j and (prints[i] ^ prints[j]).bit_count() <= 2])
    assert {tuple(r) for r in run(8)[["doc_id", "fingerprint", "component_id"]].itertuples(index=False)} == {(i, f"{prints[i]:016x}", comp[i]) for i in ids}


def test_op9(run, texts):
    seen, want = set(), set()
    for i in sorted(texts):
        b = texts[i].encode()
        gone, own = np.zeros(len(b) + 1, int), [b[p : p + 50] for p in range(len(b) - 49)]
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = 1
        seen.update(own)
        kept = np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()
        want.add((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = run(9)[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]
    assert {tuple(r) for r in got.itertuples(index=False)} == want


def test_op10(run, texts, table):
    got = run(10)
    assert sorted(got["doc_id"]) == sorted(texts) and got["score"].between(0, 1).all()
    good = set(table("labels").query("quality == 1")["doc_id"])
    assert good <= set(got[got["kept"]]["doc_id"])
