"""Exact search, SimHash groups, components and the pipeline against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash, topk
from lectern.operators import components

TEXT = "doc_id long, text string"


def brute_top(rows, k, every):
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = {}, set()
    for q, v in sorted(usable):
        if q % every == 0 and q not in asked:
            asked.add(q)
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return {q: r for q, r in out.items() if r}


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(400, 440)]  # many ties
    rows += [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0, 2.0]), (550, [2.0, 1.0]), (600, [1.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_top(rows, 5, 50)
    assert ranked(topk.top_k(df)) == want
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    assert ranked(topk.top_k(df, pivots=3)) == want
    assert topk.top_k(df.limit(0)).collect() == []


def test_bounds_leave_candidates_out():
    """With clustered vectors most candidates are never evaluated, and the result is the same."""
    rng = np.random.default_rng(2)
    x = np.round(100 * (np.repeat(rng.normal(size=(40, 16)), 50, 0) * 3 + 0.05 * rng.normal(size=(2000, 16)))).astype(np.int64)
    ids, q = np.arange(2000), x[:5]
    top = float((x * x).sum(1).max())
    pivots = np.hstack([x[::60], np.sqrt(top - (x[::60] ** 2).sum(1, keepdims=True))])
    lift = lambda v, e: np.hstack([v, e])
    dist = lambda a: np.sqrt(np.maximum(((a[:, None] - pivots[None]) ** 2).sum(2), 0))
    data = dist(lift(x, np.sqrt(np.maximum(top - (x * x).sum(1, keepdims=True), 0))))
    found = topk._search((ids[:5], q, dist(lift(q, np.zeros((5, 1))))), (ids, x, data), 5, top)
    for i in range(5):
        s = x @ q[i]
        want = sorted((-v, k) for k, v in enumerate(s.tolist()) if k != i)[:5]
        assert [(-c, b) for a, b, c in found if a == i] == want


def brute_mark(text, size):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_groups(marks, radius):
    parent = {d: d for d in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(marks)
    for a in ids:
        for b in ids:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 200):
        text = " ".join(rng.choice(["A", "the", "Ünder", "x\ty"]) for _ in range(n))
        assert simhash.simhash(text.encode().lower().split(), 4) == brute_mark(text, 4)
    assert simhash.simhash([b"w%d" % i for i in range(70_000)], 4) == brute_mark(" ".join(f"w{i}" for i in range(70_000)), 4)


def near_texts(rng, n):
    base = [[f"w{rng.randrange(500)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for d in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(300)] = f"v{d}"
        rows.append((d, rng.choice([" ".join(words), " ".join(words), None, "", "tiny text"])))
    return rows


def test_near_duplicates(spark):
    rows = near_texts(random.Random(3), 200)
    df = spark.createDataFrame(rows, TEXT).repartition(4)
    marks = {d: brute_mark(t, 4) for d, t in rows}
    want = brute_groups(marks, 4)
    for tile in (simhash.TILE, 8):
        got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(df, 4, 4, tile).collect()}
        assert got == {d: (marks[d], want[d]) for d in marks}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(5, "same text here now", 1), (5, "same text here now", 1), (9, "Same text here NOW", 2), (None, None, 3), (2, "", 4)], TEXT + ", fp int")
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(df, 4).collect())
    assert got == [("2", 2), ("5", 5), ("5", 5), ("9", 5), ("None", None)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_every_link_shares_its_bands():
    """The pigeonhole schemes: any two values within the radius agree on a chosen set of bands."""
    rng = random.Random(4)
    for n in (10**3, 10**7, 10**10):
        bands, agree = simhash.band_scheme(n, 4)
        edges = [64 * i // bands for i in range(bands + 1)]
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            same = sum((x ^ y) >> edges[i] & ((1 << edges[i + 1] - edges[i]) - 1) == 0 for i in range(bands))
            assert same >= agree


def test_forest_joins_what_links_join():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 30).astype(np.uint64)
    fps = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(40)]))
    marks = dict(enumerate(fps.tolist()))
    i, j = simhash.forest(fps, 4)
    assert len(i) < len(fps)
    parent = dict(marks)
    parent = {k: k for k in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        assert (marks[a] ^ marks[b]).bit_count() <= 4
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {k: find(k) for k in marks} == brute_groups(marks, 4)


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def share(a, b):
    return len(a & b) / len(a | b)


def test_near_copies(spark):
    """Texts with many common shingles meet, texts with few never do, by chains of links too."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(3000)}" for _ in range(400)] for _ in range(15)]
    rows = []
    for d in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 60])):
            words[rng.randrange(400)] = f"v{d}"
        rows.append((d, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "three short words"), (203, "Three short WORDS"), (None, "three short words"), (203, "a text of its own, unlike all of the others")]
    df = spark.createDataFrame([(*r, b"x") for r in rows], TEXT + ", text_key binary").repartition(3)
    grams = [(d, shingles(t)) for d, t in rows[:200]]
    want = {d: d for d, _ in grams}
    for a, x in grams:
        for b, y in grams[:a]:
            if share(x, y) >= 0.8:
                lo, hi = sorted((want[a], want[b]))
                want = {d: lo if c == hi else c for d, c in want.items()}
    for tile in (simhash.TILE, 8):
        got = simhash.near_copies(df, tile=tile).collect()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in want} == want
        rest = sorted((str(r["doc_id"]), r["component_id"]) for r in got if r["doc_id"] not in want)
        assert rest == [("200", 200), ("201", 200), ("202", 202), ("203", 202), ("203", 203), ("None", None)]
    kept = simhash.without_copies(df)
    assert kept.columns == df.columns
    left = [(d, t) for d, t in rows[:200] if want[d] == d] + [rows[200], rows[202], rows[204], rows[205]]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(d), t or "") for d, t in left)
    assert simhash.near_copies(df.limit(0)).collect() == []


def test_near_copies_at_the_border(spark):
    """Groups are those of the exact share 0.8, on both sides of it; chains of links included."""
    rng = random.Random(16)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 40, 200, 300]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            words = list(base)
            for _ in range(max(1, round(len(base) * rng.uniform(0.01, 0.03)))):
                words[rng.randrange(len(words))] = f"v{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, "a b c d e f g h"), (1001, "a b c d e f g h i"), (1002, "a b c d e f g"), (1003, "a b c d e f")]
    df = spark.createDataFrame(rows, TEXT).repartition(3)
    grams = {d: shingles(t) for d, t in rows}
    want = {d: d for d in grams}
    near = band = 0
    for a in grams:
        for b in [b for b in grams if b < a]:
            like = share(grams[a], grams[b])
            band += 0.7 <= like < 0.9
            if like >= 0.8:
                near += 1
                lo, hi = sorted((want[a], want[b]))
                want = {d: lo if c == hi else c for d, c in want.items()}
    assert near > 40 and band > 60
    for tile in (simhash.TILE, 8):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df, tile=tile).collect()} == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (300, 300)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["vertex"]: r["component"] for r in components.components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 150: 100, 200: 100}


def test_queries(spark, sf_dir):
    from lectern.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    marks = {d: brute_mark(t, 4) for d, t in docs.items()}
    want = brute_groups(marks, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{marks[d]:016x}", want[d]) for d in docs}


def test_pipeline(spark, sf_dir):
    """Each stage on its own input, by brute force."""
    import re

    import corpus_pipeline

    from .test_line_and_shard import kept_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], sf_dir)
        tables.append(spark.createDataFrame(out.collect(), out.schema))
    rows = [{r["doc_id"]: r["text"] for r in t.select("doc_id", F.col("text") if "text" in t.columns else F.lit(None).cast("string").alias("text")).collect()} for t in tables]
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    assert set(rows[0]) - set(rows[1]) <= {d for d, t in rows[0].items() if not re.search(r"[^\W\d_]", t or "")}
    lines = kept_lines(list(rows[1].items()))
    assert rows[2] == {d: (k if n else rows[1][d]) for d, (_, n, k) in lines.items() if not n or k}
    grams = {d: shingles(t) for d, t in rows[2].items()}
    assert all(rows[3][d] == rows[2][d] for d in rows[3])
    for d in set(rows[2]) - set(rows[3]):
        assert max(share(grams[d], grams[e]) for e in grams if e != d) >= 0.8
    left = sorted(rows[3])
    assert all(share(grams[a], grams[b]) < 0.8 for i, a in enumerate(left) for b in left[:i])
    assert set(rows[4]) <= set(rows[3])
    assert set(rows[5]) == set(rows[4])
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in whole.collect()} == set(rows[5])
