"""Substring dedup and context-tree scores against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from lectern.llm import ctw, substring_dedup


def brute_removed(rows, size=13):
    words = {}
    for d, t in rows:
        words[d] = [w.decode() for w in (t or "").encode().split()]
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][k : k + size]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < d:
                gone[k : k + size] = [True] * size
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def removed(df, **options):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.removed_words(df, **options).collect()}


def hard_texts(rng, n):
    base = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(25)]
    passage = " ".join(f"w{rng.randrange(40)}" for _ in range(30))
    kinds = [
        lambda: None, lambda: "", lambda: rng.choice(base), lambda: rng.choice(base) + "\t" + rng.choice(base), lambda: "a " * rng.randint(0, 40), lambda: "x y\n" * rng.randint(0, 20),
        lambda: f"own {rng.random()} {passage} tail {rng.random()}", lambda: passage, lambda: " ".join(f"é {rng.randrange(9)}" for _ in range(20)),
    ]
    return [(d, rng.choice(kinds)()) for d in range(n)]


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_removed_words(spark, block_bytes):
    rows = hard_texts(random.Random(4), 250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df, block_bytes=block_bytes) == brute_removed(rows)


def test_removed_words_edges(spark):
    assert removed(spark.createDataFrame([], "doc_id long, text string")) == {}
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(3, text, 1), (3, text, 1), (None, None, 2), (5, text + " more", 3)], "doc_id long, text string, n_words int")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.removed_words(df).collect())
    assert got == [("3", 20, 0), ("3", 20, 0), ("5", 21, 20), ("None", 0, 0)]


def test_equal_substrings_share_interior_symbols():
    """Every window of 13 words has the same usable symbols wherever it stands, unless it is one long run."""
    rng = np.random.default_rng(1)
    core = rng.integers(0, 6, 13).astype(np.uint64)
    seen = set()
    for _ in range(50):
        left, right = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))
        symbols = np.concatenate([left, core, right]).astype(np.uint64)
        low, high = substring_dedup.recompress(symbols, np.zeros(len(symbols), int))
        at = len(left)
        inside = (low >= at) & (high <= at + 13)
        seen.add(tuple(zip((low[inside] - at).tolist(), (high[inside] - at).tolist(), strict=True)))
    assert len(seen) == 1


def brute_tree(texts, depth):
    """(log10 probability of a text) by the definition, from training texts."""
    counts = collections.defaultdict(lambda: [0, 0])
    for s in texts:
        s = b"\n" * depth + s
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                for j in range(8):
                    counts[s[i - k : i], (1 << j) | (s[i] >> (8 - j))][(s[i] >> (7 - j)) & 1] += 1
    children = collections.defaultdict(list)
    for c, n in counts:
        if c:
            children[c[1:], n].append(c)
    own = lambda ab: math.lgamma(ab[0] + 0.5) + math.lgamma(ab[1] + 0.5) - math.lgamma(sum(ab) + 1) - math.log(math.pi)
    weighted = {}
    for k in range(depth, -1, -1):
        for (c, n), ab in list(counts.items()):
            if len(c) == k:
                weighted[c, n] = own(ab) if k == depth else np.logaddexp(own(ab), sum(weighted[x, n] for x in children[c, n])) - math.log(2)

    def bit(s, i, k, n, b):
        c = s[i - k : i]
        ab = counts.get((c, n), [0, 0])
        mine = (ab[b] + 0.5) / (sum(ab) + 1)
        if k == depth:
            return mine
        stop = math.exp(own(ab) - math.log(2) - weighted[c, n]) if (c, n) in weighted else 0.5
        return stop * mine + (1 - stop) * bit(s, i, k + 1, n, b)

    def score(s):
        s = b"\n" * depth + s
        return sum(math.log10(bit(s, i, 0, (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1)) for i in range(depth, len(s)) for j in range(8))

    return score


@pytest.mark.parametrize(("depth", "answer"), [(3, 256), (ctw.DEPTH, 2)])
def test_scores(spark, monkeypatch, depth, answer):
    """Against the tree by its definition, at the depth of the query too, and with subtrees answered a few blocks at a time."""
    monkeypatch.setattr(ctw, "ANSWER", answer)
    rng = random.Random(5)
    rows = [(d, rng.choice([None, "", "The cat  SAT on\nthe mat É", " ".join(rng.choice(["the", "a", "Cat", "of", "x%d" % d]) for _ in range(rng.randint(1, 30)))])) for d in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string").repartition(3)
    got = {r["doc_id"]: r for r in ctw.score(df, depth=depth, block_bytes=400).collect()}
    words = {d: (t or "").encode().lower().split() for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    tree = brute_tree([b" ".join(w) + b"\n" for d, w in words.items() if not held[d]], depth)
    c = collections.Counter(x for d, w in words.items() if not held[d] for x in [*w, None])
    n, v = sum(c.values()), len(c)
    for d, w in words.items():
        r = got[d]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(tree(b" ".join(w) + b"\n"), rel=1e-9)


def test_scores_of_nothing_and_of_no_training(spark):
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    r = ctw.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()[0]
    assert (r["held_out"], r["n_known"], r["train_tokens"]) == (True, 0, 0)
    assert r["score"] == pytest.approx(-4 * 8 * math.log10(2), rel=1e-6)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    rems = np.unique(rng.integers(0, 1 << 24, 300).astype(np.uint64) & np.uint64(0x0303FF))
    counts = rng.integers(0, 50, len(rems))
    _, _, levels = ctw.subtree(rems, counts, 4)
    fixed, rest = ctw.top_tables(__import__("pandas").DataFrame({"b1": 5, "node": levels[0].keys & 255, "n0": levels[0].n0, "n1": levels[0].n1, "pw": levels[0].pw}))
    longer = np.unique(rems >> np.uint64(8))
    for prefix in longer[:5]:
        every = (prefix << np.uint64(8)) + np.arange(256, dtype=np.uint64)
        known = np.concatenate([rems, np.setdiff1d(every, rems)])
        total = np.concatenate([counts, np.zeros(len(known) - len(rems), int)])
        order = np.argsort(known)
        logs = ctw.string_logs(5, known[order], total[order], 4, fixed, rest)
        assert (10.0 ** logs[np.isin(known[order], every)]).sum() == pytest.approx(1, rel=1e-9)


def test_fingerprints_that_collide():
    """Windows whose first fingerprints have two bits left are told apart by the second ones."""
    rng = np.random.default_rng(21)
    blocks = [(rng.integers(0, 40, n).astype(np.uint64), np.sort(rng.integers(0, 30, n))) for n in (200, 90, 1)]
    least = {}
    for window, doc in blocks:
        for w, d in zip(window.tolist(), doc.tolist(), strict=True):
            least[w] = min(least.get(w, d), d)
    pair = lambda window: (window & np.uint64(3), substring_dedup.mix(window))
    asked = collections.defaultdict(list)
    for i, (window, doc) in enumerate(blocks):
        for part, block, keys, checks, low, _ in substring_dedup._ask(i, *pair(window), doc, 3):
            asked[part].append((block, keys.tobytes() + checks.tobytes(), low.tobytes()))
    replies = pd.concat([substring_dedup._meet_windows((p,), pd.DataFrame(rows, columns=["block_id", "keys", "docs"])) for p, rows in asked.items()])
    for i, (window, doc) in enumerate(blocks):
        keys, _, number = substring_dedup._distinct(*pair(window))
        earlier = substring_dedup._answers(replies[replies["block_id"] == i], keys, 3)[number]
        first = {w: min(d for v, d in zip(window.tolist(), doc.tolist(), strict=True) if v == w) for w in window.tolist()}
        assert earlier.tolist() == [least[w] < first[w] for w in window.tolist()]
