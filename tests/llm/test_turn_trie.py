"""The prefix trie against a trie built by definition."""

import hashlib
import math
import random
import re
import zlib

import pytest

from lectern.llm import turn_trie

ROWS = "conv_id long, turn long, role string, text string, seq string, depth int"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    members, ends = {}, {}
    for c, ts in full.items():
        ends.setdefault(ts, []).append(c)
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for key in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        leaves[key] = leaves.get(key, 0) or 1
        saved[key] = saved.get(key, 0) + (len(members[key]) - 1) * words
        if key:
            up = key[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[key]
            saved[up] = saved.get(up, 0) + saved[key]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    out = []
    for key, ids in members.items():
        parent = min(members[key[:-1]]) if key else None
        out.append((min(ids), len(key), parent, len(ids), children.get(key, 0), leaves[key], saved[key], sha(ends.get(key, []))))
    return sorted(out, key=str)


def nodes(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.05:
            continue
        hot = rng.random() < 0.4
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            text = "the same opening" if hot and t < 3 else rng.choice(["", "a", "a b", "c  d\n", "e f"])
            rows.append((c, t, rng.choice(["user", None]) if not hot else "user", text if rng.random() > 0.03 else None))
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 560) for t in range(4)]
    rows += [(None, 1, "user", "x"), (700, None, "user", "first"), (700, -3, "user", "second"), (-7, 0, None, None)]
    rows += [(900, t, "user", f"{t % 7} long") for t in range(300)]
    return rows


@pytest.mark.parametrize(("seed", "limit", "turns"), [(1, 256, 1 << 19), (2, 3, 1 << 19), (3, 1, 1 << 19), (4, 256, 20)])
def test_nodes(spark, monkeypatch, seed, limit, turns):
    monkeypatch.setattr(turn_trie, "PIECE_BITS", 3)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], ROWS).repartition(3)
    monkeypatch.setattr(turn_trie.burst, "__defaults__", (limit, turns))
    assert nodes(turn_trie.trie(df, limit)) == brute(rows)


def test_empty(spark):
    assert turn_trie.trie(spark.createDataFrame([], ROWS)).collect() == []
    assert nodes(turn_trie.trie(spark.createDataFrame([(1, 0, None, None, "", 0)], ROWS))) == brute([(1, 0, None, None)])


def test_caterpillar(spark):
    """Each conversation goes on where the one before ends, so containers are burst again and again."""
    rows = [(20 * c, t, "user", "again") for c in range(30) for t in range(c + 1)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], ROWS)
    assert nodes(turn_trie.trie(df, 8)) == brute(rows)
