"""Hard negatives against sorting all scores."""

import numpy as np
import pytest

from lectern.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, rank int, grp string"


def brute(rows, every, positives=5, k=3):
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = set(), set()
    for i, v, y in sorted(usable, key=lambda r: (r[0], r[2], r[1])):
        if i % every or i in seen:
            continue
        seen.add(i)
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in usable if len(w) == len(v))
        best = [(-s, j) for s, j, z in scored if z == y and j != i][:positives]
        for p, j in best:
            fits = [(-s, n) for s, n, z in scored if z != y and 50 * p <= -100 * s <= 95 * p]
            out |= {(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fits[:k])}
    return out


def mined(df, **how):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("scale", [1.0, 40.0, 3e5])
def test_mined(spark, monkeypatch, scale):
    rng = np.random.default_rng(int(scale))
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(300):
        y = int(rng.choice([0, 0, 0, 1, 2, 3]))
        rows.append((i, ((centres[y] * 0.3 + rng.normal(size=8)).round(1) * scale).tolist(), y))
    rows += [(i, [scale * 0.5] * 8, i % 3) for i in range(300, 340)]  # ties
    rows += [(400, None, 1), (410, [1.0] * 7 + [None], 1), (420, [float("nan")] * 8, 1), (430, [1.0] * 8, None), (None, [1.0] * 8, 1), (440, [1.0, 2.0], 1), (450, [2.0, 1.0], 2), (451, [1.5, 1.0], 1), (460, [], 1), (461, [], 2)]
    rows += [(10, rows[10][1], rows[10][2])]
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], ROWS).repartition(3)
    want = sorted(brute(rows, 10))
    assert want
    assert sorted(set(mined(hard_negatives.mine(df, every=10)))) == want
    for name, value in (("ANCHORS", 4), ("LEAST_ROWS", 16), ("MOST_ROWS", 16), ("CELLS", 40), ("KEPT", 30)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(set(mined(hard_negatives.mine(df, every=10)))) == want
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_first_keeps_order_of_ties():
    s = np.array([[5, 7, 7, 7, 1], [3, 3, 3, 3, 3]])
    row, col = hard_negatives._first(s, np.array([[True] * 5, [False, True, True, True, True]]), 2)
    assert list(zip(row.tolist(), col.tolist())) == [(0, 1), (0, 2), (1, 1), (1, 2)]
