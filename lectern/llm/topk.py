"""Exact top-k search by inner product with a pivot table.

A vector x of squared length s becomes (x, sqrt(M - s)) with M at least every s, and a query q becomes (q, 0).
Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest points of a metric space.
Distances of every point to the pivots are computed once and stored with the vectors; for a query, the largest
difference of pivot distances bounds its distance to a candidate from below.  Candidates are evaluated exactly,
in the order of their bounds, until the k-th best exact score beats every bound that is left.

Vectors are packed in blocks of near neighbours: a block holds rows of one nearest pivot, and a summary has the least
and greatest distance of its rows to every pivot.  A query first searches one block of its own pivot, which gives a
k-th score to beat; summaries then say which blocks can beat it, and only to those does the query go.  The data are
shuffled once whatever the number of queries; what travels is queries, as often as the pivots leave blocks open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
#: Vectors in a data block, queries in a query block, summaries in a row, candidates evaluated at a time.
DATA_BLOCK, QUERY_BLOCK, SUMMARIES, STEP = 2_048, 512, 4_096, 64
BLOCK = "dim int, block int, ids binary, vectors binary, dists binary"


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, dim, v array<long>): floor(scale * component) of usable vectors; null or non-finite ones take no part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _distances(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    point = np.hstack([v, lift])
    apart = (point * point).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * point @ pivots.T
    return np.sqrt(np.maximum(apart, 0))


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (v * v).sum(1, keepdims=True), 0))


def _with_nearest(rows: DataFrame, pivots: dict[int, np.ndarray], top: dict[int, float]) -> DataFrame:
    """Adds ``near``, the number of each vector's nearest pivot of its dimension."""

    def nearest(batches):
        for pdf in batches:
            out = np.zeros(len(pdf), np.int32)
            dims = pdf["dim"].to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = np.array(pdf["v"].iloc[at].tolist(), np.float64).reshape(len(at), int(d))
                out[at] = _distances(v, _lift(v, top[int(d)]), pivots[int(d)]).argmin(1)
            yield pdf.assign(near=out)

    return rows.mapInPandas(nearest, "id long, dim int, v array<long>, near int")


def _packed(rows: DataFrame, size: int, first: dict[tuple[int, int], tuple[int, int]], pivots: dict[int, np.ndarray], top: dict[int, float], queries: bool) -> DataFrame:
    """Blocks of about ``size`` rows (id, dim, v, near); ``first`` has the first block and the number of blocks of each
    (dim, near).  ``dists`` are distances to the pivots, of queries without a lift."""
    numbers = rows.sparkSession.createDataFrame([(*k, *v) for k, v in first.items()], "dim int, near int, begin int, blocks int")
    keyed = rows.join(F.broadcast(numbers), ["dim", "near"])  # a row a pivot and dimension
    keyed = keyed.select("id", "dim", "v", (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), dim)
        dists = _distances(v, np.zeros((len(v), 1)) if queries else _lift(v, top[dim]), pivots[dim])
        return pd.DataFrame({"dim": [dim], "block": [int(key[1])], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [v.astype(np.int64).tobytes()], "dists": [dists.tobytes()]})

    return keyed.groupBy("dim", "block").applyInPandas(pack, BLOCK)


def _blocks_of(rows: DataFrame, size: int) -> dict[tuple[int, int], tuple[int, int]]:
    """First block and number of blocks of each (dim, near), numbered from 0 in each dimension."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    begin: dict[int, int] = {}
    for r in rows.groupBy("dim", "near").count().orderBy("dim", "near").collect():  # a row a pivot and dimension
        n = -(-r["count"] // size)
        out[r["dim"], r["near"]] = begin.get(r["dim"], 0), n
        begin[r["dim"]] = begin.get(r["dim"], 0) + n
    return out


def _most(q_norm: np.ndarray, top: float, bound: np.ndarray) -> np.ndarray:
    """The largest inner product that a distance of at least ``bound`` allows.  The slack pays for rounding in the square
    roots: a bound must never claim too much."""
    return (q_norm + top - np.square(np.maximum(bound - 1e-6 * (1 + bound), 0))) / 2 + 1e-3


def _search(q: tuple, x: tuple, k: int, top: float) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in one data block, found in bound order."""
    (q_ids, q_v, q_d), (x_ids, x_v, x_d) = q, x
    out = []
    q_norm = (q_v * q_v).sum(1)
    x_f = x_v.astype(np.float64)
    for i in range(len(q_ids)):
        bound = np.zeros(len(x_ids))
        for p in range(x_d.shape[1]):
            np.maximum(bound, np.abs(x_d[:, p] - q_d[i, p]), out=bound)
        most = _most(float(q_norm[i]), top, bound)
        most[x_ids == q_ids[i]] = -np.inf
        left, best = np.arange(len(x_ids)), []
        step = STEP
        while len(left):
            take = min(step, len(left))
            if take < len(left):
                near = np.argpartition(-most[left], take - 1)
                now, left = left[near[:take]], left[near[take:]]
            else:
                now, left = left, left[:0]
            now = now[most[now] > -np.inf]
            scores = (x_f[now] @ q_v[i]).astype(np.int64)
            best = sorted([*best, *zip((-scores).tolist(), x_ids[now].tolist(), strict=True)])[:k]
            if len(best) == k:
                left = left[most[left] >= -best[-1][0]]  # ties stay: a smaller id may win
            step *= 4
        out += [(int(q_ids[i]), v, -s) for s, v in best]
    return out


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, pivots: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the exact k best of each vector whose id is divisible by ``every``.

    Scores are integer inner products of the floored, scaled vectors; ties go to the smaller id; a query meets
    every row but those of its own id, and only rows of its own dimension.  Fewer than k candidates give fewer
    rows.  Repeated rows are candidates each, but an id is one query, by the smallest of its vectors.  Null vectors, and
    vectors with null or non-finite components, take no part; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = stored(quantised(embeddings, id_col, vector_col, scale), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect()  # a row a dimension
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = {r["dim"]: float(r["top"]) for r in counts}
    # The pivots are the `pivots` rows of each dimension with the smallest hashes: a documented bound.
    order = Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v")
    low = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    cut = {r["dim"]: min(1.0, 64.0 * pivots / r["n"]) for r in counts}
    few = low.where(F.coalesce(*[F.when(F.col("dim") == d, F.col("h") < int(c * (1 << 30))) for d, c in cut.items()]))
    chosen = few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= pivots).select("dim", "v").collect()
    points: dict[int, np.ndarray] = {}
    for d in top:
        v = np.array([r["v"] for r in chosen if r["dim"] == d], np.float64).reshape(-1, d)
        points[d] = np.hstack([v, np.sqrt(np.maximum(top[d] - (v * v).sum(1, keepdims=True), 0))])
    near = stored(_with_nearest(rows, points, top), "nearest")
    home = _blocks_of(near, DATA_BLOCK)
    data = stored(_packed(near, DATA_BLOCK, home, points, top, queries=False), "vector-blocks")
    once = near.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "near", "dim")).alias("q")).select("id", "q.dim", "q.v", "q.near")
    q_first = _blocks_of(once, QUERY_BLOCK)
    asked = _packed(once, QUERY_BLOCK, q_first, points, top, queries=True)
    chunks = {d: -(-max(begin + n for (e, _), (begin, n) in home.items() if e == d) // SUMMARIES) for d in top}
    pairs = [(d, begin + i, home[d, c][0] + i % home[d, c][1], chunks[d]) for (d, c), (begin, n) in q_first.items() for i in range(n)]
    own = spark.createDataFrame(pairs, "dim int, q_block int, block int, chunks int")  # a row a query block
    asked = asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dists").alias("q_dists"))

    def unpack(ids: bytes, vectors: bytes, dists: bytes, dim: int) -> tuple:
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(vectors, np.int64).reshape(len(ids), dim), np.frombuffer(dists).reshape(len(ids), -1)

    def to_beat(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                q, x = unpack(r.q_ids, r.q_vectors, r.q_dists, r.dim), unpack(r.ids, r.vectors, r.dists, r.dim)
                scores: dict[int, list[int]] = {}
                for query, _, score in _search(q, x, k, top[r.dim]):
                    scores.setdefault(query, []).append(score)
                least = [float(min(scores[i])) if len(scores.get(i, ())) == k else -np.inf for i in q[0].tolist()]
                yield pd.DataFrame({"dim": [r.dim], "q_block": [r.q_block], "q_ids": [r.q_ids], "q_vectors": [r.q_vectors], "q_dists": [r.q_dists], "to_beat": [np.array(least).tobytes()], "chunks": [r.chunks]})

    begun = asked.join(own, ["dim", "q_block"]).join(data, ["dim", "block"])
    asked = stored(begun.mapInPandas(to_beat, "dim int, q_block int, q_ids binary, q_vectors binary, q_dists binary, to_beat binary, chunks int"), "query-blocks")

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dists = [np.frombuffer(x).reshape(-1, len(points[int(key[0])])) for x in pdf["dists"]]
        ends = [np.concatenate([f(x, axis=0) for x in dists]).tobytes() for f in (np.min, np.max)]
        return pd.DataFrame({"dim": [int(key[0])], "chunk": [int(key[1])], "blocks": [pdf["block"].to_numpy(np.int32).tobytes()], "low": [ends[0]], "high": [ends[1]]})

    chunk = F.floor(F.col("block") / SUMMARIES).cast("int").alias("chunk")
    summaries = data.select("dim", "block", "dists", chunk).groupBy("dim", "chunk").applyInPandas(summarise, "dim int, chunk int, blocks binary, low binary, high binary")
    summaries = stored(summaries, "block-summaries")

    def choose(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                q_ids, v, dists = unpack(r.q_ids, r.q_vectors, r.q_dists, r.dim)
                blocks, least = np.frombuffer(r.blocks, np.int32), np.frombuffer(r.to_beat)
                low, high = (np.frombuffer(x).reshape(len(blocks), -1) for x in (r.low, r.high))
                bound = np.zeros((len(q_ids), len(blocks)))
                for p in range(dists.shape[1]):
                    at = dists[:, p, None]
                    np.maximum(bound, np.maximum(low[None, :, p] - at, at - high[None, :, p]), out=bound)
                open_ = _most((v * v).sum(1).astype(np.float64)[:, None], top[r.dim], bound) >= least[:, None]  # ties stay: a smaller id may win
                for b in np.flatnonzero(open_.any(0)).tolist():
                    some = np.flatnonzero(open_[:, b])
                    yield pd.DataFrame({"dim": [r.dim], "block": [int(blocks[b])], "q_ids": [q_ids[some].tobytes()], "q_vectors": [v[some].tobytes()], "q_dists": [dists[some].tobytes()]})

    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sent = asked.join(summaries, ["dim", "chunk"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "q_block", "chunk")  # query blocks against summaries only
    sent = sent.mapInPandas(choose, "dim int, block int, q_ids binary, q_vectors binary, q_dists binary")

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                found = _search(unpack(r.q_ids, r.q_vectors, r.q_dists, r.dim), unpack(r.ids, r.vectors, r.dists, r.dim), k, top[r.dim])
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = data.join(sent, ["dim", "block"]).mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
