"""Hard negatives by slots: an anchor's positives bound how near a negative may be.

An anchor's positives are its nearest rows of its own label, and each allows negatives whose score lies between two
shares of the positive's own.  These windows overlap.  Their upper limits, in descending order, cut the scores into
disjoint slots; every score belongs to one slot at most, so tasks and shuffles combine the k best of each slot and nothing
else.  The window of a positive is then the merge of its own slot and all lower ones, in descending order, down to the
window's lower limit: its first k are among the first k of each of these slots.

Rows are packed in blocks, by groups of labels, so that positives are sought in blocks of the anchor's own group only.
Anchors meet rows block by block as matrix products, which are exact: sums of integers below the mantissa's bound, by
Cauchy and Schwarz, or 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, give_back, stored

SCALE = 256
#: Groups of labels; anchors of a block; rows of a block, at least and at most, and blocks that a table is cut into between.
GROUPS, ANCHORS, LEAST_ROWS, MOST_ROWS, BLOCKS = 64, 4_096, 4_096, 131_072, 64
#: Scores looked at together, and candidates kept in a task before they are combined.
CELLS, KEPT = 1 << 20, 1 << 18
FOUND = "anchor_id long, slot int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, dim, label, grp, v array<long>): floor(256 * component) of rows with an id, a label and a finite vector."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col(label_col).cast("long")
    return embeddings.where(F.coalesce(whole & finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), label.alias("label"), F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int").alias("grp"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")
    )


def _kind(norm: float) -> str:
    """A type in which inner products of vectors of at most this squared length are exact."""
    return "float32" if norm < 1 << 24 else "float64" if norm < 1 << 53 else "int64"


def _packed(rows: DataFrame, size: int, kinds: dict[int, str], extra: tuple[str, ...] = ()) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """(blocks of about ``size`` rows sorted by id, first block and number of blocks of each (dim, group))."""
    first, begin = {}, {}
    for r in rows.groupBy("dim", "grp").count().orderBy("dim", "grp").collect():  # a row a group and dimension
        n = -(-r["count"] // size)
        first[r["dim"], r["grp"]] = begin.get(r["dim"], 0), n
        begin[r["dim"]] = begin.get(r["dim"], 0) + n
    numbers = rows.sparkSession.createDataFrame([(*k, *v) for k, v in first.items()], "dim int, grp int, begin int, blocks int")
    keyed = rows.join(F.broadcast(numbers), ["dim", "grp"])  # as many rows as groups and dimensions
    keyed = keyed.select("id", "dim", "grp", "label", "v", *extra, (F.col("begin") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("block"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        dim = int(key[0])
        v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), dim).astype(kinds[dim])
        out = {"dim": [dim], "block": [int(key[1])], "grp": [int(pdf["grp"].iloc[0])], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]}
        for c in extra:
            out[c] = [b"".join(pdf[c])]
        return pd.DataFrame(out)

    schema = "dim int, block int, grp int, ids binary, labels binary, vectors binary" + "".join(f", {c} binary" for c in extra)
    return stored(keyed.groupBy("dim", "block").applyInPandas(pack, schema), "label-blocks"), first


def _first(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best wanted scores; of equal ones those further left."""
    n = scores.shape[1]
    worst = np.iinfo(np.int64).min + 1
    if n > k:
        top = np.where(wanted, scores, worst)
        least = -np.partition(-top, k - 1, axis=1)[:, k - 1 : k]  # the k-th best; all above it stay, and of its equals the first ones
        above, equal = wanted & (top > least), wanted & (top == least)
        room = k - above.sum(1, keepdims=True)
        some = equal.any(1)
        equal[some] &= np.cumsum(equal[some], axis=1) <= room[some]
        wanted = above | equal
    return np.nonzero(wanted)


def _combined(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each (anchor, slot) among candidates (anchor, slot, id, score)."""
    if not found:
        return []
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return [rows[np.arange(len(rows)) - start < k]]


def _search(tiles: DataFrame, k: int, kinds: dict[int, str], negatives: bool) -> DataFrame:
    """Candidates (anchor_id, slot, vec_id, score): each task's k best of every anchor and slot."""

    def scores(q, x, kind):
        return (q @ x.T).astype(np.int64) if kind != "int64" else q @ x.T

    def search(batches):
        found, held = [], 0
        for pdf in batches:
            for r in pdf.itertuples():
                kind = kinds[r.dim]
                q_ids, q_labels, ids, labels = (np.frombuffer(b, np.int64) for b in (r.q_ids, r.q_labels, r.ids, r.labels))
                q, x = (np.frombuffer(b, kind).reshape(n, r.dim) for b, n in ((r.q_vectors, len(q_ids)), (r.vectors, len(ids))))
                limits = np.frombuffer(r.q_limits, ">i8").astype(np.int64).reshape(len(q_ids), -1) if negatives else None
                step = max(1, CELLS // len(ids))
                for at in range(0, len(q_ids), step):
                    some = slice(at, at + step)
                    s, same = scores(q[some], x, kind), q_labels[some, None] == labels[None, :]
                    if not negatives:
                        row, col = _first(s, same & (q_ids[some, None] != ids[None, :]), k)
                        found.append(np.stack([q_ids[some][row], np.zeros(len(row), np.int64), ids[col], s[row, col]], 1))
                    else:
                        floor, tops = limits[some, :1], limits[some, 1:]
                        fits = ~same & (s >= floor)
                        for j in range(tops.shape[1]):
                            inside = fits & (s <= tops[:, j : j + 1])
                            if j + 1 < tops.shape[1]:
                                inside &= s > tops[:, j + 1 : j + 2]
                            hit = np.flatnonzero(inside.any(1))
                            row, col = _first(s[hit], inside[hit], k)
                            row = hit[row]
                            found.append(np.stack([q_ids[some][row], np.full(len(row), j), ids[col], s[row, col]], 1))
                    held += len(found[-1])
                    if held > KEPT:
                        found = _combined(found, k)
                        held = len(found[0])
                        if held > KEPT // 2:
                            yield frame(found.pop())
                            held = 0
        for rows in _combined(found, k):
            yield frame(rows)
        give_back()

    def frame(rows: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["anchor_id", "slot", "vec_id", "score"])
        return out.astype({"slot": "int32"})

    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    with batch_rows(tiles.sparkSession, 4):
        best = tiles.mapInPandas(search, FOUND).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        return stored(best, "slot-best")


def mine(
    embeddings: DataFrame, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose id is divisible by ``every``; positives the first others of the same label by score, then
    id; negatives the first ``k`` rows of another label with low * p <= 100 * n <= high * p.  All comparisons are of
    integers.  Rows without an id, a label or a finite vector take no part; only rows of the anchor's dimension count.
    Repeated rows are candidates each; a repeated id is one anchor, by its smallest label and vector, and no positive of
    its own.  Anchors without positives, and positives without negatives, have no rows; an empty table gives none.
    """
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings, id_col, vector_col, label_col), "labelled-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()  # a row a dimension
    if not sizes:
        return spark.createDataFrame([], RESULT)
    kinds = {r["dim"]: _kind(r["norm"]) for r in sizes}
    size = min(MOST_ROWS, max(LEAST_ROWS, sum(r["n"] for r in sizes) // BLOCKS))
    data, home = _packed(rows, size, kinds)
    once = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "dim", "grp")).alias("q")).select("id", "q.*")
    asked, _ = _packed(once, ANCHORS, kinds)
    own = spark.createDataFrame([(*k_, b, b + n - 1) for k_, (b, n) in home.items()], "dim int, grp int, low int, high int")  # as many rows as groups and dimensions

    def tiles(blocks: DataFrame, ends: DataFrame, on: list[str], *extra: str) -> DataFrame:
        names = [F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "vectors", *extra)]
        sent = blocks.join(F.broadcast(ends), on).select("dim", *names, F.explode(F.sequence("low", "high")).alias("block"))
        return data.join(sent, ["dim", "block"])

    near = _search(tiles(asked, own, ["dim", "grp"]), positives, kinds, negatives=False)
    top, floor = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100"), F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100")
    windows = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), top.alias("top"), floor.alias("floor")).where("floor <= top")
    windows = stored(windows, "windows")
    # One row an anchor, of at most `positives` limits: the floor of all windows, then the slots' upper limits, descending.
    limits = windows.groupBy("anchor_id").agg(F.min("floor").alias("least"), F.sort_array(F.collect_set("top"), asc=False).alias("tops"))
    as_bytes = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: F.coalesce(F.get("tops", j), F.lit(-(2**63))))
    flat = F.concat(F.array("least"), filled)
    packed = limits.select(F.col("anchor_id").alias("id"), F.aggregate(flat, F.lit(b""), lambda a, c: F.concat(a, as_bytes(c))).alias("limits"))
    bounded, _ = _packed(once.join(packed, "id"), ANCHORS, kinds, ("limits",))
    every_block = {d: max(b + n for (e, _), (b, n) in home.items() if e == d) - 1 for d in kinds}
    whole = spark.createDataFrame([(d, 0, n) for d, n in every_block.items()], "dim int, low int, high int")  # a row a dimension
    far = _search(tiles(bounded, whole, ["dim"], "limits"), k, kinds, negatives=True)
    # Suffix merges: a window takes its slot and those below it, in descending order, down to its floor.
    slots = far.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "vec_id", "score"))).alias("found"))  # at most k a slot
    fits = lambda s: (s["score"] <= F.col("top")) & (s["score"] >= F.col("floor"))
    taken = windows.join(slots, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(F.filter("found", fits), 1, k)).alias("nth", "s"))
    return taken.select("anchor_id", "positive_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("negative_id"), "positive_score", F.col("s.score").alias("negative_score"))
