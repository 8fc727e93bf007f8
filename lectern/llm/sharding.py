"""Sharding by sampled splitters.

Records are ordered by (hash of their text, doc_id), so equal texts are neighbours.  A size-weighted sample of
the keys gives quantile boundaries; the records are range-partitioned by them; ranges that turn out larger than
their share are subdivided by a second sample drawn inside them, down to the doc_id, so that a group of copies
of any size is cut.  Exact sizes of the ranges then give every record its place in the global order, and the
order is cut into shards of near-equal bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ROW_BYTES = 16
#: Text that a range stands for at most on average: a task then sorts some million narrow rows, whatever the input.
RANGE_BYTES = 4 << 30
KEY = np.dtype([("h", "<i8"), ("d", "<i8"), ("u", "<i8")])


def shard_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (h, d, u); u tells repeated rows apart."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"),
        F.monotonically_increasing_id().alias("u"),
    )


def _sample(keyed: DataFrame, expected: float, total: int, where=None) -> np.ndarray:
    """Keys drawn with a probability in proportion to their size; ``expected`` of them on the whole."""
    draw = F.pmod(F.xxhash64("h", "d", "u", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    picked = keyed.where(draw < F.col("size") * F.lit(expected / max(total, 1)))
    rows = (picked if where is None else picked.where(where)).select("h", "d", "u").collect()  # about `expected` rows, a parameter
    return np.sort(np.array([tuple(r) for r in rows], KEY))


def _quantiles(sample: np.ndarray, n: int) -> np.ndarray:
    if not len(sample) or n < 2:
        return sample[:0]
    return np.unique(sample[(np.arange(1, n) * len(sample)) // n])


def _with_range(keyed: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds ``rng``, the number of splitters at or below the key."""

    @F.pandas_udf("int")
    def locate(h: pd.Series, d: pd.Series, u: pd.Series) -> pd.Series:
        keys = np.empty(len(h), KEY)
        keys["h"], keys["d"], keys["u"] = h, d, u
        # Narrow by hash first; only keys on a splitter's own hash need the whole comparison.
        low = np.searchsorted(splitters["h"], keys["h"], "left")
        high = np.searchsorted(splitters["h"], keys["h"], "right")
        out = low.copy()
        hot = high > low
        out[hot] = np.searchsorted(splitters, keys[hot], "right")
        return pd.Series(out.astype(np.int32))

    return keyed.withColumn("rng", locate("h", "d", "u"))


def shard_by_bytes(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 16, samples_per_range: int = 24, overfull: float = 1.5) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): every row of ``docs`` in exactly one shard, sizes near equal.

    A record goes where its middle byte falls, so a shard's bytes differ from total / shards by at most
    half of the two records at its ends.  Null and empty texts weigh
    ``ROW_BYTES``; a null doc_id sorts first among equal texts.  An empty table gives an empty result.  The
    driver holds samples, splitters and range sizes only: ``samples_per_range`` keys expected for each of
    ``shards * ranges_per_shard`` ranges, or of one for every RANGE_BYTES of a larger input (0.6 million keys at 100 TB).
    """
    spark = docs.sparkSession
    keyed = checkpointed(shard_keys(docs))
    total = keyed.agg(F.sum("size").alias("b")).collect()[0]["b"] or 0
    n_ranges = max(shards * ranges_per_shard, -(-total // RANGE_BYTES))
    sample = _sample(keyed, n_ranges * samples_per_range, total)
    splitters = _quantiles(sample, n_ranges)
    share = total / n_ranges if total else 1

    # Subdivide overfull ranges by a denser sample of their own records.
    sizes = {r["rng"]: r["b"] for r in _with_range(keyed, splitters).groupBy("rng").agg(F.sum("size").alias("b")).collect()}
    full = {k: b for k, b in sizes.items() if b > overfull * share}
    if full:
        inside = _with_range(keyed, splitters).where(F.col("rng").isin(sorted(full)))
        weight = sum(full.values())
        fine = _sample(inside, samples_per_range * sum(math.ceil(b / share) for b in full.values()), weight)
        own = np.searchsorted(splitters, fine, "right") if len(splitters) else np.zeros(len(fine), int)
        extra = [_quantiles(fine[own == k], math.ceil(b / share)) for k, b in full.items()]
        splitters = np.unique(np.concatenate([splitters, *extra]))

    order = Window.partitionBy("rng").orderBy("h", "d", "u")
    placed = _with_range(keyed, splitters).withColumns(
        {"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "nth": F.row_number().over(order)}
    )
    placed = checkpointed(placed)
    spans = placed.groupBy("rng").agg(F.max("upto").alias("b"), F.count("*").alias("n")).orderBy("rng").collect()
    offsets, bytes_before, rows_before = [], 0, 0
    for r in spans:
        offsets.append((r["rng"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["b"], rows_before + r["n"]
    before = spark.createDataFrame(offsets, "rng int, bytes_before long, rows_before long")
    cut = placed.join(F.broadcast(before), "rng").select(  # one row a range, a bounded number
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.expr(f"cast((cast(2 * (bytes_before + upto) - size as decimal(38,0)) * {shards}) div {max(2 * total, 1)} as int)"), F.lit(shards - 1)).alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("_place"),
    )
    first = cut.groupBy("shard").agg(F.min("_place").alias("_first"))
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot"))  # a row a shard
