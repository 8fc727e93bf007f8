"""Exact line dedup across documents.

Line keys are hashed to 128 bits, range-partitioned by (hash, document, position) and sorted inside each
partition.  Because document and position are part of the range key, a line that a third of all documents hold
spreads over as many partitions as its rows fill; only which document came first is carried from one partition
to the next, as one row per partition.  A pass over each sorted partition streams first occurrences and emits
the positions to drop; per document these become a zlib-compressed keep bitmap.  Text never takes part in the
sort.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as A

from .common import checkpointed, free_names, own_columns, small_batches, stored

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row (h1, h2, doc_id, text_key, pos) for each line whose key is long enough."""
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    lines = known.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER)
    keyed = lines.select("doc_id", "text_key", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_key", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, partitions: int | None = None) -> DataFrame:
    """(doc_id, text_key, keep): a compressed bitmap for each text of a document that loses lines.

    ``keep`` holds one bit a line, little-endian within bytes, 1 for lines that stay, up to the last line that
    goes; lines beyond its end stay.  ``text_key`` (xxhash64 of the text) tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc_id", "text_key", "pos"]
    ranged = line_keys(docs, min_chars).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))

    # What each partition starts and ends with, and the smallest document of either hash: a row a partition.
    edges = ranged.groupBy("part").agg(
        F.min(F.struct("h1", "h2", "doc_id")).alias("first"), F.max(F.struct("h1", "h2", F.bitwise_not("doc_id").alias("not_doc"))).alias("last")
    )
    # The document that first holds a partition's first hash, if the hash began in an earlier partition.
    begun: dict[int, tuple[int, int, int]] = {}
    opened: tuple[int, int, int] | None = None
    for r in sorted(edges.collect(), key=lambda r: r["part"]):
        if opened is not None and opened[:2] == tuple(r["first"])[:2]:
            begun[r["part"]] = opened
        last = tuple(r["last"])
        if opened is None or opened[:2] != last[:2]:
            opened = (*last[:2], ~last[2])

    def stream(batches):
        held: tuple[int, int] | None = None
        owner = 0
        for pdf in batches:
            if not len(pdf):
                continue
            h1, h2, doc, text_key, pos = (pdf[c].to_numpy() for c in order)
            part = int(pdf["part"].iloc[0])
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if held is None and part in begun and begun[part][:2] == (int(h1[0]), int(h2[0])):
                held, owner = (int(h1[0]), int(h2[0])), begun[part][2]
            continued = held == (int(h1[0]), int(h2[0]))
            first_at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
            owners = doc[first_at]
            if continued:
                owners[first_at == 0] = owner
            held, owner = (int(h1[-1]), int(h2[-1])), int(owners[-1])
            lost = doc != owners
            yield pd.DataFrame({"doc_id": doc[lost], "text_key": text_key[lost], "pos": pos[lost]})

    dropped = ranged.mapInPandas(stream, "doc_id long, text_key long, pos int")
    gone = dropped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    return gone.select("doc_id", "text_key", _bitmap(F.col("gone")).alias("keep"))


@F.pandas_udf(A.BinaryType())
def _bitmap(gone: pd.Series) -> pd.Series:
    def pack(positions) -> bytes:
        bits = np.ones((int(positions[-1]) // 8 + 1) * 8, np.uint8)
        bits[np.asarray(positions, np.int64)] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

    return gone.map(pack)


RESULTS = ("n_lines", "n_dropped", "kept_text")


def apply_bitmaps(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Documents with ``n_lines``, ``n_dropped`` and the kept text; columns of ``docs`` are kept as they are.

    Where ``docs`` has the name of a result, the result gets underscores before its own: ``free_names(docs, *RESULTS)``.
    The bitmaps are written first, so the planner knows their size when it joins them.
    """
    n_lines, n_dropped, kept_text, keep_id, keep_key, bits, whole, cut = free_names(docs, *RESULTS, "keep_id", "keep_key", "keep_bits", "whole_text", "cut_text")
    small_batches(docs.sparkSession)
    bitmaps = stored(keep, "bitmaps").select(F.col("doc_id").alias(keep_id), F.col("text_key").alias(keep_key), F.col("keep").alias(bits))
    joined = docs.join(bitmaps, (F.col("doc_id") == F.col(keep_id)) & (F.xxhash64("text") == F.col(keep_key)), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = joined.select(*own_columns(docs), text.alias(whole), _cut(F.when(F.col(bits).isNotNull(), text), F.col(bits)).alias(cut))
    return out.select(
        *own_columns(docs),
        (F.length(whole) - F.length(F.replace(F.col(whole), F.lit("\n"), F.lit(""))) + 1).cast("long").alias(n_lines),
        F.coalesce(F.col(cut)["n"], F.lit(0).cast("long")).alias(n_dropped),
        F.coalesce(F.col(cut)["text"], F.col(whole)).alias(kept_text),
    )


@F.pandas_udf(A.StructType([A.StructField("n", A.LongType()), A.StructField("text", A.StringType())]))
def _cut(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    counts, kept = [], []
    for t, k in zip(text, keep, strict=True):
        if k is None or t is None:
            counts.append(None)
            kept.append(None)
            continue
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), bitorder="little")[: len(lines)].tolist()
        bits += [1] * (len(lines) - len(bits))
        kept.append("\n".join(x for x, b in zip(lines, bits, strict=True) if b))
        counts.append(len(lines) - sum(bits))
    return pd.DataFrame({"n": pd.array(counts, "Int64"), "text": kept})


def dedup_lines(docs: DataFrame, min_chars: int = 10, partitions: int | None = None) -> DataFrame:
    """Drop every line whose key (ASCII-stripped, A-Z lower-cased, ``min_chars`` or more code points) is also in a
    document with a smaller doc_id.

    Null and empty texts are one empty line.  Rows that repeat a doc_id are one document: none of them loses a line to
    another, and each loses its own lines that a smaller doc_id holds.  Rows without a doc_id keep their text.  An empty
    table gives an empty result; names are as in ``apply_bitmaps``.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars, partitions))
