"""Helpers shared by the training-data operators: shared-folder tables, text blocks, packed arrays.

Work that needs a look at the whole corpus is done block-wise: one block is a few megabytes of text held by
one task, and what it wants to know from the rest of the corpus leaves as *one packed row per (block, hash
partition)*.  A key that a third of all documents hold therefore reaches a reducer once a block, not once a
document, and no per-occurrence rows are shuffled.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.tables import checkpointed, shared_dir, small_batches, stored  # noqa: F401 - the operators' one source of helpers

#: Bytes of text that one block holds (the last document may go over).
BLOCK_BYTES = 8 << 20

BLOCK_SCHEMA = "block_id long, doc_ids binary, lens binary, tokens binary, words binary, word_lens binary, n_tokens long"


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is written inside the block; then the caller's setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each name with underscores before it until no column of ``df`` has it; Spark compares names without case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[F.Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_column(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: worker processes are used again and keep what they
    once took, so the peaks of different operators would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(rows: list, sizes, limit: int):
    """Cut rows into runs of about ``limit`` bytes."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit:
            yield rows[start : i + 1]
            start, total = i + 1, 0
    if start < len(rows):
        yield rows[start:]


class Numbering(dict):
    """Numbers new keys in order of appearance."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated slices [start, start + len)."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.repeat(starts.astype(np.int64) - (ends - lens), lens) + np.arange(total)


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return b"".join(words), np.fromiter(map(len, words), np.uint32, len(words)).tobytes()


def unpack_words(blob: bytes, lens: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lens, np.uint32).astype(np.int64)).tolist()
    out, at = [], 0
    for end in ends:
        out.append(blob[at:end])
        at = end
    return out


def token_blocks(docs: DataFrame, lower: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write documents as blocks of dictionary-coded words ``[^\\x20\\x09-\\x0D]+``; null text has no words.

    The table is written once before anything reads it, so the composition of the blocks, which depends on
    how the scan was split, is settled even if executors are lost later.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    assert id_type in ("bigint", "int", "smallint", "tinyint"), f"doc_id must be an integer, not {id_type}"
    small_batches(docs.sparkSession)
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))

    def build(batches):
        part = TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            ids, known = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False), batch.column(1)
            texts = [t or b"" for t in binary_column(known)]
            rows = list(zip(ids.tolist(), texts, strict=True))
            for chunk in chunks(rows, map(len, texts), block_bytes):
                vocab = Numbering()
                coded, lens = [], []
                for _, text in chunk:
                    words = (text.lower() if lower else text).split()
                    lens.append(len(words))
                    coded.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
                blob, word_lens = pack_words(list(vocab))
                tokens = np.concatenate(coded)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block_id": [(part << 32) | number],
                        "doc_ids": [np.array([i for i, _ in chunk], np.int64).tobytes()],
                        "lens": [np.array(lens, np.uint32).tobytes()],
                        "tokens": [tokens.tobytes()],
                        "words": [blob],
                        "word_lens": [word_lens],
                        "n_tokens": [len(tokens)],
                    }
                )
                number += 1

    return stored(spread.mapInArrow(build, BLOCK_SCHEMA), "token-blocks")


def parts_for(total: int, per_part: int, least: int = 64) -> int:
    """Hash partitions so that each holds about ``per_part`` of ``total`` items, whatever the corpus size."""
    return max(least, -(-total // per_part))
