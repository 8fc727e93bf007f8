"""Substring deduplication by recompression.

Each document's words are recompressed: alternate rounds name runs of equal symbols and pairs of a left and a
right symbol.  A name is a 64-bit fingerprint of what it stands for and the side of a symbol is a bit of its
name, so names are the same all over the corpus without a dictionary that the rounds would have to shuffle, and
equal substrings are parsed into equal interior symbols.  With each symbol goes the stretch of words that decide
its name and its ends; a symbol whose stretch lies inside a window is part of every other occurrence of it.

Spark then works in two exchanges.  *Reveal*: the high-level symbols of all blocks meet, and a window that holds
a symbol of one document only is settled as unrepeated.  *Verify*: the windows that are left meet by 128
bits of fingerprints of their whole word sequence, and the smallest document of each is found.  Per (block, partition)
one packed row of sorted distinct fingerprints goes out and a bitmap comes back, so a passage that a third of
all documents share is one entry a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, mix, parts_for, stored, token_blocks, unpack_words

WINDOW, LEVELS = 13, 2
#: Distinct fingerprints that a reducer's partition holds on average.
PER_PART = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A second fingerprint beside the first: words, base and mixing of its own.
CHECK_BASE = np.uint64(0xD1B54A32D192ED03)

ASK_SCHEMA = "part int, block_id long, keys binary, docs binary"
REPLY_SCHEMA = "block_id long, part int, bits binary"


class Block:
    """The words of one block as fingerprints, with the document and the position of each."""

    def __init__(self, row):
        self.words = unpack_words(row["words"], row["word_lens"])
        self.tokens = np.frombuffer(row["tokens"], np.uint32)
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        digest = xxhash.xxh64_intdigest
        names, checks = (np.array([digest(w, seed) for w in self.words], np.uint64) for seed in (17, 71))
        self.symbols, self.checks = (x[self.tokens] if len(x) else np.empty(0, np.uint64) for x in (names, checks))
        self.doc_of = np.repeat(np.arange(len(self.lens)), self.lens)
        self.ends = np.cumsum(self.lens)

    def window_starts(self, size: int) -> np.ndarray:
        n = len(self.tokens)
        return np.arange(n)[np.arange(n) + size <= self.ends[self.doc_of]] if n else np.empty(0, np.int64)


class Rolling:
    """Fingerprints of any stretch of a word sequence from prefix sums of a polynomial."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = BASE):
        self.base, n = base, len(symbols)
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, base)))
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))))
        self.sums = np.append(np.uint64(0), np.cumsum(mix(symbols) * powers[:n]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def recompress(symbols: np.ndarray, doc_of: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) word stretches that decide each symbol after ``levels`` rounds of runs and pairs.

    Stretches at a document's edge reach one word beyond it, where no window does.
    """
    n = len(symbols)
    name, doc = symbols, doc_of
    low, high = np.arange(n), np.arange(n) + 1
    for level in range(levels):
        if not len(name):
            break
        # Runs: equal neighbours become one symbol, decided by the run and the symbol before and after it.
        starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])))
        counts = np.diff(np.append(starts, len(name)))
        lo, hi = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
        doc = doc[starts]
        same_left = np.append(False, doc[1:] == doc[:-1])
        same_right = np.append(doc[1:] == doc[:-1], False)
        before = np.append(0, low[starts[1:] - 1])
        after = np.append(high[starts[1:]], 0)
        low = np.where(same_left, np.minimum(lo, before), lo - 1)
        high = np.where(same_right, np.maximum(hi, after), hi + 1)
        name = np.where(counts > 1, mix(name[starts] + counts.astype(np.uint64) * BASE), name[starts])
        # Pairs: a symbol of the left side takes a following symbol of the right side with it.
        right_side = (mix(name + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        pairs = np.append(~right_side[:-1] & right_side[1:] & (doc[1:] == doc[:-1]), False)
        second = np.append(False, pairs[:-1])
        next_low, next_high = np.append(low[1:], 0), np.append(high[1:], 0)
        prev_low, prev_high = np.append(0, low[:-1]), np.append(0, high[:-1])
        has_next, has_prev = np.append(doc[1:] == doc[:-1], False), np.append(False, doc[1:] == doc[:-1])
        # A lone left symbol knows that the next is no right one, a lone right symbol that the one before is no left one.
        look_on = pairs | (~right_side & has_next)
        look_back = right_side & ~second & has_prev
        new_low = np.where(look_on, np.minimum(low, next_low), np.where(look_back, np.minimum(low, prev_low), np.where(right_side & ~has_prev, low - 1, low)))
        new_high = np.where(look_on, np.maximum(high, next_high), np.where(look_back, np.maximum(high, prev_high), np.where(~right_side & ~has_next, high + 1, high)))
        joined = np.append(mix(name[:-1] * BASE + name[1:] + np.uint64(level + 7)), np.uint64(0))
        name = np.where(pairs, joined, name)
        stay = ~second
        name, doc, low, high = name[stay], doc[stay], new_low[stay], new_high[stay]
    return low, high


def _inside(low: np.ndarray, high: np.ndarray, block: Block, size: int) -> np.ndarray:
    """Symbols whose stretch lies in one document and fits in a window."""
    n = len(block.tokens)
    fits = (high - low <= size) & (low >= 0) & (high <= n)
    at = np.flatnonzero(fits)
    return at[block.doc_of[low[at]] == block.doc_of[high[at] - 1]]


def _revealing(block: Block, size: int, levels: int):
    """(low, high, key) of the usable high-level symbols; the key is a fingerprint of the words that decide them."""
    low, high = recompress(block.symbols, block.doc_of, levels)
    use = _inside(low, high, block, size)
    low, high = low[use], high[use]
    return low, high, Rolling(block.symbols).of(low, high)


def _distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the number of each given one."""
    order = np.lexsort((checks, keys))
    a, b = keys[order], checks[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[new], b[new], number


def _ask(block_id: int, keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, parts: int):
    """(partition, block, keys, checks, smallest document, largest) of the distinct pairs of key and check in each partition."""
    order = np.lexsort((docs, checks, keys))
    keys, checks, docs = keys[order], checks[order], docs[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))) if len(keys) else np.empty(0, np.int64)
    last = np.append(first[1:], len(keys)) - 1
    keys, checks, least, most = keys[first], checks[first], docs[first], docs[last] if len(keys) else docs
    part = (keys % np.uint64(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.append(True, part[by][1:] != part[by][:-1])) if len(by) else np.empty(0, np.int64)
    for begin, end in zip(edges.tolist(), np.append(edges[1:], len(by)).tolist()[: len(edges)], strict=True):
        some = by[begin:end]
        yield int(part[some[0]]), block_id, keys[some], checks[some], least[some], most[some]


def _answers(reply: pd.DataFrame, keys: np.ndarray, parts: int) -> np.ndarray:
    """The replied bit of each key, in the order of distinct pairs."""
    out = np.zeros(len(keys), bool)
    part = (keys % np.uint64(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    begin = np.searchsorted(part[by], reply["part"].to_numpy(np.int32))
    end = np.searchsorted(part[by], reply["part"].to_numpy(np.int32), "right")
    for at, to, bits in zip(begin.tolist(), end.tolist(), reply["bits"], strict=True):
        some = by[at:to]
        out[some] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(some)).astype(bool)
    return out


def _short(keys: np.ndarray, parts: int) -> np.ndarray:
    """32 bits of each key beside its partition: enough to reveal, as what it passes is verified."""
    return (keys // np.uint64(parts)).astype(np.uint32)


def _meet_symbols(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Which symbols more than one document holds."""
    arrays = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
    many = [np.unpackbits(np.frombuffer(d, np.uint8), count=len(a)).astype(bool) for d, a in zip(pdf["docs"], arrays, strict=True)]
    every = np.sort(np.concatenate([np.unique(a) for a in arrays]))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *[a[m] for a, m in zip(arrays, many, strict=True)]]))
    bits = []
    for a, m in zip(arrays, many, strict=True):
        at = np.minimum(np.searchsorted(shared, a), max(len(shared) - 1, 0))
        bits.append(np.packbits(shared[at] == a if len(shared) else m).tobytes())
    return pd.DataFrame({"block_id": pdf["block_id"], "part": int(key[0]), "bits": bits})


def _meet_windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Which windows a smaller document than the block's smallest holds."""
    pairs = [np.frombuffer(k, np.uint64).reshape(2, -1) for k in pdf["keys"]]
    docs = np.concatenate([np.frombuffer(d, np.int64) for d in pdf["docs"]])
    keys, _, number = _distinct(*np.concatenate(pairs, axis=1))
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs)
    earlier = np.split(least[number] < docs, np.cumsum([p.shape[1] for p in pairs])[:-1])
    return pd.DataFrame({"block_id": pdf["block_id"], "part": int(key[0]), "bits": [np.packbits(x).tobytes() for x in earlier]})


def _live_windows(block: Block, reply: pd.DataFrame, size: int, levels: int, parts: int):
    """(starts, keys, checks) of the windows whose every revealing symbol is shared."""
    low, high, key = _revealing(block, size, levels)
    distinct, inverse = np.unique(key, return_inverse=True)
    shared = _answers(reply, distinct, parts)[inverse]
    # A symbol of one document settles each window that holds its stretch: starts in [high - size, low].
    n = len(block.tokens)
    change = np.zeros(n + size + 2, np.int64)
    np.add.at(change, np.maximum(high[~shared] - size, 0), 1)
    np.add.at(change, low[~shared] + 1, -1)
    settled = np.cumsum(change)[:n] > 0
    starts = block.window_starts(size)
    starts = starts[~settled[starts]]
    return starts, Rolling(block.symbols).of(starts, starts + size), Rolling(block.checks, CHECK_BASE).of(starts, starts + size)


def removed_words(docs: DataFrame, size: int = WINDOW, levels: int = LEVELS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): words covered by a ``size``-word window that also starts in a
    document with a smaller doc_id go; spans are their [start, end) word positions as little-endian int64 pairs.

    Words are ``[^\\x20\\x09-\\x0D]+`` unchanged; kept words are joined by one space.  Null and empty texts have no
    words.  Rows that repeat a doc_id are one document, so copies of a row never remove each other; a row without a
    doc_id counts as the smallest.  Windows are judged on the input.
    """
    blocks = token_blocks(docs, lower=False, block_bytes=block_bytes)
    total = blocks.agg(F.sum("n_tokens").alias("n")).collect()[0]["n"] or 0
    parts = parts_for(total // 2, PER_PART)

    def ask_symbols(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                low, _, key = _revealing(block, size, levels)
                for p, b, k, _, least, most in _ask(row["block_id"], key, np.zeros_like(key), block.doc_ids[block.doc_of[low]], parts):
                    yield _batch(p, b, _short(k, parts).tobytes(), np.packbits(least != most).tobytes())

    revealed = stored(blocks.mapInArrow(ask_symbols, ASK_SCHEMA).groupBy("part").applyInPandas(_meet_symbols, REPLY_SCHEMA), "shared-symbols")

    def ask_windows(key: tuple, block_pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in block_pdf.to_dict("records"):
            block = Block(row)
            starts, keys, checks = _live_windows(block, reply, size, levels, parts)
            for p, b, k, c, least, _ in _ask(row["block_id"], keys, checks, block.doc_ids[block.doc_of[starts]], parts):
                rows.append((p, b, k.tobytes() + c.tobytes(), least.tobytes()))
        return pd.DataFrame(rows, columns=["part", "block_id", "keys", "docs"])

    asked = blocks.groupBy("block_id").cogroup(revealed.groupBy("block_id")).applyInPandas(ask_windows, ASK_SCHEMA)
    verified = asked.groupBy("part").applyInPandas(_meet_windows, REPLY_SCHEMA)
    replies = stored(verified.withColumn("round", F.lit(2)).unionByName(revealed.withColumn("round", F.lit(1))), "repeated-windows")

    def remove(key: tuple, block_pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        out = [_remove(Block(row), reply, size, levels, parts) for row in block_pdf.to_dict("records")]
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return blocks.groupBy("block_id").cogroup(replies.groupBy("block_id")).applyInPandas(remove, "doc_id long, n_words long, n_removed long, spans binary, kept_text string")


def _batch(part: int, block_id: int, keys: bytes, docs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block_id], pa.int64()), pa.array([keys], pa.binary()), pa.array([docs], pa.binary())], names=["part", "block_id", "keys", "docs"])


def _remove(block: Block, reply: pd.DataFrame, size: int, levels: int, parts: int) -> pd.DataFrame:
    starts, keys, checks = _live_windows(block, reply[reply["round"] == 1], size, levels, parts)
    distinct, _, inverse = _distinct(keys, checks)
    earlier = _answers(reply[reply["round"] == 2], distinct, parts)[inverse]
    doc = block.doc_ids[block.doc_of[starts]]
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, doc)
    repeated = starts[earlier | (doc > least[inverse])]
    n = len(block.tokens)
    change = np.zeros(n + size + 1, np.int64)
    change[repeated] += 1
    change[repeated + size] -= 1
    gone = np.cumsum(change)[:n] > 0
    word_at = np.array([*block.words, b""], object)
    rows = []
    for i, end in enumerate(block.ends.tolist()):
        begin = end - int(block.lens[i])
        lost = gone[begin:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
        kept = word_at[block.tokens[begin:end][~lost]]
        doc_id = int(block.doc_ids[i])
        rows.append((None if doc_id == -(2**63) else doc_id, end - begin, int(lost.sum()), edges.astype("<i8").tobytes(), b" ".join(kept.tolist()).decode()))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"]).astype({"doc_id": "Int64"})
