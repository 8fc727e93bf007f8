"""Language-model scoring by context-tree weighting.

A text is the byte string of its lower-cased words, a space between them and a newline at its end.  Each byte is
eight binary decisions; every decision, in every context of 0 to ``DEPTH`` bytes, has Krichevsky-Trofimov counts,
and the weighted mixture over all depths gives the probability of a byte and so the code length of a text.

Counting, weighting and scoring run in Spark over blocks of documents.  A block sends its distinct byte strings
of DEPTH + 1 bytes, with their training counts, to the subtree of their last two context bytes; counts of a
subtree are folded a bounded number of blocks at a time.  Subtrees are weighted from the leaves up; their sums
by last byte (65,280 rows at most, whatever the corpus) give the top two levels.  Replies hold the log
probability of each string that a block asked for.  Word counts for the unigram baseline go the same way.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, mix, parts_for, stored, token_blocks, unpack_words

DEPTH = 4
END, SPACE = b"\n", b" "
#: Blocks whose counts of a subtree are added up in one group, or answered from one reading of its model; distinct
#: words that a reducer holds.
FOLD, ANSWER, WORDS_PER_PART = 64, 256, 400_000
LN2 = np.log(2.0)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive numbers: Stirling's series above a shift of 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(shift)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """The decision nodes of all contexts of one length: ``at`` says which node each (string, bit) row meets."""

    def __init__(self, context: np.ndarray, node: np.ndarray, bit: np.ndarray, count: np.ndarray):
        self.keys, self.at = np.unique(context * 256 + node, return_inverse=True)
        self.n1 = np.bincount(self.at, count * bit, len(self.keys))
        self.n0 = np.bincount(self.at, count * (1 - bit), len(self.keys))
        self.pe = kt(self.n0, self.n1)
        self.pw = self.pe

    def above(self, child: Level) -> None:
        """Weight with the longer contexts ``child``: half the own estimate, half the product of theirs."""
        first = np.zeros(len(child.keys), np.int64)
        first[child.at] = self.at
        self.pw = np.logaddexp(self.pe, np.bincount(first, child.pw, len(self.keys))) - LN2

    def stop(self) -> np.ndarray:
        return np.minimum(np.exp(self.pe - LN2 - self.pw), 1.0)

    def own(self, bit: np.ndarray) -> np.ndarray:
        n0, n1 = self.n0[self.at], self.n1[self.at]
        return (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)


def subtree(rems: np.ndarray, counts: np.ndarray, depth: int):
    """Levels 2 to ``depth`` under one two-byte context; ``rems`` are the longer context bytes, then the byte itself."""
    byte = (rems & 0xFF).astype(np.int64)
    longer = (rems >> 8).astype(np.int64)  # the byte nearest to the subtree's context is the lowest
    j = np.arange(8)
    node = ((1 << j) | (byte[:, None] >> (8 - j))).reshape(-1)
    bit = ((byte[:, None] >> (7 - j)) & 1).reshape(-1)
    count = np.repeat(counts.astype(np.float64), 8)
    levels = [Level(np.repeat(longer & ((1 << (8 * k)) - 1), 8), node, bit, count) for k in range(depth - 1)]
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        upper.above(lower)
    return node, bit, levels


def top_tables(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(fixed[byte, node, bit], rest[byte, node]) of levels 0 and 1 from sums (b1, node, n0, n1, pw) of level 2."""
    n0, n1, pw2 = (np.zeros((256, 256)) for _ in range(3))
    at = rows["b1"].to_numpy(), rows["node"].to_numpy()
    n0[at], n1[at], pw2[at] = rows["n0"], rows["n1"], rows["pw"]
    pe1 = kt(n0, n1)
    pw1 = np.logaddexp(pe1, pw2) - LN2
    z0, z1 = n0.sum(0), n1.sum(0)
    pe0 = kt(z0, z1)
    pw0 = np.logaddexp(pe0, pw1.sum(0)) - LN2
    stop0, stop1 = np.minimum(np.exp(pe0 - LN2 - pw0), 1), np.minimum(np.exp(pe1 - LN2 - pw1), 1)
    own0 = np.stack([z0 + 0.5, z1 + 0.5], -1) / (z0 + z1 + 1)[:, None]
    own1 = np.stack([n0 + 0.5, n1 + 0.5], -1) / (n0 + n1 + 1)[..., None]
    fixed = (stop0[:, None] * own0)[None] + ((1 - stop0)[None] * stop1)[..., None] * own1
    return fixed, (1 - stop0)[None] * (1 - stop1)


def string_logs(suffix: int, rems: np.ndarray, counts: np.ndarray, depth: int, fixed: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of the mixture's probability of the last byte of each string."""
    node, bit, levels = subtree(rems, counts, depth)
    p = levels[-1].own(bit)
    for level in levels[-2::-1]:
        stop = level.stop()[level.at]
        p = stop * level.own(bit) + (1 - stop) * p
    b1 = suffix & 0xFF
    p = fixed[b1, node, bit] + rest[b1, node] * p
    return np.log10(p).reshape(-1, 8).sum(1)


class HashIndex:
    """Positions of distinct 64-bit keys: an open-addressed table that numpy asks for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = keys
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.table[slot[left]] < 0]
            self.table[slot[free]] = free
            left = left[self.table[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys that are all there."""
        slot = self._slot(keys)
        out = self.table[slot]
        wrong = np.flatnonzero(self.keys[out] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.table) - 1)
            out[wrong] = self.table[slot[wrong]]
            wrong = wrong[self.keys[out[wrong]] != keys[wrong]]
        return out


class Texts:
    """The documents of one block as words and as modelled bytes."""

    def __init__(self, row, depth: int):
        self.words = unpack_words(row["words"], row["word_lens"])
        self.tokens = np.frombuffer(row["tokens"], np.uint32)
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        self.depth = depth
        self.train = np.array([held_out(i) is False for i in self.doc_ids.tolist()], bool)

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all strings of depth + 1 bytes in page order, and how many each document has."""
        word_at = np.array([*self.words, b""], object)[:-1]
        ends = np.cumsum(self.lens).tolist()
        texts = [SPACE.join(word_at[self.tokens[e - n : e]].tolist()) for e, n in zip(ends, self.lens.tolist(), strict=True)]
        pad = END * self.depth
        flat = np.frombuffer(b"".join(pad + t + END for t in texts), np.uint8)
        n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(n + self.depth) - (n + self.depth)
        code = flat[: len(flat) - self.depth].astype(np.uint64) if len(flat) else np.empty(0, np.uint64)
        for k in range(1, self.depth + 1):
            code = (code << np.uint64(8)) | flat[k : len(flat) - self.depth + k]
        real = np.ones(len(code), bool)
        for k in range(self.depth):  # strings that end in the padding of the next document
            real[(starts[1:] - self.depth + k)] = False
        return code[real], n


def held_out(doc_id: int) -> bool:
    """The contract's split: the checksum of the id's decimal text is a multiple of ten."""
    return zlib.crc32((b"" if doc_id == -(2**63) else str(doc_id).encode())) % 10 == 0


def _split_code(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(two nearest context bytes, rest of the context with the byte itself lowest)."""
    suffix = ((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int32)
    # Reverse the longer bytes, so that the nearest is the lowest and its prefixes are masks.
    rem = code & np.uint64(0xFF)
    for k in range(depth - 2):
        rem |= ((code >> np.uint64(8 * (3 + k))) & np.uint64(0xFF)) << np.uint64(8 * (k + 1))
    return suffix, rem


def _join_code(suffix: np.ndarray, rem: np.ndarray, depth: int) -> np.ndarray:
    code = (rem & np.uint64(0xFF)) | (suffix.astype(np.uint64) << np.uint64(8))
    for k in range(depth - 2):
        code |= ((rem >> np.uint64(8 * (k + 1))) & np.uint64(0xFF)) << np.uint64(8 * (3 + k))
    return code


def _fold(asked: DataFrame, n_blocks: int) -> DataFrame:
    """One row (suffix, rems, counts) a subtree, from rows of blocks, FOLD rows of one subtree at a time."""

    def add(pdf: pd.DataFrame, **keys) -> pd.DataFrame:
        rems = np.concatenate([np.frombuffer(r, np.uint64) for r in pdf["rems"]])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in pdf["counts"]])
        seen, at = np.unique(rems, return_inverse=True)
        return pd.DataFrame({**keys, "rems": [seen.tobytes()], "counts": [np.bincount(at, counts, len(seen)).astype(np.int64).tobytes()]})

    folded = asked.select("suffix", F.col("nth").alias("salt"), "rems", "counts")
    groups = n_blocks
    while groups > FOLD:
        groups = -(-groups // FOLD)
        salted = folded.withColumn("salt", F.pmod("salt", F.lit(groups)))
        folded = salted.groupBy("suffix", "salt").applyInPandas(lambda key, pdf: add(pdf, suffix=int(key[0]), salt=int(key[1])), "suffix int, salt long, rems binary, counts binary")
    return folded.groupBy("suffix").applyInPandas(lambda key, pdf: add(pdf, suffix=int(key[0])), "suffix int, rems binary, counts binary")


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits_per_byte) of every row.

    The model learns from rows whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id reads as an empty text)
    and scores every row.  Null and empty texts have the end alone.  ``base_score`` is the add-0.1 unigram model's
    log10 probability of the tokens, ``score`` the context tree's of the same tokens.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7 bytes")
    blocks = token_blocks(docs, lower=True, block_bytes=block_bytes)
    known = blocks.agg(F.sum("n_tokens").alias("n"), F.count("*").alias("blocks")).collect()[0]
    parts = parts_for(known["n"] or 0, 4 * WORDS_PER_PART)

    def ask_strings(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row, depth)
                code, n = texts.strings()
                train = np.repeat(texts.train, n)
                seen, counts = np.unique((code << np.uint64(1)) | train, return_counts=True)
                learned = np.where(seen & np.uint64(1) == 1, counts, 0)
                code = seen >> np.uint64(1)
                first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
                learned, code = np.add.reduceat(learned, first) if len(first) else learned, code[first]
                suffix, rem = _split_code(code, depth)
                order = np.lexsort((rem, suffix))
                suffix, rem, learned = suffix[order], rem[order], learned[order].astype(np.int64)
                edges = np.append(np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1])), len(suffix)) if len(suffix) else np.zeros(1, np.int64)
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict(
                    {
                        "suffix": pa.array(suffix[edges[:-1]], pa.int32()),
                        "block_id": pa.array([row["block_id"]] * len(spans), pa.int64()),
                        "nth": pa.array([int(mix(np.array([row["block_id"]], np.uint64))[0] >> np.uint64(1))] * len(spans), pa.int64()),
                        "rems": pa.array([rem[a:b].tobytes() for a, b in spans], pa.binary()),
                        "counts": pa.array([learned[a:b].tobytes() for a, b in spans], pa.binary()),
                    }
                )

    asked = stored(blocks.mapInArrow(ask_strings, "suffix int, block_id long, nth long, rems binary, counts binary"), "asked-strings")
    counts = stored(_fold(asked, known["blocks"]), "string-counts")

    def sums(batches):
        for pdf in batches:
            for suffix, rems, learned in zip(pdf["suffix"], pdf["rems"], pdf["counts"], strict=True):
                _, _, levels = subtree(np.frombuffer(rems, np.uint64), np.frombuffer(learned, np.int64), depth)
                own = levels[0]
                yield pd.DataFrame({"b1": int(suffix) & 0xFF, "node": own.keys & 0xFF, "n0": own.n0, "n1": own.n1, "pw": own.pw})

    upper = counts.mapInPandas(sums, "b1 int, node int, n0 double, n1 double, pw double").groupBy("b1", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("pw"))
    tables = docs.sparkSession.sparkContext.broadcast(top_tables(upper.toPandas()))  # 256 x 255 rows at most

    def weigh(batches):
        fixed, rest = tables.value
        for pdf in batches:
            for suffix, rems, learned in zip(pdf["suffix"], pdf["rems"], pdf["counts"], strict=True):
                logs = string_logs(int(suffix), np.frombuffer(rems, np.uint64), np.frombuffer(learned, np.int64), depth, fixed, rest)
                yield pd.DataFrame({"suffix": [int(suffix)], "model_rems": [rems], "logs": [logs.tobytes()]})

    model = stored(counts.mapInPandas(weigh, "suffix int, model_rems binary, logs binary"), "string-logs")

    def answer(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        all_rems, logs = np.frombuffer(known["model_rems"].iloc[0], np.uint64), np.frombuffer(known["logs"].iloc[0])
        out = [logs[np.searchsorted(all_rems, np.frombuffer(rems, np.uint64))].tobytes() for rems in pdf["rems"]]
        return pd.DataFrame({"block_id": pdf["block_id"], "kind": 1, "part": int(key[0]), "keys": pdf["rems"], "got": out, "n": 0, "v": 0})

    reply_schema = "block_id long, kind int, part int, keys binary, got binary, n long, v long"
    # A subtree's blocks are answered ANSWER at a time, each time from one copy of its model.
    groups = -(-max(known["blocks"], 1) // ANSWER)
    by = asked.select("suffix", F.pmod("nth", F.lit(groups)).alias("salt"), "block_id", "rems").groupBy("suffix", "salt")
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    string_replies = by.cogroup(copies.groupBy("suffix", "salt")).applyInPandas(answer, reply_schema)

    def ask_words(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row, depth)
                learned = np.bincount(texts.tokens[np.repeat(texts.train, texts.lens)], minlength=len(texts.words))
                part = np.array([zlib.crc32(w) % parts for w in texts.words], np.int64)
                by = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[by], np.arange(parts + 1))
                for p in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                    some = by[bounds[p] : bounds[p + 1]]
                    words = b"\n".join(texts.words[i] for i in some.tolist())
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "block_id": [row["block_id"]], "words": [words], "counts": [learned[some].astype(np.int64).tobytes()]})

    def meet_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [w.split(b"\n") for w in pdf["words"]]
        index, names = pd.factorize(np.array([w for ws in lists for w in ws], object))
        total = np.bincount(index, np.concatenate([np.frombuffer(c, np.int64) for c in pdf["counts"]]), len(names)).astype(np.int64)
        n, v = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(ws) for ws in lists])
        got = [total[index[e - len(ws) : e]].tobytes() for e, ws in zip(ends, lists, strict=True)]
        return pd.DataFrame({"block_id": pdf["block_id"], "kind": 2, "part": int(key[0]), "keys": b"", "got": got, "n": n, "v": v})

    words = blocks.mapInArrow(ask_words, "part int, block_id long, words binary, counts binary")
    word_replies = stored(words.groupBy("part").applyInPandas(meet_words, reply_schema), "word-counts")
    sizes = word_replies.groupBy("part").agg(F.max("n").alias("n"), F.max("v").alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()[0]
    n_train = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0).count()
    n_all, v_all = (sizes["n"] or 0) + n_train, (sizes["v"] or 0) + (n_train > 0)

    def finish(key: tuple, block_pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        out = [_score_block(Texts(row, depth), reply, parts, n_train, n_all, v_all) for row in block_pdf.to_dict("records")]
        return pd.concat(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    replies = string_replies.unionByName(word_replies)
    return blocks.groupBy("block_id").cogroup(replies.groupBy("block_id")).applyInPandas(finish, schema)


def _score_block(texts: Texts, reply: pd.DataFrame, parts: int, n_train: int, n_all: int, v_all: int) -> pd.DataFrame:
    strings = reply[reply["kind"] == 1]
    rems = [np.frombuffer(k, np.uint64) for k in strings["keys"]]
    suffix = np.repeat(strings["part"].to_numpy(np.int64), [len(r) for r in rems])
    keys = _join_code(suffix, np.concatenate(rems), texts.depth)
    logs = np.concatenate([np.frombuffer(g) for g in strings["got"]])
    code, n = texts.strings()
    per = logs[HashIndex(keys).find(code)]
    score_ = np.add.reduceat(per, np.cumsum(n) - n)

    counts = np.zeros(len(texts.words), np.int64)
    part = np.array([zlib.crc32(w) % parts for w in texts.words], np.int64)
    by = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[by], np.arange(parts + 1))
    found = reply[reply["kind"] == 2]
    for p, got in zip(found["part"], found["got"], strict=True):
        counts[by[bounds[p] : bounds[p + 1]]] = np.frombuffer(got, np.int64)
    weight = n_all + 0.1 * (v_all + 1)
    base = np.log10((counts + 0.1) / weight)
    doc = np.repeat(np.arange(len(texts.lens)), texts.lens)
    base_score = np.bincount(doc, base[texts.tokens], len(texts.lens)) + np.log10((n_train + 0.1) / weight)
    n_known = np.bincount(doc, (counts > 0)[texts.tokens], len(texts.lens)).astype(np.int64) + int(n_train > 0)
    ids = pd.array([None if i == -(2**63) else i for i in texts.doc_ids.tolist()], "Int64")
    return pd.DataFrame(
        {
            "doc_id": ids,
            "held_out": ~texts.train,
            "n_tokens": texts.lens + 1,
            "n_known": n_known,
            "train_tokens": n_all,
            "base_score": base_score,
            "score": score_,
            "bits_per_byte": -score_ / np.log10(2) / n,
        }
    )
