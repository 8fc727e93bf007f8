"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public byte vocabulary.  The score of a word sums
the probabilities of *all* its segmentations into pieces with a forward pass over the word's lattice; a text is
the product of its words.  Piece probabilities are learned by expectation maximisation with the matching
backward pass, in Spark rounds over the word counts of a bounded sample of labelled documents.
"""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, checkpointed, chunks, free_names, give_back, own_columns, small_batches, stored

#: Documents per language that fitting expects to read, rounds of EM, and pseudo-count of every piece.
FIT_DOCS, ROUNDS, PSEUDO = 2_000, 4, 0.01
#: Labels of one table: with the vocabulary this bounds what the driver and a task hold.  More labels make more tables.
TABLE_LABELS = 500
#: Words up to this many bytes are swept together, longer ones one by one; both keep a scale, so sums never vanish.
SHORT_WORD = 48
MEMORY = 100_000
BATCH_BYTES = 1 << 20

#: A word is a letter (Unicode category L) and the letters and marks after it.
words_of = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def trie(path: str) -> tuple[dict[bytes, int], int]:
    """Piece number of every piece, -1 for proper prefixes of pieces; and how many pieces there are."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    nodes: dict[bytes, int] = {}
    for i, piece in enumerate(pieces):
        for end in range(1, len(piece)):
            nodes.setdefault(piece[:end], -1)
        nodes[piece] = i
    return nodes, len(pieces)


class NodeTable:
    """The trie as an open-addressed table of string hashes, so that numpy looks up many substrings at once."""

    BITS, START, PRIME = 19, 0xCBF29CE484222325, 0x100000001B3

    def __init__(self, nodes: dict[bytes, int]):
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.values = np.zeros(1 << self.BITS, np.int32)
        hashes = np.zeros(len(nodes), np.uint64)
        for i, node in enumerate(nodes):
            h = self.START
            for byte in node:
                h = ((h ^ (byte + 1)) * self.PRIME) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        values = np.fromiter(nodes.values(), np.int32, len(nodes))
        left = np.arange(len(nodes))
        slot = self.slots(hashes)
        while len(left):
            free = self.keys[slot[left]] == 0
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = hashes[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) % len(self.keys)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Values of the nodes; -2 where there is none."""
        slot = self.slots(hashes)
        held = self.keys[slot]
        out = np.where(held == hashes, self.values[slot], np.int32(-2))
        on = np.flatnonzero((held != hashes) & (held != 0))
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.keys)
            held = self.keys[slot[on]]
            hit = held == hashes[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (held != 0)]
        return out


@functools.lru_cache(maxsize=2)
def node_table(path: str) -> NodeTable:
    return NodeTable(trie(path)[0])


class Lattice:
    """All arcs (word, start, end, piece) of the segmentations of some words."""

    def __init__(self, words: list[bytes], table: NodeTable):
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.lens.max(initial=0))
        letters = np.zeros((len(words), self.width), np.uint64)
        letters[np.arange(self.width) < self.lens[:, None]] = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        arcs: list[tuple[np.ndarray, int, int, np.ndarray]] = []
        for s in range(self.width):
            w = np.flatnonzero(self.lens > s)
            h = np.full(len(w), NodeTable.START, np.uint64)
            for e in range(s + 1, self.width + 1):
                inside = self.lens[w] >= e
                w, h = w[inside], h[inside]
                h = (h ^ letters[w, e - 1]) * np.uint64(NodeTable.PRIME)
                found = table.find(h)
                on = found > -2
                w, h, found = w[on], h[on], found[on]
                if not len(w):
                    break
                whole = found >= 0
                arcs.append((w[whole], s, e, found[whole]))
        sizes = [len(x[0]) for x in arcs]
        join = lambda k, kind: np.concatenate([x[k] for x in arcs]).astype(kind) if arcs else np.empty(0, kind)
        self.word, self.piece = join(0, np.int64), join(3, np.int64)
        self.start, self.end = (np.repeat(np.array([x[k] for x in arcs], np.int64), sizes) for k in (1, 2))

    def _sweep(self, by: np.ndarray, weights, init: np.ndarray, source: np.ndarray, backward: bool) -> np.ndarray:
        order = np.lexsort((self.word, by))
        bounds = np.searchsorted(by[order], np.arange(self.width + 2))
        steps = range(self.width - 1, -1, -1) if backward else range(1, self.width + 1)
        for at in steps:
            some = order[bounds[at] : bounds[at + 1]]
            if len(some):
                w = self.word[some]
                edge = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                init[w[edge], at] += np.add.reduceat(init[w, source[some]] * weights(some), edge, axis=0)
        return init

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each beginning of a word, in every column of the table."""
        alpha = np.zeros((len(self.lens), self.width + 1, table.shape[1]))
        alpha[:, 0] = 1
        return self._sweep(self.end, lambda some: table[self.piece[some]], alpha, self.start, backward=False)

    def uses(self, table: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Expected uses of each arc in one word, by the one column of the table that is the word's own."""
        weight = table[self.piece, column[self.word]]
        alpha, beta = (np.zeros((len(self.lens), self.width + 1)) for _ in range(2))
        alpha[:, 0] = 1
        beta[np.arange(len(self.lens)), self.lens] = 1
        self._sweep(self.end, lambda some: weight[some], alpha, self.start, backward=False)
        self._sweep(self.start, lambda some: weight[some], beta, self.end, backward=True)
        w = self.word
        return alpha[w, self.start] / alpha[w, self.lens[w]] * weight * beta[w, self.end]


@functools.lru_cache(maxsize=2)
def piece_bytes(path: str) -> np.ndarray:
    """Bytes of each piece; those of pieces longer than a short word count as one more."""
    nodes, n = trie(path)
    lens = np.zeros(n)
    for piece, number in nodes.items():
        if number >= 0:
            lens[number] = min(len(piece), SHORT_WORD + 1)
    return lens


def per_lattice(labels: int, most: int) -> int:
    """Words whose sums are held together: 49 positions of each in ``labels`` doubles take 100 MB at most."""
    return max(1, min(most, 250_000 // labels))


def scaled(table: np.ndarray, path: str) -> tuple[np.ndarray, float]:
    """(table, log scale): probabilities times a scale for each byte of the piece.

    Every segmentation of a word has all its bytes, so sums of ``n`` bytes are too large by n scales exactly.  The scale
    is the inverse root of the smallest probability: sums of short words stay between its powers of 24 and -24.  Doubles
    hold the scale of the longest piece while no probability is below e**-55, and none is: it would take 10**20 words.
    """
    log = -math.log(table.min()) / 2
    return table * np.exp(log * piece_bytes(path))[:, None], log


def long_word(word: bytes, nodes: dict[bytes, int], table: np.ndarray) -> np.ndarray:
    """Log probability of a long word: the forward pass with a running scale at each position."""
    n, langs = len(word), table.shape[1]
    alpha, scale = np.zeros((n + 1, langs)), np.zeros((n + 1, langs))
    alpha[0] = 1
    parts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for s in range(n):
        for e in range(s + 1, n + 1):
            piece = nodes.get(word[s:e])
            if piece is None:
                break
            if piece >= 0:
                parts[e].append((s, piece))
    for e in range(1, n + 1):
        starts = [s for s, _ in parts[e]]
        base = scale[starts].max(axis=0)
        alpha[e] = (alpha[starts] * np.exp(scale[starts] - base) * table[[p for _, p in parts[e]]]).sum(axis=0)
        scale[e] = base + np.log(alpha[e])
        alpha[e] = 1
    return scale[n]


def long_pieces(word: bytes, nodes: dict[bytes, int], table: np.ndarray) -> dict[int, float]:
    """Expected uses of each piece in a long word, for one language: ``table`` has a probability a piece.

    Forward and backward sums are kept as a scale at each position, as in ``long_word``.
    """
    n = len(word)
    arcs: list[tuple[int, int, int]] = []
    for s in range(n):
        for e in range(s + 1, n + 1):
            piece = nodes.get(word[s:e])
            if piece is None:
                break
            if piece >= 0:
                arcs.append((s, e, piece))
    logs = np.log([table[p] for _, _, p in arcs]).tolist()
    ahead, behind = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for (s, e, _), log in zip(arcs, logs, strict=True):
        ahead[s].append((e, log))
        behind[e].append((s, log))

    def total(parts: list[float]) -> float:
        top = max(parts)
        return top + math.log(sum(math.exp(x - top) for x in parts))

    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        alpha[e] = total([alpha[s] + log for s, log in behind[e]])
    for s in range(n - 1, -1, -1):
        beta[s] = total([beta[e] + log for e, log in ahead[s]])
    used: dict[int, float] = {}
    for (s, e, piece), log in zip(arcs, logs, strict=True):
        used[piece] = used.get(piece, 0.0) + math.exp(alpha[s] + log + beta[e] - alpha[n])
    return used


class Scorer:
    """Log probabilities of words in every language, remembered between batches."""

    def __init__(self, table: np.ndarray, path: str):
        self.table, self.path = table, path
        self.swept, self.scale = scaled(table, path)
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, table.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        """One row of log probabilities a word."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known, self.logs, new = {}, self.logs[:0], words
        if new:
            coded = [b" " + w.encode() for w in new]
            logs = np.zeros((len(new), self.table.shape[1]))
            short = [i for i, c in enumerate(coded) if len(c) <= SHORT_WORD]
            short.sort(key=lambda i: len(coded[i]))
            step = per_lattice(self.table.shape[1], 10_000)
            for at in range(0, len(short), step):
                some = short[at : at + step]
                lattice = Lattice([coded[i] for i in some], node_table(self.path))
                alpha = lattice.forward(self.swept)
                logs[some] = np.log(alpha[np.arange(len(some)), lattice.lens]) - self.scale * lattice.lens[:, None]
            for i, c in enumerate(coded):
                if len(c) > SHORT_WORD:
                    logs[i] = long_word(c, trie(self.path)[0], self.table)
            self.known |= {w: len(self.logs) + i for i, w in enumerate(new)}
            self.logs = np.concatenate([self.logs, logs])
        return self.logs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def texts(self, texts: list[str]) -> np.ndarray:
        """One row of log probabilities a text; zeros for a text without letters."""
        number = Numbering()
        coded = []
        for text in texts:
            found = words_of(text.lower())
            coded.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        logs = self.words(list(number))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, c in enumerate(coded):
            if len(c):
                seen, times = np.unique(c, return_counts=True) if len(c) > 2_000 else (c, None)
                out[i] = logs[seen].sum(axis=0) if times is None else times @ logs[seen]
        return out


def in_training(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


#: A table (piece, language) of probabilities with its languages in order.
Table = tuple[list[str], np.ndarray]


def train(docs: DataFrame, vocabulary: str | None = None, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> list[Table]:
    """Tables of probabilities, ``TABLE_LABELS`` languages each, from the labelled rows of ``docs``.

    Fitting reads about ``fit_docs`` documents of each language, chosen by a hash of doc_id and text, whatever the
    size of the input; a language with fewer gives all of them.  All words of those documents count, whatever their
    length.  Rows without a text or a label teach nothing; without any there is no table.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    sizes = [(r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect()]  # a row a language
    sizes.sort()
    path = vocabulary or default_vocabulary()
    return [_train_table(labelled, dict(sizes[at : at + TABLE_LABELS]), path, fit_docs, rounds) for at in range(0, len(sizes), TABLE_LABELS)]


def _train_table(labelled: DataFrame, sizes: dict[str, int], path: str, fit_docs: int, rounds: int) -> Table:
    langs = list(sizes)
    _, n_pieces = trie(path)
    share = labelled.sparkSession.createDataFrame([(k, min(1.0, fit_docs / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")  # a row a language, TABLE_LABELS at most

    def count(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text.lower()))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": pa.array([r[2] for r in rows], pa.int64())})

    words = checkpointed(chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    column = {k: i for i, k in enumerate(langs)}
    table = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    for _ in range(rounds):

        def expect(batches, table=table):
            swept, _ = scaled(table, path)  # the scales of a word cancel in its shares
            for pdf in batches:
                coded = [b" " + w.encode() for w in pdf["word"]]
                lang, n = pdf["lang"].map(column).to_numpy(), pdf["n"].to_numpy(float)
                short = np.array([i for i, c in enumerate(coded) if len(c) <= SHORT_WORD], int)
                for at in range(0, len(short), 5_000):
                    some = short[at : at + 5_000]
                    lattice = Lattice([coded[i] for i in some], node_table(path))
                    use, k, w = lattice.uses(swept, lang[some]), lang[some][lattice.word], lattice.word
                    key = k.astype(np.int64) * n_pieces + lattice.piece
                    seen, at_ = np.unique(key, return_inverse=True)
                    got = np.bincount(at_, use * n[some][w])
                    yield pd.DataFrame({"lang": (seen // n_pieces).astype(np.int32), "piece": (seen % n_pieces).astype(np.int32), "used": got})
                long: dict[tuple[int, int], float] = {}
                for i, c in enumerate(coded):
                    if len(c) > SHORT_WORD:
                        for piece, x in long_pieces(c, trie(path)[0], table[:, lang[i]]).items():
                            long[lang[i], piece] = long.get((lang[i], piece), 0.0) + x * n[i]
                if long:
                    yield pd.DataFrame({"lang": np.array([k for k, _ in long], np.int32), "piece": np.array([p for _, p in long], np.int32), "used": list(long.values())})

        used = words.mapInPandas(expect, "lang int, piece int, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used")).toPandas()  # pieces x labels at most
        fresh = np.full((n_pieces, len(langs)), PSEUDO)
        fresh[used["piece"], used["lang"]] += used["used"]
        table = fresh / fresh.sum(axis=0)
    return langs, table


JUDGED = "lang string, top double, total double"


def _judge(table: Table, path: str, spark):
    """The best language of a text in one table, its log probability, and the sum of all languages' beside it."""
    langs = table[0]
    model = spark.sparkContext.broadcast(table[1])  # pieces x labels, both bounded

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value, path)  # of this task: the worker process outlives it
        for text in batches:
            names, tops, totals = [], [], []
            for chunk in chunks([t or "" for t in text], [len(t or "") for t in text], BATCH_BYTES):
                logs = scorer.texts(chunk)
                best, top = logs.argmax(axis=1), logs.max(axis=1)
                blank = (logs == 0).all(axis=1)
                names += [None if b else langs[i] for i, b in zip(best, blank, strict=True)]
                tops += top.tolist()
                totals += np.exp(logs - top[:, None]).sum(axis=1).tolist()
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "top": tops, "total": totals})
        del scorer
        give_back()

    return F.pandas_udf(classify, JUDGED)


def predict(docs: DataFrame, tables: list[Table], vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (posterior under equal priors), without a shuffle.

    A text that is null or has no letter is ``und`` with score 0, and so is every text when nothing was learned.  Ties
    go to the first language in sorted order.  Columns of ``docs`` are kept as they are: where one has the name of a
    result, the result gets underscores before its own, see ``free_names``.  Beyond the first table, each costs one more
    pass over the texts, written between passes.
    """
    path, spark = vocabulary or default_vocabulary(), docs.sparkSession
    best, more, pred, score = free_names(docs, "lang_best", "lang_more", "lang_pred", "lang_score")
    small_batches(spark)
    out = docs.withColumn(best, F.lit(None).cast("struct<lang: string, top: double, total: double>"))
    for i, table in enumerate(tables):
        judged = _judge(table, path, spark)("text")
        if not i:
            out = docs.withColumn(best, judged)
            continue
        out = stored(out, "judged").withColumn(more, judged)
        a, b = F.col(best), F.col(more)
        top = F.greatest(a["top"], b["top"])
        total = a["total"] * F.exp(a["top"] - top) + b["total"] * F.exp(b["top"] - top)
        out = out.withColumn(best, F.struct(F.when(b["top"] > a["top"], b["lang"]).otherwise(a["lang"]).alias("lang"), top.alias("top"), total.alias("total"))).drop(more)
    lang = F.col(best)["lang"]
    return out.select(*own_columns(docs), F.coalesce(lang, F.lit("und")).alias(pred), F.when(lang.isNull(), 0.0).otherwise(1 / F.col(best)["total"]).alias(score))


def identify(docs: DataFrame, vocabulary: str | None = None, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows whose crc32 remainder is not 2.

    Rows without a doc_id count as training rows.  Ties between languages go to the first in sorted order.
    """
    narrow = docs.select("doc_id", "text", "lang")
    used = F.coalesce(in_training(F.col("doc_id")), F.lit(True))
    tables = train(narrow.where(used), vocabulary, fit_docs)
    out = predict(narrow.select("doc_id", "text"), tables, vocabulary)
    return out.select(F.col("doc_id"), (~F.coalesce(in_training(F.col("doc_id")), F.lit(True))).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
