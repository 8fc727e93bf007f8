"""BPE encoding and decoding with a contiguous rank array.

Each distinct pre-token ("short word") is a row of part ids with the ranks of its adjacent pairs beside it.
The row is scanned for its smallest rank, the boundary there is deleted, and only the two neighbouring ranks
are looked up again, until no pair has a rank.  All distinct words of a batch are rows of one matrix, so a
scan is one ``argmin`` over the matrix.  Words beyond ``SHORT_WORD`` bytes, where repeated scans would cost the
square of the length, use a heap over the same boundaries and ranks.

Null text encodes as the empty text.  The vocabulary file is read from its path on each executor; it is never
trained or copied.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Numbering, binary_column, chunks, give_back, ragged, small_batches

#: The byte-level pre-tokenisation pattern of the vocabulary's public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT_WORD = 64
#: Distinct words that a task remembers between batches before it starts anew.
MEMORY = 150_000
NO_RANK = np.int64(2**62)

ENCODED_SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in kept}
    moved = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(moved)}


class Codec:
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.piece = [b""] * size
        for text, i in vocab.items():
            self.piece[i] = bytes(back[c] for c in text)
        for text, i in self.special.items():
            self.piece[i] = text.encode()
        self.piece_len = np.fromiter(map(len, self.piece), np.int64, size)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(self.piece), np.uint8)
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys, values = [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            keys.append((vocab[left] << 32) | vocab[right])
            values.append((rank << 32) | vocab[left + right])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**63 - 1))
        self.values = np.append(np.array(values, np.int64)[order], NO_RANK)
        self.pair = dict(zip(keys, values, strict=True))
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.memory: dict[str, np.ndarray] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(rank << 32 | merged id) of each pair, NO_RANK where the pair never merges."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def encode_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Rank arrays of equally long-ish words, one matrix row each."""
        n, width = len(words), max(map(len, words))
        lens = np.fromiter(map(len, words), np.int64, n)
        parts = np.zeros((n, width), np.int64)
        inside = np.arange(width) < lens[:, None]
        parts[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width), NO_RANK, np.int64)
        if width > 1:
            pairs = inside[:, 1:]
            rank[:, :-1][pairs] = self.ranks(parts[:, :-1][pairs], parts[:, 1:][pairs])
        out: list[np.ndarray] = [np.empty(0, np.int64)] * n
        live = np.arange(n)
        while len(live):
            best = rank.argmin(axis=1)
            rows = np.arange(len(live))
            low = rank[rows, best]
            done = low == NO_RANK
            for r in np.flatnonzero(done):
                out[live[r]] = parts[r, : lens[r]].astype(np.uint32)
            go = ~done
            parts, rank, live, lens, best, low = parts[go], rank[go], live[go], lens[go], best[go], low[go]
            if not len(live):
                break
            rows, column = np.arange(len(live)), np.arange(parts.shape[1])
            take = np.minimum(column + (column > best[:, None]), parts.shape[1] - 1)  # deletes the boundary after `best`
            parts, rank = np.take_along_axis(parts, take, 1), np.take_along_axis(rank, take, 1)
            rank[:, -1] = NO_RANK
            lens -= 1
            parts[rows, best] = low & 0xFFFFFFFF
            rank[rows, best] = NO_RANK
            has = best + 1 < lens
            rank[rows[has], best[has]] = self.ranks(parts[rows[has], best[has]], parts[rows[has], best[has] + 1])
            has = best > 0
            rank[rows[has], best[has] - 1] = self.ranks(parts[rows[has], best[has] - 1], parts[rows[has], best[has]])
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges for a long word, with a heap instead of scans."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []
        for i in range(n - 1):
            if (v := self.pair.get((ids[i] << 32) | ids[i + 1])) is not None:
                heap.append((v >> 32, i, ids[i], ids[i + 1], v & 0xFFFFFFFF))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) >= 0 and (v := self.pair.get((ids[a] << 32) | ids[b])) is not None:
                    heapq.heappush(heap, (v >> 32, a, ids[a], ids[b], v & 0xFFFFFFFF))
        return np.array([i for i in ids if i >= 0], np.uint32)

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't remembered."""
        if len(self.memory) + len(words) > MEMORY:
            self.memory.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if len(raw) > SHORT_WORD:
                self.memory[word] = self.encode_long(raw)
            else:
                by_width.setdefault((len(raw) + 3) // 4, []).append((word, raw))
        for group in by_width.values():
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                self.memory.update(zip((w for w, _ in some), self.encode_short([r for _, r in some]), strict=True))

    def pre_tokens(self, text: str) -> list[str]:
        if self.special_split is None or not any(s in text for s in self.special):
            return self.split(text)
        out = []
        for piece in self.special_split(text):
            out += [piece] if piece in self.special else self.split(piece)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        numbers = Numbering()
        coded = []
        for text in texts:
            tokens = self.pre_tokens(text)
            coded.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        distinct = list(numbers)
        if missing := [w for w in distinct if w not in self.memory and w not in self.special]:
            if len(self.memory) + len(missing) > MEMORY:
                self.memory.clear()
                missing = [w for w in distinct if w not in self.special]
            self.learn(missing)
        special, memory = self.special, self.memory
        arrays = [np.array([special[w]], np.uint32) if w in special else memory[w] for w in distinct]
        flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint32)
        lens = np.fromiter(map(len, arrays), np.int64, len(arrays))
        starts = np.cumsum(lens) - lens
        return [flat[ragged(starts[c], lens[c])] if len(c) else np.empty(0, np.uint32) for c in coded]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the pieces joined, malformed UTF-8 replaced; special tokens stay."""
        return self.piece_bytes[ragged(self.piece_at[ids], self.piece_len[ids])].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text of every row of ``docs``.

    Rows stay where they were read: there is no shuffle.  Null text is the empty text; repeated rows give
    repeated rows; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches):
        tool = codec(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").decode() for t in binary_column(batch.column(1))]
            rows = list(zip(ids, texts, strict=True))
            for chunk in chunks(rows, map(len, texts), batch_bytes):
                coded = tool.encode_batch([t for _, t in chunk])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in chunk], pa.int64()),
                        pa.array(list(map(len, coded)), pa.int64()),
                        pa.array([c.astype("<u4").tobytes() for c in coded], pa.binary()),
                        pa.array([tool.decode(c) for c in coded], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
        tool.memory.clear()
        give_back()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ENCODED_SCHEMA)
