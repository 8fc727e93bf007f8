"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of outer punctuation; numbers, names and units become typed placeholders
whose values are kept as slots.  Windows of the resulting templates, and of the plain words, are hash-joined
between documents and benchmark items.  Template windows of a run count only if their slots are consistent: one
value of the item always stands where one value of the document stands, so re-parameterised copies are caught
and chance meetings of placeholders are not.  Windows of equal plain words always count.
"""

from __future__ import annotations

import functools
import itertools
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, checkpointed, chunks, give_back, mix, ragged, small_batches, stored

WINDOW, SIMILARITY = 5, 0.8
#: Plain words that the template of a text shorter than a window needs, so that placeholders alone match nothing.
LEAST_PLAIN = 3
#: Bits of the filter of benchmark windows and words that documents are held against before the join: 8 MB, whatever the benchmark.
FILTER_BITS, FILTER_CHUNK = 26, 15
BATCH_BYTES = 1 << 20

NUMBER = re.compile(r"[+-]?\d+(?:[.,:/-]\d+)*(?:st|nd|rd|th)?")
NUMBER_UNIT = re.compile(r"(\d+(?:[.,]\d+)*)([^\W\d_]+)")
NUMBER_WORDS = set(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
)
UNITS = set(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees kmh mph watt watts volt volts amp amps hz joule joules meter meters metre metres kilometer kilometers kilometre kilometres".split()
)
SENTENCE_END = frozenset(".!?:")
PLAIN, NUM, UNIT, TITLE = 0, 1, 2, 3
#: Kinds of the words of letters that are listed.
LISTED = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBER_WORDS, NUM)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 5)


def _tokens(word: str) -> tuple[tuple[str, int, bool], ...]:
    """(lower-cased word, kind, ends a sentence) of the tokens in a raw word: none, one, or a number and its unit."""
    bare = word.strip(string.punctuation)
    if bare.isalpha():  # most words: letters, and marks around them
        ends = not word.endswith(bare) and not SENTENCE_END.isdisjoint(word[word.rfind(bare) + len(bare) :])
        plain = bare.lower()
        kind = LISTED.get(plain, PLAIN)
        if kind == PLAIN and plain != bare and bare.istitle() and len(bare) > 1 and bare[1:].islower():
            kind = TITLE
        return ((plain, kind, ends),)
    if bare and not (bare[0].isalnum() and bare[-1].isalnum()):
        kept = [i for i, c in enumerate(bare) if c.isalnum()]
        bare = bare[kept[0] : kept[-1] + 1] if kept else ""
    if not bare:
        return ()
    ends = not SENTENCE_END.isdisjoint(word[word.rfind(bare) + len(bare) :])
    plain = bare.lower()
    kind = PLAIN
    if not bare.isalpha() and NUMBER.fullmatch(plain) or plain in NUMBER_WORDS:
        kind = NUM
    elif not bare.isalpha() and (both := NUMBER_UNIT.fullmatch(plain)) and both[2] in UNITS:
        return ((both[1], NUM, False), (both[2], UNIT, ends))
    elif plain in UNITS:
        kind = UNIT
    elif bare.istitle() and len(bare) > 1 and bare[1:].islower():
        kind = TITLE
    return ((plain, kind, ends),)


@functools.lru_cache(maxsize=100_000)
def _describe(word: str) -> tuple[tuple[int, int, bool], ...]:
    """The tokens of a raw word, each with its hash instead of the word."""
    return tuple((_hash(plain), kind, ends) for plain, kind, ends in _tokens(word))


#: What a character is; each code point is looked up when it first occurs.
SPACE, LETTER, CAPITAL, MARK, STOP, OTHER, UNSEEN = 1, 2, 4, 8, 16, 32, 64
CHARACTERS = np.full(0x110000, UNSEEN, np.uint8)


def _character(c: str) -> int:
    if c.isspace():
        return SPACE
    if c.isalpha():
        return LETTER if c.islower() and c.lower() == c else CAPITAL
    return (MARK | STOP if c in SENTENCE_END else MARK) if c in string.punctuation else OTHER


def _cut(text: str) -> tuple[np.ndarray, ...]:
    """(begin, end, what, raw, letters) of the words of ``text.split()``, found in the array of its characters.

    ``what`` joins the flags of a word's characters; without OTHER the word is letters and marks after them, or either alone;
    letters other than lower-cased ones are CAPITAL.  ``raw`` is a hash of the word, ``letters`` one of its lower-cased letters,
    the same as ``raw`` of a word of these alone.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    what = CHARACTERS[points]
    if (what == UNSEEN).any():
        new = np.unique(points[what == UNSEEN])
        CHARACTERS[new] = [_character(chr(c)) for c in new.tolist()]
        what = CHARACTERS[points]
    solid = np.zeros(len(points) + 2, bool)
    solid[1:-1] = what != SPACE
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return begin, end, what[:0], np.empty(0, np.uint64), np.empty(0, np.uint64)
    letter = what == LETTER
    what[1:][(what[1:] & (LETTER | CAPITAL) > 0) & (what[:-1] & MARK > 0)] |= OTHER  # marks before letters
    place = np.arange(len(points))
    place[begin[0] :] -= np.repeat(begin, np.diff(begin, append=len(points)))
    part = mix(points.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
    part[~solid[1:-1]] = 0
    raw = np.add.reduceat(part, begin)
    part[~letter] = 0
    return begin, end, np.bitwise_or.reduceat(what, begin) & ~np.uint8(SPACE), mix(raw), mix(np.add.reduceat(part, begin))


def windows(texts: list[str], size: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text index, position, hash, slots) of all plain and template windows; a shorter text is one window.

    A capitalised word that opens a sentence is read both as a word and as a name, in all combinations.  With
    ``bits``, only windows whose hash is in that bitmap, as are the hashes of the words that items hold and of the listed
    ones: no window is put together over any other lower-cased word.

    ``slots`` has a row of ``size`` value hashes, 0 where the word is plain.
    """
    text = "\n".join(texts)
    begin, end, what, raw, letters = _cut(text)
    upto = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # words before each text, and all
    idle = (what & (LETTER | CAPITAL | OTHER) == LETTER) & ~_sifted(letters, bits)  # one plain word that no item holds
    idle |= _between(idle, upto, what, size)
    _, at, number = np.unique(raw[~idle], return_index=True, return_inverse=True)
    vocab = [text[i:j] for i, j in zip(begin[~idle][at].tolist(), end[~idle][at].tolist())]
    # Lower-cased words of letters, most of all, make numbers only: a tuple for each would keep the collector busy.
    easy = np.array([w.islower() and w.isalpha() for w in vocab], bool)
    plainly, others = list(itertools.compress(vocab, easy.tolist())), list(map(_describe, itertools.compress(vocab, (~easy).tolist())))
    counts = np.ones(len(vocab) + 2, np.int64)  # the last two are idle words, the second of them at the end of a sentence
    counts[:-2][~easy] = np.fromiter(map(len, others), np.int64, len(others))
    one, tokens = np.repeat(np.append(easy, [False, False]), counts), [*itertools.chain.from_iterable(others), (0, PLAIN, False), (0, PLAIN, True)]
    value, kind, ends = np.empty(len(one), np.uint64), np.empty(len(one), np.int8), np.zeros(len(one), bool)
    value[one], kind[one] = np.fromiter(map(_hash, plainly), np.uint64, len(plainly)), [LISTED.get(w, PLAIN) for w in plainly]
    value[~one], kind[~one], ends[~one] = np.array([t[0] for t in tokens], np.uint64), [t[1] for t in tokens], [t[2] for t in tokens]
    starts = np.cumsum(counts) - counts
    flat = len(vocab) + (what & STOP > 0)
    flat[~idle] = number
    per = counts[flat]
    index = ragged(starts[flat], per)
    n = len(index)
    stop = np.append(0, np.cumsum(per))[upto]
    first, lens = stop[:-1], np.diff(stop)
    live = index < len(one) - 2
    whole = np.ones(n, bool)
    for k in range(1, size):
        whole[stop[1:][lens >= k] - k] = False
    begins = [(begin[_within(live, begin, k) == k], k) for begin, k in ((np.flatnonzero(whole), size), *((first[lens == k], k) for k in range(1, size)))]
    plain, value, kind, ends = mix(value)[index], value[index], kind[index], ends[index]
    opens, after_number = np.ones(n, bool), np.zeros(n, bool)
    opens[1:], after_number[1:] = ends[:-1], kind[:-1] == NUM
    opens[first[lens > 0]], after_number[first[lens > 0]] = True, False
    slot = (kind == NUM) | ((kind == UNIT) & after_number) | ((kind == TITLE) & ~opens)
    either = (kind == TITLE) & opens  # a name or any word: windows are made with both readings
    typed = kind.astype(np.uint64) + np.uint64(1)
    out = []

    def put(begin: np.ndarray, length: int, h: np.ndarray, slots: np.ndarray | None):
        keep = _sifted(h, bits)
        begin, h = begin[keep], h[keep]
        values = np.zeros((len(begin), size), np.uint64)
        if slots is not None:
            at = begin[:, None] + np.arange(length)
            values[:, :length] = np.where(slots[at] if slots.ndim == 1 else slots[keep], value[at], 0)
        owner = np.searchsorted(stop[1:], begin, "right")
        out.append((owner, begin - first[owner], h, values))

    for begin, length in begins:
        if not len(begin):
            continue
        put(begin, length, _roll(plain, begin, length, 2 * length), None)
        least = LEAST_PLAIN if length < size else 0
        sure, names = _within(slot, begin, length), _within(either, begin, length)
        some = begin[(sure > 0) & (length - sure >= min(least, length))]
        put(some, length, _roll(np.where(slot, typed, plain), some, length, 2 * length + 1), slot)
        some = begin[(names > 0) & (length - sure - names >= min(least, length))]
        put(some, length, _roll(np.where(slot | either, typed, plain), some, length, 2 * length + 1), slot | either)
        for count in range(2, int(names.max()) + 1):
            some = begin[(names == count) & (length - sure >= min(least, length))]
            at = some[:, None] + np.arange(length)
            rank = np.cumsum(either[at], axis=1) - 1
            for mask in range(1, (1 << count) - 1):
                marked = slot[at] | (either[at] & (mask >> np.maximum(rank, 0) & 1 == 1))
                fits = length - marked.sum(axis=1) >= min(least, length)
                words = np.where(marked, typed[at], plain[at])[fits]
                put(some[fits], length, _mixed(words.T, int(fits.sum()), 2 * length + 1), marked[fits])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, size), np.uint64)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _between(idle: np.ndarray, upto: np.ndarray, what: np.ndarray, size: int) -> np.ndarray:
    """Words of letters among too few that are not idle for a window: one token each, in no window, unless all of a short text."""
    opens = idle.copy()
    opens[upto[:-1][np.diff(upto) > 0]] = True
    run = np.cumsum(opens)
    other = what & OTHER > 0  # up to two tokens
    few = (np.bincount(run, ~idle) + np.bincount(run, other) < size)[run]
    busy = np.append(0, np.cumsum(~idle))[upto]
    full = np.repeat(np.diff(busy) == np.diff(upto), np.diff(upto))
    return few & ~full & ~other & (what & (LETTER | CAPITAL) > 0)


def _within(flags: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """How many of the ``length`` flags from each begin are set."""
    upto = np.append(0, np.cumsum(flags, dtype=np.int32))
    return upto[begin + length] - upto[begin]


def _roll(words: np.ndarray, begin: np.ndarray, length: int, seed: int) -> np.ndarray:
    every = len(words) - length + 1
    if 2 * len(begin) > every:  # slices of all positions are faster than most of them one by one
        return _mixed((words[k : k + every] for k in range(length)), every, seed)[begin]
    return _mixed((words[begin + k] for k in range(length)), len(begin), seed)


def _mixed(columns, count: int, seed: int) -> np.ndarray:
    h = np.full(count, seed, np.uint64)
    for column in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + column
        h ^= h >> np.uint64(29)
    return mix(h)


def _sifted(h: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.ones(len(h), bool)
    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


HIT_SCHEMA = "id long, pos int, h long, slots array<long>"


def _window_rows(df: DataFrame, size: int, sieve=None) -> DataFrame:
    """(id, pos, h, slots) rows of a two-column table (id, text); with a sieve, only windows it may hold."""

    def run(batches):
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            texts = [(t or b"").decode() for t in binary_column(batch.column(1))]
            rows = list(zip(batch.column(0).to_pylist(), texts, strict=True))
            for chunk in chunks(rows, map(len, texts), BATCH_BYTES):
                owner, pos, h, slots = windows([t for _, t in chunk], size, bits)
                ids = np.array([i for i, _ in chunk], np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, slots.size + 1, size), pa.int32()), pa.array(slots.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), values], names=["id", "pos", "h", "slots"])
        _describe.cache_clear()
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, HIT_SCHEMA)


def held_words(texts: list[str]) -> np.ndarray:
    """Hashes, as ``_cut`` makes them, of the words that windows of these texts hold, and of the listed words."""
    held = {plain for text in texts for word in set(text.split()) for plain, _, _ in _tokens(word)}
    return _cut("\n".join(held.union(LISTED)))[3]


def _word_rows(items: DataFrame) -> DataFrame:
    """The hashes of ``held_words`` as rows, of all texts of a two-column table (id, text)."""

    def run(batches):
        for batch in batches:
            texts = [(t or b"").decode() for t in binary_column(batch.column(1))]
            for chunk in chunks(texts, map(len, texts), BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(held_words(chunk).view(np.int64))], names=["h"])
        give_back()

    small_batches(items.sparkSession)
    return items.mapInArrow(run, "h long")


def _sieve(hashes: DataFrame) -> bytes:
    """A bitmap of the leading bits of all hashes of windows and words: 2**FILTER_BITS bits, in chunks, whatever the benchmark."""
    at = F.expr(f"shiftrightunsigned(h, {64 - FILTER_BITS})")
    bits = hashes.select(at.alias("at")).distinct().select((F.col("at") % (1 << FILTER_CHUNK)).alias("bit"), F.shiftright("at", FILTER_CHUNK).alias("chunk"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << FILTER_CHUNK, np.uint8)
        flags[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    size = (1 << FILTER_CHUNK) // 8
    out = bytearray((1 << FILTER_BITS) // 8)
    for r in bits.groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = r["bits"]
    return bytes(out)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, n_reworded, similarity): pairs of a document and an item it holds.

    ``similarity`` is the share of the item's window positions found in the document by plain words, or by templates
    without a slot value that the run contradicts; ``n_reworded`` of them were found by template only.  An item of fewer words than a window matches only a
    document that consists of its words.  Null and empty texts, and rows without an id, match nothing; rows that
    repeat an id count as one document or item.
    """
    items = benchmark.where("item_id is not null and text is not null").selectExpr("cast(item_id as long) id", "text").distinct()
    theirs = checkpointed(_window_rows(items, size))
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(theirs.select("h").unionByName(_word_rows(items))))
    ours = checkpointed(_window_rows(docs.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as long) id", "text"), size, sieve))
    totals = theirs.groupBy("id").agg(F.countDistinct("pos").alias("n_windows")).withColumnRenamed("id", "item_id")
    blank = F.forall("slots", lambda s: s != 0)
    a = ours.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "h", F.col("slots").alias("doc_slots"), blank.alias("blank"))
    b = theirs.select(F.col("id").alias("item_id"), "pos", "h", "slots", blank.alias("blank"))
    columns = ["doc_id", "item_id", "pos", (F.col("doc_pos") - F.col("pos")).alias("shift"), "slots", "doc_slots"]
    worded = checkpointed(a.where("not blank").drop("blank").join(b.where("not blank").drop("blank"), "h").select(*columns))
    # Windows of placeholders alone would meet every row of numbers: they count in runs that other windows have found.
    known = worded.select("doc_id", "item_id", "shift").distinct().join(b.where("blank"), "item_id").withColumn("doc_pos", F.col("pos") + F.col("shift"))
    blanks = known.select("doc_id", "item_id", "doc_pos", "pos", "h", "slots").join(a.where("blank").drop("blank"), ["doc_id", "doc_pos", "h"]).select(*columns)
    hits = checkpointed(worded.unionByName(blanks))
    run = ["doc_id", "item_id", "shift"]
    pairs = hits.where(F.exists("slots", lambda s: s != 0)).select(*run, F.explode(F.arrays_zip("slots", "doc_slots")).alias("z"))
    values = pairs.where("z.slots <> 0").groupBy(*run, "z.slots").agg(F.min("z.doc_slots").alias("lo"), F.max("z.doc_slots").alias("hi")).where("lo <> hi")
    torn = values.groupBy(*run).agg(F.collect_set("slots").alias("torn"))  # values of one item at most
    sound = hits.join(torn, run, "left").where("torn is null or not arrays_overlap(slots, torn)")
    by_word = F.when(~F.exists("slots", lambda s: s != 0), F.col("pos"))
    found = sound.groupBy("doc_id", "item_id").agg(F.countDistinct("pos").alias("n_matched"), F.countDistinct(by_word).alias("n_plain"))
    rated = found.join(totals, "item_id").withColumn("similarity", F.col("n_matched") / F.col("n_windows"))
    return rated.where(F.col("similarity") >= similarity).select("doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") - F.col("n_plain")).alias("n_reworded"), "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns as they are.

    The ids that go are written first, so the planner knows their size when it joins them.
    """
    found = stored(contamination(docs, benchmark, size, similarity).select("doc_id").distinct(), "contaminated")
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id") == F.col("f.doc_id"), "left_anti")
