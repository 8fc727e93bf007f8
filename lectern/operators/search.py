"""Folded tokens, and boolean, phrase, prefix and proximity conditions over a paragraph's token array.

Conditions are columns, combined with ``&``, ``|`` and ``~``, for filters over texts that are at hand; searches over whole
tables go through the stored index (``lexical``).
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _accents() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one character and marks, and what is left without the marks."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0xAC00), *range(0xF900, 0xFFFE))):  # between them lie Hangul syllables, which have no marks
        base, *marks = unicodedata.normalize("NFD", c)
        if base != c and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
_PLAIN = str.maketrans(ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case without marks, whether they are part of a character or stand after it."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), ACCENTED, PLAIN))


def folded(text: str) -> list[str]:
    """What ``tokens`` gives, for words of a query."""
    bare = "".join(c for c in text if unicodedata.category(c) != "Mn").translate(_PLAIN).lower()
    return re.findall(r"[^\W_]+", bare)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term(word: str, toks: Column | str = "toks") -> Column:
    return F.array_contains(toks, word)


def prefix(start: str, toks: Column | str = "toks") -> Column:
    return F.exists(toks, lambda t: t.startswith(start))


def first(word: str, toks: Column | str = "toks") -> Column:
    return F.coalesce(F.get(toks, 0) == word, F.lit(False))


def phrase(words: Column | str, toks: Column | str = "toks") -> Column:
    """Adjacent words; ``words`` are folded and separated by one space."""
    words = F.lit(words) if isinstance(words, str) else words
    return F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def near(a: str, b: str, distance: int = 10, toks: Column | str = "toks") -> Column:
    """Both words with at most ``distance`` words between them."""
    at = lambda w: F.filter(F.transform(toks, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())
    return F.exists(at(a), lambda i: F.exists(at(b), lambda j: F.abs(i - j) <= distance + 1))
