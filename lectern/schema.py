"""Vocabulary, order key and table schemas of the reading model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of chapters, and what is served and can be a position.
ALL_KINDS = ("body", "reference", "boilerplate", "excerpt")
SERVABLE_KINDS = ("body", "reference")
ADDRESSABLE_KINDS = ("body",)
STATUSES = ("unread", "reading", "finished")

# Strides of the order key.
SPINE_STRIDE = 1_000_000
MAX_SPINE = 100_000
BOOK_STRIDE = SPINE_STRIDE * MAX_SPINE
LEGACY_SPINE_STRIDE = 1_000
LEGACY_BOOK_STRIDE = 1_000_000

BOOK = "book_id long, title string, author string, series_id string, book_order long, standalone boolean"
CHAPTER = "book_id long, chapter_idx long, label string, part_label string, start_seq long, end_seq long, kind string"
PARA = "book_id long, spine_idx long, para_idx long, global_seq long, chapter_idx long, chapter_label string, text string, kind string"
PROGRESS = "reader_id long, book_id long, status string, position_chapter_idx long, ceiling_seq long"


def _guarded(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def global_seq(book_order: Column, spine_idx: Column, para_idx: Column) -> Column:
    """Position of a paragraph in its book's span; out-of-range parts raise instead of colliding."""
    ok = (book_order >= 0) & (spine_idx >= 0) & (spine_idx < MAX_SPINE) & (para_idx >= 0) & (para_idx < SPINE_STRIDE)
    value = book_order.cast("long") * BOOK_STRIDE + spine_idx.cast("long") * SPINE_STRIDE + para_idx.cast("long")
    return _guarded(value, ok, "order key out of range")


def book_floor(book_order: Column) -> Column:
    return book_order.cast("long") * BOOK_STRIDE


def _div(value: Column, by: int) -> Column:
    """Integer division of non-negative longs."""
    return ((value - value % by) / by).cast("long")


def decode_seq(seq: Column) -> dict[str, Column]:
    """book_order, spine_idx and para_idx of an order key."""
    return {"book_order": _div(seq, BOOK_STRIDE), "spine_idx": _div(seq % BOOK_STRIDE, SPINE_STRIDE), "para_idx": seq % SPINE_STRIDE}


def rescale_legacy(seq: Column) -> Column:
    """An order key of the old strides under the new ones."""
    order, rest = _div(seq, LEGACY_BOOK_STRIDE), seq % LEGACY_BOOK_STRIDE
    return global_seq(order, _div(rest, LEGACY_SPINE_STRIDE), rest % LEGACY_SPINE_STRIDE)


def servable(kind: Column) -> Column:
    return kind.isin(*SERVABLE_KINDS)


def is_part_divider(label: Column) -> Column:
    """Labels that begin with the word "part" are structure, never a position."""
    return F.coalesce(label.rlike(r"(?i)^\s*part\b"), F.lit(False))
