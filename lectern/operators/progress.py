"""Reading state: monotone watermarks with explicit resets, cascade over a series, moves of the order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.schema import BOOK_STRIDE


def watermark_history(events: DataFrame) -> DataFrame:
    """Ceiling after each event (reader_id, book_id, ts, event_id, action set|reset, seq).

    A set only raises the ceiling; a reset starts anew at its own position: a running maximum within the segments
    that resets cut.
    """
    by = Window.partitionBy("reader_id", "book_id").orderBy("ts", "event_id")
    segment = F.sum((F.col("action") == "reset").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    seen = Window.partitionBy("reader_id", "book_id", "_segment").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = events.withColumn("_segment", segment)
    return cut.withColumn("ceiling_seq", F.greatest(F.max("seq").over(seen), F.lit(0))).drop("_segment")


def watermark_final(events: DataFrame) -> DataFrame:
    """Last ceiling of each (reader, book), by two hash aggregates and no window."""
    at = F.struct("ts", "event_id")
    keys = ["reader_id", "book_id"]
    resets = events.where("action = 'reset'").groupBy(*keys).agg(F.max(at).alias("_reset"))
    live = events.join(resets, keys, "left").where(F.col("_reset").isNull() | (at >= F.col("_reset")))
    return live.groupBy(*keys).agg(F.greatest(F.max("seq"), F.lit(0)).alias("ceiling_seq"))


def set_positions(progress: DataFrame, chapter: DataFrame, requests: DataFrame) -> DataFrame:
    """State after requests (reader_id, book_id, status, chapter_idx?): unread clears, reading rises to the chapter's
    end, finished to the book's end and last addressable chapter; ceilings never fall otherwise.

    A row that no request names is kept.  An unknown status or chapter raises.
    """
    served = chapter.where(schema.servable(F.col("kind")))
    ends = served.groupBy("book_id").agg(F.max("end_seq").alias("book_end"))
    last = chapter.where(F.col("kind").isin(*schema.ADDRESSABLE_KINDS) & ~schema.is_part_divider(F.col("label"))).groupBy("book_id").agg(F.max("chapter_idx").alias("last_idx"))
    chapter_end = served.select("book_id", "chapter_idx", F.col("end_seq").alias("chapter_end"))
    r = requests.select("reader_id", "book_id", F.col("status").alias("_status"), "chapter_idx").join(ends, "book_id", "left").join(last, "book_id", "left").join(chapter_end, ["book_id", "chapter_idx"], "left")
    joined = progress.join(r, ["reader_id", "book_id"], "full")
    known = F.col("_status").isin(*schema.STATUSES) & ~((F.col("_status") == "reading") & F.col("chapter_idx").isNotNull() & F.col("chapter_end").isNull())
    asked = F.when(F.col("_status") == "finished", F.coalesce("book_end", F.lit(0))).otherwise(F.coalesce("chapter_end", F.lit(0)))
    old = F.coalesce("ceiling_seq", F.lit(0))
    ceiling = F.when(F.col("_status").isNull(), old).when(~known, F.raise_error(F.lit("unknown status or chapter")).cast("long")).when(F.col("_status") == "unread", 0).otherwise(F.greatest(old, asked))
    position = F.when(F.col("_status").isNull(), F.col("position_chapter_idx")).when(F.col("_status") == "reading", F.col("chapter_idx")).when(F.col("_status") == "finished", F.col("last_idx"))
    return joined.select("reader_id", "book_id", F.coalesce("_status", "status").alias("status"), position.alias("position_chapter_idx"), ceiling.cast("long").alias("ceiling_seq"))


def series_cascade(progress: DataFrame, book: DataFrame, book_ends: DataFrame) -> DataFrame:
    """Every volume before one that a reader reads or has finished becomes finished, at its last addressable chapter;
    ceilings only rise.  ``book_ends`` has (book_id, book_end, last_idx).

    The latest touched volume of each (reader, series) is one aggregate, so no volume meets another in a join.
    """
    keys = ["reader_id", "series_id"]
    owned = progress.join(book.select("book_id", "series_id", "book_order"), "book_id")
    latest = owned.where(F.col("status").isin("reading", "finished")).groupBy(*keys).agg(F.max("book_order").alias("latest"))
    volumes = latest.join(book.select("book_id", "series_id", "book_order"), "series_id")
    state = volumes.join(progress, ["reader_id", "book_id"], "left").join(book_ends, "book_id", "left")
    earlier = F.col("book_order") < F.col("latest")
    end = F.coalesce("book_end", F.lit(0))
    ceiling = F.when(earlier, F.greatest(F.coalesce("ceiling_seq", F.lit(0)), end)).otherwise(F.coalesce("ceiling_seq", F.lit(0)))
    status = F.when(earlier, "finished").otherwise(F.coalesce("status", F.lit("unread")))
    position = F.when(earlier, F.col("last_idx")).otherwise(F.col("position_chapter_idx"))
    return state.select("reader_id", "book_id", status.alias("status"), position.cast("long").alias("position_chapter_idx"), ceiling.cast("long").alias("ceiling_seq"))


def book_ends(chapter: DataFrame) -> DataFrame:
    """(book_id, book_end, last_idx): end of the servable text and last addressable chapter of each book."""
    spot = F.col("kind").isin(*schema.ADDRESSABLE_KINDS) & ~schema.is_part_divider(F.col("label"))
    served = schema.servable(F.col("kind"))
    return chapter.groupBy("book_id").agg(F.max(F.when(served, F.col("end_seq"))).alias("book_end"), F.max(F.when(spot, F.col("chapter_idx"))).alias("last_idx"))


def global_ceiling(progress: DataFrame) -> DataFrame:
    return progress.groupBy("reader_id").agg(F.coalesce(F.max("ceiling_seq"), F.lit(0)).alias("ceiling_seq"))


def rebase(df: DataFrame, moves: DataFrame, columns: list[str], positive_only: bool = False) -> DataFrame:
    """Shift order keys of moved books (book_id, old_order, new_order) by a constant; results out of range raise."""
    delta = F.coalesce(F.col("new_order") - F.col("old_order"), F.lit(0)) * BOOK_STRIDE
    joined = df.join(moves.select("book_id", "old_order", "new_order"), "book_id", "left")
    out = {}
    for c in columns:
        moved = F.col(c) + delta
        checked = F.when(moved < 0, F.raise_error(F.lit("order key out of range")).cast("long")).otherwise(moved)
        out[c] = F.when(F.col(c) > 0, checked).otherwise(F.col(c)) if positive_only else checked
    return joined.withColumns(out).drop("old_order", "new_order")


def lens(book: DataFrame, book_ends: DataFrame, targets: DataFrame) -> DataFrame:
    """From-scratch state of questions (reader_id, book_id, ceiling_seq): earlier volumes finished, the target exact,
    others absent; nothing is stored."""
    t = targets.join(book.select("book_id", "series_id", "book_order"), "book_id").select("reader_id", "series_id", F.col("book_order").alias("_at"), F.col("book_id").alias("_target"), "ceiling_seq")
    v = book.select("book_id", "series_id", "book_order").join(t, "series_id").where(F.col("book_order") <= F.col("_at")).join(book_ends, "book_id", "left")
    mine = F.col("book_id") == F.col("_target")
    return v.where(mine | (F.col("book_order") < F.col("_at"))).select(
        "reader_id",
        "book_id",
        F.when(mine, "reading").otherwise("finished").alias("status"),
        F.lit(None).cast("long").alias("position_chapter_idx"),
        F.when(mine, F.col("ceiling_seq")).otherwise(F.coalesce("book_end", F.lit(0))).alias("ceiling_seq"),
    )
