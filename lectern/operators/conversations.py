"""Conversation log: listing, turns, appends, undo, grouping, citation accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.schema import ADDRESSABLE_KINDS, is_part_divider


def turn_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, ord, question, answer): each user message with the assistant message right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.where(F.col("role") != "system").withColumns({"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    pairs = m.where("role = 'user' and _role = 'assistant'")
    return pairs.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), F.col("text").alias("question"), "answer")


def create(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations (conv_id, book_id, title, chapter_idx, created_at, updated_at) with empty new ones (conv_id, book_id,
    chapter_idx, at), opened where their reader is.  An id that is taken already raises."""
    taken = new.join(conversations.select("conv_id", F.lit(True).alias("_taken")), "conv_id", "left")
    free = F.when(F.col("_taken"), F.raise_error(F.concat(F.lit("there is a conversation "), F.col("conv_id").cast("string"))).cast("string")).otherwise(F.lit(""))
    opened = taken.select("conv_id", "book_id", free.alias("title"), "chapter_idx", F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    return conversations.select(*opened.columns).unionByName(opened)


def get(conversations: DataFrame, turns: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked conversations (conv_id) that exist, each with its number of turns."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turn_count"))
    found = conversations.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").join(n, "conv_id", "left")
    return found.select(*conversations.columns, F.coalesce("turn_count", F.lit(0)).alias("turn_count"))


def summaries(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """All conversations with their number of turns and a title from the first question."""
    per = turns.groupBy("conv_id").agg(F.count("*").alias("turn_count"), F.min_by("question", "ord").alias("_q"))
    out = conversations.select("conv_id").distinct().join(per, "conv_id", "left")
    return out.select("conv_id", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), T.question_title(F.col("_q")).alias("title"))


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """Turns with new ones (conv_id, seq, question, answer) after the last of each conversation."""
    last = turns.groupBy("conv_id").agg(F.max("ord").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    placed = new.join(last, "conv_id", "left").select("conv_id", (F.coalesce("_last", F.lit(-1)) + nth).cast("long").alias("ord"), "question", "answer")
    return turns.select("conv_id", "ord", "question", "answer").unionByName(placed)


def turn_results(turns: DataFrame, prefix: DataFrame) -> DataFrame:
    """(conv_id, ord, n_messages, prompt_chars, citations): what each turn sends and what its answer cites.

    A request is the conversation's prefix (conv_id, text), which never changes, then all earlier questions and answers, then
    the question; it is given by its size, as the messages themselves would repeat the history in every row.
    """
    chars = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    before = Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(chars("question") + chars("answer")).over(before), F.lit(0))
    t = turns.select("conv_id", "ord", chars("question").alias("_own"), earlier.alias("_earlier"), F.count("*").over(before).alias("_n"), T.citations(F.col("answer")).alias("citations"))
    j = t.join(prefix.select("conv_id", chars("text").alias("_prefix")), "conv_id", "left")
    size = F.coalesce("_prefix", F.lit(0)) + F.col("_earlier") + F.col("_own")
    return j.select("conv_id", "ord", (2 + 2 * F.col("_n")).alias("n_messages"), size.cast("long").alias("prompt_chars"), "citations")


def drop_last(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Turns without the last one of each (or of the given) conversation, by one aggregate."""
    last = turns.groupBy("conv_id").agg(F.max("ord").alias("ord"))
    if conversations is not None:
        last = last.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    return turns.join(last, ["conv_id", "ord"], "left_anti").select(*turns.columns)


def delete(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    return turns.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti").select(*turns.columns)


def rename(conversations: DataFrame, names: DataFrame) -> DataFrame:
    j = conversations.join(names.select("conv_id", F.col("title").alias("_t")), "conv_id", "left")
    return j.withColumn("title", F.coalesce("_t", "title")).drop("_t").select(*conversations.columns)


def grouped(conversations: DataFrame, book: DataFrame) -> DataFrame:
    """(book_id, latest, conv_ids): conversations of known books, newest first; orphans are hidden."""
    known = conversations.join(book.select("book_id"), "book_id")
    newest = F.transform(F.sort_array(F.collect_list(F.struct("updated_at", "conv_id")), asc=False), lambda c: c["conv_id"])
    return known.groupBy("book_id").agg(F.max("updated_at").alias("latest"), newest.alias("conv_ids"))


def reopened(conversations: DataFrame, progress: DataFrame) -> DataFrame:
    """Whether the reader has moved on since: the position now against the conversation's chapter."""
    now = progress.select("book_id", "status", F.col("position_chapter_idx").alias("_now"))
    j = conversations.join(now, "book_id", "left")
    moved = F.coalesce((F.col("status") == "finished") | (F.col("_now") > F.col("chapter_idx")), F.lit(False))
    return j.select("conv_id", "book_id", "chapter_idx", moved.alias("moved_on"))


def position_labels(positions: DataFrame, chapter: DataFrame) -> DataFrame:
    """(conv_id, book_id, chapter_idx, label): how a saved position reads: its chapter's label, or "Finished" from the
    last addressable chapter on."""
    spot = F.col("kind").isin(*ADDRESSABLE_KINDS) & ~is_part_divider(F.col("label"))
    last = chapter.where(spot).groupBy("book_id").agg(F.max("chapter_idx").alias("_last"))
    j = positions.join(last, "book_id", "left").join(chapter.select("book_id", "chapter_idx", "label"), ["book_id", "chapter_idx"], "left")
    return j.select("conv_id", "book_id", "chapter_idx", F.when(F.col("chapter_idx") >= F.col("_last"), "Finished").otherwise(F.col("label")).alias("label"))


def ranked(df: DataFrame, group: str, order: str, width: int = 10_000) -> DataFrame:
    """``df`` with ``rank``, the rows of its group before it, by a non-negative integer ``order``.

    Ranks are taken in stretches of the order and moved by the counts of the stretches before, so a group of any
    size spreads over tasks.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width))
    sizes = cut.groupBy(group, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(group, "_stretch").orderBy(order))
    return cut.join(sizes.withColumn("_before", before), [group, "_stretch"]).withColumn("rank", nth - 1 + F.col("_before")).drop("_stretch", "_n", "_before")


def headers(conversations: DataFrame, book: DataFrame, chapter: DataFrame) -> DataFrame:
    """Prior volumes of the series, and the place of the conversation's chapter among addressable ones."""
    prior = ranked(book.select("book_id", "series_id", "book_order"), "series_id", "book_order").select("book_id", "rank").withColumnRenamed("rank", "prior_volumes")
    spots = chapter.where(F.col("kind").isin(*ADDRESSABLE_KINDS) & ~is_part_divider(F.col("label"))).select("book_id", F.col("chapter_idx").alias("_at"))
    c = conversations.select("conv_id", "book_id", "chapter_idx")
    counts = c.join(spots, "book_id").groupBy("conv_id").agg(F.count_if(F.col("_at") <= F.col("chapter_idx")).alias("position"), F.count("*").alias("chapters"))
    return c.join(prior, "book_id", "left").join(counts, "conv_id", "left").select("conv_id", "book_id", "prior_volumes", "position", "chapters")


def citation_counts(turns: DataFrame) -> DataFrame:
    """How often each id is cited, over answers."""
    return turns.select(F.explode(T.citations(F.col("answer"))).alias("citation")).groupBy("citation").agg(F.count("*").alias("times"))
