"""Bounded retrieval: every read of text passes one semi-join with the readers' readable ranges.

A ``BoundedCorpus`` is built from the tables and never takes a bound from a caller; its methods answer for all
readers and books at once.  Nothing above a reader's ceiling reaches a result, nor a count of it.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as T
from lectern.tables import stored

from .lexical import LexicalIndex, Near, Phrase, snippet

# Limits of a read, of a context window and of a search.
MAX_SPAN, MAX_PARAS, MAX_WINDOW, SEARCH_LIMIT, SNIPPET_CHARS = 2_000, 800, 50, 40, 60
NOT_YET_SEEN = "not yet seen"


def _spans(requests: DataFrame) -> DataFrame:
    low = F.greatest(F.least("lo_idx", "hi_idx"), F.lit(0))
    return requests.select("request_id", "reader_id", "book_id", low.alias("_lo"), F.least(F.greatest("lo_idx", "hi_idx"), low + MAX_SPAN).alias("_hi"))


class BoundedCorpus:
    def __init__(self, book: DataFrame, chapter: DataFrame, para: DataFrame, progress: DataFrame):
        self._book, self._chapter, self._para, self._progress = book, chapter, para, progress
        floor = schema.book_floor(F.col("book_order"))
        self.ranges = (
            progress.join(book.select("book_id", "book_order"), "book_id")
            .where((F.col("ceiling_seq") > 0) & (F.col("ceiling_seq") >= floor))
            .select("reader_id", "book_id", floor.alias("lo"), F.col("ceiling_seq").alias("hi"))
        )

    def _within(self, df: DataFrame, seq: str) -> DataFrame:
        """Rows of df, one for each reader whose range of the row's own book holds ``seq``."""
        r = self.ranges.select(F.col("reader_id"), F.col("book_id").alias("_b"), "lo", "hi")
        return df.join(r, (F.col("book_id") == F.col("_b")) & F.col(seq).between(F.col("lo"), F.col("hi"))).drop("_b", "lo", "hi")

    @property
    def readable(self) -> DataFrame:
        """Readable paragraphs of each reader."""
        return self._within(self._para.where(schema.servable(F.col("kind"))), "global_seq")

    @property
    def open_chapters(self) -> DataFrame:
        """Servable chapters whose start is readable, of each reader."""
        return self._within(self._chapter.where(schema.servable(F.col("kind"))), "start_seq")

    # -- structure ----------------------------------------------------------

    def list_books(self, reader_id: int = 0) -> DataFrame:
        """All books of one reader's library, with status and, where readable, the current chapter's label."""
        mine = F.col("reader_id") == reader_id
        at = self._progress.where(mine).select("reader_id", "book_id", "status", "position_chapter_idx")
        label = self.open_chapters.where(mine).select("reader_id", "book_id", F.col("chapter_idx").alias("position_chapter_idx"), F.col("label").alias("current_chapter"))
        grid = self._book.select(F.lit(reader_id).cast("long").alias("reader_id"), "book_id", "title", "author", "series_id", "book_order")
        out = grid.join(at, ["reader_id", "book_id"], "left").join(label, ["reader_id", "book_id", "position_chapter_idx"], "left")
        return out.select("reader_id", "book_id", "title", "author", "series_id", "book_order", F.coalesce("status", F.lit("unread")).alias("status"), "current_chapter")

    def list_chapters(self, part: str | None = None) -> DataFrame:
        c = self.open_chapters
        if part is not None:
            c = c.where(F.col("part_label") == part)
        return c.select("reader_id", "book_id", "chapter_idx", "label", "part_label", "kind")

    def chapters_read(self) -> DataFrame:
        """Addressable chapters started and in all, and the rounded share, of each book with a range."""
        position = F.col("kind").isin(*schema.ADDRESSABLE_KINDS) & ~schema.is_part_divider(F.col("label"))
        counted = self.ranges.join(self._chapter.where(position).select("book_id", "start_seq", F.lit(1).alias("_one")), "book_id", "left").groupBy("reader_id", "book_id")
        out = counted.agg(F.count_if(F.col("start_seq").between(F.col("lo"), F.col("hi"))).alias("n_read"), F.count("_one").alias("n_total"))
        return out.withColumn("pct", T.percent(F.col("n_read"), F.col("n_total")))

    def list_positions(self) -> DataFrame:
        """The whole structure of each book, labels masked until their chapter has started."""
        shown = F.col("start_seq") <= F.coalesce("hi", F.lit(-1))
        divider = schema.is_part_divider(F.col("label"))
        c = self._chapter.where(F.col("kind").isin(*schema.ADDRESSABLE_KINDS)).join(self._progress.select("reader_id", "book_id"), "book_id")
        c = c.join(self.ranges.select("reader_id", "book_id", "hi"), ["reader_id", "book_id"], "left")
        return c.select("reader_id", "book_id", "chapter_idx", F.when(shown, F.col("label")).alias("label"), divider.alias("is_divider"), shown.alias("unlocked"))

    def truncation_markers(self) -> DataFrame:
        """Label of the last readable chapter of each book that goes on above its reader's ceiling."""
        served = self._chapter.where(schema.servable(F.col("kind")))
        c = served.join(self.ranges, "book_id").groupBy("reader_id", "book_id").agg(
            F.max_by(F.when(F.col("start_seq") <= F.col("hi"), F.col("label")), F.when(F.col("start_seq") <= F.col("hi"), F.col("start_seq"))).alias("marker"),
            F.bool_or(F.col("end_seq") > F.col("hi")).alias("more"),
        )
        return c.where("more").select("reader_id", "book_id", "marker")

    def book_spans(self) -> DataFrame:
        """First and last servable order key of each book, unbounded by design: structure, not text."""
        return self._para.where(schema.servable(F.col("kind"))).groupBy("book_id").agg(F.min("global_seq").alias("min_seq"), F.max("global_seq").alias("max_seq"))

    # -- text ---------------------------------------------------------------

    def read(self, requests: DataFrame | None = None) -> DataFrame:
        """Readable paragraphs in order; with requests (request_id, reader_id, book_id, lo_idx, hi_idx) only their spans.

        A span is in chapters; an inverted span is swapped, a negative begin is 0, a span longer than MAX_SPAN is cut,
        and each request gets its first MAX_PARAS paragraphs.
        """
        columns = ["book_id", "chapter_idx", "chapter_label", "global_seq", "text"]
        if requests is None:
            return self.readable.select("reader_id", *columns)
        hits = self.readable.join(_spans(requests), ["reader_id", "book_id"]).where(F.col("chapter_idx").between(F.col("_lo"), F.col("_hi")))
        nth = F.row_number().over(Window.partitionBy("request_id").orderBy("global_seq"))
        return hits.withColumn("_nth", nth).where(F.col("_nth") <= MAX_PARAS).select("request_id", "reader_id", *columns)

    def read_notes(self, requests: DataFrame) -> DataFrame:
        """(request_id, reader_id, book_id, capped, marker): whether a request of ``read`` has more than MAX_PARAS
        paragraphs, and, where its span goes on above the ceiling, the label of the last chapter begun."""
        served = self._para.where(schema.servable(F.col("kind"))).select("book_id", "chapter_idx", "global_seq")
        asked = _spans(requests).join(self.ranges, ["reader_id", "book_id"], "left")
        inside = F.coalesce(F.col("global_seq").between(F.col("lo"), F.col("hi")), F.lit(False))
        hits = asked.join(served, "book_id").where(F.col("chapter_idx").between(F.col("_lo"), F.col("_hi")))
        counts = hits.groupBy("request_id").agg(F.count_if(inside).alias("n"), F.bool_or(~inside).alias("more"))
        begun = self.open_chapters.groupBy("reader_id", "book_id").agg(F.max_by("label", "start_seq").alias("last_label"))
        out = requests.select("request_id", "reader_id", "book_id").join(counts, "request_id", "left").join(begun, ["reader_id", "book_id"], "left")
        return out.select("request_id", "reader_id", "book_id", (F.coalesce("n", F.lit(0)) > MAX_PARAS).alias("capped"), F.when(F.col("more"), F.col("last_label")).alias("marker"))

    def clamped(self) -> DataFrame:
        """Books with servable text that their reader can't read: a flag, never a count."""
        served = self._para.where(schema.servable(F.col("kind"))).join(self._progress.select("reader_id", "book_id"), "book_id")
        hidden = served.join(self.ranges, ["reader_id", "book_id"], "left").where(~F.coalesce(F.col("global_seq").between(F.col("lo"), F.col("hi")), F.lit(False)))
        return hidden.select("reader_id", "book_id").distinct()

    def points(self, cited: DataFrame) -> DataFrame:
        """Chapter and order key of the readable ones among cited paragraphs (book_id, spine_idx, para_idx)."""
        return self.readable.join(cited.distinct(), ["book_id", "spine_idx", "para_idx"]).select("reader_id", "book_id", "spine_idx", "para_idx", "chapter_idx", "global_seq")

    def context(self, cited: DataFrame, window: int = 3) -> DataFrame:
        """``window`` readable paragraphs before and after each readable cited one, in its own book."""
        window = max(0, min(int(window), MAX_WINDOW))
        by = Window.partitionBy("reader_id", "book_id").orderBy("global_seq")
        ranked = self.readable.withColumn("_nth", F.row_number().over(by))
        keys = ["book_id", "spine_idx", "para_idx"]
        centre = ranked.join(cited.select(*keys).distinct(), keys).select("reader_id", "book_id", F.col("global_seq").alias("cited_seq"), F.explode(F.sequence(F.col("_nth") - window, F.col("_nth") + window)).alias("_nth"))
        return ranked.join(centre, ["reader_id", "book_id", "_nth"]).select("reader_id", "book_id", "cited_seq", "global_seq", "text")

    def context_notes(self, cited: DataFrame, window: int = 3) -> DataFrame:
        """(reader_id, book_id, cited_seq, marker) of each readable cited paragraph: where fewer than ``window`` follow it
        because the book goes on above the ceiling, the label of the last chapter begun; else null."""
        window = max(0, min(int(window), MAX_WINDOW))
        by = Window.partitionBy("reader_id", "book_id")
        later = self.readable.withColumn("_after", F.count("*").over(by) - F.row_number().over(by.orderBy("global_seq")))
        keys = ["book_id", "spine_idx", "para_idx"]
        centre = later.join(cited.select(*keys).distinct(), keys).join(self.truncation_markers(), ["reader_id", "book_id"], "left")
        return centre.select("reader_id", "book_id", F.col("global_seq").alias("cited_seq"), F.when(F.col("_after") < window, F.col("marker")).alias("marker"))

    def first_seen(self, asked: DataFrame, index: LexicalIndex | None = None) -> DataFrame:
        """First readable paragraph that names each asked entity (reader_id, entity) as whole words; the same answer
        for absent and unread ones.  Names are matched as folded word phrases, in the index of all paragraphs."""
        asked = asked.select("reader_id", "entity").distinct()
        hits = (index or LexicalIndex.build(self._para)).first_mentions(asked.select("entity")).where(schema.servable(F.col("kind")))
        first = self._within(hits, "global_seq").groupBy("reader_id", "entity").agg(F.min(F.struct("global_seq", "book_id")).alias("at"))
        found = stored(asked.join(first, ["reader_id", "entity"]).select("reader_id", "entity", "at.book_id", "at.global_seq"), "first-mentions")
        labels = self._para.select("book_id", "global_seq", F.col("chapter_label").alias("chapter"))
        out = asked.join(found.join(labels, ["book_id", "global_seq"]), ["reader_id", "entity"], "left")
        return out.select("reader_id", "entity", "book_id", F.coalesce("chapter", F.lit(NOT_YET_SEEN)).alias("chapter"), "global_seq")

    def search_regex(self, pattern: str, limit: int = SEARCH_LIMIT) -> DataFrame:
        """First ``limit`` readable matches of each reader in order, with a snippet around the match.

        Patterns are as in Python: classes are those of Unicode, named groups are ``(?P<name>..)``.  One that does not
        compile matches nothing; ``invalid_regex`` tells why.
        """
        if invalid_regex(self._para.sparkSession, pattern):
            pattern = NO_MATCH
        pattern = unicode_regex(pattern)
        hits = self.readable.where(F.col("text").rlike(pattern))
        at = F.regexp_instr(F.col("text"), F.lit(pattern))
        found = F.length(F.regexp_substr(F.col("text"), F.lit(pattern)))
        start = F.greatest(at - SNIPPET_CHARS, F.lit(1))
        piece = F.substr("text", start, at - start + found + SNIPPET_CHARS)
        snippet = F.concat(F.when(start > 1, "...").otherwise(""), piece, F.when(start + F.length(piece) - 1 < F.length("text"), "...").otherwise(""))
        nth = F.row_number().over(Window.partitionBy("reader_id").orderBy("global_seq", "book_id"))
        ranked = hits.select("reader_id", "book_id", "global_seq", "chapter_label", snippet.alias("snippet"), nth.alias("_nth"))
        return ranked.where(F.col("_nth") <= limit).drop("_nth")

    def search(
        self, phrases: list[Phrase | str], condition: Column | None = None, near: tuple[Near, ...] = (), limit: int = SEARCH_LIMIT, scope: str = "all", index: LexicalIndex | None = None
    ) -> DataFrame:
        """Best readable matches of each reader by BM25, with the best window of each one's text.

        ``condition`` (default: all phrases) is made of ``lexical.has``.  Statistics are those of all paragraphs, read or
        not (``all``), or those of what the reader can read (``readable``).  Only texts of the best hits are read.
        """
        phrases = [Phrase.of(p) if isinstance(p, str) else p for p in phrases]
        index = index or LexicalIndex.build(self._para)
        if scope == "readable":
            hits = index.scored_as_read(self.ranges, phrases, condition, near)
        elif scope == "all":
            hits = self._within(index.scored(phrases, condition, near).where(schema.servable(F.col("kind"))), "global_seq")
        else:
            raise ValueError(f"no such scope: {scope}")
        nth = F.row_number().over(Window.partitionBy("reader_id").orderBy("score", "global_seq", "book_id"))
        best = stored(hits.withColumn("_nth", nth).where(F.col("_nth") <= limit), "search-hits")
        texts = self._para.select("book_id", "global_seq", "chapter_label", "text")
        shown = snippet(F.col("text"), phrases).of(best.join(texts, ["book_id", "global_seq"]), "snippet")
        return shown.select("reader_id", "book_id", "global_seq", "chapter_label", "score", "snippet")

    # -- chapter references -------------------------------------------------

    def chapter_refs(self) -> DataFrame:
        """Printed reference of each addressable chapter: a named division or the leading number; first one wins."""
        ref = printed_identity(F.col("label"))
        c = self._chapter.where(F.col("kind").isin(*schema.ADDRESSABLE_KINDS) & ~schema.is_part_divider(F.col("label"))).withColumn("ref", ref)
        return c.where("ref is not null").groupBy("book_id", "ref").agg(F.min("chapter_idx").alias("chapter_idx"))

    # -- assembly -----------------------------------------------------------

    def assemble(self, max_tokens: int = 800_000) -> DataFrame:
        """One text per reader and book: a header line per chapter, a line per paragraph; size, span and digest.

        A book beyond ``max_tokens`` raises; its length is summed up before anything is gathered.
        """
        r = self.readable
        size = F.sum(F.length("text") + 1).over(Window.partitionBy("reader_id", "book_id"))
        line = F.concat(F.col("para_idx").cast("string"), F.lit(" "), F.col("text"))
        head = F.when(F.col("_first"), F.concat(F.lit("## "), F.col("chapter_label"), F.lit("\n"))).otherwise(F.lit(""))
        by = Window.partitionBy("reader_id", "book_id").orderBy("global_seq")
        first = F.coalesce(F.lag("chapter_idx").over(by) != F.col("chapter_idx"), F.lit(True))
        lines = r.withColumns({"_first": first, "_size": size}).where(F.when(F.col("_size") / 4 > max_tokens, F.raise_error(F.lit("context over budget")).cast("boolean")).otherwise(F.lit(True)))
        rows = lines.select("reader_id", "book_id", "chapter_idx", "global_seq", F.concat(head, line).alias("line"))
        done = rows.groupBy("reader_id", "book_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("global_seq", "line"))), lambda x: x["line"]), "\n").alias("context"),
            F.count("*").alias("n_paras"),
            F.countDistinct("chapter_idx").alias("n_chapters"),
            F.max("global_seq").alias("max_seq"),
        )
        return done.select("reader_id", "book_id", "context", "n_paras", "n_chapters", "max_seq", T.token_estimate(F.col("context")).alias("tokens"), F.sha2("context", 256).alias("sha256"))

    def citation_marks(self, cited: DataFrame) -> DataFrame:
        """Place of each readable citation as a fraction of its book's span."""
        p = self.points(cited).join(self.book_spans(), "book_id")
        fraction = T.clamp((F.col("global_seq") - F.col("min_seq")) / F.greatest(F.col("max_seq") - F.col("min_seq"), F.lit(1)))
        return p.select("reader_id", "book_id", "global_seq", fraction.alias("fraction"))


#: A pattern that no text matches.
NO_MATCH = r"[^\s\S]"


def unicode_regex(pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, and names of groups in its notation; escaped signs stay as they are."""
    forms = {"(?P<": "(?<", r"\Z": r"\z"}
    out = re.sub(r"\\Z|\\.|\(\?P=(\w+)\)|\(\?P<", lambda m: f"\\k<{m[1]}>" if m[1] else forms.get(m[0], m[0]), pattern, flags=re.S)
    return f"(?U){out}"


def invalid_regex(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern does not compile, in Python or as it is given to Java; null if it does."""
    try:
        re.compile(pattern)
        spark._jvm.java.util.regex.Pattern.compile(unicode_regex(pattern))
    except re.error as e:
        return str(e)
    except Py4JJavaError as e:
        return str(e.java_exception.getDescription())
    return None


# Labels of named divisions, and of numbered chapters.
NAMED_DIVISION = r"(?i)^\s*(prologue|epilogue|interlude\w*)\b"
PRINTED_NUMBER = r"(?i)^\s*(?:chapter\s+)?(\d+)\b"


def printed_identity(label: Column) -> Column:
    """What a reader calls a chapter: the whole lower-cased label of a named division, else the leading number without
    leading zeros, else null."""
    number = F.regexp_replace(F.regexp_extract(label, PRINTED_NUMBER, 1), "^0+(?=.)", "")
    return F.when(label.rlike(NAMED_DIVISION), F.lower(T.strip(label))).otherwise(T.blank_to_null(number))
