"""Chapter derivation: markers, islands, parts, kinds, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of labels.
EXCERPT = r"(?i)\bexcerpt\b|\bread on for\b|\bpreview of\b|\bsneak peek\b|\ba preview\b|\bbonus (?:chapter|material)\b|\balso by\b"
REFERENCE = r"(?i)\bdramatis person\w*\b|\bcast of characters\b|\bmaps?\b|\bcharts?\b|\bpreface\b|\bglossary\b"
BOILERPLATE = (
    r"(?i)\bcover\b|\btitle page\b|\bfront matter\b|\bcopyright\b|\bcontents\b|\bstory so far\b|\bdedication\b|\bepigraph\b|"
    r"\babout the (?:author|book)\b|\backnowledg|\bpraise for\b|\bother (?:books|titles)\b|\bpublisher'?s note\b|\bauthor'?s note\b|"
    r"\breading group\b|\bdiscussion questions\b|\badvertisement\b"
)
NARRATIVE = r"(?i)^\s*(?:chapter\s+)?\d+\b|^\s*(?:prologue|part\b|book\s+\w+\b|interlude)|^\s*[IVXLC]+[.:]\s+\S"
WORD_NUMBERS = "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN TWENTY".split()
COVERAGE = {"L1": 0.5, "L2": 0.3, "L3": 0.2}

PART = r"(?i)^\s*PART\s+([IVXLCDM]+|\d+|" + "|".join(WORD_NUMBERS) + r")\b"


def parse_marker(text: Column) -> Column:
    """struct(kind, label) of a chapter marker, null if the text is none; the first shape that fits counts."""
    number = F.upper(F.regexp_extract(text, PART, 1))
    words = F.create_map(*[x for i, w in enumerate(WORD_NUMBERS) for x in (F.lit(w), F.lit(str(i + 1)))])
    made = lambda kind, label: F.struct(F.lit(kind).alias("kind"), label.alias("label"))
    chapter, bare = r"(?i)^\s*CHAPTER\s+(\d+)\b", r"^\s*(\d+)\s*$"
    return (
        F.when(text.rlike(chapter), made("chapter", F.concat(F.lit("Chapter "), F.regexp_extract(text, chapter, 1))))
        .when(text.rlike(PART), made("part", F.concat(F.lit("Part "), F.coalesce(F.try_element_at(words, number), number))))
        .when(text.rlike(r"(?i)^\s*PROLOGUE\b"), made("prologue", F.lit("Prologue")))
        .when(text.rlike(r"(?i)^\s*EPILOGUE\b"), made("epilogue", F.lit("Epilogue")))
        .when(text.rlike(bare), made("chapter", F.concat(F.lit("Chapter "), F.regexp_extract(text, bare, 1))))
    )


def group_markers(docs: DataFrame) -> DataFrame:
    """Sparse markers (book_id, spine_idx, marker?) as contiguous chapters.

    Documents before the first marker form their own chapter; rows get ``chapter_idx`` (dense from 0) and ``label``
    (null for the leading run).
    """
    w = Window.partitionBy("book_id").orderBy("spine_idx")
    started = F.sum(F.col("marker").isNotNull().cast("long")).over(w)
    ranked = docs.withColumns({"_island": started, "label": F.last("marker", ignorenulls=True).over(w)})
    first = F.min("_island").over(Window.partitionBy("book_id"))
    return ranked.withColumn("chapter_idx", F.col("_island") - first).drop("_island")


def assign_parts(chapters: DataFrame, parts: DataFrame) -> DataFrame:
    """As-of join: the part (book_id, start_spine, part_label) that begins last at or before each chapter's start."""
    both = chapters.select("book_id", F.col("start_spine").alias("_at"), "chapter_idx", F.lit(None).cast("string").alias("_part"), F.lit(1).alias("_kind")).unionByName(
        parts.select("book_id", F.col("start_spine").alias("_at"), F.lit(None).cast("long").alias("chapter_idx"), F.col("part_label").alias("_part"), F.lit(0).alias("_kind"))
    )
    w = Window.partitionBy("book_id").orderBy("_at", "_kind", "chapter_idx")
    filled = both.withColumn("part_label", F.last("_part", ignorenulls=True).over(w)).where("_kind = 1")
    return chapters.drop("part_label").join(filled.select("book_id", "chapter_idx", "part_label"), ["book_id", "chapter_idx"], "left")


def is_monotonic(entries: DataFrame) -> DataFrame:
    """(book_id, monotonic): whether spine_idx never goes down in entry order."""
    w = Window.partitionBy("book_id").orderBy("entry_idx")
    step = entries.withColumn("_ok", F.coalesce(F.col("spine_idx") >= F.lag("spine_idx").over(w), F.lit(True)))
    return step.groupBy("book_id").agg(F.bool_and("_ok").alias("monotonic"))


def choose_tier(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, label_tier): the first tier of the ladder that applies.

    ``docs`` has (book_id, spine_idx, heading?, first_block?), ``toc`` (book_id, entry_idx, spine_idx, label).  L1
    needs coverage and monotonic entries, L2 headings, L3 marker-shaped first blocks; L4 always applies.
    """
    return _tiers(docs, toc).select("book_id", "label_tier")


def _tiers(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """``choose_tier`` with ``parted``: whether the contents name two parts or more, in reading order.

    Each table is gone through once: the part before an entry is carried along the entries.
    """
    per = docs.groupBy("book_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("heading").isNotNull()).alias("headings"),
        F.count_if(parse_marker(F.col("first_block")).isNotNull()).alias("marked"),
    )
    w = Window.partitionBy("book_id").orderBy("entry_idx")
    part = F.coalesce(parse_marker(F.col("label"))["kind"] == "part", F.lit(False))
    spot = F.struct("spine_idx")  # never null, so a part without a place is carried too
    before = F.last(F.when(F.col("_is"), spot), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = toc.select("book_id", "entry_idx", "spine_idx", part.alias("_is")).withColumns({"_before": F.lag("spine_idx").over(w), "_part": before["spine_idx"]})
    contents = kept.groupBy("book_id").agg(
        F.countDistinct("spine_idx").alias("covered"),
        F.bool_and(F.coalesce(F.col("spine_idx") >= F.col("_before"), F.lit(True))).alias("monotonic"),
        F.count_if("_is").alias("parts"),
        F.bool_and(F.when(F.col("_is"), F.coalesce(F.col("spine_idx") >= F.col("_part"), F.lit(True)))).alias("parts_monotonic"),
    )
    joined = per.join(contents, "book_id", "left")
    tier = (
        F.when(F.coalesce(F.col("monotonic"), F.lit(False)) & (F.coalesce("covered", F.lit(0)) >= COVERAGE["L1"] * F.col("n")), "L1")
        .when(F.col("headings") >= COVERAGE["L2"] * F.col("n"), "L2")
        .when(F.col("marked") >= COVERAGE["L3"] * F.col("n"), "L3")
        .otherwise("L4")
    )
    return joined.select("book_id", tier.alias("label_tier"), F.coalesce((F.col("parts") >= 2) & F.col("parts_monotonic"), F.lit(False)).alias("parted"))


def tier_labels(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, spine_idx, marker, label_tier) with the marker that the chosen tier gives each document."""
    first = toc.groupBy("book_id", "spine_idx").agg(F.min_by("label", "entry_idx").alias("toc_label"))
    shaped = docs.join(first, ["book_id", "spine_idx"], "left").join(choose_tier(docs, toc), "book_id")
    marker = (
        F.when(F.col("label_tier") == "L1", F.col("toc_label"))
        .when(F.col("label_tier") == "L2", F.col("heading"))
        .when(F.col("label_tier") == "L3", parse_marker(F.col("first_block"))["label"])
        .otherwise(F.concat(F.lit("Section "), (F.col("spine_idx") + 1).cast("string")))
    )
    return shaped.select("book_id", "spine_idx", marker.alias("marker"), "label_tier")


def toc_parts(toc: DataFrame) -> DataFrame:
    """(book_id, start_spine, part_label): parts that a table of contents names, whatever tier labels the chapters.

    Only books with two such entries or more, in reading order; the first entry of a document counts.
    """
    marker = parse_marker(F.col("label"))
    parts = toc.where(marker["kind"] == "part").select("book_id", "entry_idx", "spine_idx", marker["label"].alias("label"))
    fit = parts.groupBy("book_id").agg(F.count("*").alias("n")).where("n >= 2").join(is_monotonic(parts).where("monotonic"), "book_id").select("book_id")
    return parts.join(fit, "book_id").groupBy("book_id", F.col("spine_idx").alias("start_spine")).agg(F.min_by("label", "entry_idx").alias("part_label"))


def label_ladder(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, label_tier): the tier of ``choose_tier``, as L1+L2 and so on where the contents give parts to another tier's chapters."""
    both = F.col("parted") & (F.col("label_tier") != "L1")
    tier = F.when(both, F.concat(F.lit("L1+"), F.col("label_tier"))).otherwise(F.col("label_tier"))
    return _tiers(docs, toc).select("book_id", tier.alias("label_tier"))


def body_checks(chapters: DataFrame) -> DataFrame:
    """(book_id, has_body): whether the classifier left a book anything to read; a book without is an error to report."""
    return chapters.groupBy("book_id").agg(F.bool_or(F.col("kind") == "body").alias("has_body"))


def compose_parts(chapters: DataFrame) -> DataFrame:
    """Absorb bare part-title chapters into the chapter that follows (else precedes) them as its part label.

    ``chapters`` has (book_id, chapter_idx, label, n_paras, start_spine, end_spine).  A part title with text of its
    own stays a chapter; an empty one gives its span away, and stays only in a book of nothing else.
    """
    whole, by = Window.partitionBy("book_id"), Window.partitionBy("book_id").orderBy("chapter_idx")
    bare = (parse_marker(F.col("label"))["kind"] == "part") & (F.col("n_paras") == 0)
    c = chapters.withColumn("_bare", F.coalesce(bare, F.lit(False)))
    c = c.withColumn("_all", F.bool_and("_bare").over(whole)).withColumn("_bare", F.col("_bare") & ~F.col("_all"))
    later, before = by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col("_bare"), F.col("chapter_idx"))
    c = c.withColumn("_into", F.coalesce(F.first(own, ignorenulls=True).over(later), F.last(own, ignorenulls=True).over(before)))
    part = F.when(parse_marker(F.col("label"))["kind"] == "part", parse_marker(F.col("label"))["label"])
    c = c.withColumn("_part", F.last(part, ignorenulls=True).over(before))
    merged = c.groupBy("book_id", F.col("_into").alias("chapter_idx")).agg(
        F.max(F.when(F.col("chapter_idx") == F.col("_into"), F.col("label"))).alias("label"),
        F.max(F.when(F.col("chapter_idx") == F.col("_into"), F.col("_part"))).alias("part_label"),
        F.sum("n_paras").alias("n_paras"),
        F.min("start_spine").alias("start_spine"),
        F.max("end_spine").alias("end_spine"),
    )
    return merged.withColumn("chapter_idx", (F.row_number().over(by) - 1).cast("long"))


def classify_kinds(chapters: DataFrame) -> DataFrame:
    """Adds ``kind`` to (book_id, chapter_idx dense from 0, label) from the labels' shapes and places alone."""
    book = Window.partitionBy("book_id")
    label, at = F.coalesce(F.col("label"), F.lit("")), F.col("chapter_idx")
    front = label.rlike(REFERENCE) | label.rlike(BOILERPLATE)
    c = chapters.withColumns({"_n": F.count("*").over(book), "_start": F.coalesce(F.min(F.when(F.btrim(label).rlike(NARRATIVE), at)).over(book), F.lit(0))})
    c = c.withColumn("_excerpt", F.coalesce(F.min(F.when(label.rlike(EXCERPT) & (at >= F.col("_start")), at)).over(book), F.col("_n")))
    c = c.withColumn("_last", F.coalesce(F.max(F.when(~front & (at >= F.col("_start")) & (at < F.col("_excerpt")), at)).over(book), F.col("_start") - 1))
    kind = (
        F.when(at < F.col("_start"), F.when(label.rlike(REFERENCE), "reference").otherwise("boilerplate"))
        .when(at >= F.col("_excerpt"), "excerpt")
        .when(at > F.col("_last"), "boilerplate")
        .otherwise("body")
    )
    return c.withColumn("kind", kind).drop("_n", "_start", "_excerpt", "_last")


def chapter_bounds(para: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, start_seq, end_seq, n_paras, n_words) of chapters that have paragraphs."""
    from lectern.functions.text import word_count

    return para.groupBy("book_id", "chapter_idx").agg(
        F.min("global_seq").alias("start_seq"), F.max("global_seq").alias("end_seq"), F.count("*").alias("n_paras"), F.sum(word_count(F.col("text"))).cast("long").alias("n_words")
    )


def size_flags(bounds: DataFrame) -> DataFrame:
    """Chapters (with kind and n_words) that are suspiciously short: reported, never dropped."""
    short = ((F.col("kind") == "body") & (F.col("n_words") < 400)) | ((F.col("kind") == "reference") & (F.col("n_words") < 250))
    return bounds.where(short)


def coverage_errors(chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """(book_id, spine_idx, n): documents that no chapter span or more than one covers."""
    spans = chapters.select("book_id", F.explode(F.sequence("start_spine", "end_spine")).alias("spine_idx"))
    seen = spans.groupBy("book_id", "spine_idx").agg(F.count("*").alias("n"))
    joined = docs.select("book_id", "spine_idx").join(seen, ["book_id", "spine_idx"], "full")
    return joined.withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
