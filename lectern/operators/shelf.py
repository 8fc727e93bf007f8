"""Shelf statistics, change capture, links, suggestions and the unified view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.conversations import ranked


def _filled(c: str) -> Column:
    return F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")


def totals(shelf: DataFrame, dnf_shelf: str | None = None) -> DataFrame:
    """One row over all shelves: counts, pages, backlog, longest and shortest read (ties: first by review_id)."""
    read, pages = F.col("shelf") == "read", F.col("num_pages")
    paged = read & pages.isNotNull()
    return shelf.agg(
        F.count_if(read).alias("books"),
        F.coalesce(F.sum(F.when(read, pages)), F.lit(0)).alias("pages"),
        F.coalesce(F.bround(F.avg(F.when(read, pages)), 0), F.lit(0)).cast("long").alias("avg_pages"),
        F.count_if(F.col("shelf") == "to-read").alias("to_read"),
        F.count_if(F.col("shelf") == "currently-reading").alias("currently_reading"),
        F.count_if(F.lit(False) if dnf_shelf is None else F.col("shelf") == dnf_shelf).alias("dnf"),
        F.coalesce(F.sum(F.when(F.col("shelf") == "to-read", pages)), F.lit(0)).alias("backlog_pages"),
        F.max_by(F.when(paged, F.col("title")), F.when(paged, F.struct(pages, -F.col("review_id")))).alias("longest"),
        F.min_by(F.when(paged, F.col("title")), F.when(paged, F.struct(pages, F.col("review_id")))).alias("shortest"),
    )


def coverage(shelf: DataFrame) -> DataFrame:
    """How many read books have each field; empty text counts as missing."""
    return shelf.where("shelf = 'read'").agg(
        F.count("*").alias("books"), *[_filled(c).alias(f"with_{c}") for c in ("date_read", "date_started", "num_pages", "published_year", "user_rating", "genres", "cover_small")]
    )


def by_month(shelf: DataFrame) -> DataFrame:
    """(month, books, pages) of dated reads, every month from the first to the last; year-only dates have no month."""
    dated = shelf.where("shelf = 'read'").withColumn("month", T.month_key(F.col("date_read"))).where("month is not null")
    counts = dated.groupBy("month").agg(F.count("*").alias("books"), F.sum(F.coalesce("num_pages", F.lit(0))).alias("pages"))
    span = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo is not null")
    day = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    calendar = span.select(F.explode(F.sequence(day("lo"), day("hi"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return calendar.join(counts, "month", "left").select("month", zero("books"), zero("pages"))


def month_books(shelf: DataFrame) -> DataFrame:
    """(month, nth, title): each month's reads by date and title."""
    dated = shelf.where("shelf = 'read'").withColumn("month", T.month_key(F.col("date_read"))).where("month is not null")
    nth = F.row_number().over(Window.partitionBy("month").orderBy("date_read", "title", "review_id"))
    return dated.select("month", nth.cast("long").alias("nth"), T.strip_series(F.col("title")).alias("title"), "date_read")


def top_authors(shelf: DataFrame, least: int = 2, n: int = 10) -> DataFrame:
    counts = shelf.where("shelf = 'read' and coalesce(author, '') <> ''").groupBy("author").agg(F.count("*").alias("books"))
    return counts.where(F.col("books") >= least).orderBy(F.desc("books"), "author").limit(n)


def by_decade(shelf: DataFrame) -> DataFrame:
    """(decade, books) of read books with a year, gaps filled."""
    counts = shelf.where("shelf = 'read' and published_year is not null").groupBy(T.decade(F.col("published_year")).alias("decade")).agg(F.count("*").alias("books"))
    span = counts.agg(F.min("decade").alias("lo"), F.max("decade").alias("hi")).where("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi", F.lit(10).cast("long"))).alias("decade")).join(counts, "decade", "left").select("decade", F.coalesce("books", F.lit(0)).alias("books"))


def series_progress(shelf: DataFrame) -> DataFrame:
    """(series, n_read, n_total, shelves) over all shelves; unread single volumes are left out."""
    s = shelf.withColumn("series", T.series_of(F.col("title"))).where("series is not null")
    out = s.groupBy("series").agg(F.count_if(F.col("shelf") == "read").alias("n_read"), F.count("*").alias("n_total"), F.array_join(F.sort_array(F.collect_set("shelf")), ",").alias("shelves"))
    return out.where("not (n_total = 1 and n_read = 0)")


def _durations(shelf: DataFrame) -> DataFrame:
    days = F.datediff(T.exact_day(F.col("date_read")), T.exact_day(F.col("date_started")))
    return shelf.where("shelf = 'read'").withColumn("days", days).where("days >= 0")


def durations(shelf: DataFrame) -> DataFrame:
    d = _durations(shelf)
    return d.agg(
        F.count("*").alias("n"),
        F.bround(F.median("days"), 0).cast("long").alias("median_days"),
        F.round(F.avg("days"), 1).alias("mean_days"),
        F.min_by("title", F.struct("days", "review_id")).alias("fastest"),
        F.max_by("title", F.struct(F.col("days"), -F.col("review_id"))).alias("slowest"),
    )


def top_genres(shelf: DataFrame, n: int = 12) -> DataFrame:
    g = shelf.where("shelf = 'read'").select(F.explode(T.top_genres(F.col("genres"))).alias("genre"))
    return g.groupBy("genre").agg(F.count("*").alias("books")).orderBy(F.desc("books"), "genre").limit(n)


def rating_by_genre(shelf: DataFrame, least: int = 3) -> DataFrame:
    g = shelf.where("shelf = 'read' and coalesce(user_rating, 0) <> 0").select("user_rating", F.explode(T.top_genres(F.col("genres"))).alias("genre"))
    return g.groupBy("genre").agg(F.count("*").alias("n"), F.round(F.avg("user_rating"), 2).alias("avg_rating")).where(F.col("n") >= least)


# -- change capture ---------------------------------------------------------

#: Columns that a feed may overwrite; the others of the shelf keep what they have.
FEED_COLUMNS = ["shelf_book_id", "title", "author", "shelf", "num_pages", "published_year", "user_rating", "date_read"]


def upsert_shelf(shelf: DataFrame, fetched: DataFrame, shelf_name: str, truncated: bool) -> DataFrame:
    """The shelf after a fetch of ``shelf_name``: new rows in, known rows updated but for the columns that
    enrichment owns; a complete fetch prunes what it lacks of that shelf, a truncated one never deletes."""
    new = fetched.select("review_id", *[F.col(c).alias(f"_{c}") for c in FEED_COLUMNS], F.col("date_added").alias("_date_added"), F.lit(True).alias("_hit"))
    both = shelf.join(new, "review_id", "full")
    hit = F.coalesce("_hit", F.lit(False))
    kept = both if truncated else both.where(hit | (F.col("shelf") != shelf_name))
    cols = [F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in FEED_COLUMNS else (F.coalesce(c, "_date_added").alias(c) if c == "date_added" else F.col(c)) for c in shelf.columns]
    return kept.select(*cols)


def usable_fetches(fetches: DataFrame) -> DataFrame:
    """Fetches (fetch_id, sync_id, shelf, truncated, at, ok) of syncs that got every shelf: a partial sync counts for nothing."""
    return fetches.join(fetches.where(~F.col("ok")).select("sync_id").distinct(), "sync_id", "left_anti")


def replay_syncs(shelf: DataFrame, fetches: DataFrame, items: DataFrame) -> DataFrame:
    """The shelf after all usable fetches in the order of ``at``, as if each went through ``upsert_shelf``.

    ``items`` (fetch_id, review_id, the feed's columns, date_added) is what the fetches held.  A row stays until the next
    complete fetch of its shelf that lacks it.  So no state is carried from fetch to fetch: each sighting of a review
    knows the next complete fetch of its shelf from the log alone, which ends the row if no sighting comes before; what is
    kept from the first sighting on (date_added, and all that enrichment owns) counts from the last ending.  Work is by
    review, whatever the size of a shelf.
    """
    log = usable_fetches(fetches)
    later = Window.partitionBy("shelf").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    log = log.withColumn("_ends", F.min(F.when(~F.col("truncated"), F.col("at"))).over(later))
    ends = log.groupBy("shelf").agg(F.min(F.when(~F.col("truncated"), F.col("at"))).alias("_ends"))
    feed = [*FEED_COLUMNS, "date_added"]
    owned = [c for c in shelf.columns if c not in (*feed, "review_id")]
    new = items.join(log.select("fetch_id", "at", "_ends"), "fetch_id").select("review_id", *feed, *[F.lit(None).cast(shelf.schema[c].dataType).alias(c) for c in owned], "at", "_ends")
    old = shelf.join(ends, "shelf", "left").select("review_id", *feed, *owned, F.lit(None).cast(new.schema["at"].dataType).alias("at"), "_ends")
    by = Window.partitionBy("review_id").orderBy(F.asc_nulls_first("at"))
    seen = old.unionByName(new).withColumn("_next", F.lead("at").over(by))
    gone = F.col("_ends").isNotNull() & (F.col("_next").isNull() | (F.col("_ends") < F.col("_next")))
    runs = seen.withColumn("_gone", gone)
    runs = runs.withColumn("_run", F.sum(F.col("_gone").cast("int")).over(by) - F.col("_gone").cast("int"))
    within = Window.partitionBy("review_id", "_run").orderBy(F.asc_nulls_first("at"))
    kept = runs.withColumns({c: F.first(c, ignorenulls=True).over(within) for c in ("date_added", *owned)})
    return kept.where("_next is null and not _gone").select(*shelf.columns)


def sync_reports(fetches: DataFrame, items: DataFrame) -> DataFrame:
    """(sync_id, total_books, shelf_counts, truncated_shelves) of each usable sync: a JSON object and a JSON list, by shelf."""
    n = items.groupBy("fetch_id").agg(F.count("*").alias("n"))
    log = usable_fetches(fetches).join(n, "fetch_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.sort_array(F.collect_list(F.struct("shelf", "n")))
    out = log.groupBy("sync_id").agg(F.sum("n").alias("total_books"), F.to_json(F.map_from_entries(one)).alias("shelf_counts"), F.to_json(F.sort_array(F.collect_set(F.when(F.col("truncated"), F.col("shelf"))))).alias("truncated_shelves"))
    return out.select("sync_id", "total_books", "shelf_counts", "truncated_shelves")


def apply_reviews(shelf: DataFrame, reviews: DataFrame) -> DataFrame:
    """Merge enrichment (review_id, date_started, date_read, date_added, read_count): started and count are set,
    date_read only fills a gap, date_added is replaced where given."""
    r = reviews.select("review_id", F.col("date_started").alias("_s"), F.col("date_read").alias("_r"), F.col("date_added").alias("_a"), F.lit(True).alias("_hit"))
    j = shelf.join(r, "review_id", "left")
    out = {"date_started": F.when(F.col("_hit"), F.col("_s")).otherwise(F.col("date_started")), "date_read": F.coalesce("date_read", "_r"), "date_added": F.coalesce("_a", "date_added")}
    return j.withColumns(out).drop("_s", "_r", "_a", "_hit")


def latest_sync(shelf: DataFrame, syncs: DataFrame) -> DataFrame:
    """(shelf, books, truncated, last_sync): counts with the flag of each shelf's last fetch."""
    last = syncs.groupBy("shelf").agg(F.max_by("truncated", F.struct("synced_at", "sync_id")).alias("truncated"), F.max("synced_at").alias("last_sync"))
    counts = shelf.groupBy("shelf").agg(F.count("*").alias("books"))
    return counts.join(last, "shelf", "left").select("shelf", "books", F.coalesce("truncated", F.lit(False)).alias("truncated"), "last_sync")


# -- entity resolution ------------------------------------------------------


def _keyed(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.explode(T.title_keys(F.col("title"))).alias("key"))


def _by_title(book: DataFrame, shelf: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(book_id, .., keys) with all title keys of each book, and (keys, shelf_book_id) of every distinct set of keys.

    Books of the same keys have the same candidates, so these are found, counted and listed once for a set of keys,
    however many books and shelf entries share a title.
    """
    own = F.sort_array(F.array_distinct(F.flatten(F.collect_list(T.title_keys(F.col("title")))))).alias("keys")
    titled = book.groupBy("book_id", *columns).agg(own)
    theirs = _keyed(shelf.select("shelf_book_id", "title"), "shelf_book_id").distinct()
    kinds = titled.select("keys").distinct()
    mates = kinds.select("keys", F.explode("keys").alias("key")).join(theirs, "key").select("keys", "shelf_book_id").distinct()
    return titled, mates


def propose_links(book: DataFrame, shelf: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(book_id, status link|no_match|ambiguous, n_candidates, candidate): books without a link by shared title keys."""
    todo = book if links is None else book.join(links.select("book_id"), "book_id", "left_anti")
    titled, mates = _by_title(todo, shelf)
    counted = mates.groupBy("keys").agg(F.count("*").alias("n"), F.min("shelf_book_id").alias("one"))
    found = titled.join(counted, "keys").select("book_id", "n", "one")
    out = todo.select("book_id").join(found, "book_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("book_id", F.when(n == 1, "link").when(n == 0, "no_match").otherwise("ambiguous").alias("status"), n.alias("n_candidates"), F.when(n == 1, F.col("one")).alias("candidate"))


def link_candidates(book: DataFrame, shelf: DataFrame, separator: str | None = None) -> DataFrame:
    """(book_id, candidates): all shelf books, in order, that share a title key with a book that has more than one; a
    list, or a text with a separator."""
    titled, mates = _by_title(book, shelf)
    listed = mates.groupBy("keys").agg(F.sort_array(F.collect_list("shelf_book_id")).alias("candidates")).where(F.size("candidates") > 1)
    if separator is not None:
        listed = listed.withColumn("candidates", F.array_join("candidates", separator))
    return titled.join(listed, "keys").select("book_id", "candidates")


def link_report(book: DataFrame, links: DataFrame, proposed: DataFrame) -> DataFrame:
    """One row (linked, already_linked, ambiguous, unmatched) of an automatic round over books without a link."""
    before = book.select("book_id").join(links.select("book_id"), "book_id", "left_semi").select(F.lit("already").alias("status"))
    kinds = (("linked", "link"), ("already_linked", "already"), ("ambiguous", "ambiguous"), ("unmatched", "no_match"))
    return proposed.select("status").unionByName(before).agg(*[F.count_if(F.col("status") == k).alias(n) for n, k in kinds])


def set_links(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (book_id, shelf_book_id, source) with a person's choices (book_id, shelf_book_id) in place of whatever was there."""
    kept = links.join(chosen.select("book_id"), "book_id", "left_anti")
    return kept.select("book_id", "shelf_book_id", "source").unionByName(chosen.select("book_id", "shelf_book_id", F.lit("manual").alias("source")))


def apply_proposed(links: DataFrame, proposed: DataFrame) -> DataFrame:
    """Links with those that ``propose_links`` found for books without one; a choice that is there stays."""
    new = proposed.where("status = 'link'").select("book_id", F.col("candidate").alias("shelf_book_id"), F.lit("auto").alias("source"))
    return links.select("book_id", "shelf_book_id", "source").unionByName(new.join(links.select("book_id"), "book_id", "left_anti"))


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links without those of the given books, manual or automatic."""
    return links.join(gone.select("book_id"), "book_id", "left_anti").select(*links.columns)


def slot_conflicts(book: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked places (book_id, series_id, book_order) that another book holds, with its id."""
    held = book.select("series_id", "book_order", F.col("book_id").alias("occupant"))
    return asked.join(held, ["series_id", "book_order"]).where("occupant <> book_id").select("book_id", "series_id", "book_order", "occupant")


def library_tree(book: DataFrame, progress: DataFrame, read: DataFrame) -> DataFrame:
    """(series_id, pos, book_id, title, status, percent, standalone): volumes of each series in order with the reader's
    standing; a series is standalone if its only book is.  ``read`` has (book_id, pct)."""
    sizes = book.groupBy("series_id").agg((F.count("*") == 1).alias("_one"))
    state = book.join(progress.select("book_id", "status"), "book_id", "left").join(read.select("book_id", "pct"), "book_id", "left").join(sizes, "series_id")
    placed = ranked(state, "series_id", "book_order")
    return placed.select("series_id", F.col("rank").alias("pos"), "book_id", "title", F.coalesce("status", F.lit("unread")).alias("status"), F.coalesce("pct", F.lit(0)).alias("percent"), (F.col("_one") & F.col("standalone")).alias("standalone"))


def pace(shelf: DataFrame) -> DataFrame:
    """One row (months, pace, horizon, kind): pages a month over the months from the first dated read to the last, and
    the months that the unread shelf lasts; null where there is no history or nothing waits."""
    read = F.col("shelf") == "read"
    month = F.when(read, T.month_key(F.col("date_read")))
    ordinal = F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")
    t = shelf.agg(
        F.coalesce(F.max(ordinal) - F.min(ordinal) + 1, F.lit(0)).cast("long").alias("months"),
        F.coalesce(F.sum(F.when(read, F.col("num_pages"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(F.col("shelf") == "to-read", F.col("num_pages"))), F.lit(0)).alias("backlog"),
    )
    known = (F.col("months") > 0) & (F.col("pages") > 0)
    t = t.withColumn("pace", F.when(known, F.col("pages") / F.col("months")))
    t = t.withColumn("horizon", F.when(F.col("backlog") > 0, F.col("backlog") / F.col("pace")))
    kind = F.when(~known, "no history").when(F.col("backlog") == 0, "caught up").when(F.col("horizon") < 1.5, "weeks").when(F.col("horizon") < 20, "months").otherwise("years")
    return t.select("months", F.round("pace", 6).alias("pace"), F.round("horizon", 6).alias("horizon"), kind.alias("kind"))


def apply_links(links: DataFrame, proposed: DataFrame) -> DataFrame:
    """Links after proposals (book_id, candidate): a manual link always stays."""
    p = proposed.where("candidate is not null").select("book_id", F.col("candidate").alias("_c"))
    j = links.join(p, "book_id", "full")
    mine = (F.col("source") == "manual") | F.col("_c").isNull()
    keep = F.coalesce(mine, F.lit(False))
    return j.select("book_id", F.when(keep, F.col("shelf_book_id")).otherwise(F.col("_c")).alias("shelf_book_id"), F.when(keep, F.col("source")).otherwise(F.lit("auto")).alias("source"))


def upload_matches(book: DataFrame, shelf: DataFrame) -> DataFrame:
    """(book_id, shelf_book_id?): the one shelf book an upload is: unique by title, else unique by a shared author word."""
    one = shelf.groupBy("shelf_book_id").agg(F.min_by(F.struct("author", "review_id"), F.struct(F.when(F.col("shelf").isin("read", "currently-reading"), 0).otherwise(1), "review_id")).alias("best"))
    titled, mates = _by_title(book, shelf, "author")
    words = lambda c: F.sort_array(F.filter(T.author_tokens(F.col(c)), lambda t: F.length(t) >= 2))
    theirs = mates.join(one.select("shelf_book_id", words("best.author").alias("theirs")), "shelf_book_id")
    theirs = theirs.groupBy("keys", "theirs").agg(F.count("*").alias("k"), F.min("shelf_book_id").alias("least"))
    titled = titled.withColumn("words", words("author"))
    shared = F.arrays_overlap("words", "theirs")
    kinds = titled.select("keys", "words").distinct().join(theirs, "keys")
    kinds = kinds.groupBy("keys", "words").agg(F.sum("k").alias("n"), F.min("least").alias("any"), F.sum(F.when(shared, F.col("k"))).alias("m"), F.min(F.when(shared, F.col("least"))).alias("by_author"))
    g = titled.join(kinds, ["keys", "words"]).groupBy("book_id").agg(F.sum("n").alias("n"), F.min("any").alias("any"), F.sum("m").alias("m"), F.min("by_author").alias("by_author"))
    pick = F.when(F.col("n") == 1, F.col("any")).when(F.col("m") == 1, F.col("by_author"))
    return book.select("book_id").join(g.select("book_id", pick.alias("shelf_book_id")), "book_id", "left")


def series_list(book: DataFrame) -> DataFrame:
    """(series_id, volumes, next_order): series but for a single standalone volume."""
    s = book.groupBy("series_id").agg(F.count("*").alias("volumes"), (F.max("book_order") + 1).alias("next_order"), F.count_if("standalone").alias("alone"))
    return s.where("not (volumes = 1 and alone = 1)").drop("alone")


def suggest_series(book: DataFrame, uploads: DataFrame) -> DataFrame:
    """(upload_id, series_id?, next_order): by hint (hint_name, hint_position), else the author's largest series."""
    stats = book.groupBy("series_id").agg(F.count("*").alias("volumes"), F.max("book_order").alias("top"), F.count_if("standalone").alias("alone"))
    by_author = book.where("author is not null").select("author", "series_id").distinct().join(stats.where("not (volumes = 1 and alone = 1)"), "series_id")
    best = by_author.groupBy("author").agg(F.min_by(F.struct("series_id", "top"), F.struct(-F.col("volumes"), "series_id")).alias("best"))
    u = uploads.withColumn("_hint", F.when(F.col("hint_name").isNotNull(), T.slug(F.col("hint_name"))))
    j = u.join(stats.select(F.col("series_id").alias("_hint"), F.col("top").alias("_top")), "_hint", "left").join(best, "author", "left")
    hinted = F.col("_hint").isNotNull()
    order = F.when(hinted, F.coalesce("hint_position", F.col("_top") + 1, F.lit(1))).otherwise(F.coalesce(F.col("best.top") + 1, F.lit(1)))
    return j.select("upload_id", F.when(hinted, F.col("_hint")).otherwise(F.col("best.series_id")).alias("series_id"), order.cast("long").alias("next_order"))


# -- unified view -----------------------------------------------------------

# Shelves of the unified view.
UNIFIED = {"to-read": "tbr", "currently-reading": "reading", "read": "completed"}
BY_STATUS = {"finished": "completed", "reading": "reading"}


def unified(shelf: DataFrame, book: DataFrame, progress: DataFrame, links: DataFrame, dnf_shelf: str | None = None) -> DataFrame:
    """Flat rows (bucket, group_rank, pos, entry_id, title, series): shelf entries and unlinked books in one view.

    Groups are series (or single books), latest date first; in a group volumes go by number, nulls last.
    """
    names = dict(UNIFIED, **({dnf_shelf: "dnf"} if dnf_shelf else {}))
    bucket = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("shelf"))
    linked = links.groupBy("shelf_book_id").agg(F.min("book_id").alias("book_id"))
    a = shelf.join(linked, "shelf_book_id", "left").select(
        bucket.alias("bucket"), F.concat(F.lit("s"), F.col("review_id").cast("string")).alias("entry_id"), T.strip_series(F.col("title")).alias("title"), T.series_of(F.col("title")).alias("series"),
        T.series_number(F.col("title")).alias("number"), F.coalesce(T.blank_to_null(F.col("date_read")), "date_added", F.lit("")).alias("touched"),
    ).where("bucket is not null")
    status = F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_STATUS.items() for x in kv]), F.coalesce("status", F.lit("unread")))
    b = book.join(links.select("book_id"), "book_id", "left_anti").join(progress.select("book_id", "status"), "book_id", "left").select(
        F.coalesce(status, F.lit("tbr")).alias("bucket"), F.concat(F.lit("b"), F.col("book_id").cast("string")).alias("entry_id"), "title", F.lit(None).cast("string").alias("series"),
        F.lit(None).cast("double").alias("number"), F.lit("").alias("touched"),
    )
    e = a.unionByName(b).withColumn("group_id", F.coalesce(F.concat(F.lit("g:"), "series"), F.col("entry_id")))
    groups = e.groupBy("bucket", "group_id").agg(F.max("touched").alias("anchor"))
    pos = F.row_number().over(Window.partitionBy("bucket", "group_id").orderBy(F.asc_nulls_last("number"), "entry_id"))
    return e.join(groups, ["bucket", "group_id"]).select("bucket", "anchor", "group_id", pos.cast("long").alias("pos"), "entry_id", "title", "series")
