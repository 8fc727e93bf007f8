"""Requests, links, conversations, digests and upkeep as queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import schema
from lectern.operators import causal, maintenance, progress, shelf
from lectern.operators import conversations as C
from lectern.operators.snapshots import Snapshots
from lectern.plans.queries import CITED, CORPUS, PAIR, PAIRS, UPLOAD, S, cited, corpus, uploads
from lectern.plans.registry import query
from lectern.plans.text_queries import concat
from lectern.sources import driver_tables as D
from lectern.tables import shared_dir

SPOT = "spot AS (SELECT book_id, max(chapter_idx) AS k FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b') GROUP BY book_id)"

# -- requests ---------------------------------------------------------------------------

REQUEST = "req AS (SELECT doc_id AS request_id, 0 AS reader_id, doc_id AS book_id, greatest(least(doc_id % 5 - 2, 2 - doc_id % 4), 0) AS a, greatest(doc_id % 5 - 2, 2 - doc_id % 4) AS b FROM documents)"


def requests(spark, d):
    """One span of chapters for each document; some are inverted, some begin or end below zero."""
    k = F.col("doc_id")
    return D.table(spark, d, "documents").select(k.alias("request_id"), F.lit(0).cast("long").alias("reader_id"), k.alias("book_id"), (k % 5 - 2).alias("lo_idx"), (2 - k % 4).alias("hi_idx"))


@query(f"""{CORPUS}, {REQUEST}, r AS (SELECT request_id, p.*, row_number() OVER (PARTITION BY request_id ORDER BY global_seq) AS nth FROM readable p JOIN req USING (reader_id, book_id) WHERE chapter_idx BETWEEN a AND b)
SELECT request_id, reader_id, book_id, chapter_idx, chapter_label, global_seq, text FROM r WHERE nth <= 800""")
def read_spans(spark, d):
    return corpus(spark, d).read(requests(spark, d))


@query(f"""{CORPUS}, {REQUEST}, x AS (SELECT request_id, count_if(global_seq BETWEEN lo AND hi) AS n, bool_or(lo IS NULL OR global_seq > hi) AS more FROM req JOIN para p USING (book_id) LEFT JOIN ranges r ON r.book_id = req.book_id
WHERE kind IN ('body', 'reference') AND chapter_idx BETWEEN a AND b GROUP BY request_id),
m AS (SELECT c.book_id, arg_max(label, start_seq) AS marker FROM servable c JOIN ranges r ON r.book_id = c.book_id AND start_seq BETWEEN lo AND hi GROUP BY c.book_id)
SELECT request_id, reader_id::BIGINT AS reader_id, q.book_id, coalesce(n, 0) > 800 AS capped, CASE WHEN more THEN marker END AS marker FROM req q LEFT JOIN x USING (request_id) LEFT JOIN m ON m.book_id = q.book_id""")
def read_notes(spark, d):
    return corpus(spark, d).read_notes(requests(spark, d))


@query(f"{CORPUS}, cited AS ({CITED}) SELECT reader_id, book_id, spine_idx, para_idx, chapter_idx, global_seq FROM readable JOIN cited USING (book_id, spine_idx, para_idx)")
def cited_points(spark, d):
    return corpus(spark, d).points(cited(spark, d))


@query(f"""WITH {D.EVENT_SQL}, s AS (SELECT *, count_if(action = 'reset') OVER (PARTITION BY reader_id, book_id ORDER BY ts, event_id) AS seg FROM event),
h AS (SELECT *, greatest(max(seq) OVER (PARTITION BY reader_id, book_id, seg ORDER BY ts, event_id), 0) AS c FROM s),
f AS (SELECT reader_id, book_id, arg_max(c, (ts, event_id)) AS c FROM h GROUP BY ALL) SELECT reader_id, max(c) AS ceiling_seq FROM f GROUP BY reader_id""")
def global_ceilings(spark, d):
    return progress.global_ceiling(progress.watermark_final(D.events(spark, d)))


# -- library and links ---------------------------------------------------------------------

LINKED = "lk AS (SELECT p_partkey AS book_id, 'old' || p_partkey AS shelf_book_id, CASE p_partkey % 5 WHEN 0 THEN 'manual' ELSE 'auto' END AS source FROM part WHERE p_partkey % 5 < 2)"
PROPOSED = "g AS (SELECT book_id, count(*) AS n, min(shelf_book_id) AS one FROM x GROUP BY book_id)"


def links(spark, d):
    k = F.col("p_partkey")
    return D.table(spark, d, "part").where(k % 5 < 2).select(k.alias("book_id"), concat("'old", "p_partkey").alias("shelf_book_id"), F.when(k % 5 == 0, "manual").otherwise("auto").alias("source"))


@query(f"""{S}, {UPLOAD}, {PAIRS}, {PROPOSED}, {LINKED}, p AS (SELECT book_id, one FROM g WHERE n = 1)
SELECT coalesce(lk.book_id, p.book_id) AS book_id, CASE WHEN source = 'manual' OR one IS NULL THEN shelf_book_id ELSE one END AS shelf_book_id, CASE WHEN source = 'manual' OR one IS NULL THEN source ELSE 'auto' END AS source FROM lk FULL JOIN p USING (book_id)""")
def links_applied(spark, d):
    """Proposals over all books, manual links kept."""
    return shelf.apply_links(links(spark, d), shelf.propose_links(uploads(spark, d).select("book_id", "title"), D.shelf(spark, d)))


@query(f"""{S}, {UPLOAD}, {PAIRS}, {PROPOSED}, {LINKED}, t AS (SELECT coalesce(n, 0) AS n FROM up LEFT JOIN g USING (book_id) WHERE book_id NOT IN (SELECT book_id FROM lk))
SELECT count_if(n = 1) AS linked, (SELECT count(*) FROM lk) AS already_linked, count_if(n > 1) AS ambiguous, count_if(n = 0) AS unmatched FROM t""")
def link_report(spark, d):
    book, known = uploads(spark, d).select("book_id", "title"), links(spark, d)
    return shelf.link_report(book, known, shelf.propose_links(book, D.shelf(spark, d), known))


@query(f"{S}, {UPLOAD}, {PAIRS} SELECT book_id, string_agg(shelf_book_id, ' ' ORDER BY shelf_book_id) AS candidates FROM (SELECT DISTINCT book_id, shelf_book_id FROM x) GROUP BY book_id HAVING count(*) > 1")
def link_candidates(spark, d):
    return shelf.link_candidates(uploads(spark, d), D.shelf(spark, d), " ")


@query(f"WITH {LINKED} SELECT * FROM lk WHERE book_id % 3 <> 0")
def links_removed(spark, d):
    return shelf.unlink(links(spark, d), D.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("book_id")))


@query("""WITH l AS (SELECT source, max(doc_id) AS top FROM documents GROUP BY source) SELECT doc_id AS book_id, source AS series_id, top AS book_order, top AS occupant FROM documents JOIN l USING (source) WHERE doc_id <> top""")
def slot_conflicts(spark, d):
    """Every book asks for the last place of its series; the one that holds it is in nobody's way."""
    book = D.books(spark, d)
    last = book.groupBy("series_id").agg(F.max("book_order").alias("book_order"))
    return shelf.slot_conflicts(book, book.select("book_id", "series_id").join(last, "series_id"))


@query(f"""{CORPUS}, rd AS (SELECT r.book_id, CASE WHEN count(c.book_id) > 0 THEN CAST(round_even(count_if(start_seq BETWEEN lo AND hi) * 100.0 / count(c.book_id), 0) AS BIGINT) ELSE 0 END AS pct
  FROM ranges r LEFT JOIN (SELECT * FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b')) c USING (book_id) GROUP BY r.book_id)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY book_order) - 1 AS pos, b.book_id, title, coalesce(status, 'unread') AS status, coalesce(pct, 0) AS percent, count(*) OVER (PARTITION BY series_id) = 1 AND standalone AS standalone
FROM book b LEFT JOIN progress USING (book_id) LEFT JOIN rd ON rd.book_id = b.book_id""")
def library_tree(spark, d):
    para, chapter = D.paras(spark, d)
    state = D.progress(spark, d, chapter)
    return shelf.library_tree(D.books(spark, d), state, corpus(spark, d).chapters_read())


@query(f"""{S}, v AS (SELECT *, CASE WHEN shelf = 'read' THEN try_strptime(substr(date_read, 1, 7), '%Y-%m') END AS mo FROM shelf),
t AS (SELECT coalesce(date_diff('month', min(mo), max(mo)) + 1, 0) AS months, sum(num_pages) FILTER (shelf = 'read') AS pages, sum(num_pages) FILTER (shelf = 'to-read') AS backlog FROM v)
SELECT months, round(pages / months, 6) AS pace, round(backlog / (pages / months), 6) AS horizon,
CASE WHEN months = 0 OR pages = 0 THEN 'no history' WHEN backlog = 0 THEN 'caught up' WHEN backlog / (pages / months) < 1.5 THEN 'weeks' WHEN backlog / (pages / months) < 20 THEN 'months' ELSE 'years' END AS kind FROM t""")
def reading_pace(spark, d):
    return shelf.pace(D.shelf(spark, d))


@query(f"""{S}, m AS (SELECT review_id, shelf_book_id, cover_small AS cover FROM shelf), c AS (SELECT 'b' || p_partkey AS shelf_book_id, 'covers/' || p_partkey || '.jpg' AS path FROM part)
SELECT review_id, m.shelf_book_id, coalesce(nullif(cover, ''), path) AS cover FROM m LEFT JOIN c USING (shelf_book_id)""")
def month_covers(spark, d):
    part = D.table(spark, d, "part")
    link = part.select(F.col("p_partkey").alias("book_id"), concat("'b", "p_partkey").alias("shelf_book_id"))
    return maintenance.month_covers(D.shelf(spark, d).select("review_id", "shelf_book_id", F.col("cover_small").alias("cover")), link, part.select(F.col("p_partkey").alias("book_id"), concat("'covers/", "p_partkey", "'.jpg").alias("path")))


@query(f"""{S} SELECT review_id, CASE WHEN CAST(substr(shelf_book_id, 2) AS BIGINT) % 4 = 0 AND CAST(substr(shelf_book_id, 2) AS BIGINT) < (SELECT count(*) FROM part) THEN 'Found, ' || substr(shelf_book_id, 2) ELSE genres END AS genres FROM shelf""")
def genres_applied(spark, d):
    k = F.col("p_partkey")
    got = D.table(spark, d, "part").where(k % 4 == 0).select(concat("'b", "p_partkey").alias("shelf_book_id"), F.array(F.lit("Found"), k.cast("string")).alias("genres"))
    return maintenance.apply_genres(D.shelf(spark, d), got).select("review_id", "genres")


@query("""SELECT 'k' || c_custkey AS key, CASE c_custkey % 3 WHEN 1 THEN 'new' ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT 'k-' || c_custkey, 'added' FROM customer WHERE c_custkey % 7 = 0""")
def settings_put(spark, d):
    k = F.col("c_custkey")
    now = D.table(spark, d, "customer").select(concat("'k", "c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    change = D.table(spark, d, "customer").where(k % 3 < 2).select(concat("'k", "c_custkey").alias("key"), F.when(k % 3 == 1, "new").alias("value"))
    fresh = D.table(spark, d, "customer").where(k % 7 == 0).select(concat("'k-", "c_custkey").alias("key"), F.lit("added").alias("value"))
    return maintenance.put_settings(now, change.unionByName(fresh))


# -- conversations ---------------------------------------------------------------------------


def turns(spark, d):
    return C.turn_pairs(D.table(spark, d, "conversations"))


@query(f"""WITH {PAIR}, n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, text AS question FROM conversations WHERE role = 'user'), l AS (SELECT conv_id, max(ord) AS last FROM t GROUP BY conv_id)
SELECT * FROM t UNION ALL SELECT conv_id, coalesce(last, -1) + nth, question, 'again' FROM n LEFT JOIN l USING (conv_id)""")
def turns_appended(spark, d):
    new = D.table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("question"), F.lit("again").alias("answer"))
    return C.append_turns(turns(spark, d), new)


@query(f"WITH {PAIR} SELECT * FROM t WHERE conv_id % 4 > 0")
def turns_deleted(spark, d):
    return C.delete(turns(spark, d), D.table(spark, d, "conversations").where("conv_id % 4 = 0"))


def talks(spark, d):
    k = F.col("conv_id")
    book = (k * 13 % 301).alias("book_id")
    return D.table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", book, (k * 7 % 101).alias("updated_at"), concat("'Talk ", "conv_id").alias("title"), (k % 6).alias("chapter_idx"))


TALK = "talk AS (SELECT DISTINCT conv_id, conv_id * 13 % 301 AS book_id, conv_id * 7 % 101 AS updated_at, 'Talk ' || conv_id AS title, conv_id % 6 AS chapter_idx FROM conversations)"


@query(f"WITH {TALK} SELECT book_id, max(updated_at) AS latest, string_agg(conv_id, ' ' ORDER BY updated_at DESC, conv_id DESC) AS conv_ids FROM talk WHERE book_id IN (SELECT doc_id FROM documents) GROUP BY book_id")
def talks_grouped(spark, d):
    return C.grouped(talks(spark, d), D.books(spark, d)).select("book_id", "latest", F.array_join(F.transform("conv_ids", lambda c: c.cast("string")), " ").alias("conv_ids"))


@query(f"WITH {TALK} SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Named ' || conv_id ELSE title END AS title FROM talk")
def talks_renamed(spark, d):
    t = talks(spark, d)
    return C.rename(t, t.where("conv_id % 2 = 0").select("conv_id", concat("'Named ", "conv_id").alias("title"))).select("conv_id", "title")


@query(f"""{CORPUS}, {TALK}, {SPOT} SELECT conv_id, t.book_id, t.chapter_idx, CASE WHEN t.chapter_idx >= k THEN 'Finished' ELSE label END AS label
FROM talk t LEFT JOIN spot ON spot.book_id = t.book_id LEFT JOIN chapter c ON c.book_id = t.book_id AND c.chapter_idx = t.chapter_idx""")
def position_labels(spark, d):
    return C.position_labels(talks(spark, d).select("conv_id", "book_id", "chapter_idx"), D.chapters(D.raw_paras(spark, d)))


# -- causal windows and digests ---------------------------------------------------------------


@query(f"{CORPUS} SELECT p.book_id, p.chapter_idx, global_seq, text FROM para p WHERE chapter_idx = book_id % 3 AND kind <> 'excerpt'")
def causal_texts(spark, d):
    """One chapter of each book, as of its own end."""
    para, chapter = D.paras(spark, d)
    asked = chapter.where("chapter_idx = book_id % 3 and kind <> 'excerpt'").select("book_id", "chapter_idx", F.col("end_seq").alias("bound_seq"))
    return causal.causal_text(para, chapter, asked).select("book_id", "chapter_idx", "global_seq", "text")


@query(f"{CORPUS} SELECT p.book_id, p.chapter_idx, global_seq FROM para p WHERE kind <> 'excerpt' AND global_seq BETWEEN book_id * {schema.BOOK_STRIDE} + 2 AND book_id * {schema.BOOK_STRIDE} + 2 * {schema.SPINE_STRIDE} + 11")
def causal_ranges(spark, d):
    """From the third paragraph of each book to the twelfth."""
    para, _ = D.paras(spark, d)
    floor = schema.book_floor(F.col("book_id"))
    end = (floor + 2 * schema.SPINE_STRIDE + 11).alias("end_seq")
    asked = D.books(spark, d).select("book_id", (floor + 2).alias("start_seq"), end, (floor + 3 * schema.SPINE_STRIDE).alias("bound_seq"))
    return causal.causal_range(para, asked).select("book_id", "chapter_idx", "global_seq")


@query(f"{CORPUS} SELECT book_id, chapter_idx FROM chapter WHERE kind <> 'excerpt' AND NOT (chapter_idx % 2 = 0 AND book_id % 3 = 0 AND book_id % 4 > 0)")
def digests_pending(spark, d):
    """Done are even chapters, of an older prompt in two of three books and an older version in every fourth."""
    c, k = D.chapters(D.raw_paras(spark, d)), F.col("book_id")
    done = c.where("chapter_idx % 2 = 0").select("book_id", "chapter_idx", F.when(k % 3 == 0, "now").otherwise("old").alias("prompt_hash"), F.when(k % 4 == 0, 1).otherwise(2).alias("schema_version"))
    return causal.pending(c, done, "now", 2).select("book_id", "chapter_idx")


DIGEST = """c AS (SELECT book_id, chapter_idx, part_label, start_seq AS lo, end_seq AS hi FROM chapter WHERE kind = 'body'),
dg AS (SELECT book_id, 'chapter' AS level, 1 AS rk, lo, hi FROM c UNION ALL SELECT book_id, 'part', 2, min(lo), max(hi) FROM c GROUP BY book_id, part_label UNION ALL SELECT book_id, 'book', 3, min(lo), max(hi) FROM c GROUP BY book_id)"""


def digests(chapter):
    c = chapter.where("kind = 'body'").select("book_id", "chapter_idx", "part_label", F.col("start_seq").alias("lo"), F.col("end_seq").alias("hi"), F.col("label").alias("text"))
    up = causal.digest_rollup(c).select("book_id", "level", F.lit(None).cast("long").alias("chapter_idx"), "part_label", "lo", "hi", "text")
    return c.select("book_id", F.lit("chapter").alias("level"), "chapter_idx", "part_label", "lo", "hi", "text").unionByName(up)


@query(f"""{CORPUS}, {DIGEST}, ok AS (SELECT r.reader_id, dg.* FROM dg JOIN ranges r ON dg.book_id = r.book_id AND dg.hi <= r.hi)
SELECT reader_id, book_id, level, lo, hi FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.book_id = a.book_id AND b.reader_id = a.reader_id AND b.rk > a.rk AND b.lo <= a.lo AND a.hi <= b.hi)""")
def digests_served(spark, d):
    tables = D.paras(spark, d)
    r = corpus(spark, d, tables).ranges.select("reader_id", "book_id", F.col("hi").alias("ceiling"))
    return causal.servable_digests(digests(tables[1]).select("book_id", "level", "lo", "hi"), r).select("reader_id", "book_id", "level", "lo", "hi")


@query(f"""{CORPUS}, c AS (SELECT book_id, chapter_idx, part_label, label FROM chapter WHERE kind = 'body')
SELECT book_id, 'chapter' AS level, chapter_idx, part_label, CASE WHEN chapter_idx % 2 = 0 THEN 'new' ELSE label END AS text FROM c
UNION ALL SELECT book_id, 'part', NULL, part_label, string_agg(label, chr(10) ORDER BY chapter_idx) FROM c GROUP BY book_id, part_label UNION ALL SELECT DISTINCT book_id, 'book', NULL, NULL, 'whole' FROM c""")
def digests_replaced(spark, d):
    """New digests of even chapters and of every book; a missing chapter or part matches a missing one."""
    old = digests(D.paras(spark, d)[1])
    new = old.where("level = 'chapter' and chapter_idx % 2 = 0").withColumn("text", F.lit("new")).unionByName(old.where("level = 'book'").withColumn("text", F.lit("whole")))
    return causal.replace_digests(old, new).select("book_id", "level", "chapter_idx", "part_label", "text")


# -- upkeep -----------------------------------------------------------------------------------


@query(f"""{CORPUS}, n AS (SELECT book_id, start_seq AS first_seq, label AS designator FROM chapter WHERE kind <> 'boilerplate')
SELECT c.book_id, c.chapter_idx, (SELECT count(DISTINCT designator) FROM n WHERE n.book_id = c.book_id AND first_seq < c.start_seq)::INTEGER AS n_known, (SELECT count(*) FROM para1 p WHERE p.book_id = c.book_id AND p.chapter_idx = c.chapter_idx)::INTEGER AS n_paras
FROM chapter c WHERE kind <> 'excerpt'""")
def prompt_payloads(spark, d):
    """Sizes of each chapter's payload; the labels of earlier chapters are what is known."""
    para, chapter = D.paras(spark, d)
    nodes = chapter.where("kind <> 'boilerplate'").select("book_id", F.col("label").alias("designator"), F.col("start_seq").alias("first_seq"))
    read = F.from_json("payload", "registry array<string>, paragraphs array<struct<global_seq:long,text:string>>")
    return maintenance.prompt_payloads(para, nodes, chapter).select("book_id", "chapter_idx", F.size(read["registry"]).alias("n_known"), F.size(read["paragraphs"]).alias("n_paras"))


@query(f"""{CORPUS}, c AS (SELECT book_id, count(*) AS chapters, count_if(kind = 'body') AS body, count_if(kind = 'excerpt') AS excerpt, min(start_seq) AS start_seq, max(end_seq) AS end_seq FROM chapter GROUP BY book_id)
SELECT book_id, title, chapters, body, excerpt, start_seq, end_seq, paragraphs FROM c JOIN book USING (book_id) JOIN (SELECT book_id, count(*) AS paragraphs FROM para1 GROUP BY book_id) USING (book_id)""")
def book_manifests(spark, d):
    """Manifests written as JSON and read again."""
    para, chapter = D.paras(spark, d)
    read = F.from_json("manifest", "title string, chapters long, body long, excerpt long, start_seq long, end_seq long, paragraphs long")
    return maintenance.manifests(D.books(spark, d), chapter, para).select("book_id", read.alias("m")).select("book_id", "m.*")


@query(f"""{CORPUS}, {TALK} SELECT 'book' AS name, count(*) AS n FROM book WHERE book_id % 5 > 0 UNION ALL SELECT 'para', count(*) FROM para WHERE book_id % 5 > 0 UNION ALL SELECT 'progress', count(*) FROM progress WHERE book_id % 5 > 0
UNION ALL SELECT 'conversation', count(*) FROM talk WHERE book_id % 5 > 0 UNION ALL SELECT 'turn', count(*) FROM conversations WHERE conv_id IN (SELECT conv_id FROM talk WHERE book_id % 5 > 0)""")
def books_deleted(spark, d):
    """Rows that stay in each table when every fifth book goes."""
    para, chapter = D.paras(spark, d)
    book = D.books(spark, d)
    tables = {"book": book, "para": para, "progress": D.progress(spark, d, chapter), "conversation": talks(spark, d), "turn": D.table(spark, d, "conversations")}
    out = None
    for name, t in maintenance.delete_books(tables, book.where("book_id % 5 = 0")).items():
        counted = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


# -- syncs and versions -------------------------------------------------------------------------

FETCHES = """took AS (SELECT (j * 3 + k)::BIGINT AS fetch_id, j::BIGINT AS sync_id, ['read', 'to-read', 'currently-reading'][k + 1] AS shelf, (j + k) % 3 = 1 AS truncated, (100 + j * 10 + (k * 2 + j) % 3)::BIGINT AS moment, NOT (j = 3 AND k = 1) AS ok
  FROM (SELECT unnest(range(6)) AS j) a, (SELECT unnest(range(3)) AS k) b),
item AS (SELECT fetch_id, review_id, title || ' #' || sync_id AS title, num_pages, 'd' || sync_id AS date_added, s.shelf FROM
  (SELECT review_id, title, num_pages, j, ['read', 'to-read', 'currently-reading'][((CASE WHEN (review_id * j) % 7 = 3 THEN 1 ELSE 0 END + CASE shelf.shelf WHEN 'read' THEN 0 WHEN 'to-read' THEN 1 ELSE 2 END) % 3) + 1] AS shelf FROM shelf, (SELECT unnest(range(6)) AS j) x WHERE (review_id + j) % 4 > 0) s
  JOIN took f ON f.sync_id = j AND f.shelf = s.shelf),
good AS (SELECT *, row_number() OVER (ORDER BY moment) AS step FROM took WHERE sync_id NOT IN (SELECT sync_id FROM took WHERE NOT ok))"""


def _fetches(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shelf, six syncs of three fetches each in shifting order, some cut short and one sync broken, and their items: three
    of four reviews a time, some of them moved to the next shelf."""
    s = D.shelf(spark, d)
    names = F.array(F.lit("read"), F.lit("to-read"), F.lit("currently-reading"))
    j, k = F.col("j"), F.col("k")
    grid = spark.range(18).select(F.floor(F.col("id") / 3).alias("j"), (F.col("id") % 3).alias("k"))
    fetches = grid.select((j * 3 + k).alias("fetch_id"), j.alias("sync_id"), F.get(names, k.cast("int")).alias("shelf"), ((j + k) % 3 == 1).alias("truncated"), (100 + j * 10 + (k * 2 + j) % 3).alias("at"), (~((j == 3) & (k == 1))).alias("ok"))
    moved = F.when((F.col("review_id") * j) % 7 == 3, 1).otherwise(0) + F.when(F.col("shelf") == "read", 0).when(F.col("shelf") == "to-read", 1).otherwise(2)
    seen = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5)))).where((F.col("review_id") + j) % 4 > 0).withColumn("k", moved % 3)
    items = seen.select(
        (j * 3 + k).cast("long").alias("fetch_id"), "review_id", "shelf_book_id", F.concat("title", F.lit(" #"), j).alias("title"), "author", F.get(names, k).alias("shelf"), "num_pages", "published_year", "user_rating", "date_read", F.concat(F.lit("d"), j).alias("date_added")
    )
    return s, fetches, items


@query(f"""WITH RECURSIVE {D.SHELF_SQL}, {FETCHES},
st AS (SELECT 0::BIGINT AS step, review_id, shelf, title, date_added, date_started, true AS there FROM shelf
  UNION ALL SELECT g.step, st.review_id, coalesce(i.shelf, st.shelf), coalesce(i.title, st.title), CASE WHEN i.review_id IS NOT NULL AND NOT there THEN i.date_added ELSE st.date_added END,
    CASE WHEN i.review_id IS NOT NULL AND NOT there THEN NULL ELSE date_started END, i.review_id IS NOT NULL OR (there AND (truncated OR st.shelf <> g.shelf))
  FROM st JOIN good g ON g.step = st.step + 1 LEFT JOIN item i ON i.fetch_id = g.fetch_id AND i.review_id = st.review_id)
SELECT review_id, shelf, title, date_added, date_started FROM st WHERE there AND step = (SELECT max(step) FROM good)""")
def sync_replay(spark, d):
    """The shelf after a log of fetches; the twin takes one fetch after the other."""
    return shelf.replay_syncs(*_fetches(spark, d)).select("review_id", "shelf", "title", "date_added", "date_started")


@query(f"""WITH {D.SHELF_SQL}, {FETCHES}, n AS (SELECT g.sync_id, g.shelf, g.truncated, count(i.review_id) AS n FROM good g LEFT JOIN item i USING (fetch_id) GROUP BY ALL)
SELECT sync_id, CAST(sum(n) AS BIGINT) AS total_books, '{{' || string_agg('"' || shelf || '":' || n, ',' ORDER BY shelf) || '}}' AS shelf_counts, '[' || coalesce(string_agg('"' || shelf || '"', ',' ORDER BY shelf) FILTER (truncated), '') || ']' AS truncated_shelves FROM n GROUP BY sync_id""")
def sync_reports(spark, d):
    _, fetches, items = _fetches(spark, d)
    return shelf.sync_reports(fetches, items)


def _versions(spark, d) -> Snapshots:
    """Even books; then multiples of four again with half of their chapters, and odd multiples of three; then back to the first."""
    store = Snapshots(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}")
    raw = D.raw_paras(spark, d)
    tables = {"book": D.books(spark, d).select("book_id", "title"), "chapter": D.chapters(raw).select("book_id", "chapter_idx", "kind"), "para": raw.select("book_id", "chapter_idx", "text")}
    b = F.col("book_id")
    store.commit({n: t.where(b % 2 == 0) for n, t in tables.items()})
    again = {n: t.where((b % 4 == 0) | (b % 6 == 3)) for n, t in tables.items()}
    again = {n: t if n == "book" else t.where(F.col("chapter_idx") % 2 == 0) for n, t in again.items()}
    again["book"] = again["book"].withColumn("title", F.concat("title", F.lit(" again")))
    store.commit(again, again["book"].select("book_id"))
    store.rollback(1)
    return store


@query(f"""{CORPUS}, v AS (SELECT 1 AS version, book_id, title, false AS half FROM book WHERE book_id % 2 = 0 UNION ALL SELECT 2, book_id, CASE WHEN book_id % 4 = 2 THEN title ELSE title || ' again' END, book_id % 4 <> 2 FROM book WHERE book_id % 2 = 0 OR book_id % 6 = 3
UNION ALL SELECT 3, book_id, title, false FROM book WHERE book_id % 2 = 0)
SELECT version, v.book_id, title, (SELECT count(*) FROM chapter c WHERE c.book_id = v.book_id AND NOT (half AND chapter_idx % 2 = 1)) AS chapters, (SELECT count(*) FROM para1 p WHERE p.book_id = v.book_id AND NOT (half AND chapter_idx % 2 = 1)) AS paragraphs FROM v""")
def table_versions(spark, d):
    """What each version of the tables holds of each book."""
    store, out = _versions(spark, d), None
    for version in store.versions:
        count = lambda name: store.table(name, version).groupBy("book_id").agg(F.count("*").alias(name))  # noqa: B023, E731
        held = store.table("book", version).join(count("chapter"), "book_id", "left").join(count("para"), "book_id", "left")
        rows = held.select(F.lit(version).alias("version"), "book_id", "title", F.coalesce("chapter", F.lit(0)).alias("chapters"), F.coalesce("para", F.lit(0)).alias("paragraphs"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""{CORPUS}, f AS (SELECT book_id, title, text, book_id % 3 > 0 AS held, book_id % 3 = 0 OR book_id % 5 = 0 AS asked FROM book JOIN documents ON doc_id = book_id WHERE text IS NOT NULL),
n AS (SELECT book_id, count(DISTINCT chapter_idx) AS chapters, count(*) AS paragraphs, count_if(kind = 'excerpt') AS excerpt_paragraphs FROM para GROUP BY book_id),
w AS (SELECT *, false AS skipped FROM f WHERE asked AND text NOT IN (SELECT text FROM f WHERE held) UNION ALL SELECT *, true FROM f WHERE held AND text IN (SELECT text FROM f WHERE asked))
SELECT book_id, title, sha256(text) AS sha256, coalesce(chapters, 0) AS chapters, coalesce(paragraphs, 0) AS paragraphs, coalesce(excerpt_paragraphs, 0) AS excerpt_paragraphs, skipped FROM w LEFT JOIN n USING (book_id)""")
def ingest_summary(spark, d):
    """Two of three books are there; the others are asked for, and every fifth once more, and what is there by its text is skipped."""
    store = Snapshots(spark, f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}")
    para, chapter = D.paras(spark, d)
    book = D.books(spark, d).join(D.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("book_id"), F.sha2("text", 256).alias("sha256")), "book_id")
    tables = {"book": book.select("book_id", "title", "sha256"), "chapter": chapter.select("book_id", "chapter_idx"), "para": para.select("book_id", "kind", "text")}
    b = F.col("book_id")
    some = lambda ok: {n: t.join(book.where(ok).select("book_id"), "book_id", "left_semi") for n, t in tables.items()}
    store.ingest(some(b % 3 > 0), force=True)
    return store.ingest(some((b % 3 == 0) | (b % 5 == 0)))


@query(f"""{CORPUS}, cited AS ({CITED}), ranked AS (SELECT *, count(*) OVER (PARTITION BY reader_id, book_id) - row_number() OVER (PARTITION BY reader_id, book_id ORDER BY global_seq) AS after FROM readable),
m AS (SELECT reader_id, c.book_id, arg_max(label, start_seq) FILTER (start_seq <= hi) AS marker FROM servable c JOIN ranges r USING (book_id) GROUP BY ALL HAVING bool_or(end_seq > hi))
SELECT r.reader_id, r.book_id, global_seq AS cited_seq, CASE WHEN after < 3 THEN marker END AS marker FROM ranked r JOIN cited USING (book_id, spine_idx, para_idx) LEFT JOIN m ON m.reader_id = r.reader_id AND m.book_id = r.book_id""")
def context_notes(spark, d):
    return corpus(spark, d).context_notes(cited(spark, d), 3)


@query(f"""{S}, {UPLOAD}, {PAIRS}, g AS (SELECT book_id, count(*) AS n, min(shelf_book_id) AS one FROM x GROUP BY book_id)
SELECT book_id, CASE WHEN book_id % 5 = 0 THEN 'b' || (book_id % 50) ELSE one END AS shelf_book_id, CASE WHEN book_id % 5 = 0 THEN 'manual' ELSE 'auto' END AS source FROM up LEFT JOIN g USING (book_id) WHERE book_id % 5 = 0 OR n = 1""")
def links_chosen(spark, d):
    """Links found by title for all books, then a person's choice for every fifth, which a second automatic round leaves alone."""
    books = uploads(spark, d).select("book_id", "title")
    proposed = shelf.propose_links(books, D.shelf(spark, d))
    none = proposed.limit(0).select("book_id", F.col("candidate").alias("shelf_book_id"), F.lit("").alias("source"))
    k = F.col("book_id")
    chosen = books.where(k % 5 == 0).select("book_id", F.concat(F.lit("b"), (k % 50).cast("string")).alias("shelf_book_id"))
    return shelf.apply_proposed(shelf.set_links(shelf.apply_proposed(none, proposed), chosen), proposed)


@query(f"""WITH {PAIR}, c AS (SELECT DISTINCT conv_id, conv_id % 7 AS book_id, 'kept' AS title, conv_id % 3 AS chapter_idx, 5::BIGINT AS created_at, 5::BIGINT AS updated_at FROM conversations
UNION ALL SELECT DISTINCT conv_id + 1000000, conv_id % 11, '', conv_id % 2, 9, 9 FROM conversations WHERE conv_id % 4 = 0)
SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.conv_id) AS turn_count FROM c WHERE conv_id % 2 = 0""")
def conv_opened(spark, d):
    """New conversations beside those with turns, and what is found of the even ones and of as many that do not exist."""
    m = D.table(spark, d, "conversations")
    k, ids = F.col("conv_id"), m.select("conv_id").distinct()
    held = ids.select("conv_id", (k % 7).alias("book_id"), F.lit("kept").alias("title"), (k % 3).alias("chapter_idx"), F.lit(5).cast("long").alias("created_at"), F.lit(5).cast("long").alias("updated_at"))
    new = ids.where(k % 4 == 0).select((k + 1_000_000).alias("conv_id"), (k % 11).alias("book_id"), (k % 2).alias("chapter_idx"), F.lit(9).cast("long").alias("at"))
    known = C.create(held, new)
    asked = known.where(k % 2 == 0).select("conv_id").unionByName(ids.select((-1 - k).alias("conv_id")))
    return C.get(known, C.turn_pairs(m), asked)
