"""Scalar functions and sources as queries over the driver's tables, with SQL twins that state the expected text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chapters
from lectern.operators import conversations as C
from lectern.operators.retrieval import printed_identity
from lectern.plans.queries import PAIR, S
from lectern.plans.registry import query
from lectern.sources import driver_tables as D
from lectern.sources import feeds
from lectern.tables import stored


def concat(*parts):
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("'") else F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def by_turn(key, *cases):
    """The case whose number is the key's remainder."""
    out = F.lit(None)
    for i, case in enumerate(cases):
        out = F.when(key % len(cases) == i, case).otherwise(out)
    return out


# -- names and ids --------------------------------------------------------------------


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_type || ' / ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM part")
def slugs(spark, d):
    return D.table(spark, d, "part").select("p_partkey", T.slug(concat("p_type", "' / ", "p_name", "'!")).alias("slug"))


@query("""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(replace(replace(p_type, ' ', '-') || '_' || p_brand, '_', '-'), '-'), lambda w: w <> ''),
lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS name FROM part""")
def humanized_names(spark, d):
    return D.table(spark, d, "part").select("p_partkey", T.humanize(concat(F.replace("p_type", F.lit(" "), F.lit("-")), "'_", "p_brand")).alias("name"))


@query(f"WITH {D.PARA0_SQL} SELECT book_id || ':' || spine_idx || ':p' || para_idx AS citation, CAST(book_id AS VARCHAR) AS book, spine_idx, para_idx, NULL::BIGINT AS broken FROM para1")
def citation_ids(spark, d):
    """Ids made and read again; a malformed one reads as nulls."""
    made = D.raw_paras(spark, d).select(T.citation_id(F.col("book_id"), F.col("spine_idx"), F.col("para_idx")).alias("citation"))
    broken = T.parse_citation(F.concat("citation", F.lit("x")))["para_idx"]
    return made.select("citation", *[c.alias(n) for n, c in T.parse_citation(F.col("citation")).items()], broken.alias("broken"))


def answers(spark, d):
    k = F.col("doc_id")
    one, two = concat("'[", "doc_id", "':", (k % 4).cast("string"), "':p", (k % 7).cast("string"), "']"), concat("'[", (k % 5).cast("string"), "':0:p1]")
    return D.table(spark, d, "documents").select(k.alias("conv_id"), concat("'See ", one, "' and ", two, "'; not [x y:1:p2] or [a:b:p1], again ", two).alias("answer"))


ONE, TWO = "doc_id || ':' || (doc_id % 4) || ':p' || (doc_id % 7)", "(doc_id % 5) || ':0:p1'"
CITED = f"cited AS (SELECT doc_id AS conv_id, CASE WHEN {ONE} = {TWO} THEN [{ONE}] ELSE [{ONE}, {TWO}] END AS ids FROM documents)"


@query(f"WITH {CITED} SELECT conv_id, '[\"' || array_to_string(ids, '\",\"') || '\"]' AS stored, len(ids)::INTEGER AS n FROM cited")
def citations_stored(spark, d):
    """Citations of answers as JSON, and how many are read back."""
    return answers(spark, d).select("conv_id", T.citations_json(T.citations(F.col("answer"))).alias("stored")).select("conv_id", "stored", F.size(T.citations_from_json(F.col("stored"))).alias("n"))


@query(f"WITH {CITED} SELECT citation, count(*) AS times FROM (SELECT unnest(ids) AS citation FROM cited) GROUP BY citation")
def citation_counts(spark, d):
    return C.citation_counts(answers(spark, d))


@query(r"""WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN '...' WHEN 3 THEN p_name || '.EPUB' ELSE p_type || ': ' || p_name || ' (' || p_brand || ') [' || p_size || ']' END AS base FROM part),
g AS (SELECT *, trim(regexp_replace(base, '[^A-Za-z0-9 ._()\[\]-]+', '_', 'g'), ' ._') AS safe FROM f)
SELECT p_partkey, CASE WHEN safe = '' THEN p_partkey || '.epub' WHEN ends_with(lower(safe), '.epub') THEN safe ELSE safe || '.epub' END AS name FROM g""")
def file_names(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 4, "shelf/...").when(k % 5 == 3, concat("p_name", "'.EPUB")).otherwise(concat("'shelf/x/", "p_type", "': ", "p_name", "' (", "p_brand", "') [", "p_size", "']"))
    return D.table(spark, d, "part").select("p_partkey", T.safe_file_name(name, k).alias("name"))


@query(f"""{S}, r AS (SELECT review_id, shelf, coalesce(genres, '') || ' , ' || upper(shelf) || ',, own ' AS raw FROM shelf)
SELECT review_id, unnest(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> shelf)) AS custom FROM r""")
def custom_shelves(spark, d):
    raw = concat(F.coalesce("genres", F.lit("")), "' , ", F.upper("shelf"), "',, own ")
    return D.shelf(spark, d).select("review_id", F.explode(T.custom_shelves(raw, F.col("shelf"))).alias("custom"))


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS review FROM pages")
def review_ids(spark, d):
    k = F.col("page_id")
    guid = concat("url", "'/review/show/", "page_id", by_turn(k, F.lit(""), F.lit("?utm=a"), F.lit("/"), F.lit("#b")))
    return D.table(spark, d, "pages").select("page_id", T.review_id(guid).alias("review"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN CAST(c_custkey AS VARCHAR) END AS user_id FROM customer")
def user_ids(spark, d):
    k = F.col("c_custkey")
    given = by_turn(k, concat("' ", "c_custkey", "' "), concat("'https://books.example/user/show/", "c_custkey", "'-name"), concat("'https://books.example/review/list/", "c_custkey", "'?shelf=read"), F.lit("nobody"))
    return D.table(spark, d, "customer").select("c_custkey", T.user_id(given).alias("user_id"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'prologue' WHEN 1 THEN 'interlude: ' || lower(source) WHEN 2 THEN CAST(doc_id AS VARCHAR) WHEN 3 THEN CAST(doc_id AS VARCHAR) WHEN 4 THEN NULL ELSE 'epilogue' END AS ref FROM documents""")
def printed_names(spark, d):
    k = F.col("doc_id")
    label = by_turn(k, F.lit("Prologue"), concat("'Interlude: ", "source"), concat("'Chapter 00", "doc_id", "'."), concat("doc_id", "': The House"), concat("'Part ", "doc_id"), F.lit("  EPILOGUE "))
    return D.table(spark, d, "documents").select("doc_id", printed_identity(label).alias("ref"))


@query("SELECT page_id, substr(sha256(coalesce(html, '')), 1, 16) AS hash FROM pages")
def prompt_hashes(spark, d):
    return D.table(spark, d, "pages").select("page_id", T.prompt_hash(F.coalesce("html", F.lit(""))).alias("hash"))


# -- text -----------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS short, length(text) // 4 AS tokens, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INTEGER AS words FROM documents")
def text_sizes(spark, d):
    t = F.col("text")
    return D.table(spark, d, "documents").select("doc_id", T.ellipsize(t, 80).alias("short"), T.token_estimate(t).alias("tokens"), T.word_count(t).alias("words"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, sha256(trim(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), ' ' || chr(10) || chr(9))) AS sha FROM p""")
def stripped_pages(spark, d):
    return D.table(spark, d, "pages").select("page_id", F.sha2(T.strip_html(F.col("html")), 256).alias("sha"))


@query(r"""SELECT doc_id, sha256(([text, trim(text, ' ' || chr(9) || chr(10) || chr(13)), text, '```json' || chr(10) || text, 'python' || chr(10) || 'of'])[doc_id % 5 + 1]) AS sha FROM
(SELECT doc_id, replace(replace(coalesce(text, ''), '`', ''), chr(13), '') AS text FROM documents)""")
def fenced_bodies(spark, d):
    """Texts as they are, in a fence of JSON, in one on a line of its text, in one that is not closed, and in one of another language."""
    text = F.translate(F.coalesce("text", F.lit("")), "`\r", "")
    bare = F.regexp_replace(text, r"^[ \t\n]+|[ \t\n]+$", "")
    k = F.col("doc_id") % 5
    given = F.when(k == 0, text).when(k == 1, F.concat(F.lit("\n```json \n"), bare, F.lit("\n``` \n"))).when(k == 2, F.concat(F.lit("```json{"), text, F.lit("}```"))).when(k == 3, F.concat(F.lit("```json\n"), text)).otherwise(F.lit("```python\nof\n```"))
    body = T.code_fence_body(given)
    return D.table(spark, d, "documents").select("doc_id", F.sha2(F.when(k == 2, F.btrim(body, F.lit("{}"))).otherwise(body), 256).alias("sha"))



ROMAN = " || ".join(f"(['', '{a}', '{a}{a}', '{a}{a}{a}', '{a}{b}', '{b}', '{b}{a}', '{b}{a}{a}', '{b}{a}{a}{a}', '{a}{c}'])[n // {u} % 10 + 1]" for u, a, b, c in ((100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")))


@query(f"WITH o AS (SELECT o_orderkey, o_orderkey % 4100 AS n FROM orders) SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 3999 THEN repeat('M', CAST(n // 1000 AS INTEGER)) || {ROMAN} ELSE CAST(n AS VARCHAR) END AS numeral FROM o")
def roman_numerals(spark, d):
    return D.table(spark, d, "orders").select("o_orderkey", T.roman(F.col("o_orderkey") % 4100).alias("numeral"))


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-07:00' END AS iso FROM events")
def feed_dates(spark, d):
    given = F.when(F.col("event_id") % 9 == 0, "Foo, 99 Bar 2019").otherwise(concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), "' -0700"))
    return D.table(spark, d, "events").select("event_id", T.rfc_date(given).alias("iso"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') END AS day,
CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS exact, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders""")
def review_dates(spark, d):
    at = lambda f: F.date_format("o_orderdate", f)
    given = T.review_date(by_turn(F.col("o_orderkey"), at("MMM d, yyyy"), at("MMM yyyy"), at("yyyy"), F.lit("not set")))
    return D.table(spark, d, "orders").select("o_orderkey", given.alias("day")).select("o_orderkey", "day", T.exact_day(F.col("day")).alias("exact"), T.month_key(F.col("day")).alias("month"))


# -- chapter markers and tiers ---------------------------------------------------------


@query("""SELECT doc_id, (['chapter', 'part', 'part', 'part', 'prologue', 'epilogue', 'chapter', NULL])[doc_id % 8 + 1] AS kind,
([ 'Chapter ' || doc_id, 'Part 3', 'Part IV', 'Part ' || doc_id, 'Prologue', 'Epilogue', 'Chapter ' || doc_id, NULL])[doc_id % 8 + 1] AS label FROM documents""")
def marker_shapes(spark, d):
    k = F.col("doc_id")
    given = by_turn(k, concat("'CHAPTER ", "doc_id", "': x"), F.lit(" Part Three"), F.lit("PART iv"), concat("'part ", "doc_id"), F.lit("Prologue to it"), F.lit("  EPILOGUE"), concat("' ", "doc_id", "' "), F.lit("Chaptered"))
    marker = chapters.parse_marker(given)
    return D.table(spark, d, "documents").select("doc_id", marker["kind"].alias("kind"), marker["label"].alias("label"))


@query("""WITH e AS (SELECT o_custkey AS book_id, o_orderkey AS entry_idx, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey // 3 ELSE o_orderkey % 97 END AS spine_idx FROM orders),
s AS (SELECT book_id, spine_idx >= lag(spine_idx) OVER (PARTITION BY book_id ORDER BY entry_idx) AS ok FROM e)
SELECT book_id, bool_and(coalesce(ok, true)) AS monotonic FROM s GROUP BY book_id""")
def contents_in_order(spark, d):
    k = F.col("o_orderkey")
    spine = F.when(F.col("o_custkey") % 2 == 0, F.floor(k / 3)).otherwise(k % 97)
    return chapters.is_monotonic(D.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), k.alias("entry_idx"), spine.alias("spine_idx")))


TIERS = f"""WITH {D.PARA0_SQL}, doc AS (SELECT DISTINCT book_id, spine_idx FROM para1), n AS (SELECT book_id, count(*) AS n, max(spine_idx) AS top FROM doc GROUP BY book_id),
f AS (SELECT *, CASE WHEN book_id % 4 = 0 THEN 'L1' WHEN book_id % 4 = 1 AND (top // 2 + 1) >= 0.3 * n THEN 'L2' WHEN book_id % 4 = 2 AND (top // 4 + 1) >= 0.2 * n THEN 'L3' ELSE 'L4' END AS label_tier FROM n)"""


def _tier_inputs(spark, d):
    """Books in turn with contents of every second document, headings, marker-shaped first blocks, and a table out of order."""
    k, i = F.col("book_id"), F.col("spine_idx")
    docs = D.raw_paras(spark, d).select("book_id", "spine_idx").distinct()
    toc = docs.where((k % 4 == 0) & (i % 2 == 0) | (k % 4 == 3)).select("book_id", F.when(k % 4 == 3, -i).otherwise(i).alias("entry_idx"), "spine_idx", concat("'Entry ", "spine_idx").alias("label"))
    heading, first = F.when((k % 4 == 1) & (i % 2 == 0), concat("'Head ", "spine_idx")), F.when((k % 4 == 2) & (i % 4 == 0), concat("'CHAPTER ", "spine_idx")).otherwise("text")
    return docs.select("book_id", "spine_idx", heading.alias("heading"), first.alias("first_block")), toc


@query(f"{TIERS} SELECT book_id, CASE WHEN book_id % 4 = 3 AND n = 1 THEN 'L1' ELSE label_tier END AS label_tier FROM f")
def label_tiers(spark, d):
    return chapters.choose_tier(*_tier_inputs(spark, d))


@query(f"""{TIERS} SELECT book_id, spine_idx, CASE WHEN book_id % 4 = 3 AND n = 1 THEN 'L1' ELSE label_tier END AS label_tier,
CASE WHEN book_id % 4 = 3 AND n = 1 THEN 'Entry 0' WHEN label_tier = 'L1' THEN CASE WHEN spine_idx % 2 = 0 THEN 'Entry ' || spine_idx END WHEN label_tier = 'L2' THEN CASE WHEN spine_idx % 2 = 0 THEN 'Head ' || spine_idx END
WHEN label_tier = 'L3' THEN CASE WHEN spine_idx % 4 = 0 THEN 'Chapter ' || spine_idx END ELSE 'Section ' || (spine_idx + 1) END AS marker FROM doc JOIN f USING (book_id)""")
def tier_markers(spark, d):
    return chapters.tier_labels(*_tier_inputs(spark, d))


@query(f"""WITH {D.PARA0_SQL}, doc AS (SELECT DISTINCT book_id, spine_idx FROM para1), c AS (SELECT book_id, unnest(generate_series(2 * spine_idx, 2 * spine_idx + spine_idx % 3)) AS spine_idx FROM doc),
n AS (SELECT book_id, spine_idx, count(*) AS n FROM c GROUP BY ALL) SELECT book_id, spine_idx, coalesce(n, 0) AS n FROM doc FULL JOIN n USING (book_id, spine_idx) WHERE coalesce(n, 0) <> 1""")
def coverage_errors(spark, d):
    """Chapters of one to three documents that leave gaps and overlap."""
    docs = D.raw_paras(spark, d).select("book_id", "spine_idx").distinct()
    start = 2 * F.col("spine_idx")
    return chapters.coverage_errors(docs.select("book_id", start.alias("start_spine"), (start + F.col("spine_idx") % 3).alias("end_spine")), docs)


# -- parts, shelves, dates -------------------------------------------------------------

PART_TOC = f"""WITH {D.PARA0_SQL}, doc AS (SELECT DISTINCT book_id, spine_idx FROM para1), n AS (SELECT book_id, count(*) AS n FROM doc GROUP BY book_id),
fit AS (SELECT book_id FROM n WHERE n > 2 AND book_id % 3 = 0 OR n > 1 AND book_id % 3 = 1)"""


def _part_contents(spark, d):
    """Contents that name a part twice for each document but the first two, a part for each, or parts out of order."""
    k, i = F.col("book_id"), F.col("spine_idx")
    docs = stored(D.raw_paras(spark, d).select("book_id", "spine_idx").distinct(), "documents-of-books")
    label = F.when((k % 3 == 0) & (i < 1), concat("'Chapter ", "spine_idx")).otherwise(concat("'PART ", "spine_idx", "': x"))
    one = docs.select("book_id", F.when(k % 3 == 2, -i).otherwise(2 * i).alias("entry_idx"), "spine_idx", label.alias("label"))
    again = one.where(k % 3 == 0).select("book_id", (F.col("entry_idx") + 1).alias("entry_idx"), "spine_idx", F.when(i > 0, "Part Nine").otherwise("x").alias("label"))
    return docs, one.unionByName(again)


@query(f"""{PART_TOC} SELECT book_id, spine_idx AS start_spine, 'Part ' || spine_idx AS part_label FROM doc JOIN n USING (book_id)
WHERE book_id % 3 = 0 AND n > 1 AND spine_idx > 0 OR book_id % 3 = 1 AND n > 1""")
def toc_parts(spark, d):
    return chapters.toc_parts(_part_contents(spark, d)[1])


@query(f"""{PART_TOC} SELECT book_id, CASE WHEN book_id % 3 < 2 AND n > 1 THEN 'L1+L4' WHEN book_id % 3 = 2 AND n > 1 THEN 'L4' ELSE 'L1' END AS label_tier FROM n""")
def label_ladder(spark, d):
    """Contents are kept from covering the books by further documents without entries."""
    docs, toc = _part_contents(spark, d)
    more = F.array("spine_idx", F.col("spine_idx") + 10_000, F.col("spine_idx") + 20_000)
    counted = docs.withColumn("n", F.count("*").over(Window.partitionBy("book_id")))
    all_docs = counted.select("book_id", F.explode(F.when(F.col("n") > 1, more).otherwise(F.array("spine_idx"))).alias("spine_idx"))
    return chapters.label_ladder(all_docs.withColumns({"heading": F.lit(None).cast("string"), "first_block": F.lit("text")}), toc)


@query(f"{D.corpus_sql()} SELECT book_id, bool_or(kind = 'body') AS has_body FROM chapter GROUP BY book_id")
def body_checks(spark, d):
    return chapters.body_checks(D.chapters(D.raw_paras(spark, d)))


@query("""WITH h AS (SELECT s_suppkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s_name, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) % 7 AS h FROM supplier)
SELECT s_suppkey, (['#1e3a5f', '#3d1f1f', '#1a2e1a', '#2e2410', '#1f1f3a', '#2a1f0e', '#0e2a2a'])[h + 1] AS colour FROM h""")
def series_colours(spark, d):
    return D.table(spark, d, "supplier").select("s_suppkey", T.series_colour(F.col("s_name")).alias("colour"))


@query("SELECT p_partkey, floor(150.5 + 16 * (greatest(96, least(1088, CASE WHEN p_partkey % 9 = 0 THEN 466 ELSE p_size * 25 END)) - 96) / 992)::BIGINT AS height FROM part")
def spine_heights(spark, d):
    pages = F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 25)
    return D.table(spark, d, "part").select("p_partkey", T.spine_height(pages).alias("height"))


@query("""WITH e AS (SELECT event_id, ts, (CASE event_id % 3 WHEN 0 THEN event_id % 70 WHEN 1 THEN event_id % 1500 ELSE event_id % 20000 END)::BIGINT AS m FROM events),
f AS (SELECT *, floor(m / 60 + 0.5)::BIGINT AS h FROM e), g AS (SELECT *, floor(h / 24 + 0.5)::BIGINT AS dd FROM f)
SELECT event_id, strftime(ts, '%-d %B %Y') AS day, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || ' hr ago' WHEN dd = 1 THEN '1 day ago' WHEN dd < 7 THEN dd || ' days ago' ELSE strftime(ts, '%-d %b %Y') END AS ago FROM g""")
def dates_shown(spark, d):
    k = F.col("event_id")
    minutes = F.when(k % 3 == 0, k % 70).when(k % 3 == 1, k % 1500).otherwise(k % 20000)
    now = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + minutes.cast("long") * 60_000_000)
    return D.table(spark, d, "events").select("event_id", T.long_date(F.col("ts")).alias("day"), T.relative_date(F.col("ts").cast("timestamp"), now).alias("ago"))


@query(f"""WITH {PAIR}, u AS (SELECT conv_id, ord, question, 'See [b' || conv_id || ':1:p' || ord || '] and [x:2:p3], [b' || conv_id || ':1:p' || ord || '].' AS answer FROM t)
SELECT conv_id, ord, 2 + 2 * (row_number() OVER w - 1) AS n_messages, (length('Text of ' || conv_id) + length(question) + coalesce(sum(length(question) + length(answer)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS prompt_chars,
'b' || conv_id || ':1:p' || ord || ' x:2:p3' AS cited FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY ord)""")
def turn_results(spark, d):
    """Answers are replaced by ones that cite."""
    talk = D.table(spark, d, "conversations")
    cite = concat("'[b", "conv_id", "':1:p", "ord", "']")
    turns = C.turn_pairs(talk).withColumn("answer", F.concat(F.lit("See "), cite, F.lit(" and [x:2:p3], "), cite, F.lit(".")))
    prefix = talk.select("conv_id").distinct().select("conv_id", concat("'Text of ", "conv_id").alias("text"))
    return C.turn_results(turns, prefix).withColumn("cited", F.array_join("citations", " ")).drop("citations")


# -- sources --------------------------------------------------------------------------


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS review_id, 'b' || o_custkey AS shelf_book_id, 'Title & <' || o_orderkey || '>' AS title, o_orderpriority AS author, (o_orderkey % 900)::INTEGER AS num_pages,
nullif(o_orderkey % 6, 0)::INTEGER AS user_rating, 'read' AS shelf, strftime(o_orderdate, '%Y-%m-%dT00:00:00-07:00') AS date_added, NULL::VARCHAR AS date_read FROM orders""")
def feed_rows(spark, d):
    """One feed of one item for each order, read as XML."""
    tag = lambda name, value: concat(f"'<{name}>", value, f"'</{name}>")
    item = F.concat(
        tag("guid", concat("'https://books.example/review/show/", "o_orderkey", "'?utm=x")), tag("book_id", concat("'b", "o_custkey")), tag("title", concat("'Title &amp; &lt;", "o_orderkey", "'&gt;")), tag("author_name", "o_orderpriority"),
        tag("user_rating", (F.col("o_orderkey") % 6).cast("string")), tag("user_date_added", concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy"), "' 00:00:00 -0700")), tag("user_read_at", F.lit("soon")),
        tag("book", tag("num_pages", (F.col("o_orderkey") % 900).cast("string"))),
    )
    xml = concat("'<rss><channel><item>", item, "'</item></channel></rss>")
    rows = feeds.parse_feeds(D.table(spark, d, "orders").select(F.lit("read").alias("shelf"), xml.alias("xml")))
    return rows.select("review_id", "shelf_book_id", "title", "author", "num_pages", "user_rating", "shelf", "date_added", "date_read")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS review_id, 'A & B ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m') AS date_started, strftime(o_orderdate, '%Y-%m-%d') AS date_read,
NULL::VARCHAR AS date_added, (o_orderkey % 3)::INTEGER AS read_count, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 900 + 1000)::INTEGER END AS num_pages FROM orders""")
def review_table_rows(spark, d):
    """One review table of one row for each order, read as HTML."""
    cell = lambda name, value: concat(f"'<td class='field {name}'><label>x</label><div class='value'>", value, "' <a href='#'>edit</a></div></td>")
    k = F.col("o_orderkey")
    pages = F.when(k % 2 == 0, concat("'1,", F.lpad((k % 900).cast("string"), 3, "0"), "' pp")).otherwise("—")
    row = F.concat(cell("title", concat("'<b>A &amp; B</b> ", "o_orderkey")), cell("date_started", F.date_format("o_orderdate", "MMM yyyy")), cell("date_read", F.date_format("o_orderdate", "MMM d, yyyy")), cell("date_added", F.lit("not set")), cell("read_count", (k % 3).cast("string")), cell("num_pages", pages))
    html = concat("'<table><tr id='review_", "o_orderkey", "'' class='bookalike'>", row, "'</tr><tr id='review_template'><td></td></tr></table>")
    return feeds.parse_review_tables(D.table(spark, d, "orders").select(html.alias("html")))


@query("SELECT p_partkey, unnest(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END) AS genre FROM part")
def scraped_genres(spark, d):
    genre = lambda c: concat("'{\"name\":\"", c, "'\" , \"webUrl\":\"https://books.example/genres/", c, "'\"}")
    page = concat("'<script>[", genre("p_type"), "',", genre("p_brand"), "',{\"name\":\"No\",\"webUrl\":\"https://books.example/lists/No\"},", genre("p_type"), "']</script>")
    return D.table(spark, d, "part").select("p_partkey", F.explode(feeds.genres(page)).alias("genre"))
