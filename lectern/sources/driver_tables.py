"""Deterministic views of the driver's tables in the shape of the reading model.

Every view has a Spark form here and a SQL twin in ``SQL``; the twins are what the oracle queries build on.
``book_order`` is the document's id, which is monotone in its series and needs no numbering pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.operators.chapters import classify_kinds
from lectern.tables import stored

PARAS_PER_CHAPTER = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("book_id"),
        F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("Author "), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.col("source").alias("series_id"),
        F.col("doc_id").alias("book_order"),
        (F.col("doc_id") % 9 == 0).alias("standalone"),
    )


def text_lines() -> Column:
    """Non-empty lines of ``text`` with single spaces."""
    return F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(F.regexp_replace(x, "[ \\t\\n\\x0B\\f\\r]+", " "))), lambda x: x != "")


def raw_paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: non-empty lines with single spaces, numbered in their document without a shuffle."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text_lines()).alias("n", "text"))
    chapter = F.floor(F.col("n") / PARAS_PER_CHAPTER)
    seq = schema.global_seq(F.col("doc_id"), chapter, F.col("n").cast("long"))
    return rows.select(F.col("doc_id").alias("book_id"), chapter.alias("spine_idx"), F.col("n").cast("long").alias("para_idx"), seq.alias("global_seq"), chapter.alias("chapter_idx"), "text")


def chapters(paras: DataFrame) -> DataFrame:
    """Chapters of ``raw_paras`` with labels by rule and kinds by the classifier."""
    bounds = paras.groupBy("book_id", "chapter_idx").agg(F.min("global_seq").alias("start_seq"), F.max("global_seq").alias("end_seq"))
    c = bounds.withColumn("last_idx", F.max("chapter_idx").over(Window.partitionBy("book_id")))
    at, book, last = F.col("chapter_idx"), F.col("book_id"), F.col("last_idx")
    label = (
        F.when((at == 0) & (last >= 2) & (book % 5 == 0), "Copyright")
        .when((at == 0) & (last >= 2) & (book % 5 == 1), "Dramatis Personae")
        .when((at == last) & (last >= 3) & (book % 4 == 0), "Glossary")
        .when((at == last) & (last >= 3) & (book % 4 == 1), F.lit("Excerpt from the next volume"))
        .when(at % 10 == 9, F.concat(F.lit("Part "), F.floor(at / 10 + 2).cast("string")))
        .otherwise(F.concat(F.lit("Chapter "), at.cast("string")))
    )
    part = F.concat(F.lit("Part "), F.floor((at + 1) / 10 + 1).cast("string"))
    labelled = c.select("book_id", "chapter_idx", label.alias("label"), part.alias("part_label"), "start_seq", "end_seq")
    return classify_kinds(labelled)


def paras(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(para, chapter) with labels and kinds; chapters are written first, as most queries read them more than once."""
    raw = raw_paras(spark, sf_dir)
    chapter = stored(chapters(raw), "chapters")
    kinds = chapter.select("book_id", "chapter_idx", F.col("label").alias("chapter_label"), "kind")
    return raw.join(kinds, ["book_id", "chapter_idx"]), chapter


def progress(spark: SparkSession, sf_dir: str, chapter: DataFrame) -> DataFrame:
    """One reader's state: good books are finished, others read to the end of chapter 1, unlabelled ones unread."""
    servable = chapter.where(schema.servable(F.col("kind")))
    ends = servable.groupBy("book_id").agg(F.max("end_seq").alias("book_end"), F.max(F.when(F.col("chapter_idx") == 1, F.col("end_seq"))).alias("ch1_end"), F.max("chapter_idx").alias("last_idx"))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumnRenamed("doc_id", "book_id")
    done = F.col("quality") == 1
    return marks.join(ends, "book_id", "left").select(
        F.lit(0).cast("long").alias("reader_id"),
        "book_id",
        F.when(done, "finished").otherwise("reading").alias("status"),
        F.when(done, F.col("last_idx")).otherwise(F.lit(1)).cast("long").alias("position_chapter_idx"),
        F.coalesce(F.when(done, F.col("book_end")).otherwise(F.coalesce("ch1_end", "book_end")), F.lit(0)).cast("long").alias("ceiling_seq"),
    )


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shelf entry an order."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    keyed = orders.withColumn("p_partkey", F.col("o_orderkey") % max(part.count(), 1))
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    suffix = F.concat(F.lit(" ("), F.col("p_brand"), F.lit(", #"), F.col("p_size").cast("string"), F.lit(")"))
    return keyed.join(part, "p_partkey").select(
        k.alias("review_id"),
        F.concat(F.lit("b"), (k % 5000).cast("string")).alias("shelf_book_id"),
        F.concat(F.col("p_name"), F.when(k % 3 < 2, suffix).otherwise(F.lit(""))).alias("title"),
        F.col("p_brand").alias("author"),
        F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "to-read").otherwise("currently-reading").alias("shelf"),
        F.when(k % 7 != 0, (k % 900 + 50).cast("long")).alias("num_pages"),
        F.when(k % 11 != 0, (k % 124 + 1900).cast("long")).alias("published_year"),
        F.when(k % 4 != 0, (k % 5 + 1).cast("long")).alias("user_rating"),
        F.when(k % 13 != 0, F.concat_ws(", ", "p_type", "o_orderpriority", F.lit("Audiobook"))).alias("genres"),
        F.when(F.col("o_orderstatus") == "F", F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 17 == 0, F.substring(date, 1, 7)).when(k % 19 == 0, F.substring(date, 1, 4)).otherwise(date)).alias("date_read"),
        F.when(k % 6 != 0, F.date_format(F.date_sub(F.to_date("o_orderdate"), (k % 60 - 10).cast("int")), "yyyy-MM-dd")).alias("date_started"),
        date.alias("date_added"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, "https://covers.example/s").alias("cover_small"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position events: clicks and views set, sign-ups reset."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "set").when(F.col("event_type") == "signup", "reset")
    return e.select(F.col("user_id").alias("reader_id"), (F.col("user_id") % 3).alias("book_id"), "ts", "event_id", kind.alias("action"), F.floor(F.col("value") * 100).alias("seq")).where("action is not null")


NL, WS = "chr(10)", "'[ \\t\\n\\x0B\\f\\r]+'"

# SQL twins, as common table expressions to be joined by commas.
BOOK_SQL = """book AS (SELECT doc_id AS book_id, 'Book ' || doc_id AS title, 'Author ' || (doc_id % 7) AS author, source AS series_id, doc_id AS book_order,
  doc_id % 9 = 0 AS standalone FROM documents)"""
PARA0_SQL = f"""
lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, {NL}), lambda x: trim(regexp_replace(x, {WS}, ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
para0 AS (SELECT doc_id AS book_id, unnest(ls) AS text, unnest(generate_series(0, len(ls) - 1)) AS para_idx FROM lines WHERE len(ls) > 0),
para1 AS (SELECT book_id, para_idx // {PARAS_PER_CHAPTER} AS spine_idx, para_idx, para_idx // {PARAS_PER_CHAPTER} AS chapter_idx,
  book_id * {schema.BOOK_STRIDE} + (para_idx // {PARAS_PER_CHAPTER}) * {schema.SPINE_STRIDE} + para_idx AS global_seq, text FROM para0)"""


def _sql_regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def chapter_sql() -> str:
    from lectern.operators.chapters import BOILERPLATE, EXCERPT, NARRATIVE, REFERENCE

    front = f"(regexp_matches(label, {_sql_regex(REFERENCE)}) OR regexp_matches(label, {_sql_regex(BOILERPLATE)}))"
    return f"""
span AS (SELECT book_id, chapter_idx, min(global_seq) AS start_seq, max(global_seq) AS end_seq FROM para1 GROUP BY ALL),
span1 AS (SELECT *, max(chapter_idx) OVER (PARTITION BY book_id) AS last_idx FROM span),
labelled AS (SELECT book_id, chapter_idx, CASE
    WHEN chapter_idx = 0 AND last_idx >= 2 AND book_id % 5 = 0 THEN 'Copyright'
    WHEN chapter_idx = 0 AND last_idx >= 2 AND book_id % 5 = 1 THEN 'Dramatis Personae'
    WHEN chapter_idx = last_idx AND last_idx >= 3 AND book_id % 4 = 0 THEN 'Glossary'
    WHEN chapter_idx = last_idx AND last_idx >= 3 AND book_id % 4 = 1 THEN 'Excerpt from the next volume'
    WHEN chapter_idx % 10 = 9 THEN 'Part ' || (chapter_idx // 10 + 2)
    ELSE 'Chapter ' || chapter_idx END AS label, 'Part ' || ((chapter_idx + 1) // 10 + 1) AS part_label, start_seq, end_seq FROM span1),
k1 AS (SELECT *, count(*) OVER b AS n, coalesce(min(CASE WHEN regexp_matches(trim(label), {_sql_regex(NARRATIVE)}) THEN chapter_idx END) OVER b, 0) AS s
  FROM labelled WINDOW b AS (PARTITION BY book_id)),
k2 AS (SELECT *, coalesce(min(CASE WHEN regexp_matches(label, {_sql_regex(EXCERPT)}) AND chapter_idx >= s THEN chapter_idx END) OVER (PARTITION BY book_id), n) AS x FROM k1),
k3 AS (SELECT *, coalesce(max(CASE WHEN NOT {front} AND chapter_idx >= s AND chapter_idx < x THEN chapter_idx END) OVER (PARTITION BY book_id), s - 1) AS l FROM k2),
chapter AS (SELECT book_id, chapter_idx, label, part_label, start_seq, end_seq, CASE
    WHEN chapter_idx < s THEN CASE WHEN regexp_matches(label, {_sql_regex(REFERENCE)}) THEN 'reference' ELSE 'boilerplate' END
    WHEN chapter_idx >= x THEN 'excerpt' WHEN chapter_idx > l THEN 'boilerplate' ELSE 'body' END AS kind FROM k3),
para AS (SELECT p.*, c.label AS chapter_label, c.kind FROM para1 p JOIN chapter c USING (book_id, chapter_idx)),
servable AS (SELECT * FROM chapter WHERE kind IN ('body', 'reference')),
ends AS (SELECT book_id, max(end_seq) AS book_end, max(CASE WHEN chapter_idx = 1 THEN end_seq END) AS ch1_end, max(chapter_idx) AS last_idx FROM servable GROUP BY book_id),
progress AS (SELECT 0::BIGINT AS reader_id, m.book_id, CASE WHEN quality = 1 THEN 'finished' ELSE 'reading' END AS status,
  (CASE WHEN quality = 1 THEN last_idx ELSE 1 END)::BIGINT AS position_chapter_idx,
  coalesce(CASE WHEN quality = 1 THEN book_end ELSE coalesce(ch1_end, book_end) END, 0)::BIGINT AS ceiling_seq
  FROM (SELECT doc_id AS book_id, max(quality) AS quality FROM labels GROUP BY doc_id) m LEFT JOIN ends USING (book_id)),
ranges AS (SELECT reader_id, book_id, book_order * {schema.BOOK_STRIDE} AS lo, ceiling_seq AS hi FROM progress JOIN book USING (book_id)
  WHERE ceiling_seq > 0 AND ceiling_seq >= book_order * {schema.BOOK_STRIDE}),
readable AS (SELECT r.reader_id, p.* FROM para p JOIN ranges r ON p.book_id = r.book_id AND p.global_seq BETWEEN r.lo AND r.hi WHERE kind IN ('body', 'reference'))"""


SHELF_SQL = """shelf_order AS (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS o_partkey FROM orders),
shelf AS (SELECT o_orderkey AS review_id, 'b' || (o_orderkey % 5000) AS shelf_book_id,
  p_name || CASE WHEN o_orderkey % 3 < 2 THEN ' (' || p_brand || ', #' || p_size || ')' ELSE '' END AS title, p_brand AS author,
  CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'to-read' ELSE 'currently-reading' END AS shelf,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 900 + 50 END AS num_pages, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 124 + 1900 END AS published_year,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 + 1 END AS user_rating,
  CASE WHEN o_orderkey % 13 <> 0 THEN p_type || ', ' || o_orderpriority || ', Audiobook' END AS genres,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y-%m')
    WHEN o_orderkey % 19 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS date_read,
  CASE WHEN o_orderkey % 6 <> 0 THEN strftime(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 - 10 AS INTEGER), '%Y-%m-%d') END AS date_started,
  strftime(o_orderdate, '%Y-%m-%d') AS date_added,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://covers.example/s' END AS cover_small
  FROM shelf_order JOIN part ON p_partkey = o_partkey)"""
EVENT_SQL = """event AS (SELECT user_id AS reader_id, user_id % 3 AS book_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'set' ELSE 'reset' END AS action,
  CAST(floor(value * 100) AS BIGINT) AS seq FROM events WHERE event_type IN ('view', 'click', 'signup'))"""


def corpus_sql() -> str:
    """All common table expressions of the bounded corpus."""
    return f"WITH {BOOK_SQL},{PARA0_SQL},{chapter_sql()}"
