"""The catalogue: each operator as a query over the driver's tables, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as T
from lectern.operators import causal, chapters, conversations, maintenance, progress, retrieval, search, shelf
from lectern.operators.lexical import LexicalIndex, Near, Phrase, has
from lectern.operators.retrieval import BoundedCorpus
from lectern.plans.registry import query
from lectern.sources import driver_tables as D
from lectern.tables import small_batches, still_there, stored

CORPUS = D.corpus_sql()


def corpus(spark: SparkSession, d: str, tables: tuple[DataFrame, DataFrame] | None = None) -> BoundedCorpus:
    para, chapter = tables or D.paras(spark, d)
    return BoundedCorpus(D.books(spark, d), chapter, para, stored(D.progress(spark, d, chapter), "progress"))


# -- bounded retrieval --------------------------------------------------------


@query(f"{CORPUS} SELECT reader_id, book_id, chapter_idx, chapter_label, global_seq, text FROM readable")
def bounded_read(spark, d):
    return corpus(spark, d).read()


@query(f"""{CORPUS} SELECT DISTINCT p.reader_id, p.book_id FROM para t JOIN progress p USING (book_id) WHERE kind IN ('body', 'reference')
AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.book_id = t.book_id AND r.reader_id = p.reader_id AND t.global_seq BETWEEN r.lo AND r.hi)""")
def clamp_flag(spark, d):
    return corpus(spark, d).clamped()


@query(f"""{CORPUS} SELECT 0::BIGINT AS reader_id, b.book_id, title, author, series_id, book_order, coalesce(p.status, 'unread') AS status, c.label AS current_chapter
FROM book b LEFT JOIN progress p USING (book_id) LEFT JOIN ranges r ON r.book_id = b.book_id
LEFT JOIN servable c ON c.book_id = b.book_id AND c.chapter_idx = p.position_chapter_idx AND c.start_seq BETWEEN r.lo AND r.hi""")
def list_books(spark, d):
    return corpus(spark, d).list_books()


@query(f"{CORPUS} SELECT reader_id, c.book_id, chapter_idx, label, part_label, kind FROM servable c JOIN ranges r ON c.book_id = r.book_id AND start_seq BETWEEN lo AND hi")
def list_chapters(spark, d):
    return corpus(spark, d).list_chapters()


@query(f"""{CORPUS} SELECT reader_id, r.book_id, count_if(start_seq BETWEEN lo AND hi) AS n_read, count(c.book_id) AS n_total,
CASE WHEN count(c.book_id) > 0 THEN CAST(round_even(count_if(start_seq BETWEEN lo AND hi) * 100.0 / count(c.book_id), 0) AS BIGINT) ELSE 0 END AS pct
FROM ranges r LEFT JOIN (SELECT * FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b')) c USING (book_id) GROUP BY ALL""")
def chapters_read_pct(spark, d):
    return corpus(spark, d).chapters_read()


@query(f"""{CORPUS} SELECT p.reader_id, c.book_id, chapter_idx, CASE WHEN start_seq <= coalesce(hi, -1) THEN label END AS label,
regexp_matches(label, '(?i)^\\s*part\\b') AS is_divider, start_seq <= coalesce(hi, -1) AS unlocked
FROM chapter c JOIN progress p USING (book_id) LEFT JOIN ranges r ON r.book_id = c.book_id WHERE kind = 'body'""")
def position_picker(spark, d):
    return corpus(spark, d).list_positions()


@query(f"""{CORPUS} SELECT reader_id, c.book_id, arg_max(label, start_seq) FILTER (start_seq <= hi) AS marker FROM servable c JOIN ranges r USING (book_id)
GROUP BY reader_id, c.book_id HAVING bool_or(end_seq > hi)""")
def truncation_marker(spark, d):
    return corpus(spark, d).truncation_markers()


@query(f"{CORPUS} SELECT book_id, min(global_seq) AS min_seq, max(global_seq) AS max_seq FROM para WHERE kind IN ('body', 'reference') GROUP BY book_id")
def book_spans(spark, d):
    return corpus(spark, d).book_spans()


CITED = "SELECT doc_id AS book_id, doc_id % 4 AS spine_idx, (doc_id % 4) * 5 + doc_id % 3 AS para_idx FROM documents"


def cited(spark, d):
    k = F.col("doc_id")
    return D.table(spark, d, "documents").select(k.alias("book_id"), (k % 4).alias("spine_idx"), ((k % 4) * 5 + k % 3).alias("para_idx"))


@query(f"""{CORPUS}, cited AS ({CITED}), ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_id, book_id ORDER BY global_seq) AS nth FROM readable),
centre AS (SELECT r.reader_id, r.book_id, r.nth, r.global_seq AS cited_seq FROM ranked r JOIN cited USING (book_id, spine_idx, para_idx))
SELECT c.reader_id, c.book_id, cited_seq, r.global_seq, r.text FROM centre c JOIN ranked r ON r.reader_id = c.reader_id AND r.book_id = c.book_id AND abs(r.nth - c.nth) <= 3""")
def context_window(spark, d):
    return corpus(spark, d).context(cited(spark, d), 3)


@query(f"""{CORPUS}, cited AS ({CITED}), b AS (SELECT book_id, min(global_seq) AS lo_seq, max(global_seq) AS hi_seq FROM para WHERE kind IN ('body', 'reference') GROUP BY book_id)
SELECT reader_id, r.book_id, global_seq, least(greatest((global_seq - lo_seq) / greatest(hi_seq - lo_seq, 1), 0.0), 1.0) AS fraction FROM readable r JOIN cited USING (book_id, spine_idx, para_idx) JOIN b ON b.book_id = r.book_id""")
def citation_marks(spark, d):
    return corpus(spark, d).citation_marks(cited(spark, d))


TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
ENTITIES = "SELECT DISTINCT list_aggregate(toks[1:2], 'string_agg', ' ') AS entity FROM (SELECT " + TOKENS + " AS toks FROM benchmark) WHERE len(toks) >= 2"


@query(f"""{CORPUS}, e AS ({ENTITIES}), t AS (SELECT *, {TOKENS} AS toks FROM readable),
h AS (SELECT t.*, e.entity FROM (SELECT *, unnest(list_distinct(toks)) AS w FROM t) t JOIN e ON w = split_part(entity, ' ', 1)
  AND contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || entity || ' ')),
f AS (SELECT reader_id, entity, arg_min(struct_pack(b := book_id, c := chapter_label, s := global_seq), global_seq) AS hit FROM h GROUP BY ALL)
SELECT 0::BIGINT AS reader_id, e.entity, hit.b AS book_id, coalesce(hit.c, 'not yet seen') AS chapter, hit.s AS global_seq FROM e LEFT JOIN f USING (entity)""")
def first_seen(spark, d):
    words = search.tokens(F.col("text"))
    e = D.table(spark, d, "benchmark").where(F.size(words) >= 2).select(F.lit(0).cast("long").alias("reader_id"), F.array_join(F.slice(words, 1, 2), " ").alias("entity"))
    return corpus(spark, d).first_seen(e, index(spark, d))


_INDEXES: dict[tuple[str, str], LexicalIndex] = {}


def index(spark: SparkSession, d: str) -> LexicalIndex:
    """The stored index of a folder's paragraphs, built once in an application, and again if its files are gone."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES or not still_there(_INDEXES[key].lengths):
        _INDEXES[key] = LexicalIndex.build(D.paras(spark, d)[0])
    return _INDEXES[key]


def at_sql(words: str, prefix: bool = False) -> str:
    """Where a phrase begins in ``toks``, by comparing slices."""
    w = words.split()
    same = [f"toks[i + {j}] = '{x}'" for j, x in enumerate(w)]
    if prefix:
        same[-1] = f"starts_with(toks[i + {len(w) - 1}], '{w[-1]}')"
    return f"list_filter(range(1, len(toks) + 1), lambda i: coalesce({' AND '.join(same)}, false))"


def score_sql(n: int, n_all: str = "n_all", words: str = "n_words") -> str:
    return "0.0 " + " ".join(
        f"- greatest(ln(({n_all} - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * len(at{i}) * {search.K1 + 1} / (len(at{i}) + {search.K1} * (1 - {search.B} + {search.B} * dl * {n_all} / {words}))" for i in range(n)
    )


def bm25_sql(phrases: list[str], condition: str, kept: dict[int, str] | None = None) -> str:
    """The 40 best of each reader: phrases as lists of beginnings; ``kept`` narrows them after they were counted."""
    n = len(phrases)
    at = ", ".join(f"{p} AS all{i}" for i, p in enumerate(phrases))
    near = ", ".join(f"{(kept or {}).get(i, f'all{i}')} AS at{i}" for i in range(n))
    df = ", ".join(f"count_if(len(all{i}) > 0) AS df{i}" for i in range(n))
    return f"""{CORPUS}, t AS (SELECT book_id, global_seq, chapter_label, kind, text, {TOKENS} AS toks FROM para), c AS (SELECT *, len(toks) AS dl, {at} FROM t), b AS (SELECT *, {near} FROM c),
s AS (SELECT count(*) AS n_all, sum(dl) AS n_words, {df} FROM c), h AS (SELECT b.*, {score_sql(n)} AS score FROM b, s WHERE {condition}),
r AS (SELECT reader_id, h.* EXCLUDE (score), round(score, 9) AS score, row_number() OVER (PARTITION BY reader_id ORDER BY round(score, 9), global_seq, h.book_id) AS nth
  FROM h JOIN ranges g ON h.book_id = g.book_id AND global_seq BETWEEN lo AND hi WHERE kind IN ('body', 'reference')),
best AS (SELECT * FROM r WHERE nth <= 40)
SELECT reader_id, book_id, global_seq, chapter_label, score FROM best"""


def _search(spark, d, phrases, condition=None, near=(), scope="all"):
    return corpus(spark, d).search(phrases, condition, near, scope=scope, index=index(spark, d)).drop("snippet")


@query(bm25_sql([at_sql("the"), at_sql("that")], "len(at0) > 0 AND len(at1) > 0"))
def search_all(spark, d):
    return _search(spark, d, ["the", "that"])


@query(bm25_sql([at_sql("von"), at_sql("pour")], "len(at0) > 0 OR len(at1) > 0"))
def search_any(spark, d):
    return _search(spark, d, ["von", "pour"], has(0) | has(1))


@query(bm25_sql([at_sql("with"), at_sql("the")], "len(at0) > 0 AND len(at1) = 0"))
def search_not(spark, d):
    return _search(spark, d, ["with", "the"], has(0) & ~has(1))


@query(bm25_sql([at_sql("of the")], "len(at0) > 0"))
def search_phrase(spark, d):
    return _search(spark, d, ["of the"])


@query(bm25_sql([at_sql("tionst", prefix=True)], "len(at0) > 0"))
def search_prefix(spark, d):
    return _search(spark, d, [Phrase.of("tionst", prefix=True)])


NEAR_SQL = {i: f"list_filter(all{i}, lambda x: len(list_filter(all{1 - i}, lambda y: abs(x - y) <= 6)) > 0)" for i in (0, 1)}


@query(bm25_sql([at_sql("heat"), at_sql("with")], "len(at0) > 0 AND len(at1) > 0", NEAR_SQL))
def search_near(spark, d):
    return _search(spark, d, ["heat", "with"], near=(Near(0, 1, 5),))


@query(bm25_sql([f"list_filter({at_sql('the')}, lambda i: i = 1)", at_sql("of th", prefix=True)], "len(at0) > 0 AND len(at1) > 0"))
def search_first(spark, d):
    """Paragraphs that begin with a word and hold a phrase whose last word goes on."""
    return _search(spark, d, [Phrase.of("the", first=True), Phrase.of("of th", prefix=True)])


@query(f"""{CORPUS}, t AS (SELECT reader_id, book_id, global_seq, chapter_label, {TOKENS} AS toks FROM readable), c AS (SELECT *, len(toks) AS dl, {at_sql('of the')} AS at0, {at_sql('and')} AS at1 FROM t),
s AS (SELECT reader_id, count(*) AS n_all, sum(dl) AS n_words, count_if(len(at0) > 0) AS df0, count_if(len(at1) > 0) AS df1 FROM c GROUP BY reader_id),
h AS (SELECT c.*, round({score_sql(2)}, 9) AS score FROM c JOIN s USING (reader_id) WHERE len(at0) > 0 OR len(at1) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY score, global_seq, book_id) AS nth FROM h)
SELECT reader_id, book_id, global_seq, chapter_label, score FROM r WHERE nth <= 40""")
def search_as_read(spark, d):
    """Ranked by what the reader can read: unread paragraphs have no influence."""
    return _search(spark, d, ["of the", "and"], has(0) | has(1), scope="readable")


PIECES = "regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{Mn}]*|[^\\p{L}\\p{N}]+')"


def snippet_sql(found: str, sizes: list[int]) -> str:
    """The best window of ten words of each row of ``best``, hit by hit and word by word."""
    hits = " UNION ALL ".join(f"SELECT reader_id, book_id, global_seq, {i} AS ip, unnest(at{i}) - 1 AS a, {n} AS size FROM best" for i, n in enumerate(sizes))
    key = "reader_id, book_id, global_seq"
    worth = lambda begin: f"SELECT {key}, cand, begin0, moved, 999 * count(DISTINCT ip) + count(ip) + any_value(bonus) AS worth, arg_min(a, (a, ip)) AS fa, arg_max(z, (a, ip)) AS la FROM {begin}"
    return f"""{found.rsplit('SELECT', 1)[0]}, hit AS (SELECT *, a + size AS z, row_number() OVER (PARTITION BY {key} ORDER BY a, ip) AS nth FROM ({hits})),
part AS (SELECT {key}, dl, {PIECES} AS pieces, CASE WHEN regexp_matches(text, '^[\\p{{L}}\\p{{N}}]') THEN 0 ELSE 1 END AS odd, text FROM best),
word AS (SELECT {key}, t, pieces[odd + 2 * t + 1] AS w, coalesce(CASE WHEN odd + 2 * t > 0 THEN pieces[odd + 2 * t] END, '') AS gap FROM (SELECT *, unnest(range(dl)) AS t FROM part)),
sentence AS (SELECT {key}, t FROM word WHERE t = 0 OR regexp_matches(gap, '[.:][ \t\n\r]+$')),
begins AS (SELECT h.{key.replace(', ', ', h.')}, 2 * nth AS cand, a AS begin0, 0 AS bonus, true AS moved FROM hit h
  UNION ALL SELECT h.{key.replace(', ', ', h.')}, 2 * nth + 1, max(t), CASE WHEN max(t) = 0 THEN 120 ELSE 100 END, false FROM hit h JOIN sentence s ON h.book_id = s.book_id AND h.global_seq = s.global_seq AND h.reader_id = s.reader_id AND t <= a
    JOIN part p ON p.book_id = h.book_id AND p.global_seq = h.global_seq AND p.reader_id = h.reader_id WHERE dl > 10 GROUP BY h.{key.replace(', ', ', h.')}, nth, a HAVING max(t) < a),
judged AS ({worth(f"begins b LEFT JOIN hit h USING ({key}) WHERE h.a >= begin0 AND h.a < begin0 + 10 GROUP BY {key}, cand, begin0, moved")}
  UNION ALL SELECT {key}, cand, begin0, moved, bonus, NULL, NULL FROM begins b WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.book_id = b.book_id AND h.global_seq = b.global_seq AND h.reader_id = b.reader_id AND a >= begin0 AND a < begin0 + 10)),
chosen AS (SELECT {key}, arg_max(struct_pack(b := begin0, m := moved, f := fa, l := la), (worth, -cand)) AS c FROM judged GROUP BY ALL),
placed AS (SELECT {key}, dl, CASE WHEN c.m THEN greatest(least(c.f - CAST(trunc((10 - (c.l - c.f)) / 2.0) AS BIGINT), dl - 10), 0) ELSE c.b END AS b FROM chosen JOIN part USING ({key})),
seen AS (SELECT w.*, b, dl, b + 9 AS e FROM word w JOIN placed USING ({key}) WHERE t BETWEEN b AND b + 9),
marked AS (SELECT s.*, coalesce(bool_or(a = t), false) AND NOT coalesce(bool_or(a < t AND z > t), false) AS opens, coalesce(bool_or(a <= t AND z > t AND t = e), false) OR coalesce(bool_or(a <= t AND z > t) AND NOT bool_or(a <= t AND z > t + 1), false) AS ends FROM seen s LEFT JOIN hit h USING ({key}) GROUP BY ALL),
told AS (SELECT *, bool_or(opens) OVER (PARTITION BY {key} ORDER BY t) AS opened FROM marked),
joined AS (SELECT {key}, min(b) AS b, min(dl) AS dl, string_agg(CASE WHEN t = b AND b > 0 THEN '' ELSE gap END || CASE WHEN opens THEN '[' ELSE '' END || w || CASE WHEN ends AND opened THEN ']' ELSE '' END, '' ORDER BY t) AS body FROM told GROUP BY {key})
SELECT {key}, chapter_label, CASE WHEN b > 0 THEN '...' ELSE '' END || body || CASE WHEN b + 9 >= j.dl - 1 THEN coalesce(pieces[odd + 2 * j.dl], '') ELSE '...' END AS snippet
FROM joined j JOIN part USING ({key}) JOIN (SELECT {key}, chapter_label FROM best) USING ({key})"""


@query(snippet_sql(bm25_sql([at_sql("of the"), at_sql("th", prefix=True)], "len(at0) > 0 AND len(at1) > 0"), [2, 1]))
def search_snippet(spark, d):
    found = corpus(spark, d).search(["of the", Phrase.of("th", prefix=True)], index=index(spark, d))
    return found.drop("score")


def regex_sql(pattern: str) -> str:
    return f"""{CORPUS}, h AS (SELECT reader_id, book_id, global_seq, chapter_label, text, regexp_extract(text, '{pattern}') AS m FROM readable WHERE regexp_matches(text, '{pattern}')),
p AS (SELECT *, strpos(text, m) AS a, greatest(strpos(text, m) - 60, 1) AS s FROM h), q AS (SELECT *, substr(text, s, a - s + length(m) + 60) AS piece FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY global_seq, book_id) AS nth FROM q)
SELECT reader_id, book_id, global_seq, chapter_label, CASE WHEN s > 1 THEN '...' ELSE '' END || piece || CASE WHEN s + length(piece) - 1 < length(text) THEN '...' ELSE '' END AS snippet
FROM r WHERE nth <= 40"""


@query(regex_sql("th[a-z]+tion"))
def search_regex(spark, d):
    return corpus(spark, d).search_regex("th[a-z]+tion")


@query(regex_sql("[\\p{L}\\p{N}_]+ñ[\\p{L}\\p{N}_]+"))
def search_regex_unicode(spark, d):
    """Letters of all scripts are letters, and groups have names as in Python."""
    return corpus(spark, d).search_regex(r"(?P<head>\w+)ñ(?P<tail>\w+)")


@query(f"""{CORPUS}, l AS (SELECT *, lag(chapter_idx) OVER (PARTITION BY reader_id, book_id ORDER BY global_seq) AS was FROM readable)
, a AS (SELECT reader_id, book_id, string_agg(CASE WHEN was IS DISTINCT FROM chapter_idx THEN '## ' || chapter_label || chr(10) ELSE '' END || para_idx || ' ' || text, chr(10) ORDER BY global_seq) AS context,
count(*) AS n_paras, count(DISTINCT chapter_idx) AS n_chapters, max(global_seq) AS max_seq FROM l GROUP BY ALL)
SELECT reader_id, book_id, n_paras, n_chapters, max_seq, length(context) // 4 AS tokens, sha256(context) AS sha256 FROM a""")
def assemble_hash(spark, d):
    return corpus(spark, d).assemble().drop("context")


def identity_sql(label: str) -> str:
    name, number = _lit(retrieval.NAMED_DIVISION), _lit(retrieval.PRINTED_NUMBER)
    return f"CASE WHEN regexp_matches({label}, {name}) THEN lower(trim({label})) ELSE nullif(CAST(try_cast(nullif(regexp_extract({label}, {number}, 1), '') AS BIGINT) AS VARCHAR), '') END"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""{CORPUS}, r AS (SELECT book_id, chapter_idx, {identity_sql('label')} AS ref FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b'))
SELECT book_id, ref, min(chapter_idx) AS chapter_idx FROM r WHERE ref IS NOT NULL GROUP BY ALL""")
def chapter_refs(spark, d):
    return corpus(spark, d).chapter_refs()


# -- structure ------------------------------------------------------------------


@query(f"{CORPUS} SELECT book_id, chapter_idx, label, kind FROM chapter")
def classify_kinds(spark, d):
    return D.chapters(D.raw_paras(spark, d)).select("book_id", "chapter_idx", "label", "kind")


@query(f"""{CORPUS}, b AS (SELECT book_id, chapter_idx, min(global_seq) AS start_seq, max(global_seq) AS end_seq, count(*) AS n_paras,
CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS n_words FROM para1 GROUP BY ALL)
SELECT b.*, kind FROM b JOIN chapter USING (book_id, chapter_idx) WHERE (kind = 'body' AND n_words < 400) OR (kind = 'reference' AND n_words < 250)""")
def size_flags(spark, d):
    para, chapter = D.paras(spark, d)
    return chapters.size_flags(chapters.chapter_bounds(para).join(chapter.select("book_id", "chapter_idx", "kind"), ["book_id", "chapter_idx"]))


MARKED = """marked AS (SELECT book_id, para_idx AS spine_idx, CASE WHEN (book_id + para_idx) % 4 = 3 THEN 'Chapter ' || para_idx END AS marker FROM para1)"""


@query(f"""{CORPUS}, {MARKED}, i AS (SELECT *, count(marker) OVER (PARTITION BY book_id ORDER BY spine_idx) AS island, last_value(marker IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY spine_idx) AS label FROM marked)
SELECT book_id, spine_idx, label, island - min(island) OVER (PARTITION BY book_id) AS chapter_idx FROM i""")
def group_markers(spark, d):
    p = D.raw_paras(spark, d)
    at = F.col("para_idx")
    docs = p.select("book_id", at.alias("spine_idx"), F.when((F.col("book_id") + at) % 4 == 3, F.concat(F.lit("Chapter "), at.cast("string"))).alias("marker"))
    return chapters.group_markers(docs).select("book_id", "spine_idx", "label", "chapter_idx")


@query(f"""{CORPUS}, parts AS (SELECT book_id, chapter_idx AS start_spine, 'Part ' || chapter_idx AS part_label FROM chapter WHERE chapter_idx % 3 = 1)
SELECT c.book_id, c.chapter_idx, p.part_label FROM chapter c ASOF LEFT JOIN parts p ON c.book_id = p.book_id AND c.chapter_idx >= p.start_spine""")
def part_asof(spark, d):
    c = D.chapters(D.raw_paras(spark, d)).select("book_id", "chapter_idx", F.col("chapter_idx").alias("start_spine"))
    parts = c.where("chapter_idx % 3 = 1").select("book_id", "start_spine", F.concat(F.lit("Part "), F.col("chapter_idx").cast("string")).alias("part_label"))
    return chapters.assign_parts(c, parts).select("book_id", "chapter_idx", "part_label")


@query(f"{CORPUS} SELECT book_id, global_seq, global_seq // {schema.BOOK_STRIDE} AS book_order, global_seq % {schema.BOOK_STRIDE} // {schema.SPINE_STRIDE} AS spine_idx, global_seq % {schema.SPINE_STRIDE} AS para_idx FROM para1")
def order_key_decode(spark, d):
    return D.raw_paras(spark, d).select("book_id", "global_seq", *[c.alias(n) for n, c in schema.decode_seq(F.col("global_seq")).items()])


@query(f"{CORPUS} SELECT book_id, para_idx, global_seq + (CASE WHEN book_id % 3 = 0 THEN 5 ELSE 3 END) * {schema.BOOK_STRIDE} AS global_seq FROM para1")
def rebase_shift(spark, d):
    p = D.raw_paras(spark, d)
    moves = D.books(spark, d).select("book_id", F.col("book_order").alias("old_order"), (F.col("book_order") + F.when(F.col("book_id") % 3 == 0, 5).otherwise(3)).alias("new_order"))
    return progress.rebase(p, moves, ["global_seq"]).select("book_id", "para_idx", "global_seq")


# -- progress -------------------------------------------------------------------


@query(f"""WITH {D.EVENT_SQL}, s AS (SELECT *, count_if(action = 'reset') OVER (PARTITION BY reader_id, book_id ORDER BY ts, event_id) AS seg FROM event)
SELECT event_id, reader_id, book_id, greatest(max(seq) OVER (PARTITION BY reader_id, book_id, seg ORDER BY ts, event_id), 0) AS ceiling_seq FROM s""")
def watermark_asof(spark, d):
    return progress.watermark_history(D.events(spark, d)).select("event_id", "reader_id", "book_id", "ceiling_seq")


@query(f"""WITH {D.EVENT_SQL}, s AS (SELECT *, count_if(action = 'reset') OVER (PARTITION BY reader_id, book_id ORDER BY ts, event_id) AS seg FROM event),
h AS (SELECT *, greatest(max(seq) OVER (PARTITION BY reader_id, book_id, seg ORDER BY ts, event_id), 0) AS c FROM s)
SELECT reader_id, book_id, arg_max(c, (ts, event_id)) AS ceiling_seq FROM h GROUP BY ALL""")
def watermark_final(spark, d):
    return progress.watermark_final(D.events(spark, d))


@query(f"""{CORPUS}, o AS (SELECT p.*, series_id, book_order FROM progress p JOIN book USING (book_id)),
spot AS (SELECT book_id, max(chapter_idx) AS k FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b') GROUP BY book_id), latest AS (SELECT reader_id, series_id, max(book_order) AS latest FROM o WHERE status IN ('reading', 'finished') GROUP BY ALL)
SELECT l.reader_id, b.book_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.series_id = b.series_id AND o.reader_id = l.reader_id AND o.status <> 'unread' AND o.book_order > b.book_order) THEN 'finished' ELSE coalesce(p.status, 'unread') END AS status,
CASE WHEN b.book_order < l.latest THEN spot.k ELSE p.position_chapter_idx END AS position_chapter_idx,
CASE WHEN b.book_order < l.latest THEN greatest(coalesce(p.ceiling_seq, 0), coalesce(e.book_end, 0)) ELSE coalesce(p.ceiling_seq, 0) END AS ceiling_seq
FROM latest l JOIN book b USING (series_id) LEFT JOIN progress p ON p.book_id = b.book_id LEFT JOIN ends e ON e.book_id = b.book_id LEFT JOIN spot ON spot.book_id = b.book_id""")
def series_cascade(spark, d):
    para, chapter = D.paras(spark, d)
    return progress.series_cascade(D.progress(spark, d, chapter), D.books(spark, d), progress.book_ends(chapter))


# -- shelf ------------------------------------------------------------------------

S = f"WITH {D.SHELF_SQL}"
READ = f"{S}, r AS (SELECT * FROM shelf WHERE shelf = 'read')"
GENRE = "list_filter(list_transform(string_split(coalesce(genres, ''), ','), lambda g: trim(g)), lambda g: g <> '' AND NOT lower(g) IN (" + ", ".join(f"'{g}'" for g in T.NOT_GENRES) + "))[1:3]"
SERIES_RE = T.SERIES_SUFFIX.replace("'", "''")
SERIES = f"nullif(trim(regexp_extract(trim(title), '{SERIES_RE}', 2)), '')"
STRIPPED = f"CASE WHEN {SERIES} IS NOT NULL THEN trim(regexp_extract(trim(title), '{SERIES_RE}', 1)) ELSE title END"


@query(f"""{S} SELECT count_if(shelf = 'read') AS books, CAST(coalesce(sum(num_pages) FILTER (shelf = 'read'), 0) AS BIGINT) AS pages,
CAST(coalesce(round_even(avg(num_pages) FILTER (shelf = 'read'), 0), 0) AS BIGINT) AS avg_pages, count_if(shelf = 'to-read') AS to_read,
count_if(shelf = 'currently-reading') AS currently_reading, 0::BIGINT AS dnf, CAST(coalesce(sum(num_pages) FILTER (shelf = 'to-read'), 0) AS BIGINT) AS backlog_pages,
arg_max(title, (num_pages, -review_id)) FILTER (shelf = 'read' AND num_pages IS NOT NULL) AS longest,
arg_min(title, (num_pages, review_id)) FILTER (shelf = 'read' AND num_pages IS NOT NULL) AS shortest FROM shelf""")
def shelf_totals(spark, d):
    return shelf.totals(D.shelf(spark, d))


@query(f"{READ} SELECT count(*) AS books, " + ", ".join(f"count_if(coalesce(CAST({c} AS VARCHAR), '') <> '') AS with_{c}" for c in ("date_read", "date_started", "num_pages", "published_year", "user_rating", "genres", "cover_small")) + " FROM r")
def shelf_coverage(spark, d):
    return shelf.coverage(D.shelf(spark, d))


MONTHS = "m AS (SELECT *, substr(date_read, 1, 7) AS month FROM r WHERE regexp_matches(date_read, '^\\d{4}-\\d{2}'))"


@query(f"""{READ}, {MONTHS}, c AS (SELECT month, count(*) AS books, CAST(sum(coalesce(num_pages, 0)) AS BIGINT) AS pages FROM m GROUP BY month),
k AS (SELECT strftime(unnest(generate_series((SELECT min(month) || '-01' FROM c)::DATE, (SELECT max(month) || '-01' FROM c)::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT month, coalesce(books, 0) AS books, coalesce(pages, 0) AS pages FROM k LEFT JOIN c USING (month)""")
def shelf_by_month(spark, d):
    return shelf.by_month(D.shelf(spark, d))


@query(f"{READ}, {MONTHS} SELECT month, row_number() OVER (PARTITION BY month ORDER BY date_read, title, review_id) AS nth, {STRIPPED} AS title, date_read FROM m")
def shelf_month_books(spark, d):
    return shelf.month_books(D.shelf(spark, d))


@query(f"{READ} SELECT author, count(*) AS books FROM r WHERE coalesce(author, '') <> '' GROUP BY author HAVING count(*) >= 2 ORDER BY books DESC, author LIMIT 10")
def shelf_top_authors(spark, d):
    return shelf.top_authors(D.shelf(spark, d))


@query(f"""{READ}, c AS (SELECT published_year // 10 * 10 AS decade, count(*) AS books FROM r WHERE published_year IS NOT NULL GROUP BY 1)
SELECT k.decade, coalesce(books, 0) AS books FROM (SELECT unnest(generate_series((SELECT min(decade) FROM c), (SELECT max(decade) FROM c), 10)) AS decade) k LEFT JOIN c USING (decade)""")
def shelf_by_decade(spark, d):
    return shelf.by_decade(D.shelf(spark, d))


@query(f"""{S}, s AS (SELECT *, {SERIES} AS series FROM shelf) SELECT series, count_if(shelf = 'read') AS n_read, count(*) AS n_total, string_agg(DISTINCT shelf, ',' ORDER BY shelf) AS shelves
FROM s WHERE series IS NOT NULL GROUP BY series HAVING NOT (count(*) = 1 AND count_if(shelf = 'read') = 0)""")
def shelf_series(spark, d):
    return shelf.series_progress(D.shelf(spark, d))


DAYS = "d AS (SELECT *, date_diff('day', try_cast(substr(date_started, 1, 10) AS DATE), try_cast(substr(date_read, 1, 10) AS DATE)) AS days FROM r WHERE length(date_read) >= 10 AND length(date_started) >= 10)"


@query(f"""{READ}, {DAYS} SELECT count(*) AS n, CAST(round_even(median(days), 0) AS BIGINT) AS median_days, round(avg(days), 1) AS mean_days,
arg_min(title, (days, review_id)) AS fastest, arg_max(title, (days, -review_id)) AS slowest FROM d WHERE days >= 0""")
def shelf_durations(spark, d):
    return shelf.durations(D.shelf(spark, d))


@query(f"{READ} SELECT genre, count(*) AS books FROM (SELECT unnest({GENRE}) AS genre FROM r) GROUP BY genre ORDER BY books DESC, genre LIMIT 12")
def shelf_genres(spark, d):
    return shelf.top_genres(D.shelf(spark, d))


@query(f"{READ} SELECT genre, count(*) AS n, round(avg(user_rating), 2) AS avg_rating FROM (SELECT user_rating, unnest({GENRE}) AS genre FROM r WHERE coalesce(user_rating, 0) <> 0) GROUP BY genre HAVING count(*) >= 3")
def shelf_rating_by_genre(spark, d):
    return shelf.rating_by_genre(D.shelf(spark, d))


FETCH = """fetched AS (SELECT review_id, shelf_book_id, title || ' (rev)' AS title, author, 'read' AS shelf, num_pages + 1 AS num_pages, published_year, user_rating, '2020-01-01' AS date_read, '1999-01-01' AS date_added
  FROM shelf WHERE num_pages IS NOT NULL AND shelf = 'read' UNION ALL SELECT review_id + 1000000000, shelf_book_id, title, author, 'read', num_pages, published_year, user_rating, date_read, date_added FROM shelf WHERE published_year IS NULL)"""


def _fetch(s: DataFrame) -> DataFrame:
    cols = ["shelf_book_id", "title", "author", "shelf", "num_pages", "published_year", "user_rating", "date_read", "date_added"]
    old = s.where("num_pages is not null and shelf = 'read'").select(
        "review_id", "shelf_book_id", F.concat("title", F.lit(" (rev)")).alias("title"), "author", F.lit("read").alias("shelf"), (F.col("num_pages") + 1).alias("num_pages"),
        "published_year", "user_rating", F.lit("2020-01-01").alias("date_read"), F.lit("1999-01-01").alias("date_added"),
    )
    new = s.where("published_year is null").withColumn("shelf", F.lit("read")).withColumn("review_id", F.col("review_id") + 1_000_000_000)
    return old.unionByName(new.select("review_id", *cols))


def _cdc_sql(keep: str) -> str:
    cols = ", ".join(f"CASE WHEN f.review_id IS NOT NULL THEN f.{c} ELSE s.{c} END AS {c}" for c in ("title", "shelf", "num_pages", "date_read"))
    return f"{S}, {FETCH} SELECT coalesce(s.review_id, f.review_id) AS review_id, {cols}, coalesce(s.date_added, f.date_added) AS date_added, s.date_started FROM shelf s FULL JOIN fetched f USING (review_id) WHERE {keep}"


def _cdc(spark, d, truncated):
    s = D.shelf(spark, d)
    return shelf.upsert_shelf(s, _fetch(s), "read", truncated).select("review_id", "title", "shelf", "num_pages", "date_read", "date_added", "date_started")


@query(_cdc_sql("f.review_id IS NOT NULL OR s.shelf <> 'read'"))
def shelf_cdc_complete(spark, d):
    return _cdc(spark, d, truncated=False)


@query(_cdc_sql("true"))
def shelf_cdc_truncated(spark, d):
    return _cdc(spark, d, truncated=True)


@query(f"""{S}, r AS (SELECT review_id, date_started AS s, date_added AS rd, CASE WHEN cover_small = '' THEN '2001-02-03' END AS a FROM shelf WHERE user_rating IS NOT NULL)
SELECT shelf.review_id, CASE WHEN r.review_id IS NOT NULL THEN s ELSE date_started END AS date_started, coalesce(date_read, rd) AS date_read, coalesce(a, date_added) AS date_added FROM shelf LEFT JOIN r USING (review_id)""")
def shelf_enrich(spark, d):
    s = D.shelf(spark, d)
    reviews = s.where("user_rating is not null").select("review_id", "date_started", F.col("date_added").alias("date_read"), F.when(F.col("cover_small") == "", "2001-02-03").alias("date_added"))
    return shelf.apply_reviews(s, reviews).select("review_id", "date_started", "date_read", "date_added")


@query(f"""{S}, y AS (SELECT event_id AS sync_id, CASE user_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'to-read' ELSE 'currently-reading' END AS shelf, value > 50 AS truncated, ts AS synced_at FROM events),
l AS (SELECT shelf, arg_max(truncated, (synced_at, sync_id)) AS truncated, max(synced_at) AS last_sync FROM y GROUP BY shelf)
SELECT c.shelf, books, coalesce(truncated, false) AS truncated, last_sync FROM (SELECT shelf, count(*) AS books FROM shelf GROUP BY shelf) c LEFT JOIN l USING (shelf)""")
def latest_sync(spark, d):
    e = D.table(spark, d, "events")
    name = F.when(F.col("user_id") % 3 == 0, "read").when(F.col("user_id") % 3 == 1, "to-read").otherwise("currently-reading")
    syncs = e.select(F.col("event_id").alias("sync_id"), name.alias("shelf"), (F.col("value") > 50).alias("truncated"), F.col("ts").alias("synced_at"))
    return shelf.latest_sync(D.shelf(spark, d), syncs)


def keys_sql(title: str) -> str:
    key = lambda x: f"regexp_replace(regexp_replace(trim({x}), '^(the|a|an)\\s+', ''), '[^a-z0-9]+', '', 'g')"
    s = f"trim(regexp_replace(lower(coalesce({title}, '')), '\\([^)]*\\)', '', 'g'))"
    dash = "'\\s[-–—]\\s'"
    forms = [key(s), key(f"regexp_replace({s}, ':.*$', '')"), key(f"regexp_replace({s}, '^[^:]+:\\s*', '')")]
    forms += [f"CASE WHEN regexp_matches({s}, {dash}) THEN {key(f'regexp_split_to_array({s}, {dash})[{i}]')} ELSE '' END" for i in (1, -1)]
    return f"list_distinct(list_filter([{', '.join(forms)}], lambda k: k <> ''))"


@query(f"{S} SELECT review_id, unnest({keys_sql('title')}) AS key FROM shelf")
def title_keys(spark, d):
    return D.shelf(spark, d).select("review_id", F.explode(T.title_keys(F.col("title"))).alias("key"))


# The uploads of these queries: parts, under titles like those of the shelf.
UPLOAD = "up AS (SELECT p_partkey AS book_id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ': ' || p_type ELSE '' END AS title, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS author FROM part)"


def uploads(spark, d):
    k = F.col("p_partkey")
    title = F.concat(F.col("p_name"), F.when(k % 2 == 0, F.concat(F.lit(": "), F.col("p_type"))).otherwise(F.lit("")))
    return D.table(spark, d, "part").select(k.alias("book_id"), title.alias("title"), F.when(k % 3 > 0, F.col("p_brand")).alias("author"))


PAIRS = f"k AS (SELECT DISTINCT shelf_book_id, unnest({keys_sql('title')}) AS key FROM shelf), u AS (SELECT book_id, author, unnest({keys_sql('title')}) AS key FROM up), x AS (SELECT DISTINCT book_id, author, shelf_book_id FROM u JOIN k USING (key))"


@query(f"""{S}, {UPLOAD}, {PAIRS}, g AS (SELECT book_id, count(*) AS n, min(shelf_book_id) AS one FROM x GROUP BY book_id)
SELECT book_id, CASE WHEN n = 1 THEN 'link' WHEN n IS NULL THEN 'no_match' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN one END AS candidate FROM up LEFT JOIN g USING (book_id)""")
def autolink(spark, d):
    return shelf.propose_links(uploads(spark, d).select("book_id", "title"), D.shelf(spark, d))


AUTHOR = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""{S}, {UPLOAD}, {PAIRS}, o AS (SELECT shelf_book_id, arg_min(author, (CASE WHEN shelf IN ('read', 'currently-reading') THEN 0 ELSE 1 END, review_id)) AS theirs FROM shelf GROUP BY shelf_book_id),
z AS (SELECT x.*, len(list_filter(list_intersect({AUTHOR.format('author')}, {AUTHOR.format('theirs')}), lambda t: length(t) >= 2)) > 0 AS s FROM x JOIN o USING (shelf_book_id)),
g AS (SELECT book_id, count(*) AS n, min(shelf_book_id) AS a, count_if(s) AS m, min(shelf_book_id) FILTER (s) AS b FROM z GROUP BY book_id)
SELECT book_id, CASE WHEN n = 1 THEN a WHEN m = 1 THEN b END AS shelf_book_id FROM up LEFT JOIN g USING (book_id)""")
def upload_match(spark, d):
    return shelf.upload_matches(uploads(spark, d), D.shelf(spark, d))


@query(f"WITH {D.BOOK_SQL} SELECT series_id, count(*) AS volumes, max(book_order) + 1 AS next_order FROM book GROUP BY series_id HAVING NOT (count(*) = 1 AND count_if(standalone) = 1)")
def series_list(spark, d):
    return shelf.series_list(D.books(spark, d))


@query(f"""WITH {D.BOOK_SQL}, st AS (SELECT series_id, count(*) AS volumes, max(book_order) AS top, count_if(standalone) AS alone FROM book GROUP BY series_id),
au AS (SELECT DISTINCT author, series_id FROM book), be AS (SELECT author, arg_min(struct_pack(s := series_id, t := top), (-volumes, series_id)) AS b FROM au JOIN st USING (series_id) WHERE NOT (volumes = 1 AND alone = 1) GROUP BY author),
u AS (SELECT item_id AS upload_id, 'Author ' || (item_id % 9) AS author, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 25) END AS hint, CASE WHEN item_id % 6 = 0 THEN item_id END AS pos FROM benchmark)
SELECT upload_id, CASE WHEN hint IS NOT NULL THEN hint ELSE b.s END AS series_id, CASE WHEN hint IS NOT NULL THEN coalesce(pos, st.top + 1, 1) ELSE coalesce(b.t + 1, 1) END AS next_order
FROM u LEFT JOIN st ON st.series_id = hint LEFT JOIN be ON be.author = u.author""")
def series_suggestion(spark, d):
    k = F.col("item_id")
    u = D.table(spark, d, "benchmark").select(
        k.alias("upload_id"), F.concat(F.lit("Author "), (k % 9).cast("string")).alias("author"), F.when(k % 3 == 0, F.concat(F.lit("Src"), (k % 25).cast("string"))).alias("hint_name"), F.when(k % 6 == 0, k).alias("hint_position")
    )
    return shelf.suggest_series(D.books(spark, d), u)


@query(f"""{CORPUS}, {D.SHELF_SQL}, lk AS (SELECT doc_id AS book_id, 'b' || (doc_id % 5000) AS shelf_book_id FROM documents WHERE lang = 'en'), l1 AS (SELECT shelf_book_id, min(book_id) AS book_id FROM lk GROUP BY 1),
e AS (SELECT CASE shelf WHEN 'to-read' THEN 'tbr' WHEN 'currently-reading' THEN 'reading' ELSE 'completed' END AS bucket, 's' || review_id AS entry_id, {STRIPPED} AS title, {SERIES} AS series,
  try_cast(nullif(regexp_extract(trim(title), '{SERIES_RE}', 3), '') AS DOUBLE) AS number, coalesce(nullif(date_read, ''), date_added, '') AS touched FROM shelf
 UNION ALL SELECT CASE p.status WHEN 'finished' THEN 'completed' WHEN 'reading' THEN 'reading' ELSE 'tbr' END, 'b' || b.book_id, title, NULL, NULL, '' FROM book b LEFT JOIN progress p USING (book_id) WHERE b.book_id NOT IN (SELECT book_id FROM lk)),
g AS (SELECT *, coalesce('g:' || series, entry_id) AS group_id FROM e)
SELECT bucket, max(touched) OVER (PARTITION BY bucket, group_id) AS anchor, group_id, row_number() OVER (PARTITION BY bucket, group_id ORDER BY number NULLS LAST, entry_id) AS pos, entry_id, title, series FROM g""")
def unified_shelves(spark, d):
    para, chapter = D.paras(spark, d)
    links = D.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("book_id"), F.concat(F.lit("b"), (F.col("doc_id") % 5000).cast("string")).alias("shelf_book_id"))
    return shelf.unified(D.shelf(spark, d), D.books(spark, d), D.progress(spark, d, chapter), links)


# -- conversations -------------------------------------------------------------------

PAIR = """m AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS answer FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, text AS question, answer FROM m WHERE role = 'user' AND r2 = 'assistant')"""


@query(f"WITH {PAIR} SELECT * FROM t")
def conv_turns(spark, d):
    return conversations.turn_pairs(D.table(spark, d, "conversations"))


@query(f"""WITH {PAIR}, q AS (SELECT conv_id, count(*) AS turn_count, trim(regexp_replace(arg_min(question, ord), '\\s+', ' ', 'g')) AS s FROM t GROUP BY conv_id)
SELECT c.conv_id, coalesce(turn_count, 0) AS turn_count, CASE WHEN length(s) > 90 THEN rtrim(substr(s, 1, 89)) || '…' ELSE s END AS title FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q USING (conv_id)""")
def conv_summary(spark, d):
    c = D.table(spark, d, "conversations")
    return conversations.summaries(c, conversations.turn_pairs(c))


@query(f"WITH {PAIR} SELECT * FROM t WHERE ord < (SELECT max(ord) FROM t x WHERE x.conv_id = t.conv_id)")
def conv_drop_last(spark, d):
    return conversations.drop_last(conversations.turn_pairs(D.table(spark, d, "conversations")))


# -- causal ---------------------------------------------------------------------------

NODE = """node AS (SELECT book_id, global_seq AS node_id, global_seq AS first_seq, global_seq AS cite_seq FROM para1),
edge AS (SELECT node.book_id, global_seq AS k, CASE WHEN para_idx % 2 = 0 THEN global_seq END AS cite_seq FROM para1 JOIN node ON node_id = CASE WHEN para_idx % 5 = 0 THEN -1 ELSE global_seq END),
attr AS (SELECT book_id, global_seq + 1 AS k, CASE WHEN para_idx % 3 = 0 THEN global_seq END AS cite_seq FROM para1)"""


@query(f"""{CORPUS}, {NODE}, n AS (SELECT node.book_id, first_seq AS k FROM node JOIN para p ON p.book_id = node.book_id AND p.global_seq = cite_seq WHERE kind <> 'excerpt'),
e AS (SELECT edge.book_id, k FROM edge LEFT JOIN para p ON p.book_id = edge.book_id AND p.global_seq = cite_seq WHERE cite_seq IS NULL OR kind <> 'excerpt'),
a AS (SELECT attr.book_id, k FROM attr LEFT JOIN para p ON p.book_id = attr.book_id AND p.global_seq = cite_seq WHERE cite_seq IS NULL OR kind <> 'excerpt')
SELECT book_id, chapter_idx, (SELECT count(*) FROM n WHERE n.book_id = c.book_id AND k <= c.end_seq) AS n_nodes, (SELECT count(*) FROM e WHERE e.book_id = c.book_id AND k <= c.end_seq) AS n_edges,
(SELECT count(*) FROM a WHERE a.book_id = c.book_id AND k <= c.end_seq) AS n_attrs FROM chapter c""")
def causal_registry(spark, d):
    para, chapter = D.paras(spark, d)
    seq = F.col("global_seq")
    nodes = para.select("book_id", seq.alias("node_id"), seq.alias("first_seq"), seq.alias("cite_seq"))
    at = F.col("para_idx")
    edges = para.select(F.when(at % 5 == 0, -1).otherwise(seq).alias("src_node_id"), seq.alias("revealed_at_seq"), F.when(at % 2 == 0, seq).alias("cite_seq"))
    attrs = para.select(seq.alias("node_id"), (seq + 1).alias("first_seq"), F.when(at % 3 == 0, seq).alias("cite_seq"))
    return causal.registry_asof(chapter, nodes, edges, attrs, para)


@query(f"""{CORPUS}, c AS (SELECT book_id, chapter_idx, part_label, start_seq AS lo, end_seq AS hi, label AS text FROM chapter WHERE kind = 'body'),
p AS (SELECT book_id, part_label, min(lo) AS lo, max(hi) AS hi, count(*) AS n_sources, string_agg(text, chr(10) ORDER BY chapter_idx) AS text, min(chapter_idx) AS k FROM c GROUP BY book_id, part_label)
SELECT book_id, 'part' AS level, part_label, lo, hi, n_sources, text FROM p
UNION ALL SELECT book_id, 'book', NULL, min(lo), max(hi), count(*), string_agg(text, chr(10) ORDER BY k) FROM p GROUP BY book_id""")
def digest_rollup(spark, d):
    c = D.chapters(D.raw_paras(spark, d)).where("kind = 'body'")
    return causal.digest_rollup(c.select("book_id", "chapter_idx", "part_label", F.col("start_seq").alias("lo"), F.col("end_seq").alias("hi"), F.col("label").alias("text")))


@query()
def components_asof(spark, d):
    """Customers and suppliers joined by orders; beyond SQL on whole tables, so tests hold it against union-find."""
    o, li = D.table(spark, d, "orders"), D.table(spark, d, "lineitem")
    e = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    edges = e.select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), F.col("o_orderkey").alias("revealed_at"))
    return causal.identity_components(edges)


IDENTITY = f"""{CORPUS}, n AS (SELECT book_id, chapter_idx AS k, start_seq AS node, start_seq AS seen, end_seq, count(*) OVER (PARTITION BY book_id) AS n FROM chapter),
e AS (SELECT x.book_id, x.node AS a, y.node AS b, z.end_seq AS seen FROM n x JOIN n y ON y.book_id = x.book_id AND y.k = (x.k * x.k + 3) % x.n JOIN n z ON z.book_id = x.book_id AND z.k = (x.k * 3 + 1) % x.n WHERE x.k % 5 < 4),
p AS (SELECT j::BIGINT AS reader_id, book_id, max(end_seq) FILTER (k <= n * j // 3) AS ceiling_seq FROM n, (SELECT unnest([0, 1, 2, 3]) AS j) i GROUP BY ALL)"""


@query(f"""{IDENTITY.replace('WITH', 'WITH RECURSIVE', 1)}, l1 AS (SELECT reader_id, e.book_id, a, b FROM e JOIN p ON p.book_id = e.book_id AND greatest(seen, a, b) <= ceiling_seq), l AS (SELECT * FROM l1 UNION ALL SELECT reader_id, book_id, b, a FROM l1),
r AS (SELECT reader_id, n.book_id, node, node AS least FROM n JOIN p ON p.book_id = n.book_id AND seen <= ceiling_seq UNION SELECT r.reader_id, r.book_id, b, least FROM r JOIN l ON l.reader_id = r.reader_id AND l.book_id = r.book_id AND l.a = r.node WHERE least < b)
SELECT reader_id, book_id, node, min(least) AS component FROM r WHERE EXISTS (SELECT 1 FROM n WHERE n.node = r.node AND seen <= (SELECT ceiling_seq FROM p WHERE p.reader_id = r.reader_id AND p.book_id = r.book_id)) GROUP BY ALL""")
def cast_as_read(spark, d):
    """Chapters as names, each known from its beginning, and links between them known from the end of some chapter, as four
    readers know them."""
    c = stored(D.chapters(D.raw_paras(spark, d)).withColumn("n", F.count("*").over(Window.partitionBy("book_id"))), "chapters")
    k, n = F.col("chapter_idx"), F.col("n")
    nodes = c.select("book_id", F.col("start_seq").alias("node"), F.col("start_seq").alias("seen"))
    at = lambda name, to: c.select("book_id", k.alias(f"{name}_idx"), F.col(to).alias(name))
    edges = c.where(k % 5 < 4).select("book_id", F.col("start_seq").alias("a"), ((k * k + 3) % n).alias("b_idx"), ((k * 3 + 1) % n).alias("seen_idx"))
    edges = edges.join(at("b", "start_seq"), ["book_id", "b_idx"]).join(at("seen", "end_seq"), ["book_id", "seen_idx"]).select("book_id", "a", "b", "seen")
    readers = c.select("book_id", k, n, "end_seq", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    ceilings = readers.where(k <= F.floor(n * F.col("j") / 3)).groupBy(F.col("j").cast("long").alias("reader_id"), "book_id").agg(F.max("end_seq").alias("ceiling_seq"))
    return causal.cast_as_read(nodes, edges, ceilings)


#: Pages that a Python worker holds as rows of one batch.
PAGES_A_BATCH = 250


@query()
def page_paragraphs(spark, d):
    """Paragraphs of every page."""
    from lectern.sources import markup

    small_batches(spark, PAGES_A_BATCH)
    return D.table(spark, d, "pages").select("page_id", F.posexplode(markup.paragraphs("html")).alias("para_idx", "text"))


@query()
def page_first_heading(spark, d):
    from lectern.sources import markup

    small_batches(spark, PAGES_A_BATCH)
    return D.table(spark, d, "pages").select("page_id", markup.first_heading("html").alias("heading"))


# -- maintenance ------------------------------------------------------------------------


@query(f"{S} SELECT DISTINCT shelf_book_id, title FROM shelf WHERE genres IS NULL")
def genre_worklist(spark, d):
    return maintenance.genre_worklist(D.shelf(spark, d))


@query(f"""{CORPUS}, l AS (SELECT book_id, max(chapter_idx) AS last_idx FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b') GROUP BY book_id)
SELECT reader_id, p.book_id, CASE WHEN p.book_id % 3 > 0 THEN CASE WHEN p.book_id % 2 = 0 AND status = 'finished' THEN l.last_idx WHEN p.book_id % 2 = 1 THEN position_chapter_idx END END AS chapter_idx FROM progress p LEFT JOIN l USING (book_id)""")
def session_positions(spark, d):
    """Every third book is unread with a position left over, every other one has no position."""
    para, chapter = D.paras(spark, d)
    k = F.col("book_id")
    state = D.progress(spark, d, chapter).withColumns({"status": F.when(k % 3 == 0, "unread").otherwise(F.col("status")), "position_chapter_idx": F.when((k % 2 == 1) | (k % 3 == 0), F.col("position_chapter_idx"))})
    return maintenance.session_positions(state, chapter)


@query(f"""{CORPUS}, {D.SHELF_SQL}, g AS (SELECT author, count(*) AS n FROM shelf GROUP BY author), b AS (SELECT author, coalesce(sum(n) OVER (ORDER BY author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT review_id, author FROM shelf WHERE author IN (SELECT author FROM b WHERE before < 200)""")
def shelf_whole_groups(spark, d):
    return maintenance.whole_groups(D.shelf(spark, d).select("review_id", "author"), "author", "author", 200)


@query(f"{CORPUS} SELECT p.reader_id, p.book_id, status, coalesce(position_chapter_idx > 0 OR status = 'finished', false) AS moved_on FROM progress p")
def conversations_reopened(spark, d):
    para, chapter = D.paras(spark, d)
    state = D.progress(spark, d, chapter)
    c = state.select(F.col("book_id").alias("conv_id"), "book_id", F.lit(0).alias("chapter_idx"))
    return conversations.reopened(c, state).join(state, "book_id").select("reader_id", "book_id", "status", "moved_on")


@query(f"""{CORPUS}, v AS (SELECT book_id, row_number() OVER (PARTITION BY series_id ORDER BY book_order) - 1 AS prior_volumes FROM book),
n AS (SELECT book_id, count_if(chapter_idx <= 1) AS position, count(*) AS chapters FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b') GROUP BY book_id)
SELECT book_id AS conv_id, book_id, prior_volumes, position, chapters FROM v LEFT JOIN n USING (book_id)""")
def conversation_headers(spark, d):
    book = D.books(spark, d)
    c = book.select(F.col("book_id").alias("conv_id"), "book_id", F.lit(1).alias("chapter_idx"))
    return conversations.headers(c, book, D.chapters(D.raw_paras(spark, d)))


@query(f"""{CORPUS}, q AS (SELECT p.reader_id, p.book_id, CASE quality WHEN 1 THEN 'unread' ELSE 'finished' END AS st FROM progress p JOIN (SELECT doc_id AS book_id, max(quality) AS quality FROM labels GROUP BY 1) USING (book_id)),
l AS (SELECT book_id, max(chapter_idx) AS k FROM chapter WHERE kind = 'body' AND NOT regexp_matches(label, '(?i)^\\s*part\\b') GROUP BY book_id)
SELECT q.reader_id, q.book_id, st AS status, CASE st WHEN 'finished' THEN l.k END AS position_chapter_idx,
CASE st WHEN 'unread' THEN 0 ELSE greatest(p.ceiling_seq, coalesce(book_end, 0)) END AS ceiling_seq FROM q JOIN progress p USING (book_id) LEFT JOIN l USING (book_id) LEFT JOIN ends USING (book_id)""")
def set_positions(spark, d):
    """Finished books become unread and the others finished."""
    para, chapter = D.paras(spark, d)
    state = D.progress(spark, d, chapter)
    asked = state.select("reader_id", "book_id", F.when(F.col("status") == "finished", "unread").otherwise("finished").alias("status"), F.lit(None).cast("long").alias("chapter_idx"))
    return progress.set_positions(state, chapter, asked)


@query(f"""{CORPUS}, m AS (SELECT series_id, max(book_order) AS newest, (min(book_order) + max(book_order)) // 2 AS middle FROM book GROUP BY series_id),
q AS (SELECT series_id, 0::BIGINT AS reader_id, newest AS at FROM m UNION ALL SELECT series_id, 1::BIGINT, max(book_order) FROM book JOIN m USING (series_id) WHERE book_order <= middle GROUP BY series_id),
t AS (SELECT reader_id, book_id, b.series_id, book_order, book_order * {schema.BOOK_STRIDE} + 7 AS ceiling_seq FROM q JOIN book b ON b.series_id = q.series_id AND b.book_order = q.at)
SELECT reader_id, b.book_id, CASE WHEN b.book_id = t.book_id THEN 'reading' ELSE 'finished' END AS status, NULL::BIGINT AS position_chapter_idx,
CASE WHEN b.book_id = t.book_id THEN t.ceiling_seq ELSE coalesce(book_end, 0) END AS ceiling_seq FROM t JOIN book b ON b.series_id = t.series_id AND b.book_order <= t.book_order LEFT JOIN ends ON ends.book_id = b.book_id""")
def lens(spark, d):
    """The from-scratch state of two questions about each series: its newest volume and the one half way, one reader each."""
    book = D.books(spark, d)
    ends = D.chapters(D.raw_paras(spark, d)).where(schema.servable(F.col("kind"))).groupBy("book_id").agg(F.max("end_seq").alias("book_end"))
    half = book.groupBy("series_id").agg(F.max("book_order").alias("newest"), F.floor((F.min("book_order") + F.max("book_order")) / 2).alias("middle"))
    halves = book.join(half, "series_id").groupBy("series_id").agg(F.max("book_order").alias("newest"), F.max(F.when(F.col("book_order") <= F.col("middle"), F.col("book_order"))).alias("middle"))
    places = halves.select("series_id", F.posexplode(F.array("newest", "middle")).alias("reader_id", "book_order"))
    asked = book.join(places, ["series_id", "book_order"])
    return progress.lens(book, ends, asked.select(F.col("reader_id").cast("long").alias("reader_id"), "book_id", (schema.book_floor(F.col("book_order")) + 7).alias("ceiling_seq")))


@query(f"""{CORPUS}, b AS (SELECT book_id, max(end_seq) AS bound_seq FROM chapter WHERE chapter_idx <= 2 GROUP BY book_id)
SELECT book_id, chapter_idx, label, kind, end_seq FROM chapter JOIN b USING (book_id) WHERE kind <> 'excerpt' AND end_seq <= bound_seq""")
def causal_chapters(spark, d):
    c = D.chapters(D.raw_paras(spark, d))
    bounds = c.where("chapter_idx <= 2").groupBy("book_id").agg(F.max("end_seq").alias("bound_seq"))
    return causal.causal_chapters(c, bounds).select("book_id", "chapter_idx", "label", "kind", "end_seq")


@query(f"{CORPUS} SELECT book_id, chapter_idx, CASE WHEN kind = 'body' THEN {identity_sql('label')} END AS ref FROM chapter")
def chapter_ref_inverse(spark, d):
    return D.chapters(D.raw_paras(spark, d)).select("book_id", "chapter_idx", maintenance.chapter_ref_of(F.col("kind"), F.col("label")).alias("ref"))
