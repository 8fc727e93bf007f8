"""Queries of validation, pass and inserts, over responses made up for every chapter of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import causal, extraction
from lectern.plans.registry import query
from lectern.sources import driver_tables as D
from lectern.tables import still_there, stored

CORPUS = D.corpus_sql()
CHAPTERS_A_TASK = 10_000

#: A response with @B, @C, @P and @Q for its book, chapter, first and last paragraph, @N for a name and @O for another one.
TEMPLATE = (
    '{"digest_markdown":"---\\nbook_id: @B\\nchapter_idx: @C\\nchapter_label: x\\npart_label: y\\n---\\n## Events\\n## State changes\\n## Open questions","entities":['
    '{"designator":"@N","node_kind":"named","cite_para_id":@P,"attributes":[{"attr_kind":"role","value":"v@C","cite_para_id":@Q}],"aliases":[{"other_designator":"@O","edge_type":"stated","cite_para_id":@P}]},'
    '{"designator":"keeper","node_kind":"unnamed","cite_para_id":@Q}]}'
)
#: What is replaced in the template by what, and the error that it makes.
FAULTS = [
    ("", "", None),
    ("keeper", "the keeper", None),
    ("}]},", "}]", "not JSON"),
    ("part_label: y\\n", "", "digest_markdown: other front matter keys"),
    ("part_label", "part_label: z\\nmood", "digest_markdown: other front matter keys"),
    ("---", "--", "digest_markdown: no front matter"),
    ("## Events", "## Event", "digest_markdown: no section ## Events"),
    ("digest_markdown", "digest", "digest_markdown: no text"),
    ('"entities":', '"entities":{},"people":', "entities: no list"),
    ('"designator":"@N",', "", "entities[0].designator: no text"),
    ('"keeper"', "5", "entities[1].designator: no text"),
    ('"@N"', '" "', "entities[0].designator: no text"),
    ('"unnamed"', '"robot"', "entities[1].node_kind: unknown"),
    ('"cite_para_id":@P,', '"cite_para_id":"@P",', "entities[0].cite_para_id: no integer"),
    ('"cite_para_id":@P,', '"cite_para_id":7,', "entities[0].cite_para_id: of another chapter"),
    ('"v@C"', "null", "entities[0].attributes[0].value: no text"),
    ('"value":"v@C","cite_para_id":@Q', '"value":"v@C","cite_para_id":7', "entities[0].attributes[0].cite_para_id: of another chapter"),
    ('"stated"', '"maybe"', "entities[0].aliases[0].edge_type: unknown"),
    ('"stated","cite_para_id":@P', '"stated","cite_para_id":7', "entities[0].aliases[0].cite_para_id: of another chapter"),
]


def _text(c: DataFrame, fault, other) -> F.Column:
    """The template with a numbered fault, its places filled in."""
    text = F.lit(TEMPLATE)
    for i, (old, new, _) in enumerate(FAULTS):
        if old:
            text = F.when(fault == i, F.replace(F.lit(TEMPLATE), F.lit(old), F.lit(new))).otherwise(text)
    at = {"@B": F.col("book_id"), "@C": F.col("chapter_idx"), "@P": F.col("start_seq"), "@Q": F.col("end_seq"), "@N": F.concat(F.lit("n"), F.col("chapter_idx") % 3), "@O": other}
    for place, value in at.items():
        text = F.replace(text, F.lit(place), value.cast("string"))
    return text


def _paragraphs(spark, d) -> tuple[DataFrame, DataFrame]:
    """(chapter, para), from one pass over the texts."""
    para = stored(D.raw_paras(spark, d).select("book_id", "chapter_idx", "global_seq"), "places")
    return stored(D.chapters(para), "chapters"), para.withColumnRenamed("global_seq", "para_id")


def _dealt(c: DataFrame) -> DataFrame:
    """Chapters in as many tasks as their responses take: rows are small beside the work that is made of them, so the
    planner, which goes by bytes, would leave them in a few."""
    return c.repartition(max(64, -(-c.count() // CHAPTERS_A_TASK)), "book_id", "chapter_idx")


def _error(e: str | None) -> str:
    return "NULL" if e is None else f"'{e}'"


@query(f"{CORPUS} SELECT book_id, chapter_idx, ([{', '.join(_error(e) for *_, e in FAULTS)}])[(book_id * 7 + chapter_idx * 3) % {len(FAULTS)} + 1] AS error FROM chapter")
def response_errors(spark, d):
    """The fault of each chapter's response, one kind after the other."""
    c, para = _paragraphs(spark, d)
    text = _text(c, (F.col("book_id") * 7 + F.col("chapter_idx") * 3) % len(FAULTS), F.lit("keeper"))
    given = _dealt(c).select("book_id", "chapter_idx", F.lit(1).alias("attempt"), text.alias("response"))
    return extraction.validated(given, para).select("book_id", "chapter_idx", "error")


_GIVEN: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _given(spark, d) -> dict[str, DataFrame]:
    """The tables of ``_made_up``, once in an application, and again if their files are gone."""
    key = spark.sparkContext.applicationId, d
    if key not in _GIVEN or not still_there(*_GIVEN[key].values()):
        _GIVEN[key] = _made_up(spark, d)
    return _GIVEN[key]


def _passed(spark, d) -> dict[str, DataFrame]:
    """The tables of ``_given`` with the pass over them, for the queries that need it."""
    g = _given(spark, d)
    if "passed" not in g:
        g["passed"] = extraction.chapter_pass(g["chapter"], g["checked"], g["registry"], g["done"], "now", 2)
    return g


def _made_up(spark, d) -> dict[str, DataFrame]:
    """Two attempts at each chapter, what the books' registries hold, and the digests there are.

    Where book and chapter add up to a multiple of three the first attempt is cut off, to a multiple of six the second; to
    one more than a multiple of five the first names somebody unknown.  Every fourth book knows three names from its
    first chapter, whose digest is old in half of them; the books after these know one from their second, which is up to date.
    """
    (c, para), b, k = _paragraphs(spark, d), F.col("book_id"), F.col("chapter_idx")
    dealt = _dealt(c)
    other = F.when(k >= 2, F.concat(F.lit("n"), (k + 1) % 3)).otherwise("keeper")
    first = dealt.select("book_id", "chapter_idx", F.lit(1).alias("attempt"), _text(c, F.when((b + k) % 3 == 0, 2).otherwise(0), F.when((b + k) % 5 == 1, "nobody").otherwise(other)).alias("response"))
    second = dealt.select("book_id", "chapter_idx", F.lit(2).alias("attempt"), _text(c, F.when((b + k) % 6 == 0, 2).otherwise(0), other).alias("response"))
    known = c.where(((b % 4 == 0) & (k == 0)) | ((b % 4 == 1) & (k == 1))).select("book_id", "chapter_idx", F.explode(F.when(k == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("i"), "start_seq")
    nodes = known.select((b * 10 + F.col("i") + 1).alias("node_id"), "book_id", F.concat(F.lit("n"), "i").alias("designator"), F.lit("named").alias("node_kind"), F.lit(0).cast("long").alias("first_seq"), F.col("start_seq").alias("cite_para_id"), "chapter_idx", "i")
    edges = nodes.where("i = 0 and chapter_idx = 0").select(F.col("node_id").alias("src_node_id"), (F.col("node_id") + 1).alias("dst_node_id"), F.lit("inferable").alias("edge_type"), F.col("first_seq").alias("revealed_at_seq"), "cite_para_id")
    attrs = nodes.select("node_id", F.lit("old").alias("attr_kind"), F.lit("v").alias("value"), "first_seq", "cite_para_id")
    done = c.where(((b % 8 == 0) & (k == 0)) | ((b % 4 == 1) & (k == 1))).select("book_id", "chapter_idx", F.when(k == 1, "now").otherwise("old").alias("prompt_hash"), F.lit(2).alias("schema_version"))
    checked = stored(extraction.validated(first.unionByName(second), para), "checked")
    registry = nodes.select("book_id", "designator", "chapter_idx")
    return {"chapter": c, "checked": checked, "registry": registry, "nodes": nodes.drop("chapter_idx", "i"), "edges": edges, "attrs": attrs, "para": para, "done": done}


PASS = f"""{CORPUS}, w AS (SELECT book_id AS b, chapter_idx AS k, start_seq AS p, end_seq AS q, book_id % 4 = 1 AND chapter_idx = 1 AS current FROM chapter WHERE kind <> 'excerpt'),
f AS (SELECT b, min(k) FILTER ((b + k) % 6 = 0 AND NOT current) AS bad FROM w GROUP BY b),
st AS (SELECT w.*, CASE WHEN k > bad THEN 'not reached' WHEN k = bad THEN 'failed' WHEN current THEN 'skipped' ELSE 'done' END AS status FROM w JOIN f USING (b)),
old AS (SELECT c.book_id * 10 + i + 1 AS node_id, c.book_id AS b, 'n' || i AS designator, start_seq AS cite, c.chapter_idx = 0 AND i = 0 AS paired,
  c.book_id % 8 = 0 AND EXISTS (SELECT 1 FROM st WHERE st.b = c.book_id AND k = 0 AND status = 'done') AS gone
  FROM chapter c, (SELECT unnest([0, 1, 2]) AS i) x WHERE (c.book_id % 4 = 0 AND c.chapter_idx = 0) OR (c.book_id % 4 = 1 AND c.chapter_idx = 1 AND i = 1)),
said AS (SELECT b, k, p, q, 0 AS place, 'n' || (k % 3) AS designator, 'named' AS node_kind, p AS cite FROM st WHERE status = 'done' UNION ALL SELECT b, k, p, q, 1, 'keeper', 'unnamed', q FROM st WHERE status = 'done'),
first AS (SELECT * FROM said s WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.b = s.b AND old.designator = s.designator AND NOT gone) QUALIFY row_number() OVER (PARTITION BY b, designator ORDER BY p, place) = 1),
fresh AS (SELECT coalesce((SELECT max(node_id) FROM old), 0) + row_number() OVER (ORDER BY b, p, place) AS node_id, * FROM first),
node AS (SELECT node_id, b AS book_id, designator, 'named' AS node_kind, 0::BIGINT AS first_seq, cite AS cite_para_id FROM old WHERE NOT gone UNION ALL SELECT node_id, b, designator, node_kind, q, cite FROM fresh),
src AS (SELECT s.*, n.node_id, CASE WHEN k >= 2 THEN 'n' || ((k + 1) % 3) ELSE 'keeper' END AS other FROM said s JOIN node n ON n.book_id = s.b AND n.designator = s.designator WHERE place = 0)"""


@query(f"""{PASS} SELECT b AS book_id, k AS chapter_idx, status, CASE WHEN status = 'done' THEN CASE WHEN (b + k) % 3 = 0 OR (b + k) % 5 = 1 THEN 2 ELSE 1 END END AS attempt,
CASE status WHEN 'done' THEN CASE WHEN (b + k) % 3 = 0 OR (b + k) % 5 = 1 THEN 2 ELSE 1 END WHEN 'failed' THEN 2 ELSE 0 END AS calls, CASE WHEN status = 'failed' THEN 'not JSON' END AS error FROM st""")
def chapter_pass(spark, d):
    return _passed(spark, d)["passed"].select("book_id", "chapter_idx", "status", "attempt", "calls", "error")


def _inserted(spark, d):
    g = _passed(spark, d)
    return extraction.insert_entities(g["chapter"], g["checked"], g["passed"], g["nodes"], g["edges"], g["attrs"], g["para"], g["done"])


@query(f"{PASS} SELECT * FROM node")
def pass_nodes(spark, d):
    return _inserted(spark, d)[0]


@query(f"""{PASS} SELECT node_id AS src_node_id, node_id + 1 AS dst_node_id, 'inferable' AS edge_type, 0 AS revealed_at_seq, cite AS cite_para_id FROM old WHERE paired AND NOT gone
UNION ALL SELECT src.node_id, n.node_id, 'stated', q, p FROM src JOIN node n ON n.book_id = b AND n.designator = other""")
def pass_edges(spark, d):
    return _inserted(spark, d)[1]


@query(f"""{PASS} SELECT node_id, 'old' AS attr_kind, 'v' AS value, 0 AS first_seq, cite AS cite_para_id FROM old WHERE NOT gone UNION ALL SELECT node_id, 'role', 'v' || k, q, q FROM src""")
def pass_attributes(spark, d):
    return _inserted(spark, d)[2]


@query(f"""{CORPUS}, t AS (SELECT book_id, chapter_idx AS k, 'n' || (chapter_idx % 3) AS named, CASE WHEN chapter_idx >= 2 THEN 'n' || ((chapter_idx + 1) % 3) ELSE 'keeper' END AS other, (book_id + chapter_idx) AS m FROM chapter),
r AS (SELECT book_id, named, CASE WHEN m % 5 = 1 THEN 'nobody' ELSE other END AS alias FROM t WHERE m % 3 > 0 UNION ALL SELECT book_id, named, other FROM t WHERE m % 6 > 0),
known AS (SELECT book_id, named AS designator FROM r UNION SELECT book_id, 'keeper' FROM r UNION SELECT book_id, 'nobody' FROM book WHERE book_id % 3 = 0)
SELECT DISTINCT book_id, alias AS designator FROM r WHERE (book_id, alias) NOT IN (SELECT book_id, designator FROM known)""")
def aliases_unresolved(spark, d):
    """Names that responses refer to and nobody declared; every third book knows the missing one."""
    known = D.books(spark, d).where("book_id % 3 = 0").select("book_id", F.lit("nobody").alias("designator"))
    return causal.unresolved_aliases(_given(spark, d)["checked"], known)
