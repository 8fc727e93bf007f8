"""Stored model responses about chapters: strict validation, the ordered pass of each book, and what it inserts.

A response is one JSON object with a digest and the chapter's entities.  It counts as a whole or not at all: the first
fault, in reading order, is its error.  Types are those of the JSON text (``VARIANT``), so a number in a string's place is a
fault; citations are joined with the chapter's own paragraphs.  The pass folds each book's chapters in order, as what one
chapter declares is what the next one may refer to; only names go through the fold.  Nodes then get their numbers, and
attributes and aliases are resolved by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.tables import stored

# Kinds of nodes and edges, sections and front matter of digests, attempts at a chapter.
NODE_KINDS, EDGE_TYPES = ("named", "unnamed"), ("stated", "inferable")
SECTIONS = ("## Events", "## State changes", "## Open questions")
CHAPTER_KEYS, ROLLUP_KEYS = ("book_id", "chapter_idx", "chapter_label", "part_label"), ("book_id", "level", "target_label")
ATTEMPTS = 2

ENTITIES = (
    "array<struct<designator: string, node_kind: string, cite_para_id: bigint, attributes: array<struct<attr_kind: string, value: string, cite_para_id: bigint>>, "
    "aliases: array<struct<other_designator: string, edge_type: string, cite_para_id: bigint>>>>"
)
FAULT = "struct<at: array<int>, error: string>"
CITE = "struct<at: array<int>, path: string, cite: bigint>"


def parsed_json(text: Column) -> Column:
    """The whole text as one JSON value, null if it is none; control characters in strings are let through.

    The parser stops at the end of the first value, so the text is read inside brackets and inside braces: what follows
    the value breaks one of them.  Objects that repeat a key are no values.
    """
    options = {"allowUnquotedControlChars": "true"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "variant", options)
    held = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "variant", options)
    items = F.try_variant_get(listed, "$", "array<variant>")
    return F.when((F.size(items) == 1) & held.isNotNull(), F.get(items, F.lit(0)))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string, variant>").isNotNull()


def _is_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _items(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _no_text(value: Column, name: str) -> Column:
    return (_kind(_field(value, name)) != "STRING") | (T.strip(F.coalesce(_string(value, name), F.lit(""))) == "")


def _no_int(value: Column, name: str) -> Column:
    return _kind(_field(value, name)) != "BIGINT"


def _fault(bad: Column, at: list, *message) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return F.when(bad, F.struct(F.array(*[F.lit(a) if isinstance(a, int) else a for a in at]).cast("array<int>").alias("at"), F.concat(*parts).alias("error")))


def digest_faults(markdown: Column, keys: tuple[str, ...]) -> list[Column]:
    """Faults of a digest: sections, front matter between dashes, exactly the given keys in it."""
    text = F.coalesce(markdown, F.lit(""))
    parts = F.split(text, "---", 3)
    lines = F.transform(F.split(T.strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), r"\R"), T.strip)
    found = F.transform(F.filter(lines, lambda x: x != ""), lambda x: T.strip(F.substring_index(x, ":", 1)))
    known = F.array(*[F.lit(k) for k in keys])
    differ = (F.size(F.array_except(known, found)) > 0) | (F.size(F.array_except(found, known)) > 0)
    out = [_fault(~F.contains(text, F.lit(s)), [3 + i], "digest_markdown: no section ", s) for i, s in enumerate(SECTIONS)]
    return [*out, _fault(F.size(parts) < 3, [6], "digest_markdown: no front matter"), _fault(differ, [7], "digest_markdown: other front matter keys")]


def _heads(v: Column, keys: tuple[str, ...]) -> list[Column]:
    return [_fault(v.isNull(), [0], "not JSON"), _fault(~_is_object(v), [1], "not an object"), _fault(_no_text(v, "digest_markdown"), [2], "digest_markdown: no text"), *digest_faults(_string(v, "digest_markdown"), keys)]


def _part(a: Column, i: Column, j: Column, order: int, part: str, texts: list[str], choice: tuple[str, tuple[str, ...]] | None) -> Column:
    """Faults of one attribute or alias."""
    path = ["entities[", i, f"].{part}[", j, "]"]
    at = lambda n: [10, i, order, j, n]
    out = [_fault(~_is_object(a), at(0), *path, ": not an object")]
    out += [_fault(_no_text(a, t), at(1 + n), *path, f".{t}: no text") for n, t in enumerate(texts)]
    if choice:
        out.append(_fault(~F.coalesce(_string(a, choice[0]).isin(*choice[1]), F.lit(False)), at(5), *path, f".{choice[0]}: unknown"))
    return F.array(*out, _fault(_no_int(a, "cite_para_id"), at(6), *path, ".cite_para_id: no integer"))


def _entity_faults(e: Column, i: Column) -> Column:
    path, at = ["entities[", i, "]"], lambda n: [10, i, 0, n]
    own = [
        _fault(~_is_object(e), at(0), *path, ": not an object"),
        _fault(_no_text(e, "designator"), at(1), *path, ".designator: no text"),
        _fault(_no_text(e, "node_kind"), at(2), *path, ".node_kind: no text"),
        _fault(~F.coalesce(_string(e, "node_kind").isin(*NODE_KINDS), F.lit(False)), at(3), *path, ".node_kind: unknown"),
        _fault(_no_int(e, "cite_para_id"), at(4), *path, ".cite_para_id: no integer"),
    ]
    lists = [_fault(_field(e, p).isNotNull() & ~_is_list(_field(e, p)), [10, i, n], *path, f".{p}: no list") for n, p in ((1, "attributes"), (2, "aliases"))]
    attributes = F.transform(_items(e, "attributes"), lambda a, j: _part(a, i, j, 1, "attributes", ["attr_kind", "value"], None))
    aliases = F.transform(_items(e, "aliases"), lambda a, j: _part(a, i, j, 2, "aliases", ["other_designator", "edge_type"], ("edge_type", EDGE_TYPES)))
    return F.concat(F.array(*own, *lists), F.flatten(attributes), F.flatten(aliases))


def _cites(e: Column, i: Column) -> Column:
    """Citations of an entity and its parts, each where its fault would stand."""
    cite = lambda x: F.try_variant_get(x, "$.cite_para_id", "bigint")
    one = lambda at, path, x: F.struct(F.array(*[F.lit(a) if isinstance(a, int) else a for a in at]).cast("array<int>").alias("at"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in path]).alias("path"), cite(x).alias("cite"))
    own = F.array(one([10, i, 0, 5], ["entities[", i, "]"], e))
    parts = [F.transform(_items(e, p), lambda a, j: one([10, i, n, j, 7], ["entities[", i, f"].{p}[", j, "]"], a)) for n, p in ((1, "attributes"), (2, "aliases"))]  # noqa: B023
    return F.concat(own, *parts)


def _entity(e: Column) -> Column:
    cite = lambda x: F.try_variant_get(x, "$.cite_para_id", "bigint").alias("cite_para_id")
    attributes = F.transform(_items(e, "attributes"), lambda a: F.struct(_string(a, "attr_kind").alias("attr_kind"), _string(a, "value").alias("value"), cite(a)))
    aliases = F.transform(_items(e, "aliases"), lambda a: F.struct(_string(a, "other_designator").alias("other_designator"), _string(a, "edge_type").alias("edge_type"), cite(a)))
    return F.struct(_string(e, "designator").alias("designator"), _string(e, "node_kind").alias("node_kind"), cite(e), attributes.alias("attributes"), aliases.alias("aliases"))


def validated(responses: DataFrame, para: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, attempt, digest_markdown, entities, error) of ``responses`` (.., response).

    ``para`` (book_id, chapter_idx, para_id) says what a chapter's response may cite.  ``error`` names the first fault and
    its place and is null for a response that counts; the others have no digest and no entities.  A null response is not
    JSON.  A fence of code marks around the text is taken off.
    """
    key = ["book_id", "chapter_idx", "attempt"]
    v = F.col("_v")
    read = responses.select(*key, parsed_json(T.code_fence_body(F.col("response"))).alias("_v"))
    no_list = _fault(~_is_list(_field(v, "entities")), [8], "entities: no list")
    faults = F.concat(F.array(*_heads(v, CHAPTER_KEYS), no_list), F.flatten(F.transform(_items(v, "entities"), _entity_faults)))
    judged = read.select(
        *key,
        F.array_min(F.filter(faults, lambda x: x.isNotNull())).alias("_fault"),
        _string(v, "digest_markdown").alias("digest_markdown"),
        F.transform(_items(v, "entities"), _entity).alias("entities"),
        F.flatten(F.transform(_items(v, "entities"), _cites)).alias("_cites"),
    )
    judged = stored(judged, "responses")
    cited = judged.select(*key, F.explode("_cites").alias("c")).where("c.cite is not null").select(*key, "c.at", "c.path", F.col("c.cite").alias("para_id"))
    own = para.select("book_id", "chapter_idx", "para_id").distinct()
    foreign = cited.join(own, ["book_id", "chapter_idx", "para_id"], "left_anti")
    first = foreign.groupBy(*key).agg(F.min(F.struct("at", F.concat("path", F.lit(".cite_para_id: of another chapter")).alias("error"))).alias("_foreign"))
    both = judged.join(first, key, "left").withColumn("error", F.array_min(F.filter(F.array("_fault", "_foreign"), lambda x: x.isNotNull()))["error"])
    good = F.col("error").isNull()
    return both.select(*key, F.when(good, F.col("digest_markdown")).alias("digest_markdown"), F.when(good, F.col("entities")).alias("entities"), "error")


def rollup_errors(responses: DataFrame) -> DataFrame:
    """``responses`` with ``error``: the first fault of a part's or book's digest, null if it counts."""
    v = F.col("_v")
    read = responses.withColumn("_v", parsed_json(T.code_fence_body(F.col("response"))))
    fault = F.array_min(F.filter(F.array(*_heads(v, ROLLUP_KEYS)), lambda x: x.isNotNull()))
    return read.withColumn("error", fault["error"]).drop("_v")


FOLDED = "book_id long, chapter_idx long, status string, attempt int, calls int, error string"
FOLDED_ARROW = pa.schema([("book_id", pa.int64()), ("chapter_idx", pa.int64()), ("status", pa.string()), ("attempt", pa.int32()), ("calls", pa.int32()), ("error", pa.string())])
ROWS_A_BATCH = 10_000


def chapter_pass(chapter: DataFrame, checked: DataFrame, registry: DataFrame, done: DataFrame, prompt_hash: str, schema_version: int, resume: bool = True) -> DataFrame:
    """(book_id, chapter_idx, status, attempt, calls, error) of every chapter but excerpts, each book's in order.

    ``checked`` is what ``validated`` gives, at most two attempts a chapter; ``registry`` (book_id, designator, chapter_idx)
    has the known names and the chapters they were cited in; ``done`` (book_id, chapter_idx, prompt_hash, schema_version) the
    digests there are.  A chapter whose digest is of this prompt and version is ``skipped``; else the first attempt that
    counts is taken and the chapter is ``done``, which an alias of a name that nobody declared prevents as a fault does.
    A chapter made again first forgets the names that were cited in it.  After two failures the chapter is ``failed``, and
    the book's later ones are ``not reached``.  Books are dealt out and sorted, known names first, and a task goes through
    the rows of its books as they come: names of one book are the state of its fold, and nothing else of it is held.
    """
    made = done.groupBy("book_id", "chapter_idx").agg(F.bool_or((F.col("prompt_hash") == prompt_hash) & (F.col("schema_version") == schema_version)).alias("current"), F.lit(True).alias("stale"))
    names = F.transform("entities", lambda e: e["designator"])
    wanted = F.flatten(F.transform("entities", lambda e, i: F.transform(e["aliases"], lambda a, j: F.struct(F.concat(F.lit("entities["), i.cast("string"), F.lit("].aliases["), j.cast("string"), F.lit("]")).alias("path"), a["other_designator"].alias("name")))))
    tries = checked.select("book_id", "chapter_idx", "attempt", "error", names.alias("declared"), wanted.alias("wanted"))
    served = chapter.where("kind <> 'excerpt'").select("book_id", "chapter_idx", "start_seq")
    work = served.join(made, ["book_id", "chapter_idx"], "left").join(tries, ["book_id", "chapter_idx"], "left")
    work = work.select("book_id", "chapter_idx", "start_seq", (F.coalesce("current", F.lit(False)) & F.lit(resume)).alias("current"), F.coalesce("stale", F.lit(False)).alias("stale"), "attempt", "error", "declared", "wanted")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for book, of_book in groupby((r for b in batches for r in b.to_pylist()), itemgetter("book_id")):
            anchors, stopped = {}, False
            for (start, idx), rows in groupby(of_book, itemgetter("start_seq", "chapter_idx")):
                if start is None:
                    anchors |= {r["designator"]: r["cited_in"] for r in rows if r["designator"] is not None}
                    continue
                rows = list(rows)
                if stopped or rows[0]["current"]:
                    out.append((book, idx, "not reached" if stopped else "skipped", None, 0, None))
                    continue
                left = {n: c for n, c in anchors.items() if c != idx} if rows[0]["stale"] else anchors
                calls, error, taken = 0, "no response", None
                for r in [r for r in rows if r["attempt"] is not None][:ATTEMPTS]:
                    calls, error = calls + 1, r["error"]
                    if error is None:
                        declared = set(r["declared"])
                        error = next((f"{w['path']}.other_designator: unknown" for w in r["wanted"] if w["name"] not in left and w["name"] not in declared), None)
                    if error is None:
                        taken = r["attempt"]
                        anchors = left
                        anchors.update((n, -1) for n in declared if n not in left)
                        break
                stopped = taken is None
                out.append((book, idx, "failed" if stopped else "done", taken, calls, error))
                if len(out) >= ROWS_A_BATCH:
                    yield _folded(out)
                    out = []
        yield _folded(out)

    names = registry.select("book_id", F.col("chapter_idx").alias("cited_in"), "designator")
    both = work.unionByName(names, allowMissingColumns=True)
    dealt = both.repartition("book_id").sortWithinPartitions("book_id", "start_seq", "chapter_idx", "attempt")
    return stored(dealt.mapInArrow(fold, FOLDED), "chapter-pass")


def _folded(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(FOLDED_ARROW.names, r, strict=True)) for r in rows], schema=FOLDED_ARROW)


def _numbered(rows: DataFrame, order: list[str], after: Column | int) -> DataFrame:
    """``rows`` with ``node_id``: consecutive numbers in order.  Rows are ranged and written with their place in their
    range; only the ranges' sizes meet, in a window of a row a range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(ranged, "numbered").withColumn("_range", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, "_range").withColumn("node_id", F.col("_before") + F.col("_nth") + 1 + after).drop("_at", "_range", "_nth", "_before")


def insert_entities(chapter: DataFrame, checked: DataFrame, passed: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame, para: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, attributes) after a pass: what the ``done`` chapters declared, beside what was there and stays.

    A chapter made again takes its old nodes with it, and these take their edges and attributes.  A name that stays known
    gets no new node; else the first chapter that declares it makes one, numbered after all there were, by book, chapter
    and place.  Attributes and aliases are stamped with their chapter's end; aliases of a node that a later chapter took
    away go with it.  Chapters that failed or were not reached leave no row.
    """
    ran = passed.where("status = 'done'").select("book_id", "chapter_idx", "attempt").join(chapter.select("book_id", "chapter_idx", "start_seq", "end_seq"), ["book_id", "chapter_idx"])
    again = ran.join(done.select("book_id", "chapter_idx").distinct(), ["book_id", "chapter_idx"])
    gone = nodes.join(para.select("book_id", F.col("para_id").alias("cite_para_id"), "chapter_idx"), ["book_id", "cite_para_id"]).join(again.select("book_id", "chapter_idx", "start_seq"), ["book_id", "chapter_idx"])
    gone = stored(gone.select("node_id", "book_id", "designator", F.col("start_seq").alias("gone_at")).distinct(), "gone-nodes")
    stay = nodes.join(gone.select("node_id"), "node_id", "left_anti")
    known = stay.groupBy("book_id", "designator").agg(F.max("node_id").alias("old_id"))
    forgot = gone.groupBy("book_id", "designator").agg(F.max("gone_at").alias("gone_at"))
    entities = ran.join(checked.select("book_id", "chapter_idx", "attempt", "entities"), ["book_id", "chapter_idx", "attempt"])
    entities = stored(entities.select("book_id", "chapter_idx", "start_seq", "end_seq", F.posexplode("entities").alias("place", "e")), "declared")
    lives = (F.col("gone_at").isNull()) | (F.col("start_seq") >= F.col("gone_at"))
    declared = entities.select("book_id", F.col("e.designator").alias("designator"), "start_seq", "place", F.col("end_seq").alias("first_seq"), F.col("e.node_kind").alias("node_kind"), F.col("e.cite_para_id").alias("cite_para_id"))
    fresh = declared.join(known, ["book_id", "designator"], "left_anti").join(forgot, ["book_id", "designator"], "left").where(lives)
    first = F.row_number().over(Window.partitionBy("book_id", "designator").orderBy("start_seq", "place"))
    fresh = fresh.withColumn("_nth", first).where("_nth = 1").drop("_nth", "gone_at")
    top = nodes.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("m")).scalar()
    fresh = stored(_numbered(fresh, ["book_id", "start_seq", "place"], top), "new-nodes")
    named = known.select("book_id", "designator", F.col("old_id").alias("id")).unionByName(fresh.select("book_id", "designator", F.col("node_id").alias("id")))

    def resolved(rows: DataFrame, name: str, to: str) -> DataFrame:
        by = named.join(forgot, ["book_id", "designator"], "left").select("book_id", F.col("designator").alias(name), F.col("id").alias(to), "gone_at")
        return rows.join(by, ["book_id", name]).where(lives).drop("gone_at")

    said = resolved(entities.select("book_id", "start_seq", "end_seq", F.col("e.designator").alias("name"), "e.attributes", "e.aliases"), "name", "node_id")
    new_attrs = said.select("node_id", F.explode("attributes").alias("a"), "end_seq").select("node_id", "a.attr_kind", "a.value", F.col("end_seq").alias("first_seq"), "a.cite_para_id")
    alias = said.select("book_id", "start_seq", F.col("node_id").alias("src_node_id"), F.explode("aliases").alias("a"), "end_seq")
    alias = alias.select("book_id", "start_seq", "src_node_id", F.col("a.other_designator").alias("other"), "a.edge_type", F.col("end_seq").alias("revealed_at_seq"), "a.cite_para_id")
    new_edges = resolved(alias, "other", "dst_node_id").select("src_node_id", "dst_node_id", "edge_type", "revealed_at_seq", "cite_para_id")
    lost = gone.select("node_id")
    kept_edges = edges
    for end in ("src_node_id", "dst_node_id"):
        kept_edges = kept_edges.join(lost.select(F.col("node_id").alias(end)), end, "left_anti")
    node_columns = ["node_id", "book_id", "designator", "node_kind", "first_seq", "cite_para_id"]
    return (
        stay.select(*node_columns).unionByName(fresh.select(*node_columns)),
        kept_edges.select(*new_edges.columns).unionByName(new_edges),
        attrs.join(lost, "node_id", "left_anti").select(*new_attrs.columns).unionByName(new_attrs),
    )
