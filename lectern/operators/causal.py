"""As-of windows over the registry of entities, digest rollups, identity components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.components import components, spanning_forest
from lectern.tables import stored


def causal_chapters(chapter: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chapters, excerpts aside, that end at or before each book's bound (book_id, bound_seq)."""
    j = chapter.where("kind <> 'excerpt'").join(bounds.select("book_id", "bound_seq"), "book_id")
    return j.where("end_seq <= bound_seq").select(*chapter.columns)


def causal_text(para: DataFrame, chapter: DataFrame, asked: DataFrame) -> DataFrame:
    """Paragraphs of asked chapters (book_id, chapter_idx, bound_seq); an excerpt or a chapter above its bound raises."""
    j = asked.join(chapter.select("book_id", "chapter_idx", "end_seq", F.col("kind").alias("_kind")), ["book_id", "chapter_idx"], "left")
    bad = F.col("end_seq").isNull() | (F.col("_kind") == "excerpt") | (F.col("end_seq") > F.col("bound_seq"))
    ok = j.where(F.when(bad, F.raise_error(F.lit("chapter not causally readable")).cast("boolean")).otherwise(F.lit(True)))
    return para.join(ok.select("book_id", "chapter_idx"), ["book_id", "chapter_idx"])


def causal_range(para: DataFrame, asked: DataFrame) -> DataFrame:
    """Paragraphs, excerpts aside, of asked spans (book_id, start_seq, end_seq, bound_seq); a span that ends above its
    bound raises instead of being cut."""
    bad = F.col("_end") > F.col("_bound")
    spans = asked.select("book_id", F.col("start_seq").alias("_start"), F.col("end_seq").alias("_end"), F.col("bound_seq").alias("_bound"))
    ok = spans.where(F.when(bad, F.raise_error(F.lit("span above its bound")).cast("boolean")).otherwise(F.lit(True)))
    return para.where("kind <> 'excerpt'").join(ok, "book_id").where(F.col("global_seq").between(F.col("_start"), F.col("_end"))).select(*para.columns)


def registry_asof(chapter: DataFrame, nodes: DataFrame, edges: DataFrame, attrs: DataFrame, para: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, n_nodes, n_edges, n_attrs): what the registry knows at each chapter's end.

    Nodes (node_id, book_id, first_seq, cite_seq) need a cited paragraph that is no excerpt.  Edges (src_node_id,
    revealed_at_seq, cite_seq?) and attributes (node_id, first_seq, cite_seq?) belong to the book of their node, whether
    or not that node itself counts; those of no node count nowhere, and a citation may be missing but not an excerpt.
    Facts are counted per chapter of their revelation and summed up in order, so no fact meets all later chapters.
    """
    from pyspark.sql import Window

    cites = para.select("book_id", F.col("global_seq").alias("cite_seq"), F.col("kind").alias("_kind"))
    zero = {c: F.lit(0) for c in ("n_nodes", "n_edges", "n_attrs")}

    def facts(df: DataFrame, at: str, what: str) -> DataFrame:
        counted = df.join(cites, ["book_id", "cite_seq"], "left").where("_kind <> 'excerpt'" + ("" if what == "n_nodes" else " or _kind is null and cite_seq is null"))
        return counted.select("book_id", F.col(at).alias("at"), F.lit(None).cast("long").alias("chapter_idx"), *[(F.lit(1) if c == what else v).alias(c) for c, v in zero.items()])

    owner = nodes.select("node_id", "book_id")
    e = edges.select(F.col("src_node_id").alias("node_id"), "revealed_at_seq", "cite_seq").join(owner, "node_id")
    a = attrs.select("node_id", "first_seq", "cite_seq").join(owner, "node_id")
    marks = chapter.select("book_id", F.col("end_seq").alias("at"), F.col("chapter_idx").cast("long").alias("chapter_idx"), *[v.alias(c) for c, v in zero.items()])
    rows = facts(nodes, "first_seq", "n_nodes").unionByName(facts(e, "revealed_at_seq", "n_edges")).unionByName(facts(a, "first_seq", "n_attrs")).unionByName(marks)
    upto = Window.partitionBy("book_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({c: F.sum(c).over(upto) for c in zero})
    return summed.where("chapter_idx is not null").select("book_id", "chapter_idx", *zero)


def digest_rollup(digests: DataFrame) -> DataFrame:
    """Chapter digests (book_id, chapter_idx, part_label?, lo, hi, text) rolled up to parts and books; spans are the
    sources' least and greatest, texts theirs in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_idx", "text"))), lambda x: x["text"]), "\n")
    part = digests.where("part_label is not null").groupBy("book_id", "part_label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_sources"), text.alias("text"), F.min("chapter_idx").alias("chapter_idx"))
    top = part.select("book_id", "chapter_idx", "lo", "hi", "text").unionByName(digests.where("part_label is null").select("book_id", "chapter_idx", "lo", "hi", "text"))
    book = top.groupBy("book_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_sources"), text.alias("text"))
    return part.select("book_id", F.lit("part").alias("level"), "part_label", "lo", "hi", "n_sources", "text").unionByName(
        book.select("book_id", F.lit("book").alias("level"), F.lit(None).cast("string").alias("part_label"), "lo", "hi", "n_sources", "text")
    )


def servable_digests(digests: DataFrame, ranges: DataFrame) -> DataFrame:
    """The coarsest digests (book_id, level, lo, hi) that lie whole below a reader's ceiling: book, else parts, else chapters.

    A digest lies in a coarser one if the greatest end of those that begin no later reaches its end, so no digest meets another.
    """
    rank = F.when(F.col("level") == "book", 3).when(F.col("level") == "part", 2).otherwise(1)
    ok = digests.join(ranges, "book_id").where(F.col("hi") <= F.col("ceiling")).withColumn("_rank", rank)
    begun = Window.partitionBy("reader_id", "book_id").orderBy("lo").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = lambda least: F.max(F.when((F.col("_rank") >= least) & F.col("lo").isNotNull(), F.col("hi"))).over(begun)
    over = ok.withColumns({"_part": reach(2), "_book": reach(3)})
    covered = F.when(F.col("_rank") == 1, F.col("hi") <= F.col("_part")).when(F.col("_rank") == 2, F.col("hi") <= F.col("_book"))
    return over.where(~F.coalesce(covered & F.col("lo").isNotNull(), F.lit(False))).drop("_rank", "ceiling", "_part", "_book")


def replace_digests(digests: DataFrame, new: DataFrame) -> DataFrame:
    """Digests with new ones in place of those of the same (book, level, chapter, part), nulls equal."""
    a, b = digests.alias("a"), new.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("book_id", "level", "chapter_idx", "part_label")]
    on = same[0] & same[1] & same[2] & same[3]
    return a.join(b, on, "left_anti").select("a.*").unionByName(new)


def pending(chapter: DataFrame, done: DataFrame, prompt_hash: str, schema_version: int) -> DataFrame:
    """Work left: chapters without an output of this prompt and version."""
    made = done.where((F.col("prompt_hash") == prompt_hash) & (F.col("schema_version") == schema_version)).select("book_id", "chapter_idx")
    return chapter.where("kind <> 'excerpt'").join(made.distinct(), ["book_id", "chapter_idx"], "left_anti")


def unresolved_aliases(checked: DataFrame, registry: DataFrame) -> DataFrame:
    """(book_id, designator) of aliases, in responses that count (``extraction.validated``), that name no known designator
    of their book."""
    e = checked.where("error is null").select("book_id", F.explode("entities").alias("e"))
    known = registry.select("book_id", "designator").unionByName(e.select("book_id", F.col("e.designator").alias("designator"))).distinct()
    alias = e.select("book_id", F.explode("e.aliases").alias("a")).select("book_id", F.col("a.other_designator").alias("designator")).distinct()
    return alias.join(known, ["book_id", "designator"], "left_anti")


def identity_components(edges: DataFrame, bound: int | None = None) -> DataFrame:
    """(node, component): components over edges (a, b, revealed_at) revealed by the bound; least node as the name."""
    e = edges if bound is None else edges.where(F.col("revealed_at") <= bound)
    e = stored(e.select("a", "b").distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    found = components(e).withColumnRenamed("vertex", "node")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cast_as_read(nodes: DataFrame, edges: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(reader_id, book_id, node, component) of what every reader knows at once: nodes (book_id, node, seen) and the
    components that edges (book_id, a, b, seen) make of them, each as of the reader's ceiling in the book.

    All edges are thinned to a spanning forest first, whatever the number of readers; it is cut at each ceiling, so a
    reader costs no more than the rows that are returned.  A component is called by its least node.  An edge counts where
    both its nodes are known.
    """
    vertex = lambda node: F.struct("book_id", F.col(node).alias("node"))
    first = nodes.groupBy("book_id", "node").agg(F.min("seen").alias("seen"))
    known = lambda end: first.select("book_id", F.col("node").alias(end), F.col("seen").alias(f"seen_{end}"))
    later = edges.join(known("a"), ["book_id", "a"]).join(known("b"), ["book_id", "b"])
    whole = later.select(vertex("a").alias("a"), vertex("b").alias("b"), F.greatest("seen", "seen_a", "seen_b").alias("seen"))
    forest = stored(spanning_forest(whole), "identity-forest").select(F.col("a.book_id").alias("book_id"), F.col("a.node").alias("a"), F.col("b.node").alias("b"), "seen")
    of = lambda node: F.struct("reader_id", "book_id", F.col(node).alias("node"))
    cut = forest.join(ceilings, "book_id").where(F.col("seen") <= F.col("ceiling_seq"))
    found = components(cut.select(of("a").alias("a"), of("b").alias("b"))).select("vertex.reader_id", "vertex.book_id", "vertex.node", F.col("component.node").alias("component"))
    seen = first.join(ceilings, "book_id").where(F.col("seen") <= F.col("ceiling_seq")).select("reader_id", "book_id", "node")
    return seen.join(found, ["reader_id", "book_id", "node"], "left").select("reader_id", "book_id", "node", F.coalesce("component", "node").alias("component"))
