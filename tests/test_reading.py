"""Invariants of bounded retrieval, reading state, structure and the text functions."""

import inspect
import random

import pytest
from pyspark.sql import functions as F

from lectern import schema
from lectern.functions import text as T
from lectern.operators.components import spanning_forest
from lectern.operators import causal, chapters, conversations, maintenance, progress, search, shelf
from lectern.operators.retrieval import BoundedCorpus, printed_identity

STRIDE, SPINE = schema.BOOK_STRIDE, schema.SPINE_STRIDE


def fixture(spark, ceilings):
    """Two series with a volume 1 each; every paragraph names its own place; one excerpt chapter a book."""
    books = [(1, "One", "A", "s", 1, False), (2, "Two", "A", "s", 2, False), (3, "Other", "B", "t", 1, False)]
    chapter, para = [], []
    for b, _, _, _, order, _ in books:
        for c in range(5):
            kind = "excerpt" if c == 3 else "body"
            seqs = [order * STRIDE + c * SPINE + p for p in range(4)]
            chapter.append((b, c, f"Chapter {c + 1}", "Part 1", seqs[0], seqs[-1], kind))
            para += [(b, c, p, s, c, f"Chapter {c + 1}", f"red fox tok{b}x{c}x{p} here", kind) for p, s in enumerate(seqs)]
    state = [(r, b, "reading", 0, s) for r, b, s in ceilings]
    return BoundedCorpus(
        spark.createDataFrame(books, schema.BOOK), spark.createDataFrame(chapter, schema.CHAPTER), spark.createDataFrame(para, schema.PARA), spark.createDataFrame(state, schema.PROGRESS)
    )


def boundary_ceilings():
    rng = random.Random(7)
    edges = [STRIDE + c * SPINE + p + e for c in range(5) for p in (0, 3) for e in (-1, 0, 1)]
    return edges + [rng.randrange(STRIDE, STRIDE + 6 * SPINE) for _ in range(20)] + [0, STRIDE - 1, 2 * STRIDE + SPINE]


def test_nothing_above_a_ceiling(spark):
    """Many readers at once: for each ceiling and method, no paragraph beyond the reader's own range shows."""
    ceilings = dict(enumerate(boundary_ceilings()))
    c = fixture(spark, [(r, 1, s) for r, s in ceilings.items()])
    cited = spark.createDataFrame([(1, i, p) for i in range(5) for p in range(4)], "book_id long, spine_idx long, para_idx long")
    requests = spark.createDataFrame([(r, r, 1, lo, hi) for r in ceilings for lo, hi in ((-5, 10**12), (3, 0))][: len(ceilings)], "request_id long, reader_id long, book_id long, lo_idx long, hi_idx long")
    answers = {
        "read": c.read(), "spans": c.read(requests), "context": c.context(cited, 60), "points": c.points(cited), "regex": c.search_regex("tok[0-9]"),
        "words": c.search(["fox"]), "marks": c.citation_marks(cited), "first": c.first_seen(spark.createDataFrame([(k, e) for k in ceilings for e in ("tok1x4x3", "red fox", "absent")], "reader_id long, entity string")),
    }
    for name, df in answers.items():
        for r in df.where("global_seq is not null").collect():
            assert r["book_id"] == 1, name
            assert r["global_seq"] <= ceilings[r["reader_id"]], name
            assert (r["global_seq"] % STRIDE) // SPINE != 3, name
    whole = c.readable.groupBy("reader_id").count().collect()
    for r in whole:
        s = ceilings[r["reader_id"]]
        assert r["count"] == sum(STRIDE + k * SPINE + p <= s for k in (0, 1, 2, 4) for p in range(4))
    for r in c.list_chapters().collect():
        assert STRIDE + r["chapter_idx"] * SPINE <= ceilings[r["reader_id"]]
    for r in c.list_positions().where("label is not null").collect():
        assert STRIDE + r["chapter_idx"] * SPINE <= ceilings[r["reader_id"]]
    seen = {(r["reader_id"], r["entity"]): r["chapter"] for r in answers["first"].collect()}
    assert len({seen[k, "absent"] for k in ceilings}) == 1
    assert seen[0, "tok1x4x3"] == seen[0, "absent"]


def test_ranges_hold_in_their_own_book_only(spark):
    c = fixture(spark, [(1, 1, STRIDE + SPINE), (1, 2, 2 * STRIDE + 1)])
    got = {(r["book_id"], r["global_seq"]) for r in c.read().collect()}
    assert got == {(1, STRIDE + p) for p in range(4)} | {(1, STRIDE + SPINE)} | {(2, 2 * STRIDE), (2, 2 * STRIDE + 1)}


def test_no_method_takes_a_bound():
    for name, f in inspect.getmembers(BoundedCorpus, inspect.isfunction):
        if name != "__init__":
            assert not {"ceiling", "bound", "max_seq", "hi"} & set(inspect.signature(f).parameters)


def test_raising_a_ceiling_only_appends(spark):
    low, high = fixture(spark, [(1, 1, STRIDE + SPINE + 1)]), fixture(spark, [(1, 1, STRIDE + 4 * SPINE)])
    a, b = (x.assemble().collect()[0]["context"] for x in (low, high))
    assert b.startswith(a)
    assert "tok1x3" not in b


def test_assembly_over_budget_raises(spark):
    with pytest.raises(Exception, match="over budget"):
        fixture(spark, [(1, 1, STRIDE + 4 * SPINE)]).assemble(max_tokens=3).collect()


def test_search_conditions(spark):
    df = spark.createDataFrame([(1, "The Café, red fox"), (2, "fox the red"), (3, None)], "n int, text string").withColumn("toks", search.tokens(F.col("text")))
    hit = lambda c: [r["n"] for r in df.where(c).orderBy("n").collect()]
    assert hit(search.term("cafe")) == [1]
    assert hit(search.phrase("red fox")) == [1]
    assert hit(search.prefix("re") & ~search.term("cafe")) == [2]
    assert hit(search.near("the", "fox", 0)) == [2]
    assert hit(search.near("the", "fox", 2)) == [1, 2]
    assert hit(search.first("fox")) == [2]



def test_watermarks(spark):
    rng = random.Random(3)
    events = [(r, 1, k, k, "reset" if rng.random() < 0.2 else "set", rng.randrange(100)) for r in range(6) for k in range(40)]
    df = spark.createDataFrame([(a, b, c, r * 100 + e, x, s) for (a, b, c, e, x, s), r in zip(events, [e[0] for e in events], strict=True)], "reader_id long, book_id long, ts long, event_id long, action string, seq long")
    want = {}
    for r, _, _, _, action, s in events:
        want[r] = s if action == "reset" else max(want.get(r, 0), s)
    assert {x["reader_id"]: x["ceiling_seq"] for x in progress.watermark_final(df).collect()} == want
    last = progress.watermark_history(df).groupBy("reader_id").agg(F.max_by("ceiling_seq", "ts").alias("c"))
    assert {x["reader_id"]: x["c"] for x in last.collect()} == want


def test_set_positions(spark):
    c = fixture(spark, [(1, 1, STRIDE + 2 * SPINE + 3), (1, 2, 2 * STRIDE + 9 * SPINE), (1, 3, 5)])
    req = spark.createDataFrame([(1, 1, "reading", 0), (1, 2, "unread", None), (2, 1, "finished", None)], "reader_id long, book_id long, status string, chapter_idx long")
    got = {(r["reader_id"], r["book_id"]): (r["status"], r["position_chapter_idx"], r["ceiling_seq"]) for r in progress.set_positions(c._progress, c._chapter, req).collect()}
    assert got == {(1, 1): ("reading", 0, STRIDE + 2 * SPINE + 3), (1, 2): ("unread", None, 0), (1, 3): ("reading", 0, 5), (2, 1): ("finished", 4, STRIDE + 4 * SPINE + 3)}
    bad = spark.createDataFrame([(1, 1, "reading", 77)], "reader_id long, book_id long, status string, chapter_idx long")
    with pytest.raises(Exception, match="unknown status or chapter"):
        progress.set_positions(c._progress, c._chapter, bad).collect()


def test_lens_and_cascade(spark):
    c = fixture(spark, [(1, 2, 2 * STRIDE + 1)])
    ends = c._chapter.groupBy("book_id").agg(F.max("end_seq").alias("book_end"))
    t = spark.createDataFrame([(9, 2, 2 * STRIDE + 5)], "reader_id long, book_id long, ceiling_seq long")
    assert {(r["book_id"], r["status"], r["ceiling_seq"]) for r in progress.lens(c._book, ends, t).collect()} == {(1, "finished", STRIDE + 4 * SPINE + 3), (2, "reading", 2 * STRIDE + 5)}
    got = {(r["book_id"], r["status"], r["position_chapter_idx"]) for r in progress.series_cascade(c._progress, c._book, progress.book_ends(c._chapter)).collect()}
    assert got == {(1, "finished", 4), (2, "reading", 0)}


def test_printed_names_of_chapters(spark):
    labels = ["20: The House", "Chapter 007", "  Prologue ", "Interlude: A", "Interlude: B", "Interludes I", "EPILOGUE", "Part 3", "Copyright", "3rd", "0", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i long, label string")
    got = [r["ref"] for r in df.select("i", printed_identity(F.col("label")).alias("ref")).orderBy("i").collect()]
    assert got == ["20", "7", "prologue", "interlude: a", "interlude: b", "interludes i", "epilogue", None, None, None, "0", None]
    kinds = spark.createDataFrame([("body", "Chapter 2"), ("reference", "Chapter 2"), ("body", "Part 1")], "kind string, label string")
    assert [r["r"] for r in kinds.select(maintenance.chapter_ref_of(F.col("kind"), F.col("label")).alias("r")).collect()] == ["2", None, None]


def test_unread_books_have_no_position(spark):
    c = fixture(spark, [])
    state = spark.createDataFrame([(1, 1, "unread", 3, 0), (1, 2, "finished", None, 5), (1, 3, "reading", 2, 5)], schema.PROGRESS)
    assert {r["book_id"]: r["chapter_idx"] for r in maintenance.session_positions(state, c._chapter).collect()} == {1: None, 2: 4, 3: 2}


def test_registry_knows_facts_of_known_nodes(spark):
    """Facts of a missing node count nowhere, excerpt citations hide a fact, missing citations do not."""
    c = fixture(spark, [])
    at = lambda k, p=0: STRIDE + k * SPINE + p
    nodes = spark.createDataFrame([(10, 1, at(0), at(0)), (11, 1, at(3), at(3)), (12, 2, 2 * STRIDE, 2 * STRIDE)], "node_id long, book_id long, first_seq long, cite_seq long")
    edges = spark.createDataFrame([(10, at(1), None), (99, at(1), None), (11, at(2), at(2)), (10, at(2), at(3))], "src_node_id long, revealed_at_seq long, cite_seq long")
    attrs = spark.createDataFrame([(10, at(0), at(0)), (98, at(0), None), (10, at(4), None)], "node_id long, first_seq long, cite_seq long")
    got = {r["chapter_idx"]: (r["n_nodes"], r["n_edges"], r["n_attrs"]) for r in causal.registry_asof(c._chapter, nodes, edges, attrs, c._para).where("book_id = 1").collect()}
    assert got == {0: (1, 0, 1), 1: (1, 1, 1), 2: (1, 2, 1), 3: (1, 2, 1), 4: (1, 2, 2)}


def test_spans_are_in_chapters(spark):
    c = fixture(spark, [(1, 1, STRIDE + 2 * SPINE + 1)])
    asked = [(1, 1, 1, 1, 0), (2, 1, 1, -7, 0), (3, 1, 1, 2, 9), (4, 1, 1, -5, -1), (5, 1, 2, 0, 9), (6, 1, 1, 3, 3)]
    req = spark.createDataFrame(asked, "request_id long, reader_id long, book_id long, lo_idx long, hi_idx long")
    got = {}
    for r in c.read(req).collect():
        got.setdefault(r["request_id"], []).append(r["chapter_idx"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [0] * 4 + [1] * 4, 2: [0] * 4, 3: [2] * 2}
    notes = {r["request_id"]: (r["capped"], r["marker"]) for r in c.read_notes(req).collect()}
    assert notes == {1: (False, None), 2: (False, None), 3: (False, "Chapter 3"), 4: (False, None), 5: (False, None), 6: (False, None)}


def test_causal_range_raises_above_its_bound(spark):
    c = fixture(spark, [])
    ask = lambda lo, hi, bound: causal.causal_range(c._para, spark.createDataFrame([(1, lo, hi, bound)], "book_id long, start_seq long, end_seq long, bound_seq long"))
    assert ask(STRIDE, STRIDE + 5 * SPINE, 2 * STRIDE).count() == 16
    with pytest.raises(Exception, match="above its bound"):
        ask(STRIDE, STRIDE + 5 * SPINE, STRIDE).collect()


def test_file_names(spark):
    got = [one(spark, T.safe_file_name(F.col("a"), F.col("b")), a=a, b=7) for a in ("x/My Book (v1) [a].epub", "a:b?c", "..", None, "Ünï.EPUB", "dir/")]
    assert got == ["My Book (v1) [a].epub", "a_b_c.epub", "7.epub", "7.epub", "n_.EPUB", "dir.epub"]


def test_order_key(spark):
    df = spark.createDataFrame([(3, 7, 11)], "b long, s long, p long").select(schema.global_seq(F.col("b"), F.col("s"), F.col("p")).alias("k"))
    assert df.collect()[0]["k"] == 3 * STRIDE + 7 * SPINE + 11
    d = df.select(*[c.alias(n) for n, c in schema.decode_seq(F.col("k")).items()]).collect()[0]
    assert (d["book_order"], d["spine_idx"], d["para_idx"]) == (3, 7, 11)
    old = spark.createDataFrame([(2_005_017,)], "k long").select(schema.rescale_legacy(F.col("k")).alias("k")).collect()[0]["k"]
    assert old == 2 * STRIDE + 5 * SPINE + 17
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(schema.global_seq(F.lit(1), F.lit(schema.MAX_SPINE), F.lit(0))).collect()


def step_by_step(labels):
    """The classifier's rules one at a time."""
    import re

    at = lambda p, s: re.search(p, s)
    n = len(labels)
    start = next((i for i, x in enumerate(labels) if re.match(chapters.NARRATIVE, x.strip())), 0)
    kinds = ["reference" if at(chapters.REFERENCE, labels[i]) else "boilerplate" for i in range(start)] + [None] * (n - start)
    cut = next((i for i in range(start, n) if at(chapters.EXCERPT, labels[i])), n)
    kinds[cut:] = ["excerpt"] * (n - cut)
    i = cut - 1
    while i >= start and (at(chapters.REFERENCE, labels[i]) or at(chapters.BOILERPLATE, labels[i])):
        kinds[i] = "boilerplate"
        i -= 1
    return [k or "body" for k in kinds]


def test_kinds_agree_with_the_rules(spark):
    pool = ["Cover", "Copyright", "Dramatis Personae", "Maps", "Prologue", "Chapter 1", "2", "Part One", "Interlude", "A Tale", "Glossary", "Acknowledgments", "Excerpt from B", "Also by C", "IV. Home"]
    rng = random.Random(5)
    books = [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(400)]
    df = spark.createDataFrame([(b, i, x) for b, ls in enumerate(books) for i, x in enumerate(ls)], "book_id long, chapter_idx long, label string")
    got = {(r["book_id"], r["chapter_idx"]): r["kind"] for r in chapters.classify_kinds(df).collect()}
    for b, ls in enumerate(books):
        assert [got[b, i] for i in range(len(ls))] == step_by_step(ls), ls


def test_markers_and_parts(spark):
    texts = ["CHAPTER 12 Dawn", "Part twenty", "PART IV", "prologue", "Epilogue", " 7 ", "seven", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [tuple(r["m"]) if r["m"] else None for r in df.orderBy("i").select(chapters.parse_marker(F.col("t")).alias("m")).collect()]
    assert got == [("chapter", "Chapter 12"), ("part", "Part 20"), ("part", "Part IV"), ("prologue", "Prologue"), ("epilogue", "Epilogue"), ("chapter", "Chapter 7"), None, None]
    c = spark.createDataFrame([(1, 0, "PART ONE", 0, 0, 0), (1, 1, "Chapter 1", 5, 1, 1), (1, 2, "PART TWO", 0, 2, 2), (2, 0, "PART ONE", 0, 0, 0)], "book_id long, chapter_idx long, label string, n_paras long, start_spine long, end_spine long")
    got = {(r["book_id"], r["chapter_idx"], r["label"], r["part_label"], r["start_spine"], r["end_spine"]) for r in chapters.compose_parts(c).collect()}
    assert got == {(1, 0, "Chapter 1", "Part 1", 0, 2), (2, 0, "PART ONE", "Part 1", 0, 0)}


def test_tiers(spark):
    docs = spark.createDataFrame(
        [(1, i, None, "x") for i in range(4)] + [(2, i, "H" if i < 2 else None, "x") for i in range(4)] + [(3, i, None, "Chapter 3" if i == 0 else "x") for i in range(4)] + [(4, 0, None, None)],
        "book_id long, spine_idx long, heading string, first_block string",
    )
    toc = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 2, "b"), (2, 0, 3, "z"), (2, 1, 1, "y")], "book_id long, entry_idx long, spine_idx long, label string")
    assert {r["book_id"]: r["label_tier"] for r in chapters.choose_tier(docs, toc).collect()} == {1: "L1", 2: "L2", 3: "L3", 4: "L4"}


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).collect()[0]["x"]


def test_text_functions(spark):
    x = F.col("x")
    f = lambda column, value: one(spark, column, x=value)
    assert f(T.slug(x), "  The Book: 2! ") == "the-book-2"
    assert f(T.humanize(x), "the_red-FOX") == "The Red Fox"
    assert f(T.series_of(x), "A Title (Red Fox, #1.5)") == "Red Fox"
    assert f(T.series_number(x), "A Title (Red Fox, #1.5)") == 1.5
    assert f(T.strip_series(x), "A Title (Red Fox, #1.5)") == "A Title"
    assert f(T.strip_series(x), "A Title (2001)") == "A Title (2001)"
    assert set(f(T.title_keys(x), "The Fox: A Tale - Part (x)")) == {"foxatalepart", "fox", "talepart", "foxatale", "part"}
    assert f(T.title_keys(x), None) == []
    assert f(T.author_tokens(x), "Chakra, S.A.") == ["chakra", "s", "a"]
    assert f(T.question_title(x), "a " * 80).endswith("…")
    assert f(T.citations(x), "see [b:1:p2] and [b:1:p2], [c:0:p0]") == ["b:1:p2", "c:0:p0"]
    assert f(T.review_id(x), "https://e.x/review/show/77?utm=a#b") == "77"
    assert f(T.user_id(x), "https://e.x/user/show/123-name") == "123"
    assert f(T.rfc_date(x), "Tue, 5 Mar 2019 07:08:09 -0800") == "2019-03-05T07:08:09-08:00"
    assert f(T.rfc_date(x), "rubbish") is None
    assert f(T.review_date(x), "Mar 5, 2019") == "2019-03-05"
    assert f(T.review_date(x), "Mar 2019") == "2019-03"
    assert f(T.review_date(x), "2019") == "2019"
    assert f(T.review_date(x), "Foo 2019") is None
    assert f(T.exact_day(x), "2019-03") is None
    assert f(T.roman(x), 1994) == "MCMXCIV"
    assert f(T.top_genres(x), "Audiobook, A, ,B,C,D") == ["A", "B", "C"]
    fenced = {"```json\n{}\n```": "{}", "```{}```": "{}", "```json {}```": "{}", "```json\n{}": "```json\n{}", " x ": " x ", "```python\n{}\n```": "python\n{}", "a\n```\n{}\n```": "a\n```\n{}\n```"}
    assert {k: f(T.code_fence_body(x), k) for k in fenced} == fenced
    assert f(T.strip_html(x), "<p>a &amp; b</p>") == "a & b"
    assert f(T.word_count(x), " a  b ") == 2
    assert [one(spark, T.percent(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((1, 8), (0, 0), (3, 8))] == [12, 0, 38]
    assert one(spark, T.custom_shelves(F.col("a"), F.col("b")), a="Read, fav , ,x", b="read") == ["fav", "x"]


def test_shelf_of_nothing(spark):
    empty = spark.createDataFrame([], "review_id long, shelf_book_id string, title string, author string, shelf string, num_pages long, published_year long, user_rating long, genres string, date_read string, date_started string, date_added string, cover_small string")
    assert shelf.totals(empty).collect()[0]["books"] == 0
    assert shelf.by_month(empty).collect() == [] and shelf.by_decade(empty).collect() == []
    assert shelf.durations(empty).collect()[0]["n"] == 0


def test_manual_links_stay(spark):
    links = spark.createDataFrame([(1, "m", "manual"), (2, "old", "auto")], "book_id long, shelf_book_id string, source string")
    proposed = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "book_id long, candidate string")
    got = {(r["book_id"], r["shelf_book_id"], r["source"]) for r in shelf.apply_links(links, proposed).collect()}
    assert got == {(1, "m", "manual"), (2, "y", "auto"), (3, "z", "auto")}


def test_conversation_log(spark):
    t = spark.createDataFrame([(1, 0, "q", "a [b:0:p1]"), (1, 1, "r", "s [b:0:p1]")], "conv_id long, ord long, question string, answer string")
    new = spark.createDataFrame([(1, 5, "x", "y"), (2, 6, "z", "w")], "conv_id long, seq long, question string, answer string")
    assert {(r["conv_id"], r["ord"]) for r in conversations.append_turns(t, new).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert [r["ord"] for r in conversations.drop_last(t).collect()] == [0]
    assert conversations.citation_counts(t).collect()[0]["times"] == 2


def test_ranks_over_stretches(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(300)], "g long, o long")
    got = {(r["g"], r["o"]): r["rank"] for r in conversations.ranked(df, "g", "o", width=7).collect()}
    assert got == {(k % 3, k): k // 3 for k in range(300)}


def test_causal_text_raises_above_its_bound(spark):
    c = fixture(spark, [(1, 1, 1)])
    ask = lambda k, bound: causal.causal_text(c._para, c._chapter, spark.createDataFrame([(1, k, bound)], "book_id long, chapter_idx long, bound_seq long"))
    assert ask(1, STRIDE + 2 * SPINE).count() == 4
    for k, bound in ((3, 9 * STRIDE), (2, STRIDE), (40, 9 * STRIDE)):
        with pytest.raises(Exception, match="not causally readable"):
            ask(k, bound).collect()


def test_unresolved_aliases(spark):
    rows = [(1, [("Fox", [("Wolf",), ("Bear",), ("Fox",)])], None), (1, None, "not JSON"), (2, [("Wolf", [])], None)]
    checked = spark.createDataFrame(rows, "book_id long, entities array<struct<designator:string,aliases:array<struct<other_designator:string>>>>, error string")
    known = spark.createDataFrame([(1, "Bear")], "book_id long, designator string")
    assert [tuple(x) for x in causal.unresolved_aliases(checked, known).collect()] == [(1, "Wolf")]


def test_cast_of_all_readers(spark):
    """The forest has one edge less than each component has nodes, and cuts at every ceiling give all edges' components."""
    rng = random.Random(12)
    nodes = [(b, v, rng.randrange(60)) for b in (1, 2, 3) for v in range(40)]
    edges = [(b, rng.randrange(40), rng.randrange(40), rng.randrange(60)) for b in (1, 2) for _ in range(90)] + [(3, 5, 5, 1), (3, 1, 2, 7), (3, 1, 2, 7), (3, 2, 1, 9)]
    ceilings = [(r, b, c) for b in (1, 2, 3) for r, c in enumerate((-1, 0, 5, 12, 30, 59, 90))]
    frame = spark.createDataFrame
    got = causal.cast_as_read(frame(nodes, "book_id long, node long, seen long"), frame(edges, "book_id long, a long, b long, seen long"), frame(ceilings, "reader_id long, book_id long, ceiling_seq long"))
    want = set()
    for r, b, c in ceilings:
        name = {v: v for k, v, s in nodes if k == b and s <= c}
        for _ in name:
            for k, x, y, s in edges:
                if k == b and s <= c and x in name and y in name:
                    name[x] = name[y] = min(name[x], name[y])
        want |= {(r, b, v, m) for v, m in name.items()}
    assert {tuple(x) for x in got.collect()} == want
    one = frame([e[1:] for e in edges if e[0] == 1], "a long, b long, seen long")
    assert spanning_forest(one).count() == len({v for e in edges if e[0] == 1 for v in e[1:3] if e[1] != e[2]}) - 1
    assert spanning_forest(one.limit(0)).collect() == []


def test_components_by_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(80), rng.randrange(80), k) for k in range(60)] + [(k, k + 1, 5) for k in range(200, 240)]
    df = spark.createDataFrame(edges, "a long, b long, revealed_at long")
    for bound in (None, 30):
        parent = {}

        def find(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b, at in edges:
            if bound is None or at <= bound:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        assert {r["node"]: r["component"] for r in causal.identity_components(df, bound).collect()} == {n: find(n) for n in list(parent)}


def test_components_of_a_long_chain(spark):
    """Many more steps than rounds; a node that only meets itself is a component."""
    order = list(range(300))
    random.Random(2).shuffle(order)
    chain = [(a, b, 1) for a, b in zip(order[:-1], order[1:], strict=True)]
    df = spark.createDataFrame([*chain, (999, 999, 1)], "a long, b long, revealed_at long")
    assert {r["node"]: r["component"] for r in causal.identity_components(df).collect()} == {k: 0 for k in order} | {999: 999}


def test_commit_is_idempotent_and_per_book(spark, tmp_path):
    target = str(tmp_path / "store")
    row = lambda b, x: spark.createDataFrame([(b, x)], "book_id long, x string")
    maintenance.commit_books(target, {"para": row(1, "old"), "manifest": row(1, "m")}, spark)
    maintenance.commit_books(target, {"para": row(2, "two")}, spark)
    for _ in range(2):
        maintenance.commit_books(target, {"para": row(1, "new")}, spark)
    assert {(r["book_id"], r["x"]) for r in spark.read.parquet(f"{target}/para").collect()} == {(1, "new"), (2, "two")}
    for b in (1, 2, 1):
        maintenance.commit_books(f"{target}-1", {"para": row(b, "one folder")}, spark, buckets=1)
    assert sorted(r["book_id"] for r in spark.read.parquet(f"{target}-1/para").collect()) == [1, 2]


def test_delete_books(spark):
    c = fixture(spark, [(1, 1, STRIDE)])
    tables = {
        "para": c._para, "progress": c._progress, "conversation": spark.createDataFrame([(10, 1), (11, 2)], "conv_id long, book_id long"),
        "turn": spark.createDataFrame([(10, 0), (11, 0)], "conv_id long, ord long"),
    }
    out = maintenance.delete_books(tables, spark.createDataFrame([(1,)], "book_id long"))
    assert {r["book_id"] for r in out["para"].collect()} == {2, 3}
    assert out["progress"].collect() == [] and [r["conv_id"] for r in out["turn"].collect()] == [11]


def test_small_tables(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    ch = spark.createDataFrame([("a", None), ("b", "3"), ("c", "4")], "key string, value string")
    assert {tuple(r) for r in maintenance.put_settings(s, ch).collect()} == {("b", "3"), ("c", "4")}
    sh = spark.createDataFrame([("x", None), ("y", "old")], "shelf_book_id string, genres string")
    f = spark.createDataFrame([("x", ["A", "B"])], "shelf_book_id string, genres array<string>")
    assert {tuple(r) for r in maintenance.apply_genres(sh, f).collect()} == {("x", "A, B"), ("y", "old")}
    m = spark.createDataFrame([("x", ""), ("y", "own")], "shelf_book_id string, cover string")
    got = maintenance.month_covers(m, spark.createDataFrame([(1, "x")], "book_id long, shelf_book_id string"), spark.createDataFrame([(1, "c.jpg")], "book_id long, path string"))
    assert {tuple(r) for r in got.collect()} == {("x", "c.jpg"), ("y", "own")}


def test_payloads_know_only_the_past(spark):
    import json

    c = fixture(spark, [(1, 1, STRIDE)])
    nodes = spark.createDataFrame([(1, "Fox", STRIDE + 1), (1, "Wolf", STRIDE + 2 * SPINE)], "book_id long, designator string, first_seq long")
    got = {(r["book_id"], r["chapter_idx"]): json.loads(r["payload"]) for r in maintenance.prompt_payloads(c._para, nodes, c._chapter).collect()}
    assert got[1, 0]["registry"] == [] and got[1, 2]["registry"] == ["Fox"] and got[1, 4]["registry"] == ["Fox", "Wolf"]
    assert (1, 3) not in got and [p["text"][8:] for p in got[1, 1]["paragraphs"]][0].startswith("tok1x1x0")
    m = json.loads(maintenance.manifests(c._book, c._chapter, c._para).where("book_id = 1").collect()[0]["manifest"])
    assert (m["chapters"], m["excerpt"], m["paragraphs"]) == (5, 1, 20)


def test_parts_of_contents(spark):
    """Two part entries at least, in reading order; other entries and repeated ones of a document do not count."""
    toc = spark.createDataFrame(
        [(1, 0, 0, "Part One"), (1, 1, 0, "PART 2"), (1, 2, 1, "Chapter 1"), (1, 3, 4, "Part III: x"), (2, 0, 0, "Part 1"), (2, 1, 1, "Chapter 1"), (3, 0, 4, "Part 1"), (3, 1, 0, "Part 2")],
        "book_id long, entry_idx long, spine_idx long, label string",
    )
    assert sorted(tuple(r) for r in chapters.toc_parts(toc).collect()) == [(1, 0, "Part 1"), (1, 4, "Part III")]
    docs = spark.createDataFrame([(b, i, f"h{i}", "x") for b in (1, 2, 3) for i in range(9)], "book_id long, spine_idx long, heading string, first_block string")
    assert {r["book_id"]: r["label_tier"] for r in chapters.label_ladder(docs, toc).collect()} == {1: "L1+L2", 2: "L2", 3: "L2"}
    kinds = spark.createDataFrame([(1, "body"), (1, "excerpt"), (2, "boilerplate"), (2, None), (3, "body")], "book_id long, kind string")
    assert {r["book_id"]: r["has_body"] for r in chapters.body_checks(kinds).collect()} == {1: True, 2: False, 3: True}


def test_colours_heights_and_dates(spark):
    def colour(text):
        h = 0
        units = text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "little")) % 2**32
        return T.SERIES_COLOURS[h % 7]

    for text in ("", "a", "mistborn-era-one", "Ünï 😀 long " * 9):
        assert one(spark, T.series_colour(F.col("a")), a=text) == colour(text)
    assert [one(spark, T.spine_height(F.col("a").cast("long")), a=n) for n in (None, 0, 96, 592, 1088, 5000)] == [156, 150, 150, 158, 166, 166]
    minute, hour = 60, 3600
    cases = {29: "just now", 30: "1 min ago", 59 * minute + 29: "59 min ago", 59 * minute + 30: "1 hr ago", 23 * hour + 29 * minute: "23 hr ago", 23 * hour + 30 * minute: "1 day ago", 6 * 24 * hour: "6 days ago", 7 * 24 * hour: "8 Aug 2026"}
    now = F.timestamp_seconds(F.lit(1786752000))  # 2026-08-15
    for past, shown in cases.items():
        assert one(spark, T.relative_date(F.timestamp_seconds(F.lit(1786752000) - F.col("a")), now), a=past) == shown
    assert one(spark, T.long_date(F.to_date("a")), a="2026-08-04") == "4 August 2026"


def test_turn_results(spark):
    turns = spark.createDataFrame([(1, 0, "abc", "de [x:1:p2] [x:1:p2]"), (1, 1, "f", None), (2, 0, "g", "h")], "conv_id long, ord long, question string, answer string")
    prefix = spark.createDataFrame([(1, "0123456789")], "conv_id long, text string")
    got = {(r["conv_id"], r["ord"]): (r["n_messages"], r["prompt_chars"], r["citations"]) for r in conversations.turn_results(turns, prefix).collect()}
    assert got == {(1, 0): (2, 13, ["x:1:p2"]), (1, 1): (4, 10 + 23 + 1, None), (2, 0): (2, 1, [])}
