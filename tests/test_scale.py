"""Work that has to stay in proportion to the rows, held by what the stages read and write."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import shelf


def stages_of(spark, run):
    """The stages that a call runs, as the status store has them."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    known = lambda: {s.stageId(): s for s in (lambda found: [found.apply(i) for i in range(found.size())])(store.stageList(None, False, False, none, None))}
    before = known().keys()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [s for i, s in known().items() if i not in before]


def noop(df):
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("what", ["propose", "candidates", "matches"])
def test_shared_titles_do_not_multiply(spark, what):
    """400 uploads and 300 shelf books under one title: no row for each pair of them."""
    books = spark.range(400).select(F.col("id").alias("book_id"), F.lit("Fox: Den").alias("title"), F.concat(F.lit("Ann "), F.col("id") % 3).alias("author"))
    entries = spark.range(300).select(F.col("id").alias("review_id"), F.format_string("b%03d", "id").alias("shelf_book_id"), F.lit("The Fox").alias("title"), F.lit("Ann Lee").alias("author"), F.lit("read").alias("shelf"))
    run = {"propose": shelf.propose_links, "candidates": shelf.link_candidates, "matches": shelf.upload_matches}[what]
    assert sum(s.shuffleWriteRecords() for s in stages_of(spark, lambda: noop(run(books, entries)))) < 10_000
    first = run(books, entries).where("book_id = 7").first()
    expected = {"propose": (7, "ambiguous", 300, None), "candidates": (7, [f"b{i:03d}" for i in range(300)]), "matches": (7, None)}
    assert tuple(first) == expected[what]


def test_links_of_books_listed_twice(spark):
    """A book under two titles has the candidates of both; under two authors each shelf book counts with each."""
    books = spark.createDataFrame([(1, "Fox", "Ann Lee"), (1, "Den", "Bob Ray"), (2, "Den", None), (3, "?", "Ann Lee"), (None, "Fox", None)], "book_id long, title string, author string")
    entries = spark.createDataFrame([(1, "x", "Fox", "Ann Lee", "read"), (2, "y", "Den", "Cy", "read")], "review_id long, shelf_book_id string, title string, author string, shelf string")
    found = {tuple(r) for r in shelf.propose_links(books, entries).collect()}
    assert found == {(1, "ambiguous", 2, None), (2, "link", 1, "y"), (3, "no_match", 0, None), (None, "no_match", 0, None)}
    assert {tuple(r) for r in shelf.link_candidates(books, entries, " ").collect()} == {(1, "x y")}
    assert {tuple(r) for r in shelf.upload_matches(books, entries).collect()} == {(1, "x"), (2, "y"), (3, None), (None, None)}


@pytest.mark.parametrize("name", ["response_errors", "aliases_unresolved"])
def test_responses_are_judged_in_many_tasks(spark, sf_dir, name):
    """Rows of chapters are small, and the planner would judge all their responses in one task."""
    from lectern.plans import extraction_queries as Q

    Q._GIVEN.clear()
    ran = stages_of(spark, lambda: noop(getattr(Q, name)(spark, sf_dir)))
    assert max(s.numTasks() for s in ran if s.shuffleReadRecords()) >= 64


def test_pass_of_many_books(spark):
    """The pass goes through books in batches; 20,000 books of one chapter each take no group each."""
    from lectern.operators import extraction as X

    chapter = spark.range(20_000).selectExpr("id as book_id", "0L as chapter_idx", "id * 10 as start_seq", "id * 10 + 2 as end_seq", "'body' as kind")
    said = "array(named_struct('designator', 'A', 'aliases', array(named_struct('other_designator', 'B', 'edge_type', 'stated', 'cite_para_id', id))))"
    checked = spark.range(20_000).where("id % 2 = 0").selectExpr("id as book_id", "0L as chapter_idx", "1 as attempt", f"{said} as entities", "cast(null as string) as error")
    registry = spark.range(20_000).where("id % 4 = 0").selectExpr("id as book_id", "'B' as designator", "5L as chapter_idx")
    done = spark.range(0).selectExpr("id as book_id", "id as chapter_idx", "'' as prompt_hash", "1 as schema_version")
    passed = X.chapter_pass(chapter, checked, registry, done, "now", 2)
    got = {tuple(r) for r in passed.groupBy((F.col("book_id") % 4).alias("k"), "status", "attempt", "calls", "error").count().collect()}
    unknown = "entities[0].aliases[0].other_designator: unknown"
    assert got == {(0, "done", 1, 1, None, 5000), (2, "failed", None, 1, unknown, 5000), (1, "failed", None, 0, "no response", 5000), (3, "failed", None, 0, "no response", 5000)}


def test_index_moves_no_words(spark):
    """The lexical index is written where its texts are read: no word is shuffled or spilled."""
    from lectern.operators.lexical import LexicalIndex, Phrase

    para = spark.range(2_000).selectExpr("id as book_id", "id as global_seq", "'body' as kind", "concat(repeat('red fox ', 50), 'den', id) as text")
    built = []
    ran = stages_of(spark, lambda: built.append(LexicalIndex.build(para)))
    assert sum(s.shuffleWriteRecords() + s.memoryBytesSpilled() for s in ran) == 0
    found = built[0].hits([Phrase.of("fox den1", prefix=True)]).where("n0 > 0")
    assert {(r["book_id"], r["dl"], tuple(r["at0"])) for r in found.collect()} == {(i, 101, (99,)) for i in range(2_000) if str(i).startswith("1")}


@pytest.mark.parametrize("name", ["page_paragraphs", "page_first_heading", "epub_paragraphs"])
def test_python_holds_few_documents(spark, sf_dir, name):
    """Whole archives and pages come to Python in small batches; a smaller setting is kept."""
    from lectern.plans.catalogue import QUERIES

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, held in (("10000", 250), ("0", 250), ("100", 100)):
            spark.conf.set(key, given)
            if name != "epub_paragraphs" or given == "10000":
                QUERIES[name](spark, sf_dir)
                assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["cast_as_read", "digests_replaced"])
def test_documents_are_cut_once(spark, sf_dir, monkeypatch, name):
    """Chapters of all documents are written once and read from there, however often a query needs them."""
    from lectern.plans.catalogue import QUERIES
    from lectern.sources import driver_tables as D

    whole, read = D.table(spark, sf_dir, "documents"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    monkeypatch.setattr(D, "table", lambda *_: whole.mapInPandas(counted, whole.schema))
    noop(QUERIES[name](spark, sf_dir))
    assert read.value == whole.count()


@pytest.mark.parametrize("name", ["chapters_read_pct", "digests_served", "label_ladder"])
def test_memory_of_one_task(spark, sf_dir, name):
    """No stage holds the sorts and tables of a dozen joins and aggregates at once."""
    from lectern.plans.catalogue import QUERIES

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        ran = stages_of(spark, lambda: noop(QUERIES[name](spark, sf_dir)))
    finally:
        spark.conf.set(key, before)
    peak = max(s.peakExecutionMemory() / s.numTasks() for s in ran) / 2**20
    assert peak < 250, peak


def test_digests_in_coarser_ones(spark):
    """A digest goes only if one coarser begins no later and ends no earlier, of the same reader and book."""
    from lectern.operators import causal

    rows = [(1, "book", 0, 100), (1, "part", 0, 40), (1, "part", 41, 90), (1, "chapter", 0, 9), (1, "chapter", 35, 45), (1, "chapter", 41, 90), (2, "chapter", 0, 9), (1, "chapter", None, 5)]
    digests = spark.createDataFrame(rows, "book_id long, level string, lo long, hi long")
    ranges = spark.createDataFrame([(7, 1, 95), (8, 1, 100), (7, 2, 100), (9, 1, 8)], "reader_id long, book_id long, ceiling long")
    got = {tuple(r) for r in causal.servable_digests(digests, ranges).select("reader_id", "book_id", "level", "lo", "hi").collect()}
    part = {(7, 1, "part", 0, 40), (7, 1, "part", 41, 90), (7, 1, "chapter", 35, 45)}
    none = {(r, 1, "chapter", None, 5) for r in (7, 8, 9)}
    assert got == part | none | {(8, 1, "book", 0, 100), (7, 2, "chapter", 0, 9)}


def test_plain_words_are_not_described_one_by_one(monkeypatch):
    """Lower-cased words of letters go straight into arrays, and give the windows that their description gives."""
    from lectern.llm import decontaminate as M

    texts = ["twelve red apples cost seven dollars in the old town", "five miles", "", "Anna ran 12 km. Bob Ray ran 7km over grüne x-ray hills"]
    rows = lambda: sorted((int(o), int(p), int(h), tuple(map(int, s))) for o, p, h, s in zip(*M.windows(texts, 5), strict=True))
    described, describe = [], M._describe.__wrapped__
    monkeypatch.setattr(M, "_describe", lambda w: described.append(w) or describe(w))
    ours = rows()
    assert set(described) == {"Anna", "12", "km.", "Bob", "Ray", "7km", "x-ray"}
    for word in ("twelve", "miles", "grüne", "ran"):
        kind = M.NUM if word in M.NUMBER_WORDS else M.UNIT if word in M.UNITS else M.PLAIN
        assert describe(word) == ((M._hash(word), kind, False),)
    assert {(o, p) for o, p, _, _ in ours if o == 1} == {(1, 0)} and sum(o == 0 and any(s) for o, _, _, s in ours) == 6


def test_windows_are_made_of_words_that_items_hold(monkeypatch):
    """With the bitmap, windows over words that no item holds are not put together; those that items hold are all found."""
    import random

    import numpy as np

    from lectern.llm import decontaminate as M

    def found(texts, items, bits):
        rows = zip(*M.windows(texts, 5, bits), strict=True)
        return sorted((int(o), int(p), int(h), tuple(map(int, s))) for o, p, h, s in rows if int(h) in items)

    rng = random.Random(3)
    odd = ["five", "miles", "7", "12 km", "5kg", "3.5l", "-", "...", "x-ray", "(red)", "Anna", "Bob.", "Ümit", "İx", "ΟΔΟΣ", "οδος", "straße", "end.", "what?!", "red…", "kg", "BIG", "a\u0301b", "of\u00a0the", "to\x1cbe", "the", "old", "town,"]
    items = [" ".join(rng.choices(odd, k=rng.randrange(1, 30))) for _ in range(60)] + ["The old town of red apples has Anna, and 5 kg of salt."]
    filler = ["".join(rng.choices("abcdefgh", k=7)) + rng.choice(["", "", ",", "."]) for _ in range(5000)]
    texts = ["", " ", "- -", "Bob. five", *items]
    for _ in range(300):
        words = rng.choices(filler, k=rng.randrange(60)) + rng.choice(items).split() + rng.choices([*filler[:20], *odd], k=12)
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    hashes = M.windows(items, 5)[2]
    flags = np.zeros(1 << M.FILTER_BITS, np.uint8)
    flags[(np.append(hashes, M.held_words(items)) >> np.uint64(64 - M.FILTER_BITS)).astype(np.int64)] = 1
    bits = np.packbits(flags, bitorder="little")
    every = set(hashes.tolist())
    ours = found(texts, every, bits)
    assert ours == found(texts, every, None) and len(ours) > 3000

    mixed, count = M._mixed, []
    monkeypatch.setattr(M, "_mixed", lambda columns, n, seed: count.append(n) or mixed(columns, n, seed))
    assert not found([" ".join(filler)], every, bits) and sum(count) < 50


def test_words_are_cut_as_split_does():
    from lectern.llm import decontaminate as M

    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    for text in ["", " ", "a", " a", "a ", "".join(f"w{i}{s}" for i, s in enumerate(spaces)), "".join(spaces) + "é😀 x", "\ufeffa\u200bb c"]:
        begin, end, what, raw, letters = M._cut(text)
        words = text.split()
        assert [text[i:j] for i, j in zip(begin, end)] == words and len(set(raw.tolist())) == len(set(words))
    _, _, what, raw, letters = M._cut("word word, word?! Word wo-rd (word) -- 7")
    assert [int(w) & M.OTHER > 0 for w in what] == [False, False, False, False, True, True, False, True]
    assert letters[0] == raw[0] == letters[1] == letters[2] != raw[1] and [int(w) & M.STOP > 0 for w in what[:3]] == [False, False, True]
