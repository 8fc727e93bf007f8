"""The positional index against FTS5 of the standard library."""

import random
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.operators import lexical, retrieval, search
from lectern.operators.lexical import LexicalIndex, Near, Phrase, has

PARA = "book_id long, global_seq long, kind string, text string"


def paragraphs():
    rng = random.Random(11)
    words = ["the", "of", "red", "fox", "Café", "tions", "tionstop", "tion", "a", "vixen", "runs"]
    texts = ["of the", "The red fox. Of the fox: of the red fox, of it", "", None, "the of the of the", "«the» – of the end."]
    for _ in range(250):
        parts = [rng.choice(words) + rng.choice(["", "", "", ",", ".", ":", " –"]) for _ in range(rng.randrange(1, 60))]
        texts.append(rng.choice(["", "… "]) + " ".join(parts) + rng.choice(["", ".", "!\n"]))
    return [(1 + i % 3, i, "body" if i % 7 else "excerpt", t) for i, t in enumerate(texts)]


QUERIES = {
    "one": ('"fox"', [Phrase.of("fox")], None, ()),
    "all": ("the AND fox", [Phrase.of("the"), Phrase.of("fox")], None, ()),
    "any": ("vixen OR cafe", [Phrase.of("vixen"), Phrase.of("CAFÉ")], lambda: has(0) | has(1), ()),
    "not": ("runs NOT vixen", [Phrase.of("runs"), Phrase.of("vixen")], lambda: has(0) & ~has(1), ()),
    "phrase": ('"of the"', [Phrase.of("of the")], None, ()),
    "long phrase": ('"of the red"', [Phrase.of("of the red")], None, ()),
    "repeated": ('"the the"', [Phrase.of("the the")], None, ()),
    "prefix": ("tionst*", [Phrase.of("tionst", prefix=True)], None, ()),
    "phrase prefix": ('"red tion" *', [Phrase.of("red tion", prefix=True)], None, ()),
    "first": ("^the", [Phrase.of("the", first=True)], None, ()),
    "near": ("NEAR(fox runs, 3)", [Phrase.of("fox"), Phrase.of("runs")], None, (Near(0, 1, 3),)),
    "near phrase": ('NEAR("of the" vixen, 2)', [Phrase.of("of the"), Phrase.of("vixen")], None, (Near(0, 1, 2),)),
    "mixed": ('("red fox" OR tion*) AND runs', [Phrase.of("red fox"), Phrase.of("tion", prefix=True), Phrase.of("runs")], lambda: (has(0) | has(1)) & has(2), ()),
}


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f (rowid, text) VALUES (?, ?)", [(r[1], r[3]) for r in paragraphs()])
    return con


@pytest.fixture(scope="module")
def index(spark):
    return LexicalIndex.build(spark.createDataFrame(paragraphs(), PARA).repartition(3))


@pytest.mark.parametrize("name", list(QUERIES))
def test_scores_and_snippets_are_those_of_fts5(spark, index, fts, name):
    match, phrases, condition, near = QUERIES[name]
    want = {i: (s, t) for i, s, t in fts.execute("SELECT rowid, bm25(f), snippet(f, 0, '[', ']', '...', 10) FROM f WHERE f MATCH ?", (match,))}
    hits = index.scored(phrases, condition and condition(), near)
    got = {r["global_seq"]: (r["score"], r["snippet"]) for r in lexical.with_snippets(hits, spark.createDataFrame(paragraphs(), PARA), phrases).collect()}
    assert set(got) == set(want)
    assert want or name == "repeated"
    for i, (score, text) in want.items():
        assert abs(got[i][0] - score) < 1e-8
        assert got[i][1] == text, i


def test_scores_as_read(spark, index):
    """Each reader's scores are those of an index that holds nothing but what the reader can read."""
    rows = paragraphs()
    ranges = [(1, 1, 0, 90), (1, 2, 0, 255), (2, 1, 0, 255), (2, 3, 10, 31), (3, 2, 0, -1)]
    phrases = [Phrase.of("of the"), Phrase.of("fox")]
    r = spark.createDataFrame(ranges, "reader_id long, book_id long, lo long, hi long")
    got = {(x["reader_id"], x["global_seq"]): x["score"] for x in index.scored_as_read(r, phrases, has(0) | has(1)).collect()}
    want = {}
    for reader in (1, 2, 3):
        seen = [p for p in rows if p[2] == "body" and any(k == reader and b == p[0] and lo <= p[1] <= hi for k, b, lo, hi in ranges)]
        if seen:
            alone = LexicalIndex.build(spark.createDataFrame(seen, PARA))
            want |= {(reader, x["global_seq"]): x["score"] for x in alone.scored(phrases, has(0) | has(1)).collect()}
    assert got == want and want


def test_first_mentions(spark, index):
    entities = ["of the", "Red Fox", "the", "tionstop the of", "absent word", "!", "cafe runs"]
    got = {(r["entity"], r["global_seq"]) for r in index.first_mentions(spark.createDataFrame([(e,) for e in entities * 2], "entity string")).collect()}
    want = set()
    for e in entities:
        words = search.folded(e)
        for _, seq, _, text in paragraphs():
            have = search.folded(text or "")
            if words and any(have[i : i + len(words)] == words for i in range(len(have))):
                want.add((e, seq))
    assert got == want


TEXTS = ["Việt Nam", "Ёж и йод", "Άλφα ὦμος", "Crème brûlée", "áb ệ", "한국어", "İstanbul", "x́ y", "Å Å", "ﬁ ½"]


def test_folding(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in df.select("text", search.tokens(F.col("text")).alias("t")).collect():
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", r["text"]) if unicodedata.category(c) != "Mn")).lower()
        assert r["t"] == bare.replace("̇", "").split() == search.folded(r["text"])


REGEX_TEXTS = ["naïve Ёж", "aa bb", "tab\there", "x=x", "plain", "12 ٣", "ends\n"]


@pytest.mark.parametrize("pattern", [r"\w+ \w+", r"(?P<q>\w)=(?P=q)", r"\bЁ\w", r"\d \d", r"\s", r"^\w+$", r"n\Z", r"\\Z", r"(?i)ёЖ", "(", "[", r"(?P<q>a)(?P<q>b)", r"a{2,1}", r"(?<=a+)b"])
def test_patterns_are_those_of_python(spark, pattern):
    import re

    df = spark.createDataFrame([(t,) for t in REGEX_TEXTS], "text string")
    bad = retrieval.invalid_regex(spark, pattern)
    try:
        compiled = re.compile(pattern)
    except re.error:
        assert bad
        return
    assert bad is None
    assert [r["text"] for r in df.where(F.col("text").rlike(retrieval.unicode_regex(pattern))).collect()] == [t for t in REGEX_TEXTS if compiled.search(t)]
