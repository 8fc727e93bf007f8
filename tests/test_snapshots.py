"""Versions of tables: together or not at all."""

import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators.snapshots import Snapshots
from lectern.tables import shared_dir

BOOK, CHAPTER, PARA = "book_id long, title string, sha256 string", "book_id long, chapter_idx long", "book_id long, kind string, text string"


@pytest.fixture
def store(spark):
    return Snapshots(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def tables(spark, books, note="a"):
    frame = spark.createDataFrame
    return {
        "book": frame([(b, f"{note}{b}", f"{note}-{b}") for b in books], BOOK),
        "chapter": frame([(b, c) for b in books for c in range(b % 3)], CHAPTER),
        "para": frame([(b, "excerpt" if p == 2 else "body", note) for b in books for p in range(b % 4)], PARA),
    }


def titles(store, version=None):
    return {r["book_id"]: r["title"] for r in store.table("book", version).collect()}


def test_commit_and_rollback(spark, store):
    assert store.versions == [] and store.manifest()["version"] == 0
    assert store.commit(tables(spark, range(20))) == 1
    assert store.commit(tables(spark, [3, 7, 40], "b")) == 2
    assert titles(store) == {b: f"a{b}" for b in range(20)} | {3: "b3", 7: "b7", 40: "b40"}
    assert titles(store, 1) == {b: f"a{b}" for b in range(20)}
    assert store.table("para").where("text = 'b'").count() == 3 + 3 + 0
    empty = tables(spark, [7], "c")
    empty["para"] = empty["para"].limit(0)
    store.commit(empty)
    assert store.table("para").where("book_id = 7").count() == 0 and store.table("para", 2).where("book_id = 7").count() == 3
    assert store.rollback(1) == 4 and titles(store) == titles(store, 1) and store.versions == [1, 2, 3, 4]


@pytest.mark.parametrize("broken", ["book", "chapter", "para"])
def test_a_crash_between_writes_changes_nothing(spark, store, broken):
    store.commit(tables(spark, range(9)))
    new = tables(spark, [2, 11], "b")
    new[broken] = new[broken].withColumn("book_id", F.when(F.col("book_id") >= 0, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("book_id")))
    with pytest.raises(Exception, match="lost"):
        store.commit(new, spark.createDataFrame([(2,), (11,)], "book_id long"))
    assert store.versions == [1] and titles(store) == {b: f"a{b}" for b in range(9)}
    assert store.table("para").count() == sum(b % 4 for b in range(9))
    assert store.commit(tables(spark, [2, 11], "b")) == 2 and titles(store)[11] == "b11"


def test_two_writers(spark, store, monkeypatch):
    store.commit(tables(spark, [1]))
    stale = store.manifest()
    store.commit(tables(spark, [2]))
    monkeypatch.setattr(store, "manifest", lambda version=None: stale)
    with pytest.raises(Exception, match="(?i)exists"):
        store.commit(tables(spark, [3]))
    monkeypatch.undo()
    assert set(titles(store)) == {1, 2}


def test_ingest_skips_known_files(spark, store):
    first = store.ingest(tables(spark, [1, 2, 3]))
    assert sorted(tuple(r) for r in first.collect()) == [(1, "a1", "a-1", 1, 1, 0, False), (2, "a2", "a-2", 2, 2, 0, False), (3, "a3", "a-3", 0, 3, 1, False)]
    again = tables(spark, [3, 4])
    again["book"] = again["book"].withColumn("book_id", F.col("book_id") + 100).withColumn("title", F.lit("other"))
    got = {r["book_id"]: (r["title"], r["paragraphs"], r["skipped"]) for r in store.ingest(again).collect()}
    assert got == {3: ("a3", 3, True), 104: ("other", 0, False)}
    assert store.ingest(tables(spark, [3], "a"), force=True).where("not skipped").count() == 1 and set(titles(store)) == {1, 2, 3, 104}


def test_reindex(spark, store):
    store.commit(tables(spark, [1, 2, 3]))
    with pytest.raises(ValueError, match=r"\[2\]"):
        store.reindex(lambda book: tables(spark, [1, 3], "new"))
    assert titles(store)[1] == "a1"
    store.reindex(lambda book: tables(spark, [r["book_id"] for r in book.collect()], "new"))
    assert titles(store) == {1: "new1", 2: "new2", 3: "new3"}
    assert store.table("para").where("text <> 'new'").count() == 0
