"""Sharding and line dedup against brute force, with nulls, ties, repeats, hot groups and clashing columns."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lectern.llm import line_dedup, sharding

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def kept_lines(rows, least=10):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                first.setdefault(key(line), d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def texts(rng, n=300):
    pool = ["A shared line of text", "  a SHARED line of text\t", "Ä shared line öf text", "short", "", "ninechars", "exactly10!", "another line that repeats"]
    rows = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.33:
            rows.append((d, "the very common line\nhot second line here\nown line number %d" % d))
        elif kind < 0.4:
            rows.append((d, rng.choice([None, "", "\n\n"])))
        else:
            rows.append((d, "\n".join(rng.choice(pool + ["unique line %d" % rng.randrange(400)]) for _ in range(rng.randint(1, 20)))))
    return rows


def test_lines(spark):
    rows = texts(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for partitions in (1, 7):
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(df, partitions=partitions).collect()}
        assert got == kept_lines(rows)


def test_lines_edges(spark):
    df = spark.createDataFrame([(1, "same long line here", 5, "x"), (1, "same long line here", 5, "x"), (None, "same long line here", 6, None), (2, "Same long line here\n" + "z" * 200_000, 7, "y")], "doc_id long, text string, n_lines int, kept_text string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "n_lines", "kept_text", "_n_lines", "n_dropped", "_kept_text"]
    got = sorted((str(r["doc_id"]), r["n_lines"], r["_n_lines"], r["n_dropped"], r["_kept_text"][:5]) for r in out.collect())
    assert got == [("1", 5, 1, 0, "same "), ("1", 5, 1, 0, "same "), ("2", 7, 2, 1, "zzzzz"), ("None", 6, 1, 0, "same ")]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_of_repeated_ids(spark):
    """Rows of one doc_id with different texts lose their own lines only, at whatever position."""
    rows = [(1, "a line of the first\nanother line here"), (2, "a line of the first\nkept one of row one"), (2, "an own line of the second row\nanother line here"), (2, "an own line of the second row\nx")]
    got = sorted(r["kept_text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([rows[0][1], "kept one of row one", "an own line of the second row", "an own line of the second row\nx"])


def test_line_columns_do_not_clash(spark):
    names = ["N_dropped", "keep_id", "keep_key", "Keep_Bits", "whole_text", "cut_text", "_text", "_keep"]
    df = spark.createDataFrame([(1, "the shared line\nx", *names), (2, "the shared line", *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "_n_dropped", "kept_text"]
    assert sorted(tuple(r)[10:] for r in out.collect()) == [(1, 1, ""), (2, 0, "the shared line\nx")]


def test_stage_reads_its_own_results(spark):
    import corpus_pipeline

    rows = [(d, "a line that all share\nown text %d" % d, "mine", 5, 18) for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_dropped int, n_chars long")
    out = corpus_pipeline.dedup_lines(spark, df, "")
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], (1, "own text 1", "mine", 5, 10), (2, "own text 2", "mine", 5, 10)]


def test_bitmaps_are_small(spark):
    keep = line_dedup.keep_bitmaps(spark.createDataFrame([(1, "a line that repeats"), (2, "\n" * 50_000 + "a line that repeats")], "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in keep] == [2]
    assert len(keep[0]["keep"]) < 200


def check_shards(rows, got, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(r["size"] for r in got)
    assert max(abs(s - sum(sizes) / shards) for s in sizes) <= largest


def test_shards(spark):
    rng = random.Random(2)
    rows = [(d, "hot copy " * 30 if d % 3 == 0 else rng.choice([None, "", "é" * rng.randrange(400), "x" * rng.randrange(2000)])) for d in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check_shards(rows, sharding.shard_by_bytes(df, shards=10).collect(), 10)


def test_ranges_follow_the_bytes(spark, monkeypatch):
    """More ranges than asked for, as with a large input, keep the law; one text fills several of them."""
    monkeypatch.setattr(sharding, "RANGE_BYTES", 200)
    rows = [(i, "one text" if i % 3 else f"text {i} " * (i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_shards(rows, sharding.shard_by_bytes(df, shards=3, ranges_per_shard=1).collect(), 3)


def test_shards_of_one_text_and_of_nothing(spark):
    rows = [(7, "the same row")] * 500 + [(None, None)] * 20
    check_shards(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect(), 4)
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_texts_are_neighbours(spark):
    rows = [(d, f"text {d % 50} " * 20) for d in range(500)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()
    assert sum(len({r["shard"] for r in got if r["doc_id"] % 50 == k}) for k in range(50)) <= 50 + 5


def test_queries(spark, sf_dir):
    from lectern.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_shards(docs, queries.op1_sharding(spark, sf_dir).collect(), 40)
    want = {(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in kept_lines(docs).items()}
    assert {tuple(r) for r in queries.op3_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want
    assert queries.op1_sharding(spark, sf_dir).where(F.col("law") != "bytes").count() == 0
