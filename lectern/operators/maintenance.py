"""Table maintenance: ingest commits, manifests, deletes over all tables, settings, work lists, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schema
from lectern.tables import stored


def commit_books(target: str, tables: dict[str, DataFrame], spark: SparkSession, buckets: int = 64) -> None:
    """Replace the rows of the books in ``tables`` (each with book_id) under ``target``, table by table.

    Books lie in ``buckets`` folders by a hash of their id, a number to be kept for the life of the tables.  Dynamic
    overwrite swaps the folders of the books at hand, other books of those folders are carried over, and a repeated commit
    changes nothing.  Tables are not committed together: readers go by ``manifest``, written last.
    """
    bucket = F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int")
    for name in sorted(tables, key=lambda n: n == "manifest"):
        rows = stored(tables[name].withColumn("bucket", bucket), f"commit-{name}")
        ids = rows.select("bucket", "book_id").distinct()
        path = f"{target}/{name}"
        if _exists(spark, path):
            old = spark.read.schema(rows.schema).parquet(path)
            beside = old.join(ids.select("bucket").distinct(), "bucket", "left_semi").join(ids, ["bucket", "book_id"], "left_anti")
            rows = rows.unionByName(stored(beside.select(*rows.columns), f"beside-{name}"))
        rows.repartition("bucket", "book_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def manifests(book: DataFrame, chapter: DataFrame, para: DataFrame) -> DataFrame:
    """(book_id, manifest): a JSON object of counts by kind for each book."""
    counts = chapter.groupBy("book_id").agg(
        F.count("*").alias("chapters"), *[F.count_if(F.col("kind") == k).alias(k) for k in schema.ALL_KINDS], F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq")
    )
    n = para.groupBy("book_id").agg(F.count("*").alias("paragraphs"))
    j = book.select("book_id", "title").join(counts, "book_id").join(n, "book_id")
    return j.select("book_id", F.to_json(F.struct("title", "chapters", "paragraphs", *schema.ALL_KINDS, "start_seq", "end_seq")).alias("manifest"))


def delete_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of deleted books, turns and conversations included."""
    ids = gone.select("book_id").distinct()
    out = {n: t.join(ids, "book_id", "left_anti").select(*t.columns) for n, t in tables.items() if "book_id" in t.columns}
    for n, t in tables.items():
        if n not in out:  # children of conversations have no book_id of their own
            out[n] = t.join(out["conversation"].select("conv_id"), "conv_id", "left_semi").select(*t.columns)
    return out


def put_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value rows after changes; a null value clears its key."""
    j = settings.join(changes.select("key", F.col("value").alias("_new"), F.lit(True).alias("_hit")), "key", "full")
    return j.select("key", F.when(F.coalesce("_hit", F.lit(False)), F.col("_new")).otherwise(F.col("value")).alias("value")).where("value is not null")


def genre_worklist(shelf: DataFrame) -> DataFrame:
    """Shelf books, one row each, whose genres were never fetched."""
    return shelf.where("genres is null").select("shelf_book_id", "title").distinct()


def apply_genres(shelf: DataFrame, fetched: DataFrame) -> DataFrame:
    """Genres (shelf_book_id, genres array) written as comma lists; an empty fetch counts as fetched."""
    f = fetched.select("shelf_book_id", F.array_join("genres", ", ").alias("_g"))
    return shelf.join(f, "shelf_book_id", "left").withColumn("genres", F.coalesce("_g", "genres")).drop("_g").select(*shelf.columns)


def session_positions(progress: DataFrame, chapter: DataFrame) -> DataFrame:
    """Chapter to talk from: the stored position, else the last one of a finished book, else null; an unread book has none."""
    spot = F.col("kind").isin(*schema.ADDRESSABLE_KINDS) & ~schema.is_part_divider(F.col("label"))
    last = chapter.where(spot).groupBy("book_id").agg(F.max("chapter_idx").alias("last_idx"))
    j = progress.join(last, "book_id", "left")
    spot = F.coalesce("position_chapter_idx", F.when(F.col("status") == "finished", F.col("last_idx")))
    return j.select("reader_id", "book_id", F.when(F.col("status") != "unread", spot).alias("chapter_idx"))


def whole_groups(items: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Groups in order while fewer than ``most`` rows stand before them: a group is never split."""
    # Every group has a row, so only the first `most` groups can qualify: the running sum sees no more.
    sizes = items.groupBy(group).agg(F.count("*").alias("n"), F.min(order).alias("at")).orderBy("at", group).limit(most)
    before = F.sum("n").over(Window.orderBy("at", group).rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most)
    return items.join(kept.select(group), group, "left_semi")


def prompt_payloads(para: DataFrame, nodes: DataFrame, chapter: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, payload): JSON of a chapter's paragraphs and of the designators known before it."""
    lines = para.groupBy("book_id", "chapter_idx").agg(F.array_sort(F.collect_list(F.struct("global_seq", "text"))).alias("paragraphs"))
    starts = chapter.where("kind <> 'excerpt'").select("book_id", "chapter_idx", "start_seq")
    known = starts.join(nodes.select("book_id", "designator", "first_seq"), "book_id").where("first_seq < start_seq")
    known = known.groupBy("book_id", "chapter_idx").agg(F.sort_array(F.collect_set("designator")).alias("registry"))
    j = starts.join(lines, ["book_id", "chapter_idx"]).join(known, ["book_id", "chapter_idx"], "left")
    empty = F.array().cast("array<string>")
    return j.select("book_id", "chapter_idx", F.to_json(F.struct(F.coalesce("registry", empty).alias("registry"), "paragraphs")).alias("payload"))


def chapter_ref_of(kind: Column, label: Column) -> Column:
    """Printed reference of an addressable chapter; null where its label prints none."""
    from .retrieval import printed_identity

    return F.when(kind.isin(*schema.ADDRESSABLE_KINDS), printed_identity(label))


def month_covers(months: DataFrame, links: DataFrame, covers: DataFrame) -> DataFrame:
    """``months`` (shelf_book_id, cover) with the linked book's cover where the shelf has none."""
    own = links.join(covers, "book_id").groupBy("shelf_book_id").agg(F.min("path").alias("_path"))
    return months.join(own, "shelf_book_id", "left").withColumn("cover", F.coalesce(F.nullif("cover", F.lit("")), "_path")).drop("_path").select(*months.columns)
