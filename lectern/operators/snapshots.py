"""Tables that change together: data folders that are never written again, and one manifest a version, published last.

Books lie in a fixed number of buckets by a hash of their id.  A commit writes the buckets of its books, with the other
books of those buckets carried over, to a folder of its own; the new manifest names that folder for these buckets and the
old folders for all others.  The version exists from the moment its manifest has its name, a rename that fails where
another writer was first; before, and after a crash at any point, readers see the version before as a whole.  Going back is
a new manifest with an old one's content.  Nothing is deleted, so a reader of an old version is not disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Snapshots:
    """Versions of the tables under ``root``, a folder that driver and executors share; every table has a book_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self._conf)

    @property
    def versions(self) -> list[int]:
        """Published versions in order."""
        folder = f"{self.root}/manifests"
        if not self._files(folder).exists(self._path(folder)):
            return []
        names = [s.getPath().getName() for s in self._files(folder).listStatus(self._path(folder))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of each table its schema and the folder of each bucket; of no table before the first commit."""
        if version is None:
            if not (known := self.versions):
                return {"version": 0, "tables": {}}
            version = known[-1]
        name = f"{self.root}/manifests/v{version:010d}.json"
        stream = self._files(name).open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        held = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(held["schema"])
        folders = sorted(set(held["buckets"].values()))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _publish(self, tables: dict, version: int) -> int:
        """Give the next manifest its name; raises where another writer has published that version."""
        begun, name = f"{self.root}/manifests/.{uuid.uuid4().hex}", f"{self.root}/manifests/v{version:010d}.json"
        stream = self._files(begun).create(self._path(begun))
        stream.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        stream.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._hadoop.FileContext.getFileContext(self._path(name).toUri(), self._conf).rename(self._path(begun), self._path(name), no_overwrite)
        return version

    def commit(self, tables: dict[str, DataFrame], books: DataFrame | None = None, afresh: bool = False) -> int:
        """Put the rows of ``books`` (default: those that ``tables`` have) in place of what there was of them, in all tables.

        A book without rows in some table loses those it had there.  ``afresh`` begins from no books at all.  Returns the
        version; on any error there is none.
        """
        before = self.manifest()
        held = {} if afresh else before["tables"]
        ids = books if books is not None else None
        for df in tables.values() if ids is None else ():
            ids = df.select("book_id") if ids is None else ids.unionByName(df.select("book_id"))
        bucket = F.pmod(F.xxhash64("book_id"), F.lit(BUCKETS)).cast("int")
        ids = ids.select("book_id").distinct().withColumn("bucket", bucket)
        place = f"{self.root}/data/{uuid.uuid4().hex}"
        ids.write.parquet(f"{place}/_books")
        ids = self.spark.read.parquet(f"{place}/_books")
        touched = [str(r["bucket"]) for r in ids.select("bucket").distinct().collect()]  # BUCKETS at most
        out = {name: dict(t) for name, t in held.items()}
        for name, df in tables.items():
            rows, old = df.withColumn("bucket", bucket), held.get(name, {}).get("buckets", {})
            beside = [old[b] for b in touched if b in old]
            if beside:
                kept = self.spark.read.schema(StructType.fromJson(held[name]["schema"])).parquet(*beside).join(ids.select("book_id"), "book_id", "left_anti")
                rows = rows.unionByName(kept.withColumn("bucket", bucket), allowMissingColumns=True)
            rows.repartition("bucket", "book_id").write.partitionBy("bucket").parquet(f"{place}/{name}")
            written = {b: f"{place}/{name}/bucket={b}" for b in touched}
            new = {b: p for b, p in written.items() if self._files(p).exists(self._path(p))}
            out[name] = {"schema": rows.drop("bucket").schema.jsonValue(), "buckets": {b: p for b, p in old.items() if b not in written} | new}
        return self._publish(out, before["version"] + 1)

    def rollback(self, version: int) -> int:
        """Make an older version's content the newest version."""
        return self._publish(self.manifest(version)["tables"], self.manifest()["version"] + 1)

    def ingest(self, tables: dict[str, DataFrame], force: bool = False) -> DataFrame:
        """Commit the books of ``tables`` (book, chapter, para) whose file is not there yet; a row for each book asked.

        (book_id, title, sha256, chapters, paragraphs, excerpt_paragraphs, skipped): a skipped book's row is that of the
        book that has its file, from the stored tables.  With ``force`` all are committed.  Files are told by sha256.
        """
        asked = tables["book"]
        if not self.versions or force:
            known = asked.select("sha256").limit(0)
        else:
            known = self.table("book").select("sha256").distinct()
        new = asked.join(known, "sha256", "left_anti").select("book_id")
        fresh = {name: df.join(new, "book_id", "left_semi").select(*df.columns) for name, df in tables.items()}
        old = self.manifest()["version"]
        now = self.commit(fresh, new)
        done = _summary(*(self.table(t, now) for t in ("book", "chapter", "para"))).join(new, "book_id", "left_semi").withColumn("skipped", F.lit(False))
        if not old or force:
            return done
        there = _summary(*(self.table(t, old) for t in ("book", "chapter", "para"))).join(asked.select("sha256").distinct(), "sha256", "left_semi")
        return done.unionByName(there.withColumn("skipped", F.lit(True)))

    def reindex(self, build: Callable[[DataFrame], dict[str, DataFrame]]) -> int:
        """Build all tables again from the recorded books; ids and orders stay, and nothing changes unless all is built.

        ``build`` gets the newest version of the table ``book`` and gives every table.  A book that it leaves out raises,
        as its source is missing.
        """
        recorded = self.table("book")
        tables = build(recorded)
        lost = recorded.select("book_id").join(tables["book"].select("book_id"), "book_id", "left_anti")
        some = [r["book_id"] for r in lost.limit(10).collect()]
        if some:
            raise ValueError(f"no source for books {some}")
        return self.commit(tables, afresh=True)


def _summary(book: DataFrame, chapter: DataFrame, para: DataFrame) -> DataFrame:
    n = chapter.groupBy("book_id").agg(F.count("*").alias("chapters"))
    p = para.groupBy("book_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("kind") == "excerpt").alias("excerpt_paragraphs"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chapters", "paragraphs", "excerpt_paragraphs")]
    return book.select("book_id", "title", "sha256").join(n, "book_id", "left").join(p, "book_id", "left").select("book_id", "title", "sha256", *counts)
