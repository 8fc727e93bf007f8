"""EPUB books as Spark jobs: archives become rows of entries, and packages, reading orders, contents and covers are
joins and windows over those rows.

A Python task only unzips, or reads one small XML entry or one HTML document at a time.  Malformed books give a row with
``error`` set, never a failed job.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as A

from lectern import schema
from lectern.functions.text import slug
from lectern.tables import small_batches, stored

from . import markup

# Content media types and extensions, smallest image that counts as a cover.
CONTENT_TYPES = ["application/xhtml+xml", "text/html", "application/x-dtbook+xml"]
CONTENT_EXTENSIONS = r"(?i)\.(xhtml|html|htm)$"
NCX_TYPE = "application/x-dtbncx+xml"
MIN_COVER_BYTES = 100

CONTAINER, ENCRYPTION = "META-INF/container.xml", "META-INF/encryption.xml"
INLINE_IMAGE = r"(?i)<(?:img\b[^>]*\bsrc|image\b[^>]*\bhref)\s*=\s*[\"']([^\"']+)"
ENTRY_ROW = "path string, sha256 string, name string, content binary, error string, package boolean"
_STRING = A.StringType()
_ITEM = A.StructType([A.StructField(c, _STRING) for c in ("id", "name", "kind", "props")])
_TARGET = A.StructType([A.StructField(c, _STRING) for c in ("name", "label")])
_SERIES = A.StructType([A.StructField("name", _STRING), A.StructField("position", A.DoubleType())])
PACKAGE_ROW = A.StructType(
    [A.StructField("title", _STRING), A.StructField("author", _STRING), A.StructField("items", A.ArrayType(_ITEM)), A.StructField("spine", A.ArrayType(_STRING)), A.StructField("cover_id", _STRING), A.StructField("series", _SERIES)]
)
#: Bytes of entries that an unzipping task gathers before it hands them on.
CHUNK = 16 << 20
#: Archives, or documents of archives, that a Python worker holds as rows of one batch.
ARCHIVES_A_BATCH = 250


@dataclass(frozen=True)
class Library:
    """Tables of parsed archives, keyed by ``path``.

    ``book``: (path, sha256, title, author, sequence_tier, error, series, cover), a row for each file; ``document``: (path,
    spine_idx, name, heading, first_block, n_paras); ``para``: (path, spine_idx, para_idx, text); ``toc``: (path, entry_idx,
    spine_idx, label).  Books with an error have no rows but that of ``book``.
    """

    book: DataFrame
    document: DataFrame
    para: DataFrame
    toc: DataFrame


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _find(root, name: str) -> list:
    return [e for e in root.iter() if _local(e.tag) == name]


def _words(element) -> str:
    return " ".join("".join(element.itertext()).split())


def _root(content) -> ElementTree.Element | None:
    try:
        return None if content is None else ElementTree.fromstring(bytes(content))
    except ElementTree.ParseError:
        return None


def resolve_href(base: str, href: str) -> str:
    """Zip path of a reference: no fragment, unquoted, dots resolved, never above the root."""
    path = posixpath.normpath(posixpath.join(base, unquote(href.split("#", 1)[0])))
    while path.startswith("../"):
        path = path[3:]
    return path.lstrip("/")


def natural_key(name: Column) -> Column:
    """Sort key: lower-cased text and whole numbers of any length, in turn."""
    part = lambda i: F.regexp_extract_all(F.lower(name), F.lit(r"(\D*)(\d*)"), F.lit(i))
    digits = lambda d: F.regexp_replace(d, "^0+", "")
    return F.zip_with(part(1), part(2), lambda t, d: F.struct(t.alias("t"), F.length(digits(d)).alias("n"), digits(d).alias("d")))


def _rootfile(container) -> str | None:
    root = _root(container)
    return None if root is None else next((e.get("full-path") for e in _find(root, "rootfile") if e.get("full-path")), None)


def _entry(archive: zipfile.ZipFile, name: str) -> tuple[bytes | None, str | None]:
    try:
        return archive.read(name), None
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, EOFError, ValueError) as e:
        return None, f"unreadable entry: {e}"


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ENTRY_ROW: one without a name for each file, with an error where it is no archive, and one for each entry, with
    an error where it can't be read.  The package document is marked here, so no content is shuffled to find it."""
    columns = ["path", "sha256", "name", "content", "error", "package"]
    for pdf in batches:
        rows, size = [], 0
        for path, sha, content in zip(pdf["path"], pdf["sha256"], pdf["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(bytes(content)))
            except zipfile.BadZipFile:
                rows.append((path, sha, None, None, "not a zip file", False))
                continue
            rows.append((path, sha, None, None, None, False))
            names = dict.fromkeys(archive.namelist())
            package = _rootfile(_entry(archive, CONTAINER)[0]) if CONTAINER in names else None
            for name in names:
                data, error = _entry(archive, name)
                rows.append((path, sha, name, data, error, name == package))
                size += len(data or b"")
                if size >= CHUNK:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def _series(metas: list) -> dict | None:
    """Series of a collection refinement, else of the catalogue tool's meta tags."""
    for m in metas:
        if m.get("property") == "belongs-to-collection" and (m.text or "").strip():
            number = next((x.text for x in metas if x.get("refines") == f"#{m.get('id')}" and x.get("property") == "group-position"), None)
            return {"name": m.text.strip(), "position": _number(number)}
    named = {m.get("name"): m.get("content") for m in metas if m.get("name")}
    if named.get("calibre:series"):
        return {"name": named["calibre:series"].strip(), "position": _number(named.get("calibre:series_index"))}
    return None


@F.pandas_udf(PACKAGE_ROW)
def _package(name: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Metadata, items and spine of package documents; all null where one can't be parsed."""
    columns = ["title", "author", "items", "spine", "cover_id", "series"]

    def one(path, data):
        opf = _root(data)
        if opf is None:
            return [None] * len(columns)
        text = lambda tag: next((t for t in map(_words, _find(opf, tag)) if t), None)
        metas, base = _find(opf, "meta"), posixpath.dirname(path)
        whole = [e for e in _find(opf, "item") if e.get("id") and e.get("href") and e.get("media-type")]
        items = [{"id": e.get("id"), "name": resolve_href(base, e.get("href")), "kind": e.get("media-type"), "props": e.get("properties") or ""} for e in whole]
        cover = next((m.get("content") for m in metas if m.get("name") == "cover"), None)
        return [text("title"), text("creator"), items, [e.get("idref", "") for e in _find(opf, "itemref")], cover, _series(metas)]

    return pd.DataFrame([one(*x) for x in zip(name, content, strict=True)], columns=columns, dtype=object)


@F.pandas_udf(A.ArrayType(_TARGET))
def _contents(name: pd.Series, content: pd.Series) -> pd.Series:
    """Targets and labels of an NCX or of a navigation document's first list of contents, in order."""

    def one(path, data):
        root, folder = _root(data), posixpath.dirname(path)
        if root is None:
            return []
        if _local(root.tag) == "ncx":
            child = lambda e, name: next((c for c in e if _local(c.tag) == name), None)
            pairs = []
            for point in _find(root, "navPoint"):
                target, label = child(point, "content"), child(point, "navLabel")
                text = None if label is None else child(label, "text")
                if target is not None and text is not None:
                    pairs.append((target.get("src"), (text.text or "").strip()))
        else:
            navs = [n for n in _find(root, "nav") if any(_local(k) == "type" and "toc" in v.split() for k, v in n.attrib.items())]
            pairs = [(a.get("href"), "".join(a.itertext()).strip()) for n in navs[:1] for a in _find(n, "a")]
        return [{"name": resolve_href(folder, href), "label": label} for href, label in pairs if href]

    return pd.Series([one(*x) for x in zip(name, content, strict=True)])


@F.pandas_udf(A.ArrayType(_STRING))
def _locked(content: pd.Series) -> pd.Series:
    """Names that an encryption list refers to; an unreadable list locks nothing by name (null)."""

    def one(data):
        root = _root(data)
        return None if root is None else [resolve_href("", e.get("URI", "")) for e in _find(root, "CipherReference")]

    return content.map(one)


@F.pandas_udf(_STRING)
def _resolved(name: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if not h else resolve_href(posixpath.dirname(n), h) for n, h in zip(name, href, strict=True)])


def _text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def _reading_order(names: DataFrame, items: DataFrame, spine: DataFrame) -> DataFrame:
    """(path, sequence_tier, spine_idx, name): the spine, else content of the manifest, else content files by natural order."""
    by_id = items.groupBy("path", "id").agg(F.max_by("name", "pos").alias("name"))
    blank = F.lit(None).cast(names.select(natural_key(F.col("name")).alias("k")).schema["k"].dataType)
    first = spine.join(by_id, ["path", "id"]).select("path", F.lit("S1").alias("sequence_tier"), "pos", blank.alias("key"), "name")
    second = items.where(F.col("kind").isin(CONTENT_TYPES)).select("path", F.lit("S2"), "pos", blank, "name")
    there = first.union(second).join(names, ["path", "name"], "left_semi").select("path", "sequence_tier", "pos", "key", "name")
    files = names.where(F.col("name").rlike(CONTENT_EXTENSIONS) & ~F.startswith("name", F.lit("META-INF/")))
    third = files.select("path", F.lit("S3"), F.lit(0), natural_key(F.col("name")), "name")
    book = Window.partitionBy("path")
    ranked = there.union(third).withColumn("_best", F.min("sequence_tier").over(book)).where("sequence_tier = _best")
    nth = F.row_number().over(book.orderBy("pos", "key", "name")) - 1
    return ranked.select("path", "sequence_tier", nth.cast("long").alias("spine_idx"), "name")


def _covers(entries: DataFrame, items: DataFrame, packages: DataFrame, inline: DataFrame) -> DataFrame:
    """(path, cover): by EPUB 3 property, by meta tag, by name, else the first image of the first document (``inline``: path, name,
    href)."""
    images = items.where(F.startswith("kind", F.lit("image/")))
    in_id, in_name = (F.contains(F.lower(c), F.lit("cover")) for c in ("id", "name"))
    rank = F.struct((~in_id).alias("a"), F.length("name").alias("b"), F.col("name").alias("c"))
    ladder = (
        items.where(F.array_contains(F.split("props", r"\s+"), "cover-image")).groupBy("path").agg(F.lit("C1").alias("tier"), F.min_by("name", "pos").alias("name"))
        .union(images.join(packages.select("path", F.col("cover_id").alias("id")), ["path", "id"]).groupBy("path").agg(F.lit("C2"), F.max_by("name", "pos")))
        .union(images.where(in_id | in_name).groupBy("path").agg(F.lit("C3"), F.min_by("name", rank)))
        .union(inline.select("path", F.lit("C4"), _resolved(F.col("name"), F.col("href"))))
    )
    found = ladder.join(entries.where(F.length("content") >= MIN_COVER_BYTES).select("path", "name"), ["path", "name"])
    best = found.groupBy("path").agg(F.min(F.struct("tier", "name")).alias("c")).select("path", "c.*")
    picture = best.join(entries.select("path", "name", "content"), ["path", "name"])
    return picture.select("path", F.struct("tier", F.col("name").alias("href"), "content").alias("cover"))


def parse_books(files: DataFrame) -> Library:
    """Tables of the archives in ``files`` (path, content, sha256), paths being unique.  Python holds few archives, or few
    documents, at once."""
    small_batches(files.sparkSession, ARCHIVES_A_BATCH)
    packed = files.select("path", "content", "sha256")
    rows = stored(packed.mapInPandas(_unzip, ENTRY_ROW), "epub-entries")
    entries = rows.where("name is not null")
    names = entries.select("path", "name")
    package = entries.where("package").select("path", _package("name", "content").alias("p")).select("path", "p.*")
    packages = stored(package.where("items is not null"), "epub-packages")
    items = packages.select("path", F.posexplode("items").alias("pos", "i")).select("path", "pos", "i.*")
    spine = packages.select("path", F.posexplode("spine").alias("pos", "id"))
    whole = names.join(packages.select("path"), "path", "left_semi")
    order = stored(_reading_order(whole, items, spine), "epub-order")

    locks = entries.where(F.col("name") == ENCRYPTION).select("path", F.explode(F.coalesce(_locked(F.col("content")), F.array())).alias("name"))
    locked = locks.join(order, ["path", "name"], "left_semi").select("path").distinct()

    pages = order.join(entries.select("path", "name", "content"), ["path", "name"])
    html = pages.select("path", "sequence_tier", "spine_idx", "name", _text(F.col("content")).alias("html"))
    image = F.when(F.col("spine_idx") == 0, F.regexp_extract("html", INLINE_IMAGE, 1)).alias("image")
    parsed = html.select("path", "sequence_tier", "spine_idx", "name", image, markup.headed_paragraphs("html").alias("t"))
    parsed = stored(parsed.select("path", "sequence_tier", "spine_idx", "name", "image", "t.*"), "epub-documents")
    inline = parsed.where("spine_idx = 0").select("path", "name", F.col("image").alias("href"))

    size = parsed.groupBy("path").agg(F.first("sequence_tier").alias("sequence_tier"), F.max("spine_idx").alias("_last"), F.max(F.size("paras")).alias("_paras"))
    unread = rows.where("name is not null and error is not null").join(order, ["path", "name"], "left_semi").groupBy("path").agg(F.min("error").alias("_entry"))
    has = lambda df, c: df.select("path", F.lit(True).alias(c))
    archives = rows.where("name is null").select("path", "sha256", F.col("error").alias("_zip"))
    state = archives.join(has(packages, "_package"), "path", "left")
    state = state.join(size, "path", "left").join(has(locked, "_locked"), "path", "left").join(unread, "path", "left")
    error = (
        F.when(F.col("_zip").isNotNull(), F.col("_zip"))
        .when(F.col("_package").isNull(), "no package document")
        .when(F.col("_last").isNull(), "no reading order")
        .when(F.col("_locked"), "encrypted content")
        .when(F.col("_entry").isNotNull(), F.col("_entry"))
        .when((F.col("_last") >= schema.MAX_SPINE) | (F.col("_paras") >= schema.SPINE_STRIDE), "too many documents or paragraphs")
    )
    state = stored(state.select("path", "sha256", F.when(error.isNull(), F.col("sequence_tier")).alias("sequence_tier"), error.alias("error")), "epub-state")
    good = state.where("error is null").select("path")

    about = packages.select("path", F.coalesce("title", F.lit("Untitled")).alias("title"), "author", "series").join(good, "path", "left_semi")
    book = state.join(about, "path", "left").join(_covers(entries, items, packages, inline).join(good, "path", "left_semi"), "path", "left")
    document = parsed.join(good, "path", "left_semi")
    ncx = F.col("kind") == NCX_TYPE
    nav = F.array_contains(F.split("props", r"\s+"), "nav") | ((F.col("kind") == CONTENT_TYPES[0]) & F.endswith(F.lower("name"), F.lit("nav.xhtml")))
    guide = items.where(nav | ncx).select("path", "name", F.when(ncx, 0).otherwise(1).alias("rank"), "pos")
    listed = guide.join(entries.select("path", "name", "content"), ["path", "name"]).select("path", "rank", "pos", _contents("name", "content").alias("e")).where(F.size("e") > 0)
    lists = listed.groupBy("path").agg(F.min_by("e", F.struct("rank", "pos")).alias("e")).select("path", F.posexplode("e").alias("pos", "e"))
    at = document.groupBy("path", "name").agg(F.min("spine_idx").alias("spine_idx"))
    targets = lists.select("path", "pos", "e.name", "e.label").where("label <> ''").join(at, ["path", "name"])
    nth = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return Library(
        book.select("path", "sha256", "title", "author", "sequence_tier", "error", "series", "cover"),
        document.select("path", "spine_idx", "name", "heading", F.get("paras", 0).alias("first_block"), F.size("paras").cast("long").alias("n_paras")),
        document.select("path", "spine_idx", F.posexplode("paras").alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long")),
        targets.select("path", nth.cast("long").alias("entry_idx"), "spine_idx", "label"),
    )


def read_epubs(spark: SparkSession, path: str, known: DataFrame | None = None) -> Library:
    """Tables of each file under ``path``; files whose sha256 is in ``known`` are skipped before they are unzipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    files = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    if known is not None:
        files = files.join(known.select("sha256").distinct(), "sha256", "left_anti")
    return parse_books(files)


def _ranked(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` with ``_rank``, the place from 1 in its group: places are taken in range partitions, written first, and moved by
    the counts of the partitions before, so a group of any size spreads over tasks."""
    cut = stored(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()), "epub-ranks")
    sizes = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order))
    return cut.join(sizes.withColumn("_before", before), [group, "_part"]).withColumn("_rank", nth + F.col("_before")).drop("_part", "_n", "_before")


def book_ids(books: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``books`` with a ``slug`` from the title, made unique by suffixes -2, -3 ... in path order."""
    named = _ranked(books.withColumn("_slug", slug(F.col("title"))), "_slug", "path")
    if taken is not None:
        named = named.join(taken.groupBy(F.regexp_replace("slug", r"-\d+$", "").alias("_slug")).agg(F.count("*").alias("_used")), "_slug", "left")
    else:
        named = named.withColumn("_used", F.lit(0))
    n = F.col("_rank") + F.coalesce("_used", F.lit(0))
    return named.withColumn("slug", F.when(n == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), n.cast("string")))).drop("_slug", "_used", "_rank")


def ingest(library: Library, target: str, buckets: int = 64) -> None:
    """Append good books and their paragraphs under ``target``; ``known`` on reading makes it idempotent.

    Paragraphs lie in ``buckets`` folders by a hash of the book, whatever the number of books; the book rows, by which readers
    and ``known`` go, are written last.
    """
    good = library.book.where("error is null")
    key = good.select("path", "sha256")
    bucket = F.pmod(F.xxhash64("sha256"), F.lit(buckets)).cast("int")
    library.para.join(key, "path").drop("path").withColumn("bucket", bucket).repartition("bucket", "sha256").write.mode("append").partitionBy("bucket").parquet(f"{target}/para")
    good.write.mode("append").parquet(f"{target}/book")
