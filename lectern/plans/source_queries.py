"""EPUB sources as queries, with their SQL twins: each document is packed as an archive and read back.

The archives differ by ``doc_id``: reading order from the spine (backwards), from the manifest or from file names; contents in a
navigation document or an NCX; four ways to name a cover, some of them too small; some encrypted, some no archives.
"""

from __future__ import annotations

import html
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as A

from lectern.plans.registry import query
from lectern.sources import driver_tables as D
from lectern.sources import epub

CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'


def _archive(doc_id: int, source: str, lines) -> bytes:
    if doc_id % 11 == 5:
        return b"no archive"
    out, chapters = io.BytesIO(), [lines[i : i + D.PARAS_PER_CHAPTER] for i in range(0, len(lines), D.PARAS_PER_CHAPTER)]
    kind = "application/octet-stream" if doc_id % 3 == 2 else "application/xhtml+xml"
    items = "".join(f'<item id="c{i}" href="text/ch%20{i}.xhtml" media-type="{kind}"/>' for i in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{i}"/>' for i in reversed(range(len(chapters)))) if doc_id % 3 == 0 else ""
    labels = [(i, f"Chapter {i}") for i in range(len(chapters))] + [(len(chapters), "Gone")]
    if doc_id % 2:
        guide, about = "toc.ncx", 'media-type="application/x-dtbncx+xml"'
        toc = "<ncx><navMap>" + "".join(f'<navPoint><navLabel><text>{t}</text></navLabel><content src="text/ch%20{i}.xhtml#a"/></navPoint>' for i, t in labels) + "</navMap></ncx>"
        meta = f'<meta name="calibre:series" content="{html.escape(source)}"/><meta name="calibre:series_index" content="{doc_id}.5"/>'
    else:
        guide, about = "nav.xml", 'media-type="application/xml" properties="nav"'
        toc = '<html xmlns:e="e"><nav e:type="toc">' + "".join(f'<a href="text/ch%20{i}.xhtml">{t}</a>' for i, t in labels) + "</nav></html>"
        meta = f'<meta property="belongs-to-collection" id="s">{html.escape(source)}</meta>'
    props = ' properties="cover-image"' if doc_id % 4 == 0 else ""
    picture = f'<item id="{"cover" if doc_id % 4 == 2 else "pic"}" href="pic.png" media-type="image/png"{props}/>'
    meta += '<meta name="cover" content="pic"/>' if doc_id % 4 == 1 else ""
    opf = (
        f'<package xmlns:dc="dc"><metadata><dc:title>Book  {doc_id}</dc:title><dc:creator>Author {doc_id % 7}</dc:creator>{meta}</metadata>'
        f'<manifest>{items}{picture}<item id="toc" href="{guide}" {about}/></manifest><spine>{refs}</spine></package>'
    )
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/content.opf", opf)
        z.writestr(f"OEBPS/{guide}", toc)
        z.writestr("OEBPS/pic.png", b"x" * (10 if doc_id % 5 == 0 else 120))
        for i, ps in enumerate(chapters):
            z.writestr(f"OEBPS/text/ch {i}.xhtml", f"<html><body><h1>Chapter {i}</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in ps) + "</body></html>")
        if doc_id % 7 == 3:
            z.writestr("META-INF/encryption.xml", '<encryption><CipherReference URI="OEBPS/text/ch%200.xhtml"/></encryption>')
    return out.getvalue()


@F.pandas_udf(A.BinaryType())
def _packed(doc_id: pd.Series, source: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([_archive(*x) for x in zip(doc_id, source, lines, strict=True)])


def library(spark, d) -> epub.Library:
    """Tables of the archives of all documents."""
    docs = D.table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), D.text_lines().alias("lines"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), _packed("doc_id", "source", "lines").alias("content"))
    return epub.parse_books(files.withColumn("sha256", F.sha2("content", 256)))


def by_book(df: DataFrame) -> DataFrame:
    return df.withColumn("book_id", F.col("path").cast("long")).drop("path", "sha256")


EPUB = f"""WITH {D.PARA0_SQL},
size AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(ls), 0) AS n, (coalesce(len(ls), 0) + {D.PARAS_PER_CHAPTER - 1}) // {D.PARAS_PER_CHAPTER} AS chapters FROM lines JOIN documents USING (doc_id)),
state AS (SELECT *, CASE WHEN doc_id % 11 = 5 THEN 'not a zip file' WHEN n = 0 THEN 'no reading order' WHEN doc_id % 7 = 3 THEN 'encrypted content' END AS error FROM size),
chap AS (SELECT doc_id AS book_id, chapters, unnest(generate_series(0, chapters - 1)) AS i FROM state WHERE error IS NULL),
place AS (SELECT book_id, i, CASE WHEN book_id % 3 = 0 THEN chapters - 1 - i ELSE i END AS spine_idx FROM chap),
block AS (SELECT book_id, spine_idx, 0 AS para_idx, 'Chapter ' || i AS text FROM place UNION ALL
  SELECT book_id, spine_idx, para_idx % {D.PARAS_PER_CHAPTER} + 1, text FROM place JOIN (SELECT book_id, chapter_idx AS i, para_idx, text FROM para1) USING (book_id, i))"""


@query(f"""{EPUB} SELECT doc_id AS book_id, error, CASE WHEN error IS NULL THEN 'S' || (doc_id % 3 + 1) END AS sequence_tier, CASE WHEN error IS NULL THEN 'Book ' || doc_id END AS title,
CASE WHEN error IS NULL THEN 'Author ' || (doc_id % 7) END AS author, CASE WHEN error IS NULL THEN source END AS series_name, CASE WHEN error IS NULL AND doc_id % 2 = 1 THEN doc_id + 0.5::DOUBLE END AS position,
CASE WHEN error IS NULL AND doc_id % 5 <> 0 AND doc_id % 4 < 3 THEN 'C' || (doc_id % 4 + 1) END AS cover_tier FROM state""")
def epub_books(spark, d):
    return by_book(library(spark, d).book).select("book_id", "error", "sequence_tier", "title", "author", F.col("series.name").alias("series_name"), "series.position", F.col("cover.tier").alias("cover_tier"))


@query(f"{EPUB} SELECT book_id, spine_idx, 'OEBPS/text/ch ' || i || '.xhtml' AS name, 'Chapter ' || i AS heading, 'Chapter ' || i AS first_block, n AS n_paras FROM place JOIN (SELECT book_id, spine_idx, count(*) AS n FROM block GROUP BY ALL) USING (book_id, spine_idx)")
def epub_documents(spark, d):
    return by_book(library(spark, d).document)


@query(f"{EPUB} SELECT book_id, spine_idx, para_idx, text FROM block")
def epub_paragraphs(spark, d):
    return by_book(library(spark, d).para)


@query(f"{EPUB} SELECT book_id, i AS entry_idx, spine_idx, 'Chapter ' || i AS label FROM place")
def epub_contents(spark, d):
    return by_book(library(spark, d).toc)


@query(f"""{EPUB}, s AS (SELECT doc_id AS book_id, 'book' AS slug, row_number() OVER (ORDER BY doc_id::VARCHAR) AS nth FROM state WHERE error IS NULL AND doc_id % 2 = 0)
SELECT book_id, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS slug FROM s""")
def epub_slugs(spark, d):
    """Slugs of even books, all titled alike."""
    good = library(spark, d).book.where("error is null").where(F.col("path").cast("long") % 2 == 0)
    return by_book(epub.book_ids(good.withColumn("title", F.lit("Book!")))).select("book_id", "slug")
