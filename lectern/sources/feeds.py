"""Shelf feeds (RSS) and review tables (HTML) as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as A

from lectern.functions import text as T

ITEM = (
    "guid string, book_id string, title string, author_name string, isbn string, book_published string, book_description string, book_small_image_url string, "
    "book_medium_image_url string, book_large_image_url string, average_rating string, user_rating string, user_review string, user_shelves string, "
    "user_date_added string, user_read_at string, user_date_created string, book struct<num_pages:string>"
)
FEED = f"struct<channel:struct<item:array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in re.split(r', (?![^<]*>)', ITEM))}>>>>"
#: A fetch of this many rows or more was cut by the feed.
TRUNCATED_AT = 100
NULL_CELLS = ("not set", "—", "-", "")


def _blank(c: str) -> Column:
    return T.blank_to_null(F.btrim(F.col(c)))


def parse_items(items: DataFrame, shelf: Column) -> DataFrame:
    """Shelf rows of feed items; coercions give null instead of errors, and a rating of 0 is none."""
    number = lambda c, kind: _blank(c).try_cast(kind)
    return items.select(
        T.review_id(_blank("guid")).alias("review_id"),
        F.coalesce(_blank("book_id"), F.lit("")).alias("shelf_book_id"),
        F.coalesce(_blank("title"), F.lit("")).alias("title"),
        F.coalesce(_blank("author_name"), F.lit("")).alias("author"),
        _blank("isbn").alias("isbn"),
        F.btrim(F.col("book.num_pages")).try_cast("int").alias("num_pages"),
        number("book_published", "int").alias("published_year"),
        _blank("book_description").alias("description"),
        _blank("book_small_image_url").alias("cover_small"),
        _blank("book_medium_image_url").alias("cover_medium"),
        _blank("book_large_image_url").alias("cover_large"),
        number("average_rating", "double").alias("average_rating"),
        F.nullif(number("user_rating", "int"), F.lit(0)).alias("user_rating"),
        _blank("user_review").alias("user_review"),
        shelf.alias("shelf"),
        T.custom_shelves(_blank("user_shelves"), shelf).alias("custom_shelves"),
        T.rfc_date(_blank("user_date_added")).alias("date_added"),
        T.rfc_date(_blank("user_read_at")).alias("date_read"),
        T.rfc_date(_blank("user_date_created")).alias("date_created"),
        F.lit(None).cast("string").alias("date_started"),
    )


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Rows of feed documents (shelf, xml); a document that is no feed raises."""
    parsed = feeds.select("shelf", F.from_xml("xml", FEED[7:-1].replace("channel:", "channel ", 1), {"mode": "PERMISSIVE"}).alias("feed"), "xml")
    ok = parsed.where(F.when(~F.coalesce(F.contains("xml", F.lit("<channel")), F.lit(False)), F.raise_error(F.lit("not a feed")).cast("boolean")).otherwise(F.lit(True)))
    items = ok.select("shelf", F.explode("feed.channel.item").alias("i")).select("shelf", "i.*")
    return parse_items(items, F.col("shelf"))


def fetch_log(rows: DataFrame) -> DataFrame:
    """(shelf, item_count, truncated) of parsed feeds."""
    return rows.groupBy("shelf").agg(F.count("*").alias("item_count")).withColumn("truncated", F.col("item_count") >= TRUNCATED_AT)


REVIEW = "review_id string, title string, date_started string, date_read string, date_added string, read_count int, num_pages int"
_ROW = re.compile(r"<tr\b[^>]*\bid=[\"']review_(\d+)[\"'][^>]*>(.*?)</tr>", re.I | re.S)
_CELL = re.compile(r"<td\b[^>]*\bclass=[\"'][^\"']*\bfield\s+(\w+)[^\"']*[\"'][^>]*>(.*?)</td>", re.I | re.S)
_VALUE = re.compile(r"<div\b[^>]*\bclass=[\"'][^\"']*\bvalue\b[^\"']*[\"'][^>]*>(.*?)(?:</div>|\Z)", re.I | re.S)


def _cells(html: str | None) -> list[dict]:
    """Rows of a review table by id; template rows have no number and are none."""
    import html as entities

    rows = []
    for number, body in _ROW.findall(html or ""):
        cells = {}
        for name, cell in _CELL.findall(body):
            value = _VALUE.search(cell)
            text = re.sub(r"<a\b[^>]*>\s*(?:edit|\[edit\])\s*</a>", "", value[1] if value else cell, flags=re.I | re.S)
            cells[name] = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", text)).split())
        rows.append({"review_id": number} | {k: cells.get(k) for k in ("title", "date_started", "date_read", "date_added", "read_count", "num_pages")})
    return rows


CELLS = ("review_id", "title", "date_started", "date_read", "date_added", "read_count", "num_pages")


@F.pandas_udf(A.ArrayType(A.StructType([A.StructField(c, A.StringType()) for c in CELLS])))
def _review_cells(html: pd.Series) -> pd.Series:
    return html.map(_cells, na_action=None)


def parse_review_tables(pages: DataFrame) -> DataFrame:
    """Reviews of pages (html): dates keep their precision, numbers are their digits, null marks are null."""
    r = pages.select(F.explode(_review_cells("html")).alias("r")).select("r.*")
    real = lambda c: F.when(~F.lower(F.col(c)).isin(*NULL_CELLS), F.col(c))
    digits = lambda c: F.regexp_replace(real(c), r"\D", "").try_cast("int")
    return r.select(
        "review_id", F.coalesce("title", F.lit("")).alias("title"), *[T.review_date(real(c)).alias(c) for c in ("date_started", "date_read", "date_added")],
        digits("read_count").alias("read_count"), digits("num_pages").alias("num_pages"),
    )


def genres(page: Column) -> Column:
    """Genre names in a book page's script, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'"name":"([^"]+)"\s*,\s*"webUrl":"[^"]*/genres/[^"]+"'), F.lit(1)))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def digest_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of digest files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
