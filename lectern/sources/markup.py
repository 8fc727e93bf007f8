"""Paragraphs and headings of HTML as pandas UDFs on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as A

# Tags that end a paragraph, tags whose text never shows.
BLOCK_TAGS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "br", "li", "blockquote"}
SKIP_TAGS = {"script", "style"}
HEADINGS = {"h1", "h2", "h3", "h4"}
BODY = re.compile(r"<body\b[^>]*>(.*)</body\s*>", re.I | re.S)


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[str] = []
        self.headings: list[str] = []
        self.parts: list[str] = []
        self.skipped = 0
        self.heading = False

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.paragraphs.append(text)
            if self.heading:
                self.headings.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.skipped += 1
        elif tag in BLOCK_TAGS:
            self.flush()
            self.heading = tag in HEADINGS

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS:
            self.skipped = max(0, self.skipped - 1)
        elif tag in BLOCK_TAGS:
            self.flush()
            self.heading = False

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


def _parse(html: str | None) -> _Paragraphs:
    found = BODY.search(html or "")
    parser = _Paragraphs()
    parser.feed(found[1] if found else (html or ""))
    parser.close()
    parser.flush()
    return parser


def paragraphs_of(html: str | None) -> list[str]:
    return _parse(html).paragraphs


def first_heading_of(html: str | None) -> str | None:
    return next(iter(_parse(html).headings), None)


@F.pandas_udf(A.ArrayType(A.StringType()))
def paragraphs(html: pd.Series) -> pd.Series:
    return html.map(paragraphs_of, na_action=None)


@F.pandas_udf(A.StringType())
def first_heading(html: pd.Series) -> pd.Series:
    return html.map(first_heading_of, na_action=None)


@F.pandas_udf(A.StructType([A.StructField("heading", A.StringType()), A.StructField("paras", A.ArrayType(A.StringType()))]))
def headed_paragraphs(html: pd.Series) -> pd.DataFrame:
    """The first heading and the paragraphs, from one reading."""
    read = [_parse(h) for h in html]
    return pd.DataFrame({"heading": [next(iter(r.headings), None) for r in read], "paras": [r.paragraphs for r in read]}, dtype=object)
