"""Scalar text, date and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of review dates, list words that are no genre, series suffix of a title.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
NOT_GENRES = ["audiobook", "audiobooks", "ebook", "ebooks", "book club", "owned", "currently reading", "to read", "favorites"]
SERIES_SUFFIX = r"^(.*)\s\(([^,()]+),\s*#(\d+(?:\.\d+)?)\)\s*$"
# Cover colours of series; pages and heights of a book's spine.
SERIES_COLOURS = ["#1e3a5f", "#3d1f1f", "#1a2e1a", "#2e2410", "#1f1f3a", "#2a1f0e", "#0e2a2a"]
MIN_PAGES, MAX_PAGES, DEFAULT_PAGES, MIN_HEIGHT, MAX_HEIGHT = 96, 1088, 466, 150, 166
# A citation in an answer, and a whole citation id.
CITATION = r"\[([^\[\]:\s]+:\d+:p\d+)\]"
CITATION_ID = r"^([^:]+):(\d+):p(\d+)$"


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """White space away at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def slug(text: Column, fallback: str = "untitled") -> Column:
    """Lower case, other than letters and digits as single hyphens."""
    return F.coalesce(blank_to_null(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))), F.lit(fallback))


def humanize(series_id: Column) -> Column:
    words = F.filter(F.split(F.replace(series_id, F.lit("_"), F.lit("-")), "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def series_of(title: Column) -> Column:
    """Series name of a trailing "(Series, #N)"; null if there is none."""
    return blank_to_null(F.btrim(F.regexp_extract(F.btrim(title), SERIES_SUFFIX, 2)))


def series_number(title: Column) -> Column:
    return F.try_to_number(blank_to_null(F.regexp_extract(F.btrim(title), SERIES_SUFFIX, 3)), F.lit("999999999D999999")).cast("double")


def strip_series(title: Column) -> Column:
    return F.when(series_of(title).isNotNull(), F.btrim(F.regexp_extract(F.btrim(title), SERIES_SUFFIX, 1))).otherwise(title)


def _key(part: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.btrim(part), r"^(the|a|an)\s+", ""), "[^a-z0-9]+", "")


def title_keys(title: Column) -> Column:
    """Normalised forms of a title: whole, colon head and tail, first and last spaced-dash segment."""
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\([^)]*\)", ""))
    dashed = s.rlike(r"\s[-–—]\s")
    parts = F.split(s, r"\s[-–—]\s")
    forms = F.array(
        _key(s),
        _key(F.regexp_replace(s, r":.*$", "")),
        _key(F.regexp_replace(s, r"^[^:]+:\s*", "")),
        F.when(dashed, _key(F.element_at(parts, 1))).otherwise(F.lit("")),
        F.when(dashed, _key(F.element_at(parts, -1))).otherwise(F.lit("")),
    )
    return F.array_distinct(F.filter(forms, lambda k: k != ""))


def author_tokens(author: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(author, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def question_title(question: Column, limit: int = 90) -> Column:
    """A question as a conversation's title."""
    s = squeeze(question)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…"))).otherwise(s)


def citations(answer: Column) -> Column:
    """Cited ids in order of appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))


def citations_json(cited: Column) -> Column:
    """Cited ids as a conversation stores them: a JSON array."""
    return F.to_json(cited)


def citations_from_json(stored: Column) -> Column:
    """Cited ids of a stored JSON array; none for an empty or broken one."""
    return F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))


def prompt_hash(template: Column) -> Column:
    """Sixteen hexadecimal digits that name a prompt template."""
    return F.substring(F.sha2(template, 256), 1, 16)


def citation_id(book_id: Column, spine_idx: Column, para_idx: Column) -> Column:
    return F.format_string("%s:%s:p%s", book_id.cast("string"), spine_idx.cast("string"), para_idx.cast("string"))


def parse_citation(text: Column) -> dict[str, Column]:
    """book, spine_idx, para_idx of a strict citation id; nulls if it is malformed."""
    part = lambda i: blank_to_null(F.regexp_extract(text, CITATION_ID, i))
    return {"book": part(1), "spine_idx": part(2).try_cast("long"), "para_idx": part(3).try_cast("long")}


# Fixed value: a whole text in a code fence, of JSON or without a language.
FENCED = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"


def code_fence_body(text: Column) -> Column:
    """What stands inside a code fence around the whole text, on one line or more; else the text as it is."""
    bare = strip(text)
    return F.when(bare.rlike(FENCED), F.regexp_extract(bare, FENCED, 1)).otherwise(text)


# Fixed value: characters that a stored file name does not keep.
UNSAFE_IN_FILE_NAME = r"[^A-Za-z0-9 ._()\[\]-]+"


def safe_file_name(name: Column, book_id: Column) -> Column:
    """Last part of an upload's path in safe characters, as an EPUB; the book's id where nothing is left."""
    base = F.element_at(F.split(F.rtrim(F.coalesce(name, F.lit("")), F.lit("/")), "/"), -1)
    safe = F.btrim(F.regexp_replace(base, UNSAFE_IN_FILE_NAME, "_"), F.lit(" ._"))
    named = F.when(F.lower(safe).endswith(".epub"), safe).otherwise(F.concat(safe, F.lit(".epub")))
    return F.when(safe != "", named).otherwise(F.concat(book_id.cast("string"), F.lit(".epub")))


def custom_shelves(raw: Column, shelf: Column) -> Column:
    """Comma list without blanks and without the echo of the shelf itself."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda s: F.btrim(s))
    return F.filter(items, lambda s: (s != "") & (F.lower(s) != F.lower(F.btrim(shelf))))


def review_id(guid: Column) -> Column:
    """Last part of a URL, without query or fragment."""
    last = F.element_at(F.split(F.rtrim(F.coalesce(guid, F.lit("")), F.lit("/")), "/"), -1)
    return F.regexp_replace(last, r"[?#].*$", "")


def user_id(value: Column) -> Column:
    """A bare number, or the number in a profile URL; null otherwise."""
    v = F.btrim(value)
    return F.when(v.rlike(r"^\d+$"), v).otherwise(blank_to_null(F.regexp_extract(v, r"/(?:user/show|review/list|review/list_rss)/(\d+)", 1)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def top_genres(genres: Column, n: int = 3) -> Column:
    """First ``n`` of a comma list that are genres."""
    items = F.filter(F.transform(F.split(F.coalesce(genres, F.lit("")), ","), lambda g: F.btrim(g)), lambda g: (g != "") & ~F.lower(g).isin(*NOT_GENRES))
    return F.slice(items, 1, n)


def strip_html(text: Column) -> Column:
    """Tags away, the common entities decoded."""
    out = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>|</p>", "\n"), r"<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.btrim(out, F.lit(" \n\t"))


def ellipsize(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def roman(number: Column) -> Column:
    """Roman numeral of 1 to 3999; other numbers as digits."""
    place = lambda unit, one, five, ten: F.element_at(
        F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]),
        (F.floor(number / unit) % 10 + 1).cast("int"),
    )
    text = F.concat(F.repeat(F.lit("M"), F.floor(number / 1000).cast("int")), place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X"))
    return F.when(number.between(1, 3999), text).otherwise(number.cast("string"))


def rfc_date(value: Column) -> Column:
    """ISO-8601 text, offset kept, of an RFC-2822 date; null on garbage."""
    pattern = r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}):(\d{2}):(\d{2})\s+([+-]\d{2})(\d{2})\s*$"
    g = lambda i: F.regexp_extract(value, pattern, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(g(2)))
    day = F.concat_ws("-", g(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(g(1), 2, "0"))
    real = (month > 0) & F.try_to_date(day, "yyyy-MM-dd").isNotNull() & (g(4) < "24") & (g(5) < "60") & (g(6) < "60")
    return F.when(F.coalesce(value.rlike(pattern) & real, F.lit(False)), F.concat(day, F.lit("T"), g(4), F.lit(":"), g(5), F.lit(":"), g(6), g(7), F.lit(":"), g(8)))


def review_date(value: Column) -> Column:
    """ISO-8601 text of a review-table date, no more precise than what was written."""
    v = F.btrim(value)
    month_at = lambda text: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), text)
    full, month, year = r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})$", r"^([A-Za-z]{3}) (\d{4})$", r"^\d{4}$"
    fm, mm = month_at(F.regexp_extract(v, full, 1)), month_at(F.regexp_extract(v, month, 1))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(v.rlike(full) & (fm > 0), F.concat_ws("-", F.regexp_extract(v, full, 3), two(fm), two(F.regexp_extract(v, full, 2))))
        .when(v.rlike(month) & (mm > 0), F.concat_ws("-", F.regexp_extract(v, month, 2), two(mm)))
        .when(v.rlike(year), v)
    )


def exact_day(value: Column) -> Column:
    """Date of ISO text that is precise to the day, else null."""
    return F.when(F.length(value) >= 10, F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))


def month_key(value: Column) -> Column:
    """YYYY-MM of ISO text that is precise to the month, else null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}"), F.substring(value, 1, 7))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("long")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    return F.floor(F.length(text) / chars_per_token)


def percent(part: Column, whole: Column) -> Column:
    """Rounded half to even; 0 for an empty whole."""
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 0)).otherwise(F.lit(0.0)).cast("long")


def series_colour(series_id: Column) -> Column:
    """Cover colour by a 32-bit polynomial hash of the id's UTF-16 units."""
    points = F.transform(F.filter(F.split(series_id, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda p: F.array(F.floor((p - 0x10000) / 0x400) + 0xD800, (p - 0x10000) % 0x400 + 0xDC00)
    units = F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(pair(p))))
    hashed = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: (h * 31 + u) % (1 << 32))
    return F.get(F.array(*[F.lit(c) for c in SERIES_COLOURS]), (hashed % len(SERIES_COLOURS)).cast("int"))


def spine_height(num_pages: Column) -> Column:
    """Height of a book's spine on the shelf by its pages."""
    pages = F.least(F.greatest(F.coalesce(num_pages, F.lit(DEFAULT_PAGES)), F.lit(MIN_PAGES)), F.lit(MAX_PAGES))
    return F.floor(MIN_HEIGHT + (pages - MIN_PAGES) / (MAX_PAGES - MIN_PAGES) * (MAX_HEIGHT - MIN_HEIGHT) + 0.5).cast("long")


def long_date(day: Column) -> Column:
    """A date as "4 August 2026"."""
    return F.date_format(day, "d MMMM yyyy")


def relative_date(then: Column, now: Column) -> Column:
    """How long ago, by minutes, hours and days, each rounded from the one before; a date from a week on."""
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    minutes = rounded((F.unix_millis(now) - F.unix_millis(then)) / 60_000)
    hours = rounded(minutes / 60)
    days = rounded(hours / 24)
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
        .when(days < 7, F.concat(days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago")))
        .otherwise(F.date_format(then, "d MMM yyyy"))
    )
