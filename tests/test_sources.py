"""Books, feeds and tables from synthetic files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import epub, feeds, markup


def make_epub(title="A Book", docs=(("Chapter 1", ["one", "two"]),), spine=True, extra="", items="", meta="", files=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        man = "".join(f'<item id="c{i}" href="text/ch%20{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(docs)))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(docs))) if spine else ""
        z.writestr(
            "OEBPS/content.opf",
            f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:creator>Me</dc:creator>{meta}</metadata>'
            f'<manifest>{man}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{refs}</spine></package>',
        )
        points = "".join(f'<navPoint><navLabel><text>{label}</text></navLabel><content src="text/ch%20{i}.xhtml#x"/></navPoint>' for i, (label, _) in enumerate(docs))
        z.writestr("OEBPS/toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>")
        for i, (label, ps) in enumerate(docs):
            z.writestr(f"OEBPS/text/ch {i}.xhtml", f"<html><body class='ab'><h1>{label}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</body></html>")
        for name, content in files:
            z.writestr(name, content)
        if extra:
            z.writestr("META-INF/encryption.xml", extra)
    return out.getvalue()


def test_book(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(make_epub(docs=(("Prologue", ["p<i>q</i>r"]), ("Chapter 1", ["x  y", ""]))))
    (tmp_path / "b.epub").write_bytes(b"not a zip")
    locked = '<encryption><CipherReference URI="OEBPS/text/ch%200.xhtml"/></encryption>'
    (tmp_path / "c.epub").write_bytes(make_epub(extra=locked))
    (tmp_path / "d.epub").write_bytes(make_epub(spine=False))
    library = epub.read_epubs(spark, str(tmp_path))
    books = library.book
    got = {r["path"][-6:]: r for r in books.collect()}
    assert got["b.epub"]["error"] == "not a zip file"
    assert got["c.epub"]["error"] == "encrypted content"
    assert (got["a.epub"]["sequence_tier"], got["d.epub"]["sequence_tier"]) == ("S1", "S2")
    mine = F.col("path") == got["a.epub"]["path"]
    assert [(t["entry_idx"], t["spine_idx"], t["label"]) for t in library.toc.where(mine).orderBy("entry_idx").collect()] == [(0, 0, "Prologue"), (1, 1, "Chapter 1")]
    paras = [(r["spine_idx"], r["para_idx"], r["text"]) for r in library.para.where(mine).orderBy("spine_idx", "para_idx").collect()]
    assert paras == [(0, 0, "Prologue"), (0, 1, "pqr"), (1, 0, "Chapter 1"), (1, 1, "x y")]
    assert {r["path"][-6:] for r in library.para.select("path").distinct().collect()} == {"a.epub", "d.epub"}
    epub.ingest(library, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/para")).count() == 4 + 3
    assert epub.read_epubs(spark, str(tmp_path), known=books).book.count() == 0
    named = {(r["path"][-6:], r["slug"]) for r in epub.book_ids(books.where("error is null")).collect()}
    assert named == {("a.epub", "a-book"), ("d.epub", "a-book-2")}


def test_cover_and_series(spark, tmp_path):
    picture = b"x" * 200
    item = '<item id="pic" href="i/cover.png" media-type="image/png" properties="cover-image"/>'
    meta = '<meta name="calibre:series" content="Fox"/><meta name="calibre:series_index" content="2"/>'
    (tmp_path / "a.epub").write_bytes(make_epub(items=item, files=[("OEBPS/i/cover.png", picture)], meta=meta))
    (tmp_path / "b.epub").write_bytes(make_epub(items=item, files=[("OEBPS/i/cover.png", b"x")]))
    plain = item.replace(' properties="cover-image"', "")
    (tmp_path / "c.epub").write_bytes(make_epub(items=plain, meta='<meta name="cover" content="pic"/>', files=[("OEBPS/i/cover.png", picture)]))
    (tmp_path / "d.epub").write_bytes(make_epub(items=plain, files=[("OEBPS/i/cover.png", picture)]))
    (tmp_path / "e.epub").write_bytes(make_epub(docs=(("One", ["<img src='../i/x.png'/>"]),), files=[("OEBPS/i/x.png", picture)]))
    got = {r["path"][-6]: r for r in epub.read_epubs(spark, str(tmp_path)).book.collect()}
    assert (got["a"]["series"].asDict(), got["b"]["series"]) == ({"name": "Fox", "position": 2.0}, None)
    assert [got[k]["cover"] and got[k]["cover"]["tier"] for k in "abcde"] == ["C1", None, "C2", "C3", "C4"]
    assert bytes(got["e"]["cover"]["content"]) == picture


def test_reading_order(spark, tmp_path):
    """Files alone are read by whole numbers, case aside; names of the package that no entry has do not count."""
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="p.opf"/></c>')
        z.writestr("p.opf", '<package><manifest><item id="x" href="gone.xhtml" media-type="text/html"/></manifest><spine><itemref idref="x"/></spine></package>')
        for n in ("ch10.html", "Ch2.html", "ch1.HTM", "META-INF/no.html", "ch010b.xhtml", "note.txt"):
            z.writestr(n, f"<p>{n}</p>")
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="p.opf"/></c>')
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="p.opf"/></c>')
        z.writestr("p.opf", "<package><manifest/></package>")
    library = epub.read_epubs(spark, str(tmp_path))
    assert [r["name"] for r in library.document.orderBy("spine_idx").collect()] == ["ch1.HTM", "Ch2.html", "ch10.html", "ch010b.xhtml"]
    assert {r["path"][-6]: (r["sequence_tier"], r["error"], r["title"]) for r in library.book.collect()} == {
        "a": ("S3", None, "Untitled"), "b": (None, "no package document", None), "c": (None, "no reading order", None),
    }


def test_archives_are_read_once(spark):
    """No table of a library reads, or makes, an archive a second time; one without entries is a book with an error."""
    made = spark.sparkContext.accumulator(0)
    whole, none = make_epub(docs=(("Chapter 1", ["one"]),)), b"PK\x05\x06" + bytes(18)

    def archive(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(path=pdf["id"].astype(str), content=[none if i == 3 else whole for i in pdf["id"]])[["path", "content"]]

    files = spark.range(20).mapInPandas(archive, "path string, content binary").withColumn("sha256", F.sha2("content", 256))
    library = epub.parse_books(files)
    assert {(r["path"], r["error"], r["title"]) for r in library.book.collect()} == {(str(i), "no package document" if i == 3 else None, None if i == 3 else "A Book") for i in range(20)}
    assert library.document.count() == 19 and library.para.where("text = 'one'").count() == 19
    assert made.value == 20


@pytest.mark.parametrize(("base", "href", "path"), [("OEBPS", "a%20b.html#x", "OEBPS/a b.html"), ("", "../../x", "x"), ("a/b", "./../c", "a/c")])
def test_hrefs(base, href, path):
    assert epub.resolve_href(base, href) == path


def test_paragraphs():
    page = "<html><head><title>t</title></head><body id='x'>lead<p>a <b>b</b>\n c<br>d</p><script>var x='<p>'</script><div>&amp;e<!-- no --></div></body></html>"
    assert markup.paragraphs_of(page) == ["lead", "a b c", "d", "&e"]
    assert markup.paragraphs_of("") == [] and markup.paragraphs_of(None) == []
    assert markup.first_heading_of("<h2></h2><p>x</p><h3>Real</h3>") == "Real"


def test_feed(spark):
    item = "<item><guid>https://e.x/show/5?utm=1</guid><book_id>b5</book_id><title>T</title><user_rating>0</user_rating><average_rating>4.2</average_rating><book id='1'><num_pages>300</num_pages></book><user_shelves>read, fav</user_shelves><user_read_at>Tue, 05 Mar 2019 00:00:00 -0800</user_read_at><user_date_added>junk</user_date_added></item>"
    df = spark.createDataFrame([("read", f"<rss><channel>{item}<item><title>Only</title></item></channel></rss>")], "shelf string, xml string")
    got = {r["title"]: r for r in feeds.parse_feeds(df).collect()}
    r = got["T"]
    assert (r["review_id"], r["num_pages"], r["user_rating"], r["average_rating"], r["custom_shelves"]) == ("5", 300, None, 4.2, ["fav"])
    assert (r["date_read"], r["date_added"]) == ("2019-03-05T00:00:00-08:00", None)
    assert (got["Only"]["review_id"], got["Only"]["num_pages"]) == ("", None)


def test_review_table(spark):
    cell = lambda name, v: f'<td class="field {name}"><label>x</label><div class="value">{v} <a href="#">edit</a></div></td>'
    row = '<tr id="review_42">' + cell("title", "The <b>Fox</b>") + cell("num_pages", "1,234 pp") + cell("date_started", "Mar 5, 2019") + cell("date_read", "not set") + cell("read_count", "2") + "</tr>"
    df = spark.createDataFrame([(f"<table>{row}<tr id='review_template'><td></td></tr></table>",), (None,)], "html string")
    r = feeds.parse_review_tables(df).collect()
    assert len(r) == 1
    assert (r[0]["review_id"], r[0]["title"], r[0]["num_pages"], r[0]["date_started"], r[0]["date_read"], r[0]["read_count"]) == ("42", "The Fox", 1234, "2019-03-05", None, 2)


def test_genres(spark):
    page = '{"name":"Fantasy","webUrl":"https://e.x/genres/fantasy"},{"name":"Fantasy","webUrl":"https://e.x/genres/f"},{"name":"No","webUrl":"https://e.x/y"}'
    assert spark.createDataFrame([(page,)], "p string").select(feeds.genres(F.col("p")).alias("g")).collect()[0]["g"] == ["Fantasy"]
