"""BPE, language ID, HTML extraction and decontamination on fixtures, nulls, edges and held-out rows."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, html_main, langid

TEXT = "doc_id long, text string"


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def odd_texts(n=600):
    rng = random.Random(1)
    letters = "ab é\n\t'  s漢字123 \x1c\x85🙂ﬁ​　힣x"
    rows = ["".join(rng.choice([rng.choice(letters), "<|endoftext|>", " the", "'ll", "<|endof"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*rows, "a" * 5000, "ab" * 3000, "", " " * 1000, "é" * 400, "x" * 64, "x" * 65]


def test_codec_matches_the_library():
    lib, mine = library(), bpe.codec(bpe.default_vocabulary())
    texts = odd_texts()
    want = lib.encode_batch(texts, add_special_tokens=False)
    got = mine.encode_batch(texts)
    assert [g.tolist() for g in got] == [w.ids for w in want]
    assert [mine.decode(g) for g in got] == [lib.decode(w.ids, skip_special_tokens=False) for w in want]
    assert [mine.decode(g) for g in got] == texts


def test_short_and_long_words_agree():
    mine = bpe.codec(bpe.default_vocabulary())
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(1, 60))).encode() for _ in range(300)]
    for short, word in zip(mine.encode_short(words), words, strict=True):
        assert short.tolist() == mine.encode_long(word).tolist()


def test_decoding_mends_broken_bytes():
    mine = bpe.codec(bpe.default_vocabulary())
    half = mine.byte_id[np.frombuffer("é".encode()[:1], np.uint8)]
    assert mine.decode(half) == "�"


def test_encode_rows(spark):
    lib = library()
    rows = [(1, None), (2, ""), (None, "the cat"), (2, "the cat"), (2, "the cat"), (3, "word " * 40_000)]
    got = bpe.encode_decode(spark.createDataFrame([(*r, "x") for r in rows], TEXT + ", ids string")).collect()
    assert len(got) == len(rows)
    for d, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert any((r["doc_id"], bytes(r["ids"]), r["decoded"], r["n_tokens"]) == (d, ids, t or "", len(ids) // 4) for r in got)
    assert bpe.encode_decode(spark.createDataFrame([], TEXT)).collect() == []


def test_bpe_query(spark, sf_dir):
    from lectern.llm import queries

    lib = library()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op5_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_all_segmentations_are_summed():
    nodes, n = langid.trie(langid.default_vocabulary())
    rng = np.random.default_rng(3)
    table = rng.dirichlet(np.ones(n), 3).T

    def brute(word):
        ways = [np.zeros(3) for _ in range(len(word) + 1)]
        ways[0] = np.ones(3)
        for e in range(1, len(word) + 1):
            for s in range(e):
                if nodes.get(word[s:e], -1) >= 0:
                    ways[e] = ways[e] + ways[s] * table[nodes[word[s:e]]]
        return np.log(ways[-1])

    scorer = langid.Scorer(table, langid.default_vocabulary())
    words = ["a", "the", "station", "straße", "naïve", "ciónmente" * 4, "x" * 60, "日本語"]
    for word, logs in zip(words, scorer.words(words), strict=True):
        assert logs == pytest.approx(brute(b" " + word.encode()))
        assert langid.long_word(b" " + word.encode(), nodes, table) == pytest.approx(brute(b" " + word.encode()))


def test_language_of_held_out_documents(spark, sf_dir):
    from lectern.llm import queries

    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op8_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_long_words_are_learned(spark):
    """Languages without spaces, of long runs only, are told apart; expected pieces agree with the lattice's."""
    rng = random.Random(4)
    signs = {"zh": "的一是不了人我在有他这中大来上国", "ja": "のにはをたがでてとしれさある日本"}
    run = lambda k: "".join(rng.choice(signs[k]) for _ in range(40))
    rows = [(i, "。".join(run(k) for _ in range(5)), k) for i, k in enumerate(["ja", "zh"] * 20)]
    tables = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(i, run(k), k) for i, k in enumerate(["ja", "zh"] * 10)]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), tables).collect()
    assert [r["lang_pred"] for r in got] == [r["lang"] for r in got]
    nodes, n = langid.trie(langid.default_vocabulary())
    flat = np.full((n, 1), 1.0 / n)
    word = " naïvestation".encode()
    lattice = langid.Lattice([word], langid.node_table(langid.default_vocabulary()))
    want = np.bincount(lattice.piece, lattice.uses(flat, np.zeros(1, int)), n)
    used = langid.long_pieces(word, nodes, flat[:, 0])
    assert set(used) == set(lattice.piece.tolist()) and all(v == pytest.approx(want[p]) for p, v in used.items())


def brute_languages(rows):
    """(id, language, score) by plain expectation maximisation over dictionaries and a plain forward sum."""
    nodes, n_pieces = langid.trie(langid.default_vocabulary())
    pieces = {p: i for p, i in nodes.items() if i >= 0}
    words = lambda t: [b" " + w.encode() for w in langid.words_of((t or "").lower())]
    arcs = lambda w: [(s, e, pieces[w[s:e]]) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in pieces]

    def forward(w, prob):
        alpha = [1.0] + [0.0] * len(w)
        for s, e, p in sorted(arcs(w), key=lambda a: a[1]):
            alpha[e] += alpha[s] * prob.get(p, prob[None])
        return alpha

    counts = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(words(text))
    model = {k: {None: 1.0 / n_pieces} for k in sorted(counts)}
    for _ in range(langid.ROUNDS):
        for lang, c in counts.items():
            used = Counter()
            for w, n in c.items():
                alpha = forward(w, model[lang])
                beta = [0.0] * len(w) + [1.0]
                for s, e, p in sorted(arcs(w), key=lambda a: -a[0]):
                    beta[s] += model[lang].get(p, model[lang][None]) * beta[e]
                for s, e, p in arcs(w):
                    used[p] += n * alpha[s] * model[lang].get(p, model[lang][None]) * beta[e] / alpha[len(w)]
            total = sum(used.values()) + langid.PSEUDO * n_pieces
            model[lang] = {p: (langid.PSEUDO + x) / total for p, x in used.items()} | {None: langid.PSEUDO / total}
    out = {}
    for i, text, _ in rows:
        logs = {k: sum(np.log(forward(w, prob)[len(w)]) for w in words(text)) for k, prob in model.items()}
        if not words(text):
            out[i] = ("und", 0.0)
            continue
        best = max(logs, key=logs.get)
        out[i] = (best, 1 / sum(np.exp(x - logs[best]) for x in logs.values()))
    return out


def test_query_is_plain_expectation_maximisation(spark, tmp_path):
    from lectern.llm import queries

    rng = random.Random(8)
    vocabulary = {"en": "the of stone river and with tree".split(), "de": "der und Stein mit Fluß über Baum".split(), "fr": "la pierre et avec rivière où arbre".split()}
    shared = "hotel radio naïve wind".split()
    rows = [(i, " ".join(rng.choice(vocabulary[k] + shared) for _ in range(rng.randint(1, 6))), k) for i, k in enumerate(rng.choices(list(vocabulary), k=60))]
    rows += [(100, None, "en"), (101, "12 !", "de"), (102, "hotel", None), (103, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_languages(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op8_language_id(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-6), i


def test_chunks_depend_on_labels(monkeypatch):
    assert langid.per_lattice(4, 10_000) == 10_000 and langid.per_lattice(500, 10_000) == 500
    path = langid.default_vocabulary()
    rng = np.random.default_rng(1)
    _, n = langid.trie(path)
    table = rng.random((n, 3))
    words = [f"wort{i}" for i in range(40)]
    whole = langid.Scorer(table / table.sum(0), path).words(words)
    monkeypatch.setattr(langid, "per_lattice", lambda labels, most: 7)
    assert np.allclose(langid.Scorer(table / table.sum(0), path).words(words), whole)


def test_language_edges(spark):
    df = spark.createDataFrame(
        [(0, "the cat and the dog", "en", "a"), (1, "der Hund und die Katze", "de", "a"), (2, None, "en", None), (3, "123 !?", "de", ""), (4, "und der Hund", None, "a"), (None, "the dog", "en", "a"), (7, "the " * 50_000, "en", "a")],
        "doc_id long, text string, lang string, lang_pred string",
    )
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got[2] == ("und", 0.0) and got[3] == ("und", 0.0)
    assert got[4][0] == "de" and got[7][0] == "en"
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_words_of_all_lengths_are_summed_alike():
    """Neither floors nor lengths decide: words around the limit of short ones score as long ones do, and differ by language."""
    path = langid.default_vocabulary()
    nodes, n = langid.trie(path)
    table = np.full((n, 2), 1e-10)
    for piece, number in nodes.items():
        if number >= 0 and len(piece) == 1:
            table[number, 1] = 2e-10
    scorer = langid.Scorer(table, path)
    words = ["ꙮ" * k for k in range(9, 19)] + ["漢" * 14, "x" * 47, "x" * 48]
    for word, logs in zip(words, scorer.words(words), strict=True):
        want = langid.long_word(b" " + word.encode(), nodes, table)
        assert logs == pytest.approx(want) and logs[0] < logs[1]


def test_letters_are_letters(spark):
    df = spark.createDataFrame([(0, "the cat sat on the mat", "en"), (1, "²½①", None), (2, "́ ⅷ 7", None), (3, "हिन्दी", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert got == {0: ("en", 1.0), 1: ("und", 0.0), 2: ("und", 0.0), 3: ("en", 1.0)}
    assert langid.words_of("हिन्दी a1b") == ["हिन्दी", "a", "b"]


def test_many_labels(spark, monkeypatch):
    """Labels beyond one table give the results of one large table."""
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), (None, None), ("42", None)] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df).collect()}
    assert all(want[i][0] == (k or "und") for i, _, k in rows)
    monkeypatch.setattr(langid, "TABLE_LABELS", 2)
    for r in langid.identify(df).collect():
        assert (r["lang_pred"], r["score"]) == (want[r["doc_id"]][0], pytest.approx(want[r["doc_id"]][1]))


def test_language_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "the cat", "en", "mine", 7, "x")], "doc_id long, text string, lang string, lang_pred string, lang_score int, Lang_Best string")
    out = langid.predict(df, langid.train(df))
    assert out.columns == [*df.columns, "_lang_pred", "_lang_score"]
    assert tuple(out.collect()[0]) == (1, "the cat", "en", "mine", 7, "x", "en", 1.0)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy</div><div class="wrap"><div class="post-content p12"><h1>Head &amp; line</h1><p><b>One<br>
two.<p>Three &eacute;<script>var t="</p>";</script> four</p><div class="share">Share</div><form><p>Your mail</p></form><blockquote>Quote</blockquote></div>
<div id="comments"><p>A reader says a lot of things here, far more than the article does, again and again and again and again.</p></div></div>
<aside><p>Side</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, "http://A.example:80/y", PAGE.replace("p12", "p7")), (3, None, None), (4, "rubbish", ""), (5, "http://b.example/", "plain <b>text"), (6, "http://a.example/z", "<body><p>Only here</p></body>"), (6, "http://a.example/z", "<body><p>Only here</p></body>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html_main.extract(df).collect())
    article = "Head & line\nOne two.\nThree é four\nQuote"
    assert got == [(1, article), (2, article), (3, ""), (4, ""), (5, "plain text"), (6, "Only here"), (6, "Only here")]
    assert html_main.extract(df.limit(0)).collect() == []
    votes = {r["host"]: r["path"] for r in html_main.host_paths(df).collect()}
    assert votes["a.example"] == "/body/div.wrap/div.p.post-content"


def texts_of_hosts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html_main.extract(df).orderBy("page_id").collect()]


LONG, MORE = "A long paragraph of the article. " * 9 + "End.", "Another long part of it, of another class. " * 6 + "End."


def test_headline_and_parts_of_an_article(spark):
    """The choice is the whole article, not the part with most characters; junk beside it stays out."""
    inner = f"<h1>Head</h1><p class=lead>Lead</p><div class=entry-content><p>{LONG}</p></div><p>Close</p>"
    cut = f"<h1>Head</h1><section class=a><p>{LONG}</p></section><section class=b><p>{MORE}</p></section>"
    whole, both = f"Head\nLead\n{LONG}\nClose", f"Head\n{LONG}\n{MORE}"
    side = "<div class=other><p>Something else</p></div>"
    pages = [f"<body>{side}<{tag}>{x}</{tag.split()[0]}></body>" for x in (inner, cut) for tag in ("article", "main", "div class=post")]
    assert texts_of_hosts(spark, pages) == [whole] * 3 + [both] * 3


def test_class_words_spare_the_article(spark):
    """Words of class or id exclude no article and no wrapper of the page."""
    p = f"<p>{LONG}</p>"
    pages = [
        f"<article class='post comments-open'>{p}</article>",
        f"<div class='post no-comments'>{p}</div>",
        f"<div id='page' class='has-sidebar'><nav>No</nav>{p}<div class='sidebar'>Side</div></div>",
        f"<div class='layout with-nav'><article>{p}</article><div id='comments'><p>{MORE * 3}</p></div></div>",
        f"<main class='sidebar-right'>{p}</main>",
        f"<div class='widget'>{p}</div>",
        f"<article>{p}</article><div class='related'><article><p>Card</p></article></div>",
    ]
    assert texts_of_hosts(spark, pages) == [LONG] * 7


def test_parts_named_by_doubtful_words_first(spark):
    """cookie-content and footer-content are no article text, an entry-header is."""
    junk = "<div class='cookie-content'><p>We use cookies</p></div><div class='footer-content'><p>Imprint</p></div><div id='sidebarText'>Side</div>"
    page = f"<body><div class=post><div class='entry-header'><h1>Head</h1></div><p>{LONG}</p>{junk}</div></body>"
    assert texts_of_hosts(spark, [page]) == [f"Head\n{LONG}"]


def test_page_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>", "a", "b", "c")], "page_id long, url string, html string, won_host string, Won_Path string, page_host string")
    assert [tuple(r) for r in html_main.extract(df).collect()] == [(1, "http://a.example/", "a", "b", "c", "x")]


@pytest.mark.parametrize("part", ["<a", "<!x", "<a '", '<a x="', "<div>", "<div>x", "</article>", "<head>", "<title", "<div><article>y", "<i>'\"", "<script>", "</script", "<a\"\""])
def test_time_grows_with_the_page(part):
    """Unclosed tags, quotes and raw parts, deep nesting, and ends of what was never opened."""
    took = []
    for n in (20_000, 80_000):
        begin = time.process_time()
        page = html_main.parse("<div>" * (n if part == "</article>" else 0) + part * n)
        if page.blocks:
            html_main.main_container(page)
        took.append(time.process_time() - begin)
    assert took[1] < 9 * took[0] + 1


def labelled_page(rng, i):
    """A page of one of three layouts, with the text that a reader would call the article."""
    words = lambda n: " ".join(rng.choice(["stone", "river", "Haus", "bleu", "tree", "walk", "light", "&amp;", "naïve"]) for _ in range(n))
    head, paras = words(6), [words(rng.randint(8, 90)) for _ in range(rng.randint(1, 9))]
    junk = f"<nav><a href=/>{words(3)}</a></nav>"
    ad, foot, side, notes = f"<div class=ad>{words(9)}</div>", f"<footer>{words(5)}</footer>", f"<div class='sidebar'>{words(30)}</div>", f"<section id=comments><p>{words(rng.randint(5, 200))}</p></section>"
    body = "".join(f"<p>{p}</p>" for p in paras)
    page = [
        f"<body>{junk}{ad}<article><h1>{head}</h1>{body}</article>{notes}{foot}</body>",
        f"<body>{junk}<div id=wrap{i}><div class='post p{i}'><h1>{head}</h1><div class=entry>{body}</div>{ad}</div>{side}</div>{foot}</body>",
        f"<body><table><tr><td class=menu>{words(9)}</td><td class=story><h1>{head}</h1>{body}</td></tr></table>{foot}</body>",
    ][i % 3]
    return page, "\n".join(x.replace("&amp;", "&") for x in [head, *paras])


def main_text(page):
    found = html_main.parse(page)
    return html_main.text_of(found, {html_main.main_container(found)[0]}) if found.blocks else ""


STORY = "The committee met again on Tuesday and heard from the people who live beside the river about the new bridge. " * 3


@pytest.mark.parametrize("part", ["a", "a-", "a ", "a =", "a='", "=", "hidden ", "style=a "])
def test_time_grows_with_a_tag(part):
    """A tag of a megabyte takes no longer than its letters do."""
    begin = time.time()
    assert "told" in main_text(f"<div {part * (1_000_000 // len(part))}>untold</div><p>told</p>")
    assert time.time() - begin < 5


def test_header_of_an_article_stays():
    page = f"<header><p>Site name</p></header><article><header><h1>Headline</h1><p>Standfirst</p></header><p>{STORY}</p><footer>Tags</footer></article>"
    assert main_text(page).split("\n")[:2] == ["Headline", "Standfirst"]
    assert "Site name" not in main_text(page) and "Tags" not in main_text(page)


@pytest.mark.parametrize("name", ["ad-hoc-committee", "share-price", "search-results-study", "reply-of-the-minister"])
def test_names_of_other_subjects_stay(name):
    assert "Kept words" in main_text(f'<article><p>{STORY}</p><div class="{name}"><p>Kept words of the article.</p></div><p>{STORY}</p></article>')


@pytest.mark.parametrize("name", ["kommentare", "werbung", "share-box", "ad top", "publicité", "related-posts-river", "comments-list", "suche"])
def test_other_parts_go(name):
    inner = '<a href="/x">Lost words</a>' if "river" in name else "Lost words of others."
    assert "Lost words" not in main_text(f'<article><p>{STORY}</p><div class="{name}"><p>{inner}</p></div><p>{STORY}</p></article>')


@pytest.mark.parametrize("tag", ["svg", "object", "noscript", "template", "canvas", "math"])
def test_raw_tags_without_an_end_are_void(tag):
    assert main_text(f"<article><h1>Headline</h1><{tag} x=1><p>{STORY}</p></article>").endswith(STORY.strip())
    begin = time.time()
    main_text(f"<{tag}>" * 200_000 + f"<p>{STORY}</p>")
    assert time.time() - begin < 5


def test_labelled_pages(spark):
    """F1 of words over labelled pages of three hosts with menus, adverts, sidebars, comments and footers."""
    rng = random.Random(9)
    made = [labelled_page(rng, i) for i in range(150)]
    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_main.extract(df).collect()}
    both = want = found = 0
    for i, (_, text) in enumerate(made):
        a, b = Counter(got[i].split()), Counter(text.split())
        both, found, want = both + (a & b).total(), found + a.total(), want + b.total()
    assert 2 * both / (found + want) >= 0.99
    assert sum(got[i] == text for i, (_, text) in enumerate(made)) >= 145


def test_page_query(spark, sf_dir):
    from lectern.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op6_html_main(spark, sf_dir).collect()
    assert {r["page_id"] for r in got} == set(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "track(" not in r["text"] and "©" not in r["text"]


def test_long_page(spark):
    page = "<article>" + "<p>word &lt; word</p>" * 20_000
    df = spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")
    assert html_main.extract(df).collect()[0]["text"] == "\n".join(["word < word"] * 20_000)


ITEM = "The teacher said that Anna has 5 apples and gives 2 kg to Bob every day of the week."


def test_contamination(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "two words", "x"), (3, None, "x"), (1, ITEM, "x")], "item_id long, text string, doc_id string")
    same = ITEM.upper().replace(" ", "!! ")
    changed = "in class the teacher said that Maria has 17 apples and gives 9 lb to Peter every day of the week, yes"
    torn = "the teacher said that Maria has 17 apples and gives 17 lb to Peter Maria day of the month"
    rows = [(1, same), (2, changed), (3, torn), (4, None), (5, ""), (6, "nothing of the kind is in here at all"), (7, "Two words."), (8, "two words and more"), (None, ITEM), (9, "filler " * 30_000 + ITEM), (9, "filler " * 30_000 + ITEM)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], TEXT + ", item_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contamination(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 2), (9, 1)}
    assert got[2, 1]["n_reworded"] > 0 and got[1, 1]["n_reworded"] == 0
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "6", "8", "None"]
    assert decontaminate.contamination(docs, items.limit(0)).collect() == []
    assert decontaminate.contamination(docs.limit(0), items).collect() == []


def test_slots_must_be_consistent(spark):
    items = spark.createDataFrame([(1, "He paid 5 pounds for the book and 5 pounds for the lamp and left.")], "item_id long, text string")
    good, bad = "He paid 8 pounds for the book and 8 pounds for the lamp and left.", "He paid 8 pounds for the book and 9 pounds for the lamp and left."
    docs = spark.createDataFrame([(1, good), (2, bad)], TEXT)
    assert [r["doc_id"] for r in decontaminate.contamination(docs, items).collect()] == [1]


def test_contradicted_slot_spares_verbatim_windows(spark):
    """An item word for word but for one of two equal numbers: only the windows over that number are lost."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55)]
    words[10] = words[40] = "7"
    changed = [*words[:40], "8", *words[41:]]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame([(1, " ".join(changed))], TEXT), items).collect()
    assert [(r["n_windows"], r["n_matched"], r["n_reworded"]) for r in got] == [(51, 46, 0)]


def test_reworded_names_and_dense_windows(spark):
    """Names that open a sentence, and windows with few or no plain words, are re-parameterised like others."""
    names = "Tom has 12 red apples and 7 green pears. Anna gives him 5 more apples. How many fruits does Tom have now?"
    dense = "Add 2 kg 3 kg 5 kg of salt to 7 l 9 l 4 l of water"
    alone = "1 2 3 4 5 6 7"
    items = spark.createDataFrame([(1, names), (2, dense), (3, alone)], "item_id long, text string")
    docs = [
        (1, "Lena has 31 red apples and 4 green pears. Maria gives him 9 more apples. How many fruits does Lena have now?"),
        (2, "Well then, Lena has 31 red apples and 4 green pears. Maria gives him 9 more apples. How many fruits does Lena have now? Tell."),
        (3, "Lena has 31 red apples and 4 green pears. Maria gives him 9 more apples. How many fruits does Berta have now?"),
        (4, "add 12 lb 13 lb 15 lb of salt to 17 m 19 m 14 m of water"),
        (5, " ".join(str(k) for k in range(100, 400))),
        (6, "7 1 2 3 4 5 6 7 8"),
    ]
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"]) for r in decontaminate.contamination(spark.createDataFrame(docs, TEXT), items).collect()}
    assert got == {(1, 1): (18, 18), (2, 1): (18, 18), (4, 2): (14, 14), (6, 3): (3, 3)}


def test_contamination_query(spark, sf_dir):
    """Against a search for each item's bare words in each document's."""
    import re

    from lectern.llm import queries

    bare = lambda t: " " + " ".join(w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", x.lower()) for x in t.split()) if w) + " "
    docs = {r["doc_id"]: bare(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: bare(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, w in items.items() if w in t and len(w.split()) >= 5}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, sf_dir).collect()}
    assert whole <= got
    assert len(got - whole) <= 0.1 * len(got) + 1
