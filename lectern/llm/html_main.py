"""Main-text extraction from HTML by consensus host paths.

Every page's containers are scored by the text they hold; the best one is raised to the article around it, each
page votes for its generalised tag-class path (digits and ids removed), and Spark adds the votes up per host.  Pages are then read again
and the containers on the winning path of their host give the text; a page without one falls back to its own
best container.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, free_names, small_batches, stored

CONTAINERS = {"body", "main", "article", "section", "div", "td", "table", "center", "fieldset", "li", "dd", "blockquote", "figure", "details"}
#: Subtrees that never hold main text.
NEVER = {"nav", "footer", "aside", "form", "header", "button", "menu", "dialog", "select", "option"}
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head", "object", "canvas", "math", "audio", "video"}
#: Of these the rest of the page is content where the end is missing.
PLAIN = {"script", "style", "textarea", "title", "iframe"}
BLOCKS = CONTAINERS | NEVER | {"html", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "dt", "pre", "hr", "tr", "th", "tbody", "thead", "tfoot", "caption", "address", "figcaption", "summary", "hgroup"}
NESTING = CONTAINERS | NEVER
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of class and id names: what they mark goes, unless a word of GOOD marks it too; BAD always goes.
BAD = {
    "comment", "comments", "disqus", "reply", "replies", "respond", "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo",
    "kommentar", "kommentare", "commentaire", "commentaires", "comentario", "comentarios", "commenti", "reacties", "werbung", "anzeige", "anzeigen", "publicité", "publicite", "publicidad", "pubblicità", "reklame",
}
DOUBTFUL = {
    "nav", "navbar", "navigation", "menu", "menus", "footer", "header", "masthead", "sidebar", "aside", "widget", "widgets", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
    "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "search", "skip", "disclaimer", "form",
    "menü", "menú", "suche", "seitenleiste", "fußzeile", "kopfzeile", "hinweis", "teilen", "anmelden", "recherche", "partager", "connexion", "entête", "buscar", "compartir", "suscribirse", "relacionados",
}
GOOD = {"content", "article", "main", "story", "entry", "text", "body"}
#: Words that say nothing of what a part holds; a name with any other word beside a telling one is about that word as well.
PART = {
    "box", "block", "container", "wrapper", "wrap", "list", "item", "items", "area", "section", "panel", "row", "col", "column", "grid", "slot", "unit", "zone", "left", "right", "top", "bottom", "inner", "outer",
    "inline", "middle", "side", "page", "site", "post", "posts", "articles", "stories", "group", "bar", "link", "links", "button", "buttons", "icon", "icons", "module", "region", "holder", "title", "heading", "wide",
    "thread", "count", "media", "primary", "secondary", "global", "sticky", "fixed", "mobile", "desktop", "dropdown", "toggle", "results", "leave", "user", "reader", "readers", "third", "party", "google", "label",
}
#: Words that make a class a state of the page or article (has-sidebar, comments-open), not the name of a part.
STATE = {"has", "no", "not", "with", "without", "open", "closed", "enabled", "disabled"}
ARTICLES = {"article", "main"}

#: A tag ends at the first ``>`` outside quotes, or at the first one where a quote is never closed; an unquoted ``<``
#: gives it up, so that a page of unclosed tags takes time in proportion to its length.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>|<[!?][^<>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_WORDS = re.compile(r"[^\W\d_]+")
RAW_END = {tag: re.compile(rf"</{tag}\b[^<>]*+>?", re.I) for tag in RAW}
HEAD_END = re.compile(r"</head\b[^<>]*+>?|(?=<body\b)", re.I)


def _hidden(tag: str, attributes: dict[str, str], raw: str, in_article: bool) -> bool:
    """Whether a subtree goes whatever it holds; an article's own header stays."""
    if tag in NEVER and not (tag == "header" and in_article):
        return True
    if attributes.get("role", "").lower() in ROLES or re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", '""', raw)):
        return True
    return attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def _words(name: str) -> list[str]:
    return NAME_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _doubtful(name: list[str]) -> bool:
    """Whether a name is of a doubtful part: cookie-content is, entry-header, a part of the article, is not."""
    return next((w in DOUBTFUL for w in name if w in DOUBTFUL or w in GOOD), False)


def _unsure(name: list[str]) -> bool:
    """Whether a telling word stands beside words of another subject: ad-hoc-committee, share-price."""
    telling = BAD | DOUBTFUL
    return not telling.isdisjoint(name) and any(len(w) > 2 and w not in telling and w not in PART and w not in GOOD and w not in STATE for w in name)


def _marked(attributes: dict[str, str]) -> str:
    """What the class and id say of a subtree: "bad", "state" (bad in a state only), "doubtful", "unsure" (links decide) or
    nothing."""
    every = [_words(w) for w in (attributes.get("class", "") + " " + attributes.get("id", "")).split()]
    names = [w for w in every if not _unsure(w)]
    mark = _sure_mark(names)
    return mark or ("unsure" if len(names) < len(every) else "")


def _sure_mark(names: list[list[str]]) -> str:
    bad = [w for w in names if not BAD.isdisjoint(w)]
    if bad:
        return "bad" if any(STATE.isdisjoint(w) for w in bad) else "state"
    good = any(not GOOD.isdisjoint(w) and DOUBTFUL.isdisjoint(w) for w in names)
    return "doubtful" if not good and any(map(_doubtful, names)) else ""


class Page:
    """What one reading of a page found: blocks (container, text) in page order, and of each container its parent, its
    name (tag and classes), a hash of its path, and whether it holds an h1.  Container 0 is the page."""

    def __init__(self):
        self.blocks: list[tuple[int, str]] = []
        self.parents, self.names, self.hashes = [-1], [""], [path_hash("")]
        self.headings: set[int] = set()

    def add(self, parent: int, name: str) -> int:
        self.parents.append(parent)
        self.names.append(name)
        self.hashes.append(_step(self.hashes[parent], name))
        return len(self.parents) - 1

    def path(self, container: int) -> str:
        """The generalised path; only that of the voted container is ever written out."""
        parts = []
        while container > 0:
            parts.append(self.names[container])
            container = self.parents[container]
        return "".join("/" + x for x in reversed(parts))


def _step(above: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), above)


def path_hash(path: str) -> int:
    out = 0
    for name in path.split("/")[1:]:
        out = _step(out, name)
    return out


def parse(page: str) -> Page:
    """The page outside excluded subtrees.

    Class and id words exclude no article or main, and nothing that holds the page's article: a container with an
    article, main or most of the page's text, where no other article or main has more.  A name that joins such a word
    with another subject counts only where most of the text is links.  Where nothing is left, the doubtful words and then
    all words are ignored.
    """
    out, marks = _parse(page, frozenset())
    if not any(m[1] for m in marks):
        return out
    size, holds = [m[2] for m in marks], [m[3] for m in marks]
    for i in range(len(marks) - 1, 0, -1):
        size[marks[i][0]] += size[i]
        holds[marks[i][0]] |= holds[i]
    total, elsewhere = size[0], marks[0][4]
    links = [m[5] for m in marks]
    for i in range(len(marks) - 1, 0, -1):
        links[marks[i][0]] += links[i]
    spared = {i for i, m in enumerate(marks) if m[1] == "unsure" and 2 * links[i] < size[i]}
    spared |= {
        i
        for i, (_, mark, *_) in enumerate(marks)
        if mark and size[i] > elsewhere and (2 * size[i] > total if holds[i] and mark == "bad" else holds[i] or mark != "bad" and 2 * size[i] > total)
    }
    if spared:
        out, _ = _parse(page, spared)
    for ignored in ({"doubtful", "state", "unsure"}, {"doubtful", "state", "unsure", "bad"}):
        if not out.blocks:
            out, _ = _parse(page, spared | {i for i, m in enumerate(marks) if m[1] in ignored})
    return out


def _parse(page: str, spared) -> tuple[Page, list[list]]:
    """One reading of a page in which the nesting tags numbered in ``spared`` are not excluded by their words.

    The marks have a row (parent, mark, own characters, is an article that words do not exclude, characters of
    unexcluded articles, own characters in links) for each nesting tag, the first for the page, hidden subtrees apart.
    A tag whose content has no markup is void where its end is missing; a script or style then takes the rest.
    """
    out = Page()
    stack: list[tuple[str, int, bool, bool, int, bool]] = [("", 0, False, False, 0, False)]  # (tag, container, inside an excluded subtree, inside a hidden one, mark, inside an article)
    marks: list[list] = [[-1, "", 0, False, 0, 0.0]]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    endless: set[str] = set()
    at, n = 0, len(page)
    length, linked, link_at = 0, 0, -1  # characters of the parts, those in links, where an open link began

    def end_link(again: bool):
        nonlocal linked, link_at
        if link_at >= 0:
            linked += length - link_at
            link_at = length if again else -1

    def flush():
        nonlocal length, linked, link_at
        end_link(again=True)
        if parts:
            _, container, excluded, hidden, mark, in_article = stack[-1]
            if not hidden:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    marks[mark][2] += len(text)
                    marks[mark][5] += len(text) * linked / max(length, 1)
                    if not excluded:
                        out.blocks.append((container, text))
                        if in_article:
                            marks[0][4] += len(text)
            parts.clear()
        length, linked, link_at = 0, 0, min(link_at, 0)

    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            parts.append(page[at:])
            length += n - at
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
            length += found.start() - at
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(found[1])
        if tag in RAW:
            if not closing and tag not in endless and not found[3].rstrip().endswith("/"):
                end = (HEAD_END if tag == "head" else RAW_END[tag]).search(page, at)
                if end:
                    at = end.end()
                elif tag in PLAIN:
                    at = n
                else:
                    endless.add(tag)
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
                length += 1
            elif tag == "a":
                end_link(again=False)
                link_at = -1 if closing else length
            continue
        flush()
        if tag == "h1" and not closing and not stack[-1][2]:
            out.headings.add(stack[-1][1])
        if tag not in NESTING:
            continue
        if closing:
            if opened[tag]:
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
            continue
        if tag == "li" and stack[-1][0] == "li":
            stack.pop()
            opened["li"] -= 1
        if found[3].rstrip().endswith("/"):
            continue
        _, container, excluded, hidden, above, in_article = stack[-1]
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(found[3])}
        hidden = hidden or _hidden(tag, attributes, found[3], in_article)
        mark = "" if hidden or tag == "body" else _marked(attributes)
        article = tag in ARTICLES and not hidden
        marks.append([above, "" if article else mark, 0, article and mark != "bad", 0, 0.0])
        excluded = excluded or hidden or bool(marks[-1][1]) and len(marks) - 1 not in spared
        if tag in CONTAINERS and not excluded:
            names = ".".join(sorted({re.sub(r"[\d/]+", "", w) for w in attributes.get("class", "").split()} - {""}))
            container = out.add(container, f"{tag}{'.' + names if names else ''}")
        stack.append((tag, container, excluded, hidden, len(marks) - 1, in_article or tag in ARTICLES))
        opened[tag] += 1
    flush()
    return out, marks


def scores(blocks: list[tuple[int, str]], parents: list[int]) -> list[float]:
    """Characters of each container's own blocks, and half of those of its direct children."""
    own = [0.0] * len(parents)
    for container, text in blocks:
        own[container] += len(text)
    total = list(own)
    for c in range(1, len(parents)):
        total[parents[c]] += own[c] / 2
    return total


def main_container(page: Page) -> tuple[int, float]:
    """The article's container and its vote: the container with the best score, raised to what holds all of the article.

    That is the article around it, or a main of which it is most; without those, the smallest container with most of
    the page's text, or the one that adds the heading to it, if the text is still most of that one.
    """
    parents = page.parents
    points = scores(page.blocks, parents)
    best = max(range(len(points)), key=lambda c: (points[c], -c))
    size, headed = [0] * len(parents), [c in page.headings for c in range(len(parents))]
    for container, text in page.blocks:
        size[container] += len(text)
    for c in range(len(parents) - 1, 0, -1):
        size[parents[c]] += size[c]
        headed[parents[c]] |= headed[c]
    chain = [best]
    while parents[chain[-1]] >= 0:
        chain.append(parents[chain[-1]])
    tags = [page.names[c].split(".")[0] for c in chain]
    if "article" in tags:
        return chain[tags.index("article")], points[best]
    most = next((c for c in chain if 2 * size[c] > size[0]), best)
    if "main" in tags:
        main = chain[tags.index("main")]
        return (main if 2 * size[best] > size[main] or most in chain[chain.index(main) :] else most), points[best]
    titled = next((c for c in chain[chain.index(most) :] if headed[c]), most)
    return (titled if 2 * size[most] > size[titled] else most), points[best]


def text_of(page: Page, chosen: set[int]) -> str:
    inside = [False] * len(page.parents)
    for c, parent in enumerate(page.parents):
        inside[c] = c in chosen or (parent >= 0 and inside[parent])
    return "\n".join(text for container, text in page.blocks if inside[container])


def host_of(url) -> F.Column:
    """Host of a URL, lower-cased; '' for none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the generalised path that most characters of each host's pages vote for."""

    def vote(batches):
        for batch in batches:
            hosts, paths, votes = [], [], []
            for host, raw in zip(batch.column(0).to_pylist(), binary_column(batch.column(1)), strict=True):
                page = parse((raw or b"").decode())
                if page.blocks:
                    best, points = main_container(page)
                    hosts.append(host)
                    paths.append(page.path(best))
                    votes.append(points)
            yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()), "votes": pa.array(votes, pa.float64())})

    ballots = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, votes double")
    totals = ballots.groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(30,1)")).alias("votes"))
    return totals.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text`` (empty if there is none) of every row.

    Null html and url are empty; rows that repeat a page each give a row; pages without a host share one vote.  Ties of
    votes go to the path that sorts last.  A column of ``pages`` that is called text gives way; all others stay.
    The host table is written first, so that its size is known when the join is planned.
    """
    small_batches(pages.sparkSession)
    won, path, key = free_names(pages, "won_host", "won_path", "page_host")
    winners = stored(host_paths(pages), "host-paths").select(F.col("host").alias(won), F.col("path").alias(path))
    names = [c for c in pages.columns if c.lower() not in ("html", "text")]
    keyed = pages.select(*[F.col(f"`{c}`") for c in names], "html", host_of(F.col("url")).alias(key))
    joined = keyed.join(winners, F.col(key) == F.col(won), "left")

    @F.pandas_udf("string")
    def read(raw: pd.Series, path: pd.Series) -> pd.Series:
        out = []
        for source, want in zip(raw, path, strict=True):
            page = parse(source or "")
            wanted = path_hash(want) if want is not None else None
            chosen = {c for c, h in enumerate(page.hashes) if h == wanted}
            text = text_of(page, chosen) if chosen else ""
            if not text and page.blocks:
                text = text_of(page, {main_container(page)[0]})
            out.append(text)
        return pd.Series(out)

    return joined.select(*[F.col(f"`{c}`") for c in names], read("html", path).alias("text"))
