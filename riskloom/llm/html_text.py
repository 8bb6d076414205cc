"""Main text of web pages by removal of site templates.

Subtrees of elements are hashed with the page's host and counted in Spark; one that stands on many different pages of
a host is its template and is deleted. What a single page's structure names as no article (menus, footers, adverts,
forms, scripts, readers' comments) is deleted as well, since hosts of few pages have no recurring subtrees. Inside the
article a name alone deletes only containers of a whole class or id that can mean nothing else; on pages without an
article, containers whose class or id consists of such words. Slugs of titles have other words and delete nothing. Prose inside the article is counted only in containers of a class with a word that names no
article, so that copied articles keep their paragraphs.

The text is that of the article elements, else of the main element, else of what remains of the page. A null or empty
page has an empty text. A page without a host has no templates. Repeated rows are one page in the counts, and each
has its own result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage
from riskloom.llm.common import map_chunks, texts_of

# Different pages of a host on which a subtree stands to be a template.
MIN_PAGES = 5
# Template hashes that are sent to every task; more are joined to their pages.
SENT_HASHES = 2_000_000

# Elements and names of the markup language, and words by which sites name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp svg template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption dd dt head html legend li option tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption".split())
NO_ARTICLE = frozenset("head nav footer aside form button select menu dialog fieldset object applet audio video canvas".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer "
    "login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription widget widgets header masthead".split()
)
# Words that may stand beside those in a class or id that names no article, such as "main-nav" or "related-posts"; any
# other word makes it a title's slug or a name of its own, such as "share-prices".
BESIDE = frozenset(
    "site main page top bottom left right primary secondary global container wrapper wrap box area list block bar inner outer links link items item "
    "form buttons button icons icon unit slot thread posts articles stories mobile desktop overlay panel".split()
)

# Whole classes that name no article even inside one, whole ids that do, and elements that are never deleted there by name.
NO_TEXT_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle adsense ad-slot ad-container ad-wrapper ad-unit ad-banner banner-ad comment comments comment-list "
    "comments-area commentlist comment-form disqus disqus_thread share-bar sharebar share-buttons sharing-buttons social-share social-sharing sharedaddy "
    "newsletter newsletter-signup newsletter-form cookie-notice cookie-banner cookie-consent sidebar menu footer notice related-posts respond".split()
)
NO_TEXT_IDS = frozenset("comments comment-list disqus_thread respond sidebar footer comment-form newsletter-signup cookie-banner cookie-notice".split())
TEXT_TAGS = PROSE | {"hgroup", "header", "article", "main", "body", "html"}
_LINES = frozenset({"p", "li", "td", "blockquote"})

_OFF = NO_ARTICLE_NAMES | {":" + r for r in NO_ARTICLE_ROLES}
_REPLIES = frozenset("comment comments reply replies".split())
_NO_NAMES: tuple[frozenset[str], bool, frozenset[str], frozenset[str]] = (frozenset(), False, frozenset(), frozenset())
_UNENDED = ("<!--", "<![CDATA[")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/<>]*)", re.S,
)
_PLAIN = re.compile(r"""[^'"<>]*+""")
_UNQUOTED = re.compile(r"[^<>]*+")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_MARKS = re.compile(r"class|id|role|hidden|style", re.I)
_HOST = re.compile(r"\A\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _names(attributes: str) -> tuple[frozenset[str], bool, frozenset[str], frozenset[str]]:
    """Roles, marked by a colon; whether the element is hidden; its classes; its id."""
    if not _MARKS.search(attributes):
        return _NO_NAMES
    roles, hidden, classes, ids = set(), False, set(), set()
    for m in _NAMED.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            classes.update(value.split())
        elif key == "id":
            ids.update(value.split())
        elif key == "role":
            roles.update(":" + v for v in value.split())
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value == "true"
        elif re.search(r"display\s*:\s*none", value):
            hidden = True
    return frozenset(roles), hidden, frozenset(classes), frozenset(ids)


@lru_cache(maxsize=10_000)
def _names_no_article(name: str) -> bool:
    """Whether a whole class or id consists of words for what is no article, and of words that go with them."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in NO_ARTICLE_NAMES for w in words) and all(w in NO_ARTICLE_NAMES or w in BESIDE for w in words)


class Attributes:
    """Ends of tags, in time linear in the page: a quote that once led to no tag end is not followed again."""

    def __init__(self, html: str):
        self.html = html
        self.dead: set[int] = set()
        # By quote, where none is from here on.
        self.none: dict[str, int] = {}

    def end(self, at: int) -> int:
        """Where the ``>`` of a tag stands whose attributes begin here; -1 if it is no tag."""
        html, begin, passed = self.html, at, []
        while True:
            at = _PLAIN.match(html, at).end()
            sign = html[at : at + 1]
            if sign == ">":
                return at
            if sign not in ("'", '"') or at in self.dead:
                break
            passed.append(at)
            closing = -1 if at + 1 >= self.none.get(sign, len(html)) else html.find(sign, at + 1)
            if closing < 0:
                self.none[sign] = min(self.none.get(sign, len(html)), at + 1)
                break
            at = closing + 1
        self.dead.update(passed)
        # Quotes that are not closed are signs like any other.
        at = _UNQUOTED.match(html, begin).end()
        return at if html[at : at + 1] == ">" else -1


class Page:
    """Elements of a page in page order: tag, parent, begin, end, attributes; and its texts with their elements."""

    def __init__(self, html: str):
        self.html = html
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.attributes: list[str] = []
        # (element, text); None is the edge of a block.
        self.texts: list[tuple[int, str | None]] = []
        self._parse()

    def _parse(self) -> None:
        html, at, stack = self.html, 0, []
        size = len(html)
        # Open elements by tag, so that a tag that is not open costs no walk.
        opened: Counter[str] = Counter()
        attributes = Attributes(html)
        # Text since the last tag begins here.
        text = 0

        def close(depth: int, end: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                self.ends[i] = end
                opened[self.tags[i]] -= 1
                if self.tags[i] in BLOCK:
                    self.texts.append((i, None))

        def last(tags, stop) -> int | None:
            if not any(opened[t] for t in tags):
                return None
            for d in range(len(stack) - 1, -1, -1):
                tag = self.tags[stack[d]]
                if tag in tags:
                    return d
                if tag in stop:
                    return None
            return None

        # Behind the last sign that can end a tag there is only text, and perhaps a comment that does not end.
        last_end = html.rfind(">") + 1
        tail = size
        while at < last_end:
            m = _TAG.search(html, at, last_end)
            if not m:
                break
            end = m.end() - 1
            if m[0].startswith(_UNENDED) and not m[0].endswith("]]>" if m[0].startswith("<![") else "-->"):
                tail = m.start()
                break
            if m[2] and (end := attributes.end(m.end())) < 0:
                at = m.end()
                continue
            if m.start() > text:
                self.texts.append((stack[-1] if stack else -1, html[text : m.start()]))
            at = text = end + 1
            if m[1]:
                tag = m[1].lower()
                depth = last({tag}, () if tag in ("body", "html", "article", "main", "div", "section") else {"article", "main", "body"} - {tag})
                if depth is not None:
                    close(depth, at)
                elif tag in ("p", "br"):
                    self.texts.append((stack[-1] if stack else -1, None))
                continue
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in CLOSES_P and (depth := last({"p"}, {"button", "table", "article", "main", "body"})) is not None:
                close(depth, m.start())
            elif tag in SIBLINGS and (depth := last(*SIBLINGS[tag])) is not None:
                close(depth, m.start())
            if tag == "body" and (depth := last({"head"}, ())) is not None:
                close(depth, m.start())
            i = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1] if stack else -1)
            self.begins.append(m.start())
            self.ends.append(at)
            self.attributes.append(html[m.end() : end])
            if tag in BLOCK or tag == "br":
                self.texts.append((i, None))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9])[^>]*>", re.I).search(html, at)
                at = text = end.end() if end else size
                self.ends[i] = at
            elif tag not in VOID:
                stack.append(i)
                opened[tag] += 1
        tail = min([tail, *[k for k in (html.find(u, max(text, last_end)) for u in _UNENDED) if k >= 0]])
        if text < tail:
            self.texts.append((stack[-1] if stack else -1, html[text:tail]))
        close(0, size)

    def judge(self) -> None:
        """Which elements are articles, hold one, lie in one, and which the structure deletes."""
        n = len(self.tags)
        named = [_names(a) if a else _NO_NAMES for a in self.attributes]
        clear = [not c.isdisjoint(NO_TEXT_CLASSES) or not d.isdisjoint(NO_TEXT_IDS) for _, _, c, d in named]
        shut = [h or not r.isdisjoint(_OFF) for r, h, _, _ in named]
        # Inside an article only whole names that are clear delete, and neither text nor titles.
        strict = [x or self.tags[i] not in TEXT_TAGS and clear[i] for i, x in enumerate(shut)]
        # Outside, containers go by any name made of such words, and paragraphs by a clear class.
        off = [
            x or (any(map(_names_no_article, c | d)) if self.tags[i] not in TEXT_TAGS else self.tags[i] in _LINES and not c.isdisjoint(NO_TEXT_CLASSES))
            for i, (x, (_, _, c, d)) in enumerate(zip(shut, named))
        ]
        other = [s or not c.isdisjoint(NO_ARTICLE_NAMES) or any(x.startswith("comment-") for x in c) for (_, _, c, _), s in zip(named, strict)]
        articles = [i for i in range(n) if self.tags[i] == "article" and not other[i]]
        mains = [i for i in range(n) if (self.tags[i] == "main" or ":main" in named[i][0]) and not other[i]]
        self.holds = [False] * n
        self.roots = set(articles or mains)
        for i in self.roots:
            while i >= 0 and not self.holds[i]:
                self.holds[i], i = True, self.parents[i]
        self.inside = [False] * n
        self.gone = [False] * n
        self.prose = [t in PROSE for t in self.tags]
        for i, p in enumerate(self.parents):
            within = p >= 0 and self.inside[p]
            self.inside[i] = i in self.roots or within
            if self.holds[i]:
                continue
            tag = self.tags[i]
            if p >= 0 and self.gone[p] or tag in NO_ARTICLE or tag in RAW:
                self.gone[i] = True
            elif tag not in ("html", "body"):
                reader = tag == "article" and (not named[i][2].isdisjoint(_REPLIES) or any(x.startswith("comment-") for x in named[i][2]))
                self.gone[i] = strict[i] or reader if within else off[i] or tag == "header"
        # Named containers, which recurrence on the host deletes inside an article too.
        self.named = [self.tags[i] not in TEXT_TAGS and any(not NO_ARTICLE_NAMES.isdisjoint(x.split("-")) for x in c) for i, (_, _, c, _) in enumerate(named)]
        for i in range(n - 1, -1, -1):
            if self.prose[i] and self.parents[i] >= 0:
                self.prose[self.parents[i]] = True

    def candidates(self) -> list[int]:
        """Elements that may be a template: blocks that hold no article and, inside an article, no prose or a name."""
        return [
            i for i, t in enumerate(self.tags)
            if t in BLOCK and t not in ("html", "head", "body") and not self.holds[i] and not (self.inside[i] and self.prose[i] and not self.named[i])
            and not (t == "li" and self.parents[i] >= 0)
        ]

    def text(self, deleted: set[int]) -> str:
        gone = list(self.gone)
        for i, p in enumerate(self.parents):
            gone[i] = gone[i] or i in deleted or (p >= 0 and gone[p])
        keep = [not g and (x or not self.roots) for g, x in zip(gone, self.inside)]
        parts = [" " if t is None else unescape(t) if "&" in t else t for i, t in self.texts if (keep[i] if i >= 0 else not self.roots)]
        return " ".join("".join(parts).split())


def subtree_hashes(page: Page, host: str) -> list[int]:
    """Hash of host and markup of every candidate, as signed longs, in page order."""
    import xxhash

    out = []
    for i in page.candidates():
        digest = xxhash.xxh64_intdigest(f"{host}\0{page.html[page.begins[i] : page.ends[i]]}".encode("utf-8", "surrogatepass"))
        out.append(digest - (1 << 64) if digest >> 63 else digest)
    return out


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(subtree): hashes of subtrees on at least ``min_pages`` different pages of their host."""
    def make():
        import xxhash

        def work(chunk):
            subtrees, signs = [], []
            for url, html in zip(chunk.column("url").to_pylist(), texts_of(chunk.column("html"))):
                if host := host_of(url):
                    page = Page(html.decode())
                    page.judge()
                    found = set(subtree_hashes(page, host))
                    subtrees += found
                    signs += [xxhash.xxh64_intdigest(html) >> 1] * len(found)
            return {"subtree": pa.array(subtrees, pa.int64()), "page": pa.array(signs, pa.int64())}

        return work

    seen = map_chunks(pages.select(F.col("url").cast("string").alias("url"), "html"), "html", "subtree long, page long", make)
    return seen.distinct().groupBy("subtree").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages).select("subtree")


def _extracted(pages: DataFrame, known: Callable[[], Callable[[list[int], object], set[int]]]) -> DataFrame:
    def make():
        is_template = known()

        def work(chunk):
            texts = []
            own = chunk.column("__own").to_pylist() if "__own" in chunk.schema.names else [None] * chunk.num_rows
            for url, html, mine in zip(chunk.column("url").to_pylist(), texts_of(chunk.column("html")), own):
                page, host = Page(html.decode()), host_of(url)
                page.judge()
                deleted = set()
                if host:
                    hashes = subtree_hashes(page, host)
                    hit = is_template(hashes, mine)
                    deleted = {i for i, h in zip(page.candidates(), hashes) if h in hit}
                texts.append(page.text(deleted))
            return {"page_id": chunk.column("page_id"), "url": chunk.column("url"), "text": pa.array(texts, pa.string()), "n_chars": np.array([len(t) for t in texts], dtype=np.int64)}

        return work

    return map_chunks(pages, "html", "page_id long, url string, text string, n_chars long", make)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, sent_hashes: int = SENT_HASHES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    found = cut_lineage(templates(rows, min_pages))
    if found.count() <= sent_hashes:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in found.collect()], dtype=np.int64)))

        def known():
            table = sent.value

            def hit(hashes, _):
                if not hashes or not len(table):
                    return set()
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                return {h for h, t in zip(hashes, table[at].tolist()) if h == t}

            return hit

        return _extracted(rows, known)

    # More templates than a task may hold: each page gets those it has.
    def list_own():
        def work(chunk):
            keys, subtrees = [], []
            for key, url, html in zip(chunk.column("__key").to_pylist(), chunk.column("url").to_pylist(), texts_of(chunk.column("html"))):
                if host := host_of(url):
                    page = Page(html.decode())
                    page.judge()
                    own = set(subtree_hashes(page, host))
                    keys += [key] * len(own)
                    subtrees += own
            return {"__key": pa.array(keys, pa.int64()), "subtree": pa.array(subtrees, pa.int64())}

        return work

    keyed = rows.withColumn("__key", F.xxhash64("url", "html"))
    listed = map_chunks(keyed, "html", "__key long, subtree long", list_own).distinct()
    own = listed.join(found, "subtree").groupBy("__key").agg(F.collect_set("subtree").alias("__own"))
    return _extracted(keyed.join(own, "__key", "left").drop("__key"), lambda: lambda hashes, mine: set(mine or ()) & set(hashes))
