"""Main text of web pages: elements that recur across many pages of a host are site template.

Every page is parsed to elements; each element subtree outside the article gets a hash over
its tags, classes and text. Spark counts, per host, on how many different pages each hash
occurs, and subtrees that recur on many pages are deleted. Furniture that differs from page
to page (menus, adverts, forms, comments) is recognised by its tag, role or class. What is
left of the article (or of the body, where a page marks none) becomes blocks of text.

Copies of one page count once, so an article that a host publishes many times is not taken
for template. Inside ``<article>`` or ``<main>`` only containers with less than half of its text
can be template, counted over different articles; paragraphs, headings and the article stay.

Defined results: null html counts as empty and gives an empty text; a null or relative url
belongs to the host ''. Repeated rows give equal rows; an empty table gives an empty result;
broken markup is closed at the end of its parent. ``<br>`` is white space.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pixelstrata.llm.tables import stored

MIN_PAGES = 8  # a template occurs on at least so many different pages of its host
SMALL = 100_000  # hashes up to which the template table is sent to every task
SALTS = 16  # parts of the pages of a template in a join

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in "script style textarea title noscript iframe template".split()}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open element of the named kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
HOLDS = frozenset("ul ol dl table select article section div body html main td th blockquote".split())
ARTICLE = frozenset(("article", "main"))
BOXES = frozenset("address aside details div dl fieldset figure footer form header menu nav ol section table ul".split())
INSIDE = 0x2545F4914F6CDD1D  # sets the hashes of boxes in articles apart from those outside
FURNITURE_TAGS = frozenset("nav footer aside form head script style noscript template iframe svg canvas button select textarea object video audio dialog menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login sidebar menu navbar navigation nav breadcrumb breadcrumbs footer header masthead comment comments "
    "disqus discussion replies reply respond share sharing social related recommended recommendations widget widgets toolbar pagination pager skip".split()
)
WORD = re.compile(r"[A-Za-z]+")


class Page:
    """Elements and text of one page in page order."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#page"]
        self.attributes: list[str] = [""]
        self.parents: list[int] = [-1]
        self.events: list[tuple[int, object]] = []  # (0, text), (1, opened element), (2, closed element), (3, void tag)
        stack, at = [0], 0
        for m in iter(lambda: TOKEN.search(source, at), None):
            if m.start() > at:
                self.events.append((0, source[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if m["cdata"]:
                self.events.append((0, html.escape(m["cdata"])))
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                self._end(tag, stack)
                continue
            if tag in VOID:
                self.events.append((3, tag))
                continue
            self._make_room(tag, stack)
            self.tags.append(tag)
            self.attributes.append(m["attributes"].strip())
            self.parents.append(stack[-1])
            stack.append(len(self.tags) - 1)
            self.events.append((1, stack[-1]))
            if tag in RAW:
                end = RAW[tag].search(source, at)
                self.events.append((0, source[at : end.start()]))
                at = end.end()
                self.events.append((2, stack.pop()))
            elif m["attributes"].endswith("/") and tag not in BLOCK:
                self.events.append((2, stack.pop()))
        if at < len(source):
            self.events.append((0, source[at:]))
        while len(stack) > 1:
            self.events.append((2, stack.pop()))

    def _end(self, tag: str, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                while len(stack) > k:
                    self.events.append((2, stack.pop()))
                return
            if tag not in BLOCK and self.tags[stack[k]] in HOLDS:
                return  # a stray end tag of running text closes no container

    def _make_room(self, tag: str, stack: list[int]) -> None:
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        while ends:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = self.tags[stack[k]]
                if open_tag in ends:
                    while len(stack) > k:
                        self.events.append((2, stack.pop()))
                    break
                if open_tag in HOLDS:
                    return
            else:
                return

    def values(self, node: int) -> dict[str, str]:
        return {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(self.attributes[node])} if self.attributes[node] else {}

    def inside(self, kinds: frozenset) -> list[bool]:
        """Whether each element or one above it is of the kinds."""
        out = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            out[k] = out[self.parents[k]] or self.tags[k] in kinds
        return out

    def above(self, marked: list[bool]) -> list[bool]:
        """Whether something below each element is marked."""
        out = [False] * len(self.tags)
        for k in range(len(self.tags) - 1, 0, -1):
            if marked[k] or out[k]:
                out[self.parents[k]] = True
        return out

    def subtree_hashes(self) -> list[int]:
        """64 bits over tags, classes, ids and text of each element with all below it."""
        out, parts, current = [0] * len(self.tags), {0: []}, 0
        for kind, value in self.events:
            if kind == 1:
                own = self.values(value)
                parts[value] = [self.tags[value], own.get("class", ""), own.get("id", "")]
                current = value
            elif kind == 2:
                digest = hashlib.blake2b("\x1f".join(parts.pop(value)).encode("utf-8", "replace"), digest_size=8)
                out[value] = int.from_bytes(digest.digest(), "little", signed=True)
                current = self.parents[value]
                parts[current].append(digest.hexdigest())
            elif kind == 0:
                text = " ".join(value.split())
                if text:
                    parts[current].append(text)
            else:
                parts[current].append(value)
        return out

    def boxes(self) -> dict[int, int]:
        """Containers inside an article that hold less than half of its text, and that article."""
        root, size, node = [0] * len(self.tags), [0] * len(self.tags), 0
        for kind, value in self.events:
            if kind == 1:
                node = value
            elif kind == 2:
                node = self.parents[value]
            elif kind == 0:
                size[node] += len("".join(value.split()))
        for k in range(len(self.tags) - 1, 0, -1):
            size[self.parents[k]] += size[k]
        for k in range(1, len(self.tags)):
            root[k] = k if self.tags[k] in ARTICLE else root[self.parents[k]]
        holds = self.above([t in ARTICLE for t in self.tags])
        return {k: root[k] for k in range(1, len(self.tags)) if root[k] and self.tags[k] in BOXES and not holds[k] and 2 * size[k] < size[root[k]]}

    def furniture(self) -> list[bool]:
        """Elements whose tag, role, class, id or style says that they are no article text."""
        content = self.inside(ARTICLE)
        holds = self.above([t in ARTICLE for t in self.tags])
        out = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            tag = self.tags[k]
            if tag in FURNITURE_TAGS or tag == "header" and not content[k] and not holds[k]:
                out[k] = True
                continue
            if not self.attributes[k] or tag in ("html", "body", "main") or holds[k]:
                continue
            own = self.values(k)
            if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) or own.get("role", "") in FURNITURE_ROLES:
                out[k] = True
                continue
            words = {w.lower() for w in WORD.findall(own.get("class", "") + " " + own.get("id", ""))} & FURNITURE_WORDS
            out[k] = bool(words) and not (words == {"header"} and content[k])
        return out

    def blocks(self, dropped: list[bool], only: frozenset | None) -> list[str]:
        """Text of each block outside dropped elements (and inside elements of the kinds, if given)."""
        take = self.inside(only) if only else [True] * len(self.tags)
        out: list[str] = []
        piece: list[str] = []
        hidden, node = 0, 0

        def flush():
            text = " ".join(html.unescape("".join(piece)).split())
            if text:
                out.append(text)
            piece.clear()

        for kind, value in self.events:
            if kind == 1:
                node = value
                hidden += dropped[value]
                if self.tags[value] in BLOCK:
                    flush()
            elif kind == 2:
                if self.tags[value] in BLOCK:
                    flush()
                hidden -= dropped[value]
                node = self.parents[value]
            elif kind == 3:
                if value == "hr":
                    flush()
                elif value == "br":
                    piece.append(" ")
            elif not hidden and take[node]:
                piece.append(value)
        flush()
        return out


def template_candidates(page: Page) -> list[tuple[int, int | None]]:
    """Hashes of block elements of the body that neither are nor hold nor lie in the article, and of boxes in it with the hash of their article."""
    content = page.inside(ARTICLE)
    holds = page.above([t in ARTICLE for t in page.tags])
    outside = page.inside(frozenset(("head",)))
    hashes = page.subtree_hashes()
    inner = {(hashes[k] ^ INSIDE, hashes[root]) for k, root in page.boxes().items()}
    return list(inner | {(hashes[k], None) for k in range(1, len(page.tags)) if page.tags[k] in BLOCK and page.tags[k] not in ("html", "body") and not (content[k] or holds[k] or outside[k])})


def main_text(source: str, template: frozenset[int]) -> str:
    """The article of a page, blocks joined by an empty line."""
    if not source:
        return ""
    page = Page(source)
    dropped = page.furniture()
    if template:
        content, boxes = page.inside(ARTICLE), page.boxes()
        for k, h in enumerate(page.subtree_hashes()):
            if h in template and not content[k] or k in boxes and h ^ INSIDE in template:
                dropped[k] = True
    for only in (frozenset(("article",)), frozenset(("main",)), None):
        if only is None or any(t in only for t in page.tags):
            blocks = page.blocks(dropped, only)
            if blocks:
                return "\n\n".join(blocks)
    return ""


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _page_key(html: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(html), F.lit("")))


def subtrees(pages: DataFrame) -> DataFrame:
    """host, page, hash, unit: candidates of each page with the page, or the article around them, that counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, units = [], [], []
            keys = batch.column(1).to_pylist()
            for r, source in enumerate(batch.column(2).to_pylist()):
                for h, article in template_candidates(Page(source or "")):
                    at.append(r), found.append(h), units.append(keys[r] if article is None else article)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.int64()), pa.array(units, pa.int64())], names=["host", "page", "hash", "unit"])

    return pages.select(host_of("url").alias("host"), _page_key("html"), "html").mapInArrow(run, "host string, page bigint, hash bigint, unit bigint")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, hash: subtrees that recur on ``min_pages`` different pages of the host, however many it has."""
    counts = subtrees(pages).select("host", "hash", "unit").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_pages).select("host", "hash")


def _page_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """host, page, hashes: the templates that occur on each page."""
    every = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = subtrees(pages).select("host", "page", "hash").withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    return own.join(every, ["host", "hash", "salt"]).groupBy("host", "page").agg(F.collect_set("hash").alias("hashes"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html)``."""
    templates = stored(site_templates(pages, min_pages), "html-templates")
    kind = dict(pages.dtypes)["page_id"]
    keyed = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    by_host: dict[str, set[int]] = {}
    if templates.count() <= SMALL:
        for r in templates.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        joined = keyed.withColumn("hashes", F.lit(None).cast("array<bigint>"))
    else:
        found = stored(_page_templates(pages, templates), "html-page-templates")
        joined = keyed.withColumn("page", _page_key("html")).join(found, ["host", "page"], "left").select(*keyed.columns, "hashes")
    shared = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in by_host.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, none = shared.value, frozenset()
        for batch in batches:
            texts = []
            for source, host, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                own = frozenset(hashes.as_py()) if hashes.is_valid else known.get(host, none)
                texts.append(main_text(source or "", own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
