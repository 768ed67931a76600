"""Main text of web pages by removal of site templates.

Each page is parsed once into blocks of text, and each element's subtree gets a hash of
its tags and texts. Spark counts on how many pages of a host, different in what may be their main
text, each subtree occurs; copies of a page count once. Those that recur on LEAST_PAGES or more, however large the host, are the site's
template, and their blocks go. What markup itself names as no content (menus, forms, scripts, adverts,
comments, ...) goes as well.

If a page marks its article, only blocks in it stay, and what recurs there is mostly content: headings, cells of tables,
short sentences. So in an article a subtree is template only if it is a list of links, or if it stands in the same place, under
the same tags from the root on, on most of the host's different pages.

Defined results: null and empty html give empty text; pages without url or host have no site to share a
template with; broken and cut-off markup is read as far as it goes; time and memory grow in proportion to a page's
length, however deep it nests; repeated rows give equal texts; an empty table gives no rows; other columns of the input
are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_mart.llm.common import extended, in_slices, is_small, joined, schema_of, small, written

LEAST_PAGES = 4
LINKED = 0.7  # of a subtree's text, from which on it is a list of links; it has two at least
FEW = 2000  # templates of a host up to which they go to its pages
HEAVY = 20_000  # pages with one template from which on it goes to the pages

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # an opening tag ends these open elements, up to one of the fences
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"),
}
# Elements, roles and words of class names and ids that mark what is no main text.
NO_TEXT = frozenset(
    "head script style noscript template iframe object svg math canvas audio video map form button select input textarea datalist "
    "nav aside footer dialog menu search".split()
)
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NO_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond reply replies footer masthead topbar toolbar widget widgets login".split()
)
PAGE_HEADER = frozenset(["header", "masthead", "topbar"])  # these only outside the article

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Element:
    tag: str
    dropped: bool  # by its own markup
    article: int  # how deep in article elements
    number: int
    path: int  # a hash of the tags from the root on
    parts: list[str] = field(default_factory=list)
    length: int = 0
    linked: int = 0  # of its length, in links
    links: int = 0
    holds_article: bool = False


def attributes(rest: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest.rstrip(">"))}


def is_no_text(tag: str, rest: str, in_article: bool) -> bool:
    if tag in NO_TEXT or (tag == "header" and not in_article):
        return True
    if "=" not in rest and "hidden" not in rest or tag in ("html", "body"):
        return False
    own = attributes(rest)
    if "hidden" in own or own.get("role", "").lower() in NO_ROLE or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True
    names = {w.lower() for w in _NAME_WORD.findall(own.get("class", "") + " " + own.get("id", ""))}
    return bool(names & NO_NAME) or (not in_article and bool(names & PAGE_HEADER))


def is_article(tag: str, rest: str) -> bool:
    return tag == "article" or tag == "main" or "main" in rest and attributes(rest).get("role", "").lower() == "main" or "articleBody" in rest


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


class Page:
    """Blocks (text, number of the element they lie in, whether in the article); of each element the number of
    the one that it lies in, and the key by whose recurrence it is removed (None: never), by content or by place."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool]] = []
        self.up: list[int] = []
        self.keys: list[int | None] = []
        self.by_place: list[bool] = []
        self.text: list[str] = []
        self.stack = [Element("", False, 0, -1, 0)]
        self.depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
        self.block_depths = [0]
        at = 0
        while at < len(html):
            token = _TOKEN.search(html, at)
            end = token.start() if token else len(html)
            if end > at:
                self.add(html[at:end])
            if not token:
                break
            at = token.end()
            if tag := (token["tag"] or "").lower():
                if token["close"]:
                    self.close(tag)
                else:
                    self.open(tag, token["rest"])
                    if tag in RAW:
                        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                        at = found.end() if found else len(html)
                        self.close(tag)
            elif token[0].startswith("<![CDATA["):
                self.add(token[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        self.pop_to(1)
        self.end_block()

    def add(self, text: str) -> None:
        top = self.stack[-1]
        text = unescape(text) if "&" in text else text
        if not top.dropped:
            self.text.append(text)
        if small := " ".join(text.split()):
            top.parts.append(small)
            top.length += len(small)
            top.linked += len(small) if self.depths["a"] else 0

    def end_block(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                top = self.stack[-1]
                self.blocks.append((text, top.number, top.article > 0))
            self.text = []

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self.end_block()
            if self.depths["p"]:
                self.close_open(("p",), ("td", "th", "div", "button", "object", "article", "section", "blockquote", "li"))
        if tag in CLOSES:
            ended, fence = CLOSES[tag]
            while self.close_open(ended.split(), fence.split()):
                pass
        if tag in VOID:
            self.text.append(" ")
            return
        top = self.stack[-1]
        number = len(self.up)
        self.up.append(top.number)
        self.keys.append(None)
        self.by_place.append(False)
        dropped = top.dropped or is_no_text(tag, rest, top.article > 0)
        article = top.article + (not dropped and is_article(tag, rest))
        self.depths[tag].append(len(self.stack))
        if tag in BLOCK:
            self.block_depths.append(len(self.stack))
        self.stack.append(Element(tag, dropped, article, number, _hash(f"{top.path:x} {tag}")))

    def close_open(self, tags: list[str] | tuple[str, ...], fence: list[str] | tuple[str, ...]) -> bool:
        deepest = lambda names: max((self.depths[t][-1] for t in names if self.depths[t]), default=0)
        depth = deepest(tags)
        if depth == 0 or depth < deepest(fence):
            return False
        self.pop_to(depth)
        return True

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        depths = self.depths[tag]
        if not depths:
            if tag in ("br", "p"):
                self.text.append(" ")
        elif tag in BLOCK or self.block_depths[-1] <= depths[-1]:  # an inline end tag doesn't end blocks
            self.pop_to(depths[-1])

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def pop(self) -> None:
        if self.stack[-1].tag in BLOCK:
            self.end_block()
            self.block_depths.pop()
        own = self.stack.pop()
        self.depths[own.tag].pop()
        value = _hash(own.tag + "\0" + "\0".join(own.parts))
        links = own.links + (own.tag == "a")
        if own.length and not (own.dropped or own.holds_article or own.tag in ("html", "body")):
            self.by_place[own.number] = own.article > 0 and not (links >= 2 and own.linked >= LINKED * own.length)
            self.keys[own.number] = _hash(f"{own.path:x} {value:x}") if self.by_place[own.number] else value
        top = self.stack[-1]
        top.holds_article |= own.holds_article or own.article > top.article
        top.parts.append(f"{value:x}")
        top.length += own.length
        top.linked += own.linked
        top.links += links

    def found(self) -> tuple[list[str], list[int], list[int], list[int], list[int], list[int]]:
        """Texts of the blocks that may be main text; for each the last element around it that may be removed (-1: none);
        of those elements, each with a number above that of any around it, the next one around and the key; and the
        page's distinct keys by content and by place."""
        blocks = [b for b in self.blocks if b[2]] if any(b[2] for b in self.blocks) else self.blocks
        needed = [False] * len(self.up)
        for _, element, _ in blocks:
            while element >= 0 and not needed[element]:
                needed[element] = True
                element = self.up[element]
        near, up, keys = [-1] * len(self.up), [], []  # the element itself or the next around it that may be removed
        for element, above in enumerate(self.up):
            around = near[above] if above >= 0 else -1
            if needed[element] and self.keys[element] is not None:
                near[element] = len(up)
                up.append(around)
                keys.append(self.keys[element])
            else:
                near[element] = around
        at = [near[element] if element >= 0 else -1 for _, element, _ in blocks]
        of = [sorted({k for k, place in zip(self.keys, self.by_place) if k is not None and place == by}) for by in (False, True)]
        return [b[0] for b in blocks], at, up, keys, *of


def staying(texts: list[str], at: list[int], up: list[int], keys: list[int], gone: set[int]) -> list[str]:
    """The blocks that lie in no element whose key is gone."""
    removed = [False] * (len(up) + 1)  # the last is for -1
    for element, around in enumerate(up):
        removed[element] = keys[element] in gone or removed[around]
    return [text for text, element in zip(texts, at) if not removed[element]]


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url or "").hostname or "").lower() or None
    except ValueError:
        return None


_PARSED = "host string, texts array<string>, at array<int>, up array<int>, keys array<bigint>, contents array<bigint>, places array<bigint>, version bigint"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, and _PARSED) for each page; equal texts are one version."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4 << 20):
            found = [Page(h.as_py() or "").found() for h in batch.column("html")]
            texts, at, up, keys, contents, places = zip(*found)
            ints = lambda lists, kind: pa.array(lists, pa.list_(kind))
            yield extended(
                batch, ["page_id", "url"],
                host=pa.array([host_of(u.as_py()) for u in batch.column("url")], pa.string()),
                texts=pa.array(texts, pa.list_(pa.string())), at=ints(at, pa.int32()), up=ints(up, pa.int32()),
                keys=ints(keys, pa.int64()), contents=ints(contents, pa.int64()), places=ints(places, pa.int64()),
                version=pa.array([_hash("\n".join(t)) for t in texts], pa.int64()),
            )

    return pages.select("page_id", "url", "html").mapInArrow(parse, schema_of(pages, ["page_id", "url"], _PARSED))


def templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, key, pages) of the keys by content that occur on many different pages of the host, and of those by place that occur on
    many and on most, from rows (host, contents, places, version) of pages."""
    of_host = found.where("host is not null")
    named = lambda column, by: F.transform(column, lambda k: F.struct(k.alias("key"), F.lit(by).alias("by_place")))
    keys = F.explode(F.concat(named("contents", False), named("places", True))).alias("of")
    own = of_host.select("host", "version", keys).select("host", "version", "of.*").distinct()
    pages = of_host.select("host", "version").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    often = own.groupBy("host", "key", "by_place").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least_pages)
    most = joined(often, pages, ["host"]).where(~F.col("by_place") | (2 * F.col("pages") > F.col("_all")))
    return most.select("host", "key", "pages")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    If no host has more than FEW templates and all hosts' together are few, each page gets its
    host's; else the pages' keys meet them, those of HEAVY pages or more by going to all tasks while they are few.
    """
    found = written(parsed(pages).withColumn("_row", F.monotonically_increasing_id()), "pages")
    often = written(templates(found.select("host", "contents", "places", "version")), "templates")
    most = often.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    if most <= FEW and is_small(often):
        gone = F.broadcast(often.groupBy("host").agg(F.collect_set("key").alias("_all_gone")))
        both = joined(found, gone, ["host"], "left").withColumn("gone", F.array_intersect("keys", "_all_gone"))
    else:
        own = found.where("host is not null").select("_row", "host", F.explode(F.array_distinct("keys")).alias("key"))
        heavy = small(written(often.where(F.col("pages") >= HEAVY), "heavy"))
        met = [joined(own, t.select("host", "key"), ["host", "key"], "left_semi") for t in (heavy, often.where(F.col("pages") < HEAVY))]
        both = joined(found, met[0].unionByName(met[1]).groupBy("_row").agg(F.collect_set("key").alias("gone")), ["_row"], "left")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4 << 20):
            lists = [batch.column(c).to_pylist() for c in ("texts", "at", "up", "keys", "gone")]
            texts = ["\n".join(staying(*own, set(gone or ()))) for *own, gone in zip(*lists)]
            yield extended(batch, ["page_id", "url"], text=pa.array(texts, pa.string()))

    rows = both.select("page_id", "url", "texts", "at", "up", "keys", "gone")
    return rows.mapInArrow(resolve, schema_of(pages, ["page_id", "url"], "text string")).withColumn("n_chars", F.length("text").cast("long"))
