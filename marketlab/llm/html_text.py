"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its structural elements and text blocks, each with its
role (the path of block elements above it). Per host, a token's occurrence
vector holds its count on every page; the vector is carried as a sum of hashes
of (page, count), so it is aggregated with map-side combine and no page list is
built. Elements and texts with one vector form an equivalence class. A class of
more than one token, on ``TEXT_PAGES`` pages at least, with an element around
its other tokens is a layout: its texts nested in that element are template
text, and its ``article`` and ``main`` elements hold the article of its pages.
A host may have any number of layouts. A class whose texts are more than what
is left in the slots of its element is an article shown on several pages, no
layout. Text on nearly all pages of the host belongs to the host's own layout
also if its vector differs on a few pages. What is left in the slots is extracted:
of a page with ``article`` or ``main`` elements the text inside them, of any
other page all text, in the smallest element that holds it.

Containers of menus, forms, notices and the like are recognised by element and
by class, id or role words; inside articles by whole class names and ids only.
Ids of headings, sections and paragraphs are anchors and say nothing. Template text (the same block in the same role on
nearly all pages) is dropped outside ``article`` and ``main`` elements only, so
articles that quote each other keep their passages.

Defined results: null or empty html gives an empty text; a url without host is
a host of its own; a host with one page relies on roles alone; broken markup is
read as far as it goes; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marketlab.llm.common import stored

SUPPORT = 0.5  # share of the host's pages from which an element needs no layout
TEXT_SUPPORT, TEXT_PAGES = 0.9, 4  # share of the host's pages for text of its own layout; least pages of any layout
#: Element names by use.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
CHROME = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map label fieldset".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that may stand beside chrome words in a name inside an article ("share-buttons").
PLAIN_WORDS = frozenset("area bar block box button buttons container group icon icons inner item items link links list post posts section widgets wrap wrapper".split())
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 hgroup section p".split())  # their ids are link targets
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Block:
    role: str
    text: str
    chrome: bool
    inner: bool  # inside an article or main element
    above: tuple[str, ...]  # roles of the elements around it


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: dict[str, int] = field(default_factory=dict)


@lru_cache(maxsize=4096)
def _marks(attrs: str) -> tuple[tuple[str, ...], tuple[str, ...], str, str]:
    """Class names, ids, role, and a short name of the element's class."""
    classes, ids, role, name = [], [], "", ""
    for m in _MARKS.finditer(attrs):
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            role = value.strip()
        else:
            (classes if m[1].lower() == "class" else ids).extend(value.split())
            if m[1].lower() == "class":
                name = ".".join(value.split()).replace("/", ":")  # roles are cut at slashes
    return tuple(classes), tuple(ids), role, name


@lru_cache(maxsize=4096)
def _chrome(names: tuple[str, ...], inner: bool) -> bool:
    """Whether class names or ids speak of chrome: by any word, inside an article by all words of a name."""
    found = [frozenset(_WORD.findall(x)) for x in names]
    if inner:
        return any(x & CHROME_WORDS and x <= CHROME_WORDS | PLAIN_WORDS for x in found)
    words = frozenset().union(*found)
    return bool(words & CHROME_WORDS) or "header" in words


def parse(page: str) -> Page:
    """Blocks and structural elements of a page."""
    out = Page()
    stack: list[tuple[str, str, bool, bool]] = []  # tag, role path, chrome, inner
    text: list[str] = []

    def flush() -> None:
        s = " ".join("".join(text).split())
        text.clear()
        if s:
            _, role, chrome, inner = stack[-1] if stack else ("", "", False, False)
            out.blocks.append(Block(role, s, chrome, inner, tuple(x[1] for x in stack if x[0] in BLOCKS)))

    def close(tags: tuple[str, ...], barrier: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                if any(x[0] in BLOCKS for x in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            close((m[1].lower(),), frozenset({"table", "td", "th"}) if m[1].lower() not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "article", "main", "div", "section") else frozenset())
            continue
        tag, attrs = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        if not tag:
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            flush()
            close(("p",), BLOCKS - {"p"})
            if tag in CLOSES:
                close(CLOSES[tag], frozenset({"ul", "ol", "dl", "table"}))
        if tag in VOID:
            continue
        classes, ids, role, name = _marks(attrs)
        above = stack[-1] if stack else ("", "", False, False)
        inner = above[3] or tag in ("article", "main") or role == "main"
        chrome = above[2] or tag in CHROME or role in CHROME_ROLES or (tag == "header" and not above[3])
        if tag not in ("html", "body", "main") and not chrome:
            chrome = _chrome(classes if tag in ANCHORS else classes + ids, above[3])
        path = above[1]
        if tag in BLOCKS and tag not in ("p", "hr"):
            path = f"{above[1]}/{tag}" + (f".{name}" if name else "")
            out.elements[path] = out.elements.get(path, 0) + 1
        stack.append((tag, path, chrome, inner))
    flush()
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def key_of(role: str, text: str) -> int:
    """64-bit name of a text block in its role."""
    return int.from_bytes(hashlib.blake2b(f"{role}#{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, role, text, kind, n, chars): elements (kind 0, text 0) and text blocks outside articles (kind 1, text by name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, texts = (batch.column(c).to_pylist() for c in ("host", "page", "html"))
            cols: dict[str, list] = {k: [] for k in ("host", "page", "role", "text", "kind", "n", "chars")}
            for h, k, t in zip(hosts, keys, texts):
                p = parse(t or "")
                chars: dict[str, int] = {}
                same: dict[tuple[str, str], int] = {}
                for b in p.blocks:
                    if not b.chrome:
                        for role in set(b.above):
                            chars[role] = chars.get(role, 0) + len(b.text)
                        if not b.inner:
                            same[b.role, b.text] = same.get((b.role, b.text), 0) + 1
                rows = [(r, 0, 0, n, chars.get(r, 0)) for r, n in p.elements.items()] + [(r, key_of(r, x), 1, n, n * len(x)) for (r, x), n in same.items()] + [("", 0, 2, 1, 0)]
                for r, x, kind, n, c in rows:
                    for name, v in zip(cols, (h, k, r, x, kind, n, c)):
                        cols[name].append(v)
            yield pa.RecordBatch.from_pydict(cols, schema=pa.schema([("host", pa.string()), ("page", pa.int64()), ("role", pa.string()), ("text", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("chars", pa.int64())]))

    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, role string, text long, kind int, n int, chars long")


def templates(tokens: DataFrame) -> DataFrame:
    """Per host: mains (roles of its layouts' article elements) and fixed (names of template text)."""
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")
    per = tokens.groupBy("host", "kind", "role", "text").agg(vector, F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"))
    whole = per.where("kind = 2").select("host", F.col("pages").alias("all_pages"))
    per = per.where("kind < 2").join(whole, "host").withColumn("d", F.size(F.split("role", "/")))
    able = per.where((F.col("pages") >= TEXT_PAGES) | ((F.col("kind") == 0) & (F.col("pages") >= SUPPORT * F.col("all_pages"))))
    # one class per occurrence vector; its tokens are on the same pages, so a class is no longer than a page
    around = F.min(F.when(F.col("kind") == 0, F.struct("d", (-F.col("chars")).alias("c"), "role"))).alias("around")
    cls = able.groupBy("host", "vector").agg(F.collect_list(F.struct("kind", "role", "text", "most", "chars", "pages", "all_pages")).alias("tokens"), around)
    nests = lambda t: (t["kind"] == 1) & F.coalesce((t["role"] == F.col("around.role")) | t["role"].startswith(F.concat("around.role", F.lit("/"))), F.lit(False))
    own = F.aggregate(F.filter("tokens", nests), F.lit(0).cast("long"), lambda s, t: s + t["chars"])
    layout = (F.size("tokens") > 1) & F.col("around").isNotNull() & (F.get("tokens", F.lit(0))["pages"] >= TEXT_PAGES)
    cls = cls.withColumn("layout", layout).withColumn("slots", layout & (2 * own <= -F.col("around.c")))
    t = cls.withColumn("t", F.explode(F.transform("tokens", lambda t: t.withField("nests", nests(t))))).select("host", "layout", "slots", "t.*")
    here = F.col("pages") >= SUPPORT * F.col("all_pages")
    once = (F.col("kind") == 0) & (F.col("most") == 1) & (F.col("chars") > 0)
    semantic = once & F.element_at(F.split("role", "/"), -1).rlike("^(article|main)(\\.|$)") & (here | F.col("layout"))
    everywhere = (F.col("pages") >= TEXT_SUPPORT * F.col("all_pages")) & (F.col("all_pages") >= TEXT_PAGES)
    fixed = F.when((F.col("kind") == 1) & (everywhere | (F.col("slots") & F.col("nests"))), F.col("text"))
    return t.groupBy("host").agg(F.collect_list(F.when(semantic, F.col("role"))).alias("mains"), F.collect_list(fixed).alias("fixed"))


def shared(blocks: list[Block]) -> str | None:
    """Role of the smallest element around all blocks."""
    roles = None
    for b in blocks:
        roles = list(b.above) if roles is None else [x for x in roles if x in b.above]
    return roles[-1] if roles else None


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, host, main (role of the article's element), text, n_chars."""
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    # one row per host, written so that its size is known when the join is planned: pages of a hot host stay spread
    found = stored(templates(page_tokens(p.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html"))))
    q = p.join(found.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h"), "left").select("page_id", "url", "host", "html", "mains", "fixed")
    schema = f"page_id {p.schema['page_id'].dataType.simpleString()}, url string, host string, main string, text string"

    def slots(html_text: str, mains: list[str], fixed: list[int]) -> list[Block]:
        own = [b for b in parse(html_text).blocks if not b.chrome]
        articles = [b for b in own if b.inner]  # a page may mark its articles itself
        if articles:
            roles = set(mains)
            return [b for b in articles if not roles.isdisjoint(b.above)] or articles
        names = set(fixed)
        return [b for b in own if key_of(b.role, b.text) not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "mains", "fixed")))
            got = [slots(t or "", mains or [], fixed or []) for t, mains, fixed in rows]
            found = pa.array([shared(x) for x in got], pa.string()), pa.array(["\n".join(b.text for b in x) for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *found], names=["page_id", "url", "host", "main", "text"])

    out = q.select("page_id", "url", "host", "mains", "fixed", "html").mapInArrow(run, schema)
    return out.select("page_id", "url", "host", "main", "text", F.char_length("text").cast("long").alias("n_chars"))
