"""Main text of web pages by nearest-URL page differencing.

Pages stand in one total order of host, URL path, id, url and a hash of the page, so the nearest page by
path is a neighbour: of the one before and the one behind on the same host, the one that shares the longer
path prefix (ties: the one before). Both pages' text lines (blocks) are aligned by their longest common
subsequence. Shared lines are the site's template and are deleted; so are the lines of elements that are no
article by their tag or name (menus, adverts, forms, comments). A line of running text inside the article
itself stays even when the neighbour has it too, and a neighbour that leaves (almost) nothing of the page is
a mirror of it, not a template: the other neighbour is taken, or none.

The order is cut into ranges at keys of a hash-ordered sample, and the first and last page of each range
also travel to the range beside it. So every page meets its true neighbours and the result does not depend on
partitions. A range streams through its task, three pages at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.common import bounded_batches, stored, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
FORM_END = re.compile(r"</form\b", re.I)

# fixed values: elements and names
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "audio", "video", "title", "select", "annotation", "annotation-xml"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover", "munderover",
          "mtable", "mtr", "mtd", "mspace", "mpadded", "mphantom", "menclose", "semantics"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "caption"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
#: blocks of one line: they hold text but are no container
PLAIN = RUNNING - {"li", "blockquote", "td", "th", "dd"}
#: an element that ends where such a sibling begins
SIBLINGS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
NO_ARTICLE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head", "label", "legend", "output", "datalist"}
NO_ARTICLE_NAMES = {"nav", "navbar", "navigation", "menu", "footer", "sidebar", "aside", "notice", "notices", "cookie", "cookies", "consent", "banner", "ad", "ads",
                    "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "disqus", "respond", "reply",
                    "replies", "newsletter", "subscribe", "subscription", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs",
                    "popup", "modal", "form", "widget", "login", "signup", "search", "toolbar", "pagination", "pager", "contentinfo", "complementary", "alert"}
#: inside a sentence only these are no text: "comment" or "search" may mark words of the article
ADVERT_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent",
                "popup", "modal"}
HEADER_NAMES = {"header", "masthead", "topbar"}
#: a name of several words is one of the above where its other words only say which or where: "site-footer", not "no-footer"
AFFIXES = {"site", "page", "main", "top", "bottom", "left", "right", "center", "header", "body", "content", "area", "list", "item", "items", "section", "container",
           "wrapper", "wrap", "box", "block", "bar", "inner", "outer", "primary", "secondary", "global", "local", "user", "mobile", "desktop", "sticky", "fixed",
           "floating", "slot", "unit", "zone", "panel", "row", "col", "column", "group", "button", "buttons", "btn", "icon", "icons", "link", "links", "post", "posts",
           "article", "articles", "entry", "story", "text", "title", "heading", "thread", "count", "input", "field", "media", "js", "wp", "fb", "facebook", "google",
           "twitter", "dfp", "gdpr", "div", "the", "id", "my"}
LEAVES_OPEN = {"nav", "header", "footer", "ad", "form", "menu"}
ARTICLE_NAMES = {"articlebody", "main", "article", "content", "post", "entry", "story"}

DROPPED, BODY, NAMED, MAIN, ARTICLE = range(5)


#: a neighbour is a mirror if less than this part of the page's characters is its own
MIRROR = 1 / 50


class Line:
    __slots__ = ("place", "tag", "text")

    def __init__(self, text: str, place: int, tag: str):
        self.text, self.place, self.tag = text, place, tag


def _is(words: list[str], known: set[str]) -> bool:
    """A name, given as its words, is one of the known ones or such a one with affixes and numbers."""
    return any(x in known for x in words) and all(x in known or x in AFFIXES or x.isdigit() for x in words)


def _container(tag: str, attributes: str, place: int) -> tuple[int, str]:
    """Where the text of an element that opens inside ``place`` belongs, and what closes it early.

    An article, a main part or an element of an article's name is not dropped for its class or id."""
    names: set[str] = set()
    styles: list[list[str]] = []
    roles: list[list[str]] = []
    hidden = False
    if attributes:
        for key, *values in NAMES.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key in ("hidden", "aria-hidden"):
                hidden |= key == "hidden" or value == "true"
            else:
                got = [[x for x in SPLIT.split(name) if x] for name in value.split()]
                (styles if key in ("class", "id") else roles).extend(got)
                names.update(x for words in got for x in words)
    if tag in ("html", "body"):
        return place, ""
    if tag in INLINE:
        return (DROPPED if hidden or any(_is(x, ADVERT_NAMES) for x in styles + roles) else place), "ad"
    if tag in ("article", "main") or any(len(x) == 1 and x[0] in ARTICLE_NAMES for x in styles + roles):
        styles = []
    called = styles + roles
    if hidden or tag in NO_ARTICLE or any(_is(x, NO_ARTICLE_NAMES) for x in called):
        return DROPPED, tag if tag in LEAVES_OPEN else "ad" if names & {"ad", "ads", "advert", "banner"} else ""
    if place == DROPPED:
        return DROPPED, ""
    if tag in PLAIN:
        return place, ""
    if (tag == "header" or any(_is(x, HEADER_NAMES) for x in called)) and place < NAMED:
        return DROPPED, "header"
    if tag == "article":
        return ARTICLE, ""
    if tag == "main" or "main" in names and tag in ("div", "section"):
        return max(place, MAIN), ""
    if names & ARTICLE_NAMES:
        return max(place, NAMED), ""
    return place, ""


def lines(html: str) -> list[Line]:
    """The text blocks of a page in order, each with the container and the element it stands in."""
    out: list[Line] = []
    stack: list[tuple[str, int, str, bool]] = []  # tag, place, what closes it early, an inline element without text
    opened: Counter = Counter()
    place, tag_of, parts, at, size = BODY, "", [], 0, len(html)
    quiet, form_ends = 0, True

    def flush():
        nonlocal parts
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Line(text, place, tag_of))
            parts = []

    def push(tag: str, inside: int, early: str = "", silent: bool = False):
        nonlocal quiet
        stack.append((tag, inside, early, silent))
        opened[tag] += 1
        quiet += silent

    def cut(i: int):
        nonlocal quiet
        for tag, _, _, silent in stack[i:]:
            opened[tag] -= 1
            quiet -= silent
        del stack[i:]

    def stand():
        nonlocal place, tag_of
        place, tag_of = (stack[-1][1], stack[-1][0]) if stack else (BODY, "")

    def wraps() -> bool:
        """A form round at least half of the page's markup holds the page, not fields."""
        nonlocal form_ends
        end = FORM_END.search(html, at) if form_ends else None
        form_ends = end is not None
        return 2 * ((end.start() if end else size) - m.start()) >= size

    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            if not quiet:
                parts.append(html[at:])
            break
        if m.start() > at and not quiet:
            parts.append(html[at:m.start()])
        at = m.end()
        close, tag, attributes = m.groups()
        if tag is None:
            if m.group().startswith("<![CDATA[") and not quiet:
                parts.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in RAW:
            if not close and not m.group().endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            if not quiet:
                parts.append("\n")
            continue
        if tag in INLINE:
            if close:
                i = len(stack) - 1
                while i >= 0 and stack[i][3] and stack[i][0] != tag:
                    i -= 1
                if i >= 0 and stack[i][3]:
                    cut(i)
            elif tag not in VOID and (quiet or attributes and place != DROPPED and _container(tag, attributes, place)[0] == DROPPED):
                push(tag, place, "ad", True)
            continue
        flush()
        if tag in VOID:
            continue
        if close:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut(i)
        else:
            i = len(stack)  # a paragraph ends where a block begins
            while i and stack[i - 1][3]:
                i -= 1
            if i and stack[i - 1][0] == "p":
                cut(i - 1)
            if tag in ("article", "main"):  # an unclosed menu or advert ends here
                while stack and (stack[-1][1] == DROPPED or stack[-1][3]) and stack[-1][2]:
                    cut(len(stack) - 1)
            if stack and stack[-1][0] in SIBLINGS.get(tag, ()):
                cut(len(stack) - 1)
            stand()
            around = DROPPED if quiet else place
            if tag == "form" and wraps():
                push(tag, around)
            else:
                push(tag, *_container(tag, attributes, around))
        stand()
    flush()
    return out


def _rising(a: list[int], b: list[int]) -> list[int]:
    """Hunt-Szymanski: the longest rising run of matches, each line's matches taken from the last."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple | None] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    got, node = [], links[-1] if links else None
    while node:
        got.append(node[0])
        node = node[1]
    return got


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and each beginning of ``b``, by bit vectors: a
    zero bit is a place of ``b`` where the length grows."""
    masks: dict[int, bytearray] = {}
    for j, x in enumerate(b):
        masks.setdefault(x, bytearray((len(b) + 7) // 8))[j >> 3] |= 1 << (j & 7)
    ints = {x: int.from_bytes(m, "little") for x, m in masks.items() if x in set(a)}
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        hit = v & ints.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(a: list[str], b: list[str]) -> set[int]:
    """The positions in ``a`` of one longest common subsequence.

    Equal ends are set aside and lines of one page only cannot match. Few matches are walked one by one; many
    (long pages of equal lines) are halved at the middle of ``a``, where two bit-vector passes say how ``b``
    divides (Hirschberg), in memory linear in the lines."""
    ids: dict[str, int] = {}
    got: set[int] = set()
    work = [([(i, ids.setdefault(x, len(ids))) for i, x in enumerate(a)], [ids.setdefault(x, len(ids)) for x in b])]
    while work:
        left, right = work.pop()
        n, m = 0, min(len(left), len(right))
        while n < m and left[n][1] == right[n]:
            n += 1
        k = 0
        while k < m - n and left[-1 - k][1] == right[-1 - k]:
            k += 1
        got.update(i for i, _ in left[:n] + left[len(left) - k:])
        left, right = left[n:len(left) - k], right[n:len(right) - k]
        mine, other = Counter(x for _, x in left), Counter(right)
        matches = sum(mine[x] * other[x] for x in mine)
        if not matches:
            continue
        left, right = [(i, x) for i, x in left if x in other], [x for x in right if x in mine]
        if matches <= 50_000 or len(left) == 1:
            got.update(left[i][0] for i in _rising([x for _, x in left], right))
            continue
        half = len(left) // 2
        head, tail = [x for _, x in left[:half]], [x for _, x in left[half:]]
        at = int(np.argmax(_lengths(head, right) + _lengths(tail[::-1], right[::-1])[::-1]))
        work += [(left[:half], right[:at]), (left[half:], right[at:])]
    return got


def main_text(page: list[Line], *nearest: list[Line] | None) -> str:
    """The page's article: the lines of its innermost kind of container and the prose of the containers
    around it; without any container, of the body. Lines shared with the nearest page are deleted, but for
    running text of the innermost container. ``nearest`` are the neighbours, the nearer one first."""
    best = max((x.place for x in page), default=DROPPED)
    if best == DROPPED:
        return ""
    own = [i for i, x in enumerate(page) if x.place == best or BODY < x.place < best and x.tag in PROSE]
    size = sum(len(page[i].text) for i in own)
    for other in nearest:
        if other:
            shared = common_subsequence([x.text for x in page], [x.text for x in other])
            left = [i for i in own if i not in shared or best > BODY and page[i].place == best and page[i].tag in RUNNING]
            if sum(len(page[i].text) for i in left) >= MIRROR * size:
                own = left
                break
    return "\n\n".join(page[i].text for i in own)


def _nearest(path: str, before: str | None, behind: str | None) -> int:
    """-1 for the page before, 1 for the one behind, 0 for none."""
    def prefix(other):
        n = 0
        for x, y in zip(path, other):
            if x != y:
                break
            n += 1
        return n

    if before is None:
        return 0 if behind is None else 1
    return 1 if behind is not None and prefix(behind) > prefix(before) else -1


def _difference(batches) -> Iterator[pa.RecordBatch]:
    def pages():
        for batch in batches:
            for part, guest, host, path, page_id, url, html in zip(*[batch.column(i) for i in range(7)]):
                yield (part.as_py(), host.as_py()), path.as_py(), page_id.as_py(), url.as_py(), lines(html.as_py() or ""), guest.as_py()

    def extract(before, page, behind):
        before, behind = (x if x and x[0] == page[0] else None for x in (before, behind))
        sides = [x[4] if x else None for x in (before, behind)]
        if _nearest(page[1], before[1] if before else None, behind[1] if behind else None) > 0:
            sides.reverse()
        return page[2], page[3], main_text(page[4], *sides)

    def rows():
        before = page = None
        for behind in pages():
            if page and not page[5]:
                yield extract(before, page, behind)
            before, page = page, behind
        if page and not page[5]:
            yield extract(before, page, None)

    out: list = []
    for row in rows():
        out.append(row)
        if len(out) == 500:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    ids, urls, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _homes(keys: DataFrame, parts: int):
    """A function from keys to the ranges that they travel to: their own, and the one beside it for the first
    and the last key of a range. The driver holds a few sampled keys and two end keys for each range."""
    sampled = keys.orderBy(F.xxhash64("key")).limit(min(20 * parts, 100_000)).select(F.substring("key", 1, 512).alias("key"))
    points = sorted(r["key"] for r in sampled.collect())
    cuts = [points[i * len(points) // parts] for i in range(1, parts)] if points else []

    @F.pandas_udf("int")
    def home(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(cuts, k)).astype("int32")

    ends = sorted(map(tuple, keys.groupBy(home("key").alias("part")).agg(F.min("key"), F.max("key")).collect()))
    guests: dict[str, list[int]] = {}
    for (part, _, last), (behind, first, _) in zip(ends, ends[1:]):
        guests.setdefault(last, []).append(behind)
        guests.setdefault(first, []).append(part)

    @F.pandas_udf("array<int>")
    def homes(key: pd.Series) -> pd.Series:
        return key.map(lambda k: [bisect_right(cuts, k), *guests.get(k, ())])

    return homes


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html); other columns are not read.

    Null and empty pages give an empty text. A null url has no host and pairs with others of that
    kind. Rows that repeat are pages like any other, mirrors of each other; an empty table gives no rows. Whole
    copies of one row stand in one range."""
    spark = pages.sparkSession
    bounded_batches(spark)
    url = F.coalesce(F.col("url"), F.lit(""))
    placed = pages.select(
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col("page_id").cast("long").alias("page_id"), "url", "html")
    number = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, " ")
    placed = placed.withColumn("key", F.concat_ws("\0", "host", "path", number, url, F.hex(F.xxhash64("html"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = _homes(stored(placed.select("key"), "page-keys"), parts)
    sent = placed.withColumn("homes", homes("key")).select(F.posexplode("homes").alias("turn", "part"), "*")
    sent = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key")
    sent = sent.select("part", (F.col("turn") > 0).alias("guest"), "host", "path", "page_id", "url", "html")
    texts = sent.mapInArrow(_difference, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op2_nearest_url_main_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
