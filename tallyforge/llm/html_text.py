"""HTML extraction by site template removal.

Pass one parses each page into text blocks and hashes element subtrees in two ways: by all that they hold, and, for
elements beside an article, by their place in the page (the tags, classes and ids from the root down), as a menu or an advert
stands in the same place of a site's template with other words on each page. Spark counts, for each host and hash, on how many
different pages it stands. Subtrees that recur on many pages of a host are deleted; this decides first. Of what is left, forms, scripts, comments and what else a
page itself marks as no main text goes by tags and marks. A page from which nothing recurring was deleted, such as one of a small host,
falls back to its article, if that holds the bulk of its text. Headings, paragraphs and list items of an article, or of a page
without one, are never deleted for recurring by themselves, nor lists and tables within an article: passages that several pages share are text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, ship, utf8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select canvas audio video noframes".split())
#: Elements that hold no main text wherever they stand.
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset".split()) | RAW
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("br td th wbr img".split())
ARTICLE = frozenset(["article", "main"])
#: Elements that are text: they are kept though they recur. So are, within an article, those that hold such text together.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption tr td th caption".split())
GROUPS = frozenset("ul ol dl figure table tbody thead tfoot".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
#: Words of a class, id or role that mark what isn't main text.
MARK = re.compile(r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|header|masthead|footer|foot|cookies?|consent|notices?|alerts?|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|share|sharing|social|related|recommend\w*|widget\w*|comments?|replies|disqus|respond|pagination|pager|skip|toolbar|complementary|navigation|contentinfo|form", re.I)
#: A name that begins or ends so tells of the page around a marked part, or of a part of an article, not of the part itself.
AROUND = frozenset("has no with without is not wrap wrapper container layout page body content main inner outer grid row".split())
HEADS = frozenset("header footer head foot".split())
OF_ARTICLE = frozenset("entry article post story title section".split())


def is_mark(value: str, inside: bool) -> bool:
    """Whether one of the names in a class, id or role marks an element; ``inside`` an article a header or footer is part of it."""
    for name in value.split():
        words = [w for w in re.split("[-_]+", name.lower()) if w]
        if len(words) > 1 and (words[0] in AROUND or words[-1] in AROUND):
            continue
        heads = inside or bool(words) and words[0] in OF_ARTICLE
        if any(MARK.fullmatch(w) and not (heads and w in HEADS) for w in words):
            return True
    return False


TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
#: What marks an advert also in the middle of a line of text.
INLINE_MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKING = frozenset(["class", "id", "role"])
NUMBER = re.compile(r"\d+")
MIN_PAGES = 5


class Node:
    __slots__ = ("tag", "dropped", "marked", "inside", "holds", "first", "parts", "before", "place")

    def __init__(self, tag: str, dropped: bool, marked: bool, inside: bool, first: int, place: str) -> None:
        self.tag, self.dropped, self.marked, self.inside, self.first, self.place = tag, dropped, marked, inside, first, place
        self.holds = tag in ARTICLE  # an article
        self.parts: list[bytes] = []
        self.before: list[str] | None = None  # the text of the line up to here, if this is dropped from a line


class Page:
    """Blocks of text in order, which of them tags and marks leave, and the subtrees that may be deleted: (hash, first block,
    block after the last)."""

    def __init__(self, source: str) -> None:
        self.blocks: list[str] = []
        self.kept: list[bool] = []
        self.within: list[bool] = []  # an article
        self.subtrees: list[tuple[int, int, int]] = []
        self._marks: list[tuple[int, int]] = []
        self._beside: list[tuple[int, int, str]] = []
        self._text: list[str] = []
        self._stack = [Node("", False, False, False, 0, "")]
        self.article = False
        self._parse(source)
        self._flush()
        while len(self._stack) > 1:
            self._close()
        self.digest = _hash(b"".join(self._stack[0].parts))
        half = sum(len(b) for b, k in zip(self.blocks, self.kept) if k) / 2
        for first, past in self._marks:
            if sum(len(b) for b, k in zip(self.blocks[first:past], self.kept[first:past]) if k) <= half:  # else it is the page
                self.kept[first:past] = [False] * (past - first)
        if self.article:  # the places beside it, the outermost of those that nest
            reached = 0
            for first, past, place in sorted(self._beside, key=lambda x: (x[0], -x[1])):
                if past > reached:
                    self.subtrees.append((_hash(b"place" + place.encode("utf-8", "surrogatepass")), first, past))
                    reached = past

    def wanted(self, gone: frozenset[int] | set[int] = frozenset()) -> list[tuple[int, str]]:
        """The blocks of main text, by their numbers, after the blocks ``gone`` were deleted for recurring."""
        left = [i for i, k in enumerate(self.kept) if k and i not in gone]
        if self.article and not gone:
            inside = [i for i in left if self.within[i]]
            if 2 * sum(len(self.blocks[i]) for i in inside) >= sum(len(self.blocks[i]) for i in left):
                left = inside
        return [(i, self.blocks[i]) for i in left]

    def _parse(self, source: str) -> None:
        at, n, lower = 0, len(source), None
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text.append(source[at:])
                return
            if lt > at:
                self._text.append(source[at:lt])
            c = source[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                if source.startswith("<!--", lt):
                    end = source.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
            elif c.isalpha() or c == "/" and source[lt + 2 : lt + 3].isalpha():
                m = TAG.match(source, lt)
                if m is None:  # a quote without its other half
                    end = source.find(">", lt)
                    if end < 0:
                        return
                    m = TAG.match(re.sub("[\"']", " ", source[lt : end + 1]))
                    at = end + 1
                    if m is None:
                        continue
                else:
                    at = m.end()
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                elif tag in RAW and not m[3].rstrip().endswith("/"):
                    if lower is None:
                        lower = source.lower() if len(source.lower()) == n else source
                    end = lower.find("</" + tag, at)
                    stop = source.find(">", end) if end >= 0 else -1
                    at = n if stop < 0 else stop + 1
                else:
                    self._start(tag, m[3])
            else:
                self._text.append("<")
                at = lt + 1

    def _start(self, tag: str, rest: str) -> None:
        if tag in SPACED:
            self._text.append(" ")
        block = tag in BLOCKS
        if block:
            self._flush()
            self._imply("p", ())
        if tag in CLOSES:
            for t in CLOSES[tag]:
                self._imply(t, LIMITS[tag])
        if tag in VOID:
            return
        top = self._stack[-1]
        dropped = top.dropped or tag in DROPPED or tag == "header" and not top.inside
        marked, names = False, tag
        if rest and tag not in ("html", "body"):
            for m in ATTRIBUTE.finditer(rest):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in MARKING and block:
                    names += f".{NUMBER.sub('#', value)}"
                if dropped or tag in ARTICLE:
                    continue
                if name == "hidden" or block and name == "aria-hidden" and value == "true":
                    dropped = True
                elif name in MARKING:
                    if block:
                        marked |= is_mark(value, top.inside)
                    else:
                        dropped = INLINE_MARKS.search(value) is not None
        if tag in ARTICLE and not dropped:
            self.article = True
        node = Node(tag, dropped, marked, top.inside or tag in ARTICLE, len(self.blocks), f"{top.place}>{names}" if block else top.place)
        if dropped and not top.dropped and not block:
            node.before, self._text = self._text, []
        self._stack.append(node)

    def _imply(self, tag: str, limits: tuple[str, ...]) -> None:
        """Closes an open ``tag`` that a start tag ends, if no element stands between that shields it."""
        for i in range(len(self._stack) - 1, 0, -1):
            t = self._stack[i].tag
            if t == tag:
                if tag in BLOCKS:
                    self._flush()
                while len(self._stack) > i:
                    self._close()
                return
            if t in limits or t in BLOCKS and not limits or t == "td" and tag == "p":
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag in SPACED:
            self._text.append(" ")
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                while len(self._stack) > i:
                    self._close()
                return
            if tag not in BLOCKS and self._stack[i].tag in BLOCKS:
                return

    def _close(self) -> None:
        node = self._stack[-1]
        if node.tag in BLOCKS:
            self._flush()
        elif node.before is not None:
            self._text = node.before
        self._stack.pop()
        up = self._stack[-1]
        own = _hash(node.tag.encode("utf-8", "surrogatepass") + b">" + b"".join(node.parts))
        up.parts.append(own.to_bytes(8, "little", signed=True))
        up.holds |= node.holds
        past = len(self.blocks)
        if node.tag not in BLOCKS or node.holds or node.tag in ("html", "body") or past == node.first:
            return
        if node.marked:
            self._marks.append((node.first, past))
        if not node.inside:
            self._beside.append((node.first, past, node.place))
        if node.tag not in TEXT and not (node.inside and node.tag in GROUPS):
            self.subtrees.append((own, node.first, past))

    def _flush(self) -> None:
        if self._text:
            text = "".join(self._text)
            self._text.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                top = self._stack[-1]
                self.blocks.append(text)
                self.kept.append(not top.dropped)
                self.within.append(top.inside)
                top.parts.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


SUBTREES = pa.schema([("row_hash", pa.int64()), ("host", pa.string()), ("page", pa.int64()), ("subtree", pa.int64()), ("first", pa.int32()), ("past", pa.int32())])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = utf8(batch.column("html"))
        keys, hosts = batch.column("row_hash").to_pylist(), batch.column("host").to_pylist()
        for a, b in pieces(offsets, 2 << 20):
            rows = []
            for i, source in enumerate(batch.column("html").slice(a, b - a).to_pylist(), a):
                page = Page(source or "")
                rows += [(keys[i], hosts[i], page.digest, *s) for s in page.subtrees]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SUBTREES)], schema=SUBTREES)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages with their html compressed, for the shuffle that brings a page and its deletions together."""
    for batch in batches:
        _, offsets = utf8(batch.column("html"))
        for a, b in pieces(offsets, 2 << 20):
            part = batch.slice(a, b - a)
            html = pa.array([zlib.compress((t or "").encode(), 1) for t in part.column("html").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("row_hash"), html], ["page_id", "url", "row_hash", "html"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part, texts, sizes, removed = batch.slice(a, 256), [], [], []
            for source, gone in zip(part.column("html"), part.column("gone").to_pylist()):
                page = Page(zlib.decompress(source.as_py()).decode())
                out = {i for g in gone or () for i in range(g["first"], g["past"])}
                text = "\n\n".join(t for _, t in page.wanted(out))
                texts.append(text.encode("utf-8", "replace").decode())
                sizes.append(len(text))
                removed.append(len(out))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_chars", "n_removed"])


def recurring_subtrees(subtrees: DataFrame, pages: DataFrame, min_pages: int) -> DataFrame:
    """(host, subtree) of subtrees that stand on ``min_pages`` different pages of a host or more, and on twice the binary logarithm of
    the number of its pages: a section's template is found on a large host too.

    Pages of equal content count once. The pairs of subtree and page are made distinct before they are counted, so a host
    with a third of all pages is dealt out by subtree.
    """
    seen = subtrees.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    size = pages.groupBy("host").agg(F.count("*").alias("of_host"))
    return seen.join(size, "host").filter(F.col("n") >= F.floor(2 * F.log2("of_host"))).select("host", "subtree")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed), a row for each row of ``pages``; text is empty if a page has none. n_removed counts the blocks of
    text that were deleted because their subtree recurs on the host.

    A null html counts as empty, a null url as a host of its own. A page without an article or main element gives all its
    body but for what recurs or is marked. Repeated rows are kept. Columns beyond the three named are ignored.
    """
    ship(pages.sparkSession)
    url = F.col(url_col)
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    # rows with the same hash hold the same page, so it names a row well enough to delete by
    source = source.withColumn("row_hash", F.xxhash64("html", "host"))
    # read twice below, and small beside the pages: kept, so that each page is parsed once for it
    subtrees = cut(source.select("row_hash", "host", "html").mapInArrow(_subtrees, "row_hash long, host string, page long, subtree long, first int, past int"))
    recurring = recurring_subtrees(subtrees, source, min_pages)
    gone = subtrees.select("row_hash", "host", "subtree", "first", "past").distinct().join(recurring, ["host", "subtree"], "left_semi")
    gone = gone.groupBy("row_hash").agg(F.collect_list(F.struct("first", "past")).alias("gone"))
    packed = source.select("page_id", "url", "row_hash", "html").mapInArrow(_packed, "page_id long, url string, row_hash long, html binary")
    return packed.join(gone, "row_hash", "left").select("page_id", "url", "html", "gone").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_removed long")
