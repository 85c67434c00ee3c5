"""HTML extraction by wrapper induction.

Pages of one host are aligned in pairs by simple tree matching of their DOM trees.  Aligned lines of text that
agree vote for "template", others for "slot"; votes are counted in Spark by host, node path and text.  What most
alignments of a host agree on is its template.  The varying slots show where the content is: the deepest container standing once a page that holds most of a host's varying text outside links,
with every other such container that holds a good part of it, is the host's content region; an article or main element around one is content as a whole.  A page's text is what the region holds, with the title
above it.  Template is dropped wherever it stands, but for the region's headings: those recur because articles do.

Markup decides only where alignment can't: inside the region it leaves out menus, forms, adverts, notices and
comments, which vary like content does; on hosts without a region it stands in for it (article or main element,
else body without headers, footers and sidebars).

Pages of a host are dealt into groups of about 64 by a hash of page_id, and a page is aligned with the one before it
in its group, so neither partitions nor batches change a vote, and a host with a third of all pages is spread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions
from .words import slices

#: Elements by what they are
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("head script style noscript template iframe object svg math canvas audio video button select option textarea title".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
MAIN = frozenset("article main".split())
#: Elements that hold other blocks; only these are regions, and only these are marked by their names
HOLDS = frozenset("article aside blockquote body details div dl fieldset figure footer form header html main nav ol section table tbody td tr ul".split())
#: Words of class, id and role names that mark what is not the article
BOILER = frozenset("""
ad ads adv advert adverts advertisement advertising banner promo promotion promoted sponsor sponsored
nav navbar navigation menu menus breadcrumb breadcrumbs toolbar tabs pagination pager
footer foot copyright sidebar side aside rail widget widgets related recommended recommendations
notice notices alert cookie cookies consent gdpr popup modal overlay subscribe subscription newsletter signup login
comment comments respond reply replies discussion disqus share sharing social
form search searchbox contentinfo complementary
""".split())
#: Those of them that also name parts of articles: what bears no other is dropped only where it is little prose
WEAK = frozenset("form search discussion related recommended share sharing social side aside rail tabs reply respond alert notice notices promotion".split())
#: Characters outside links from which a block with a weak name is prose
PROSE = 120
#: Words that say nothing beside those of BOILER
FILLER = frozenset("area bar block bottom box container content div holder inner item items left links list main outer page panel post posts right section site slot small top unit wrap wrapper".split())
#: Names of page headers, which count outside an article only
HEADS = frozenset("header masthead head pageheader siteheader".split())
#: Elements that a start tag closes if they are open as its siblings' last
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Bytes of what all hosts need up to which it is broadcast; beyond, it is joined by shuffle, in SALTS parts a host
BROADCAST_LIMIT, SALTS = 8 << 20, 16
#: Pages of a group, about
GROUP = 64
#: Bits of the table of one alignment; longer lists are halved first, with the same result
_TABLE = 1 << 26
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none")
KEEP, HEAD, MAYBE, DROP = range(4)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _long(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)


class Line:
    """A run of text inside one block element: its text, the characters of it inside links, and its vote's key."""

    __slots__ = ("text", "linked", "key")
    shape = 0

    def __init__(self, text: str, linked: int, path: int):
        self.text, self.linked = text, linked
        self.key = _long(b"%d %s" % (path, text.encode("utf-8", "surrogatepass")))


class Node:
    """A block element: its tag, shape (tag and class names, long numbers in them as one), path (shapes from the root), mark, and its blocks and lines in order."""

    __slots__ = ("tag", "shape", "path", "mark", "parent", "depth", "kids", "key")

    def __init__(self, tag: str, shape: int, mark: int, parent: Node | None):
        self.tag, self.shape, self.mark, self.parent, self.kids, self.key = tag, shape, mark, parent, [], 0
        above = 0 if parent is None else parent.path
        self.depth = 0 if parent is None else 1 if tag in ("html", "body") else max(parent.depth, 1) + 1
        self.path = ((above * 0x9E3779B97F4A7C15 + shape) ^ (above >> 29)) & 0x7FFFFFFFFFFFFFFF


@lru_cache(65536)
def _named(value: str) -> int:
    """The mark that a class, id or role gives: one of its names is made of boilerplate words alone."""
    mark = KEEP
    for name in value.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", name).lower()) if w]
        rest = [w for w in words if w not in FILLER]
        if rest and BOILER.issuperset(rest):
            if not WEAK.issuperset(rest):
                return DROP
            mark = MAYBE
            continue
        if rest and HEADS.issuperset(rest):
            mark = max(mark, HEAD)
    return mark


@lru_cache(65536)
def _shape(tag: str, names: str | None) -> int:
    return _long(" ".join([tag, *sorted(re.sub(r"\d{3,}", "0", x) for x in (names or "").split())]).encode("utf-8", "surrogatepass")) | 1


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    mark = DROP if tag in RAW or tag in APART else HEAD if tag == "header" else KEEP
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
            return DROP
        if name == "id" and tag == "section":  # where links go, not what it is
            continue
        if name in ("class", "id", "role") and value and tag in HOLDS and tag not in MAIN and tag not in ("html", "body"):
            mark = max(mark, _named(value))
    return mark


class _Builder(HTMLParser):
    """Builds the tree of a page's blocks, however its tags are closed; inline markup dissolves into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#page", 1, KEEP, None)]
        self.open = [("#page", True, 0, 0)]  # tag, is a block, hides, links
        self.within = [self.nodes[0]]  # the open blocks
        self.hidden = self.links = self.linked = 0
        self.line: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each tag in self.open
        self.solid = [0]  # of the open blocks but paragraphs

    def flush(self) -> None:
        if self.line:
            text = " ".join("".join(self.line).split())
            if text:
                block = self.within[-1]
                block.kids.append(Line(text, min(self.linked, len(text)), block.path))
            self.line.clear()
            self.linked = 0

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            tag, block, hides, links = self.open.pop()
            self.places[tag].pop()
            if block:
                if tag != "p":
                    self.solid.pop()
                self.flush()
                self.within.pop()
            else:
                self.hidden -= hides
                self.links -= links

    def updatepos(self, i, j):
        """Line numbers aren't needed."""
        return j

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag)
        if tag in BLOCK:
            self.flush()
            if tag not in ("html", "body"):
                closes = (closes or set()) | {"p"}
        if closes:
            at = max((self.places[t][-1] for t in closes if self.places.get(t)), default=0)
            if at and self.solid[-1] <= at:
                self.close_from(at)
        if tag in VOID:
            if tag == "br":
                self.line.append(" ")
            return
        mark = _mark(tag, attrs)
        if tag in BLOCK:
            node = Node(tag, _shape(tag, next((v for k, v in attrs if k == "class"), None)), mark, self.within[-1])
            node.parent.kids.append(node)
            self.nodes.append(node)
            self.within.append(node)
            self.places.setdefault(tag, []).append(len(self.open))
            if tag != "p":
                self.solid.append(len(self.open))
            self.open.append((tag, True, 0, 0))
        else:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, False, mark == DROP, tag == "a"))
            self.hidden += mark == DROP
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def handle_data(self, data):
        if not self.hidden:
            self.line.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str | None) -> list[Node]:
    """The blocks of a page in document order, its root first; a null is empty."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    prose: dict[int, int] = {}
    for node in reversed(builder.nodes):  # without recursion: a page may nest without bound
        own = prose.pop(id(node), 0) + sum(len(k.text) - k.linked for k in node.kids if k.shape == 0)
        if node.mark == MAYBE:
            node.mark = KEEP if own >= PROSE else DROP
        if node.parent is not None:
            prose[id(node.parent)] = prose.get(id(node.parent), 0) + own
        node.key = hash((node.shape, *(k.key for k in node.kids)))
    return builder.nodes


def _rows(a: list[int], b: list[int]) -> list[int]:
    """For each prefix of a, a bit for each item of b: 0 where the longest common subsequence grows there."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & full
        out.append(row)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and each prefix of b."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    for x in a:
        both = row & at.get(x, 0)
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, exact for lists of any length, in memory linear in them beyond a bound."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            out.append((lo, left))
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            out.append((hi, right))
        if lo == hi or left == right:
            continue
        p, q = a[lo:hi], b[left:right]
        if len(p) > 1 and len(p) * len(q) > _TABLE:
            half = len(p) // 2
            split = int(np.argmax(_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]))
            todo += [(lo, lo + half, left, left + split), (lo + half, hi, left + split, right)]
            continue
        rows, i, j = [(1 << len(q)) - 1, *_rows(p, q)], len(p), len(q)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((lo + i, left + j))
    return sorted(out)


def align(a: Node, b: Node) -> list[tuple[Line, Line]]:
    """Simple tree matching from the root: the lines of both trees that are matched in order, under matched blocks.

    Children are matched by longest common subsequences: first of equal subtrees, then, between those, of shapes
    (tag and class names).  Marked blocks are left out.  There is no bound on length or depth.
    """
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        xs, ys = ([k for k in n.kids if k.shape == 0 or k.mark != DROP] for n in (x, y))
        pairs, i, j = [], 0, 0
        same = common([k.key for k in xs], [k.key for k in ys])
        for p, q in [*same, (len(xs), len(ys))]:
            pairs += [(i + s, j + t) for s, t in common([k.shape for k in xs[i:p]], [k.shape for k in ys[j:q]])]
            i, j = p + 1, q + 1
        for p, q in same + pairs:
            (out if xs[p].shape == 0 else todo).append((xs[p], ys[q]))
    return out


def blocks(nodes: list[Node], template: frozenset[int] = frozenset(), region: frozenset[int] = frozenset()) -> list[str]:
    """The page's content in order: of its region and the title above, else of its article or main element, else of its body."""
    held = set()
    for node in nodes if region else ():
        if node.path in region:
            around = node
            while around is not None and around.tag not in MAIN:
                around = around.parent
            held.add(id(around or node))

    def walk(inside) -> list[str]:
        found: list[str] = []
        stack: list[tuple[object, bool, bool, bool]] = [(nodes[0], False, False, False)]
        while stack:
            item, wanted, article, heading = stack.pop()
            if item.shape == 0:
                if wanted and (item.key not in template or article and heading):
                    found.append(item.text)
                continue
            here = wanted or inside(item)
            article = article or item.tag in MAIN or id(item) in held
            if item.mark == DROP or item.mark == HEAD and not article:
                continue
            stack += [(k, here, article, item.tag in HEADINGS) for k in reversed(item.kids)]
        return found

    got = []
    if held:
        got = walk(lambda n: id(n) in held or n.tag == "h1")
    return got or walk(lambda n: n.tag in MAIN) or walk(lambda n: True)


def _host(url):
    """The host of a url, lower case; the empty text for a null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))


class _Group:
    """Votes of one group: lines by key (same, met), and containers by path (count, pages, varying characters, depth)."""

    def __init__(self):
        self.lines: dict[int, list[int]] = {}
        self.holders: dict[int, list[int]] = {}

    def compare(self, last: list[Node], page: list[Node]) -> None:
        pairs = align(last[0], page[0])
        agreed = {y.key for x, y in pairs if x.key == y.key}
        prose = {n.path: 0 for n in page}
        varying, below = 0, dict.fromkeys(range(len(page)), 0)
        place = {id(n): k for k, n in enumerate(page)}
        dropped = set()
        whole = 0
        for k, n in enumerate(page):
            if n.mark == DROP or n.parent is not None and id(n.parent) in dropped:
                dropped.add(id(n))
                continue
            for line in n.kids:
                if line.shape == 0:
                    size = len(line.text) - line.linked
                    whole += size
                    if line.key not in agreed:
                        below[k] += size
                        varying += size
        if varying * 10 < whole or not varying:  # near copies of a page tell nothing about its template
            return
        for x, y in pairs:
            for key in {x.key, y.key}:
                got = self.lines.setdefault(key, [0, 0])
                got[0] += x.key == y.key
                got[1] += 1
        seen = set()
        for k in range(len(page) - 1, -1, -1):
            n = page[k]
            if k:
                below[place[id(n.parent)]] += below[k]
            if id(n) in dropped or k and n.tag not in HOLDS:
                continue
            got = self.holders.setdefault(n.path, [0, 0, 0, n.depth])
            got[0] += 1
            got[1] += n.path not in seen
            got[2] += below[k]
            seen.add(n.path)


_VOTES = pa.schema([("host", pa.string()), ("line", pa.bool_()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("depth", pa.int32())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, line, key, a, b, c, depth) of each group: a line's agreements and meetings, a container's count, pages and varying characters."""
    group, now, last, first = _Group(), None, None, True

    def packed() -> pa.RecordBatch:
        rows = [(now[0], True, k, *v, 0, 0) for k, v in group.lines.items()] + [(now[0], False, k, *v) for k, v in group.holders.items()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _VOTES, strict=True)], schema=_VOTES)

    for batch in batches:
        for part in slices(batch, "html"):
            for host, bucket, html in zip(*(part.column(c).to_pylist() for c in ("host", "bucket", "html")), strict=True):
                page = parse(html)
                if now != (host, bucket):
                    if group.holders:
                        yield packed()
                    group, now = _Group(), (host, bucket)
                elif page[0].key != last[0].key:
                    group.compare(last, page)
                last = page
    if group.holders:
        yield packed()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = ["\n\n".join(blocks(parse(html), frozenset(lines or ()), frozenset(region or ()))) for html, lines, region in zip(*(part.column(c).to_pylist() for c in ("html", "lines", "region")), strict=True)]
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), out, pc.utf8_length(out).cast(pa.int64())], ["page_id", "url", "text", "n_chars"])


def _with_hosts(pages: DataFrame, hosts: DataFrame, size) -> DataFrame:
    """pages with what is known of their hosts: broadcast if its bytes allow, else joined in parts, so that no host fills a task."""
    if (hosts.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_LIMIT:
        return pages.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame, support: int = 2, share: float = 0.5, spread: float = 0.2, most: float = 0.7, part: float = 0.15) -> DataFrame:
    """The main text of every page of pages (page_id, url, html): page_id, url, text, n_chars.

    A line is template if `support` alignments of its host agreed on it (one, on a host with one alignment),
    `share` of those that met it, and `spread` of all; the content region of a host is the deepest container that holds `most` of its varying text, and those beside it that hold `part` of it.
    Blocks keep page order and are joined by two line feeds; white space inside one becomes one space.  A
    null or empty page has an empty text, as has a page without content; very long and very deep pages are aligned and read whole.
    A null url is a host of its own; repeated pages are each extracted, and neither they nor near copies vote; pages that
    tie on page_id are aligned in the order of a hash of their html.  A host of one page has no template and no region.  An empty table gives no
    rows.  Results depend on neither partitions nor batches.  Other columns are ignored.
    """
    n = partitions(pages.sparkSession, pages, "html")
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    large = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > GROUP).select("host", F.ceil(F.col("pages") / GROUP).alias("buckets")))
    sized = _with_hosts(rows.select("host", "page_id", "html"), large, F.octet_length("host") + 16)
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.coalesce("buckets", F.lit(1))))
    ordered = dealt.select("host", "bucket", "page_id", "html").repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket", "page_id", F.xxhash64("html"))
    votes = ordered.select("host", "bucket", "html").mapInArrow(_votes, "host string, line boolean, key long, a long, b long, c long, depth int")
    sums = votes.groupBy("host", "line", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"), F.max("depth").alias("depth"))
    # lines that agreed, and containers that stand once on most pages that have them
    some = sums.where(F.when(F.col("line"), (F.col("a") > 0) & (F.col("a") >= share * F.col("b"))).otherwise(F.col("a") <= 1.1 * F.col("b")))
    line = F.when(F.col("line"), F.struct(F.col("a"), F.col("key")))
    holder = F.when(~F.col("line"), F.struct("depth", "key", "b", "c"))
    # a host's template is as long as a page at most times its designs, not as its pages
    by_host = some.groupBy("host").agg(F.collect_list(line).alias("lines"), F.collect_list(holder).alias("holders"))
    root = F.filter("holders", lambda x: x.depth == 0)[0]
    deep = F.array_max(F.filter("holders", lambda x: (x.depth > 1) & (x.c >= most * root.c)))
    agreed = F.filter("lines", lambda x: x.a >= F.greatest(F.least(F.lit(support), root.b), spread * root.b))
    # what holds less than `most` is beside the deepest one, or within it
    beside = F.filter("holders", lambda x: (x.depth > 1) & (x.c >= part * root.c) & (x.c < most * root.c))
    region = F.when(deep.isNotNull(), F.concat(F.array(deep.key), F.transform(beside, lambda x: x.key)))
    known = cut(by_host.select("host", F.transform(agreed, lambda x: x.key).alias("lines"), region.alias("region")).where((F.size("lines") > 0) | F.col("region").isNotNull()))
    return _with_hosts(rows, known, F.octet_length("host") + 8 * F.size("lines") + 8 * F.coalesce(F.size("region"), F.lit(0)) + 16).select("page_id", "url", "html", "lines", "region").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
