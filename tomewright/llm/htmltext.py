"""Main text of web pages: structure first, then differences between pages of nearest URLs.

A page is cut into lines (its blocks), each with what encloses it. Pages are put in order of host and URL path;
a page is aligned with the nearest pages before and after it in that order (of the same host, and no copies of it) by the longest
common subsequence of their lines. Lines shared with both (or with the only one) are the site's, not the page's, and
go, unless an ``article`` element encloses them: articles are copied and quoted between pages, and would else be lost."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.textbatches import map_batches
from tomewright.llm.urlfilter import host_of
from tomewright.session import forget, materialize

#: Pages that are aligned by one call, and how many neighbours on a side are tried.
BLOCK, REACH = 128, 2
#: A neighbour with so large a part of a page's text (or it of the neighbour's) is a copy, not another page.
COPY = 0.8
#: Bits that an alignment may keep; longer ones are split.
CELLS = 1 << 28

_MARKUP = re.compile(
    r"""(?isx)
    <!--.*?(?:-->|\Z)
    | <(script|style|textarea|title|iframe|noembed|noframes|xmp)\b[^>]*+>.*?(?:</\1\s*+>|\Z)
    | <(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    | <(/?)([a-z][^\s/>]*+)([^>]*+)>
    | <[!?/][^>]*+>"""
)
_ATTRIBUTE = re.compile(r"""(?s)([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_STATE = re.compile(r"(?i)(?:has|have|with|without|no|is|hide|show|open|close|toggle)[-_]")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are no part of an article, and those that are its own only inside one.
NOISE = frozenset("nav footer aside form dialog menu button select noscript template svg canvas audio video object map head".split())
NOISE_OUTSIDE = frozenset(["header"])
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Words in class and id of menus, page headers and footers, sidebars, notices, adverts, forms and readers' comments.
NOISE_WORDS = frozenset(
    """nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topbar toolbar masthead footer colophon copyright
    sidebar sidebars aside widget widgets related recommended recommendations trending cookie cookies consent gdpr notice notices notification
    notifications alert popup modal overlay toast newsletter subscribe subscription signup paywall banner announcement disclaimer ad ads adv
    advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion form forms
    search searchbox login comment comments commentlist disqus respond reply replies discussion share sharing social""".split()
)
NOISE_WORDS_OUTSIDE = frozenset(["header"])
#: Names of elements that hold an article where no element says so.
NAMED = frozenset("article content post entry story articlebody".split())
#: A start tag in these ends the open element of the same row, unless one of the barriers is between.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = frozenset("ul ol dl table select div section article main aside nav header footer form body html".split())


class Line(NamedTuple):
    """A block's text and what encloses it."""

    text: str
    noise: bool  #: within an element of the lists above
    article: bool
    main: bool
    named: bool  #: within an element whose class or id names an article
    inner: bool  #: within an article that is itself within noise, and there not within noise of its own


def _marks(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element is noise, an article, the page's main part, or named as its content."""
    noise, article, main, named = tag in NOISE, tag == "article", tag == "main", False
    noise = noise or tag in NOISE_OUTSIDE and not in_content
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and tag not in ("html", "body"):
                # names that tell what a part has or lacks ('has-sidebar') don't tell what it is
                told = [x for x in value.split() if not _STATE.match(x)]
                words = {w.lower() for x in told for w in _WORD.findall(x)}
                if tag == "article":  # 'comment' is a reader's, 'post comment-open' an article
                    flagged = not NOISE_WORDS.isdisjoint(x.lower() for x in told)
                else:
                    flagged = not words.isdisjoint(NOISE_WORDS) or not in_content and not words.isdisjoint(NOISE_WORDS_OUTSIDE)
                noise = noise or flagged and tag != "main"
                named = named or not flagged and not words.isdisjoint(NAMED)
            elif name == "role":
                roles = set(value.lower().split())
                noise = noise or not roles.isdisjoint(NOISE_ROLES)
                main, article = main or "main" in roles, article or "article" in roles
            elif name == "itemprop":
                article = article or "articlebody" in value.lower().split()
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                noise = noise or tag not in ("html", "body")
    return noise, article and not noise, main and not noise, named and not noise and tag not in INLINE


def lines_of(html: str) -> list[Line]:
    """The blocks of a page that have text: references decoded, white space made one space, trimmed."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, tuple[bool, bool, bool, bool], bool]] = []  # tag, its marks, whether an article within noise
    depth = [0, 0, 0, 0]  # how many open elements have each mark
    inner: list[int] = []  # depth of noise at the open articles within noise

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Line(text, depth[0] > 0, depth[1] > 0, depth[2] > 0, depth[3] > 0, bool(inner) and depth[0] == inner[0]))

    def close() -> None:
        _, marks, within = stack.pop()
        for i, mark in enumerate(marks):
            depth[i] -= mark
        if within:
            inner.pop()

    def close_to(tags: set[str], barriers: frozenset[str]) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                while len(stack) > at:
                    close()
                return
            if stack[at][0] in barriers:
                return

    at = 0
    for found in _MARKUP.finditer(html):
        if found.start() > at:
            data = html[at : found.start()]
            parts.append(unescape(data) if "&" in data else data)
        at = found.end()
        ends, tag, attributes = (found[2], found[3], found[4]) if found[3] else (found[5], found[6], found[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if ends:
            if tag in INLINE and depth[0]:
                flush()  # words in a line that are an advert end here
            close_to({tag}, frozenset() if tag not in INLINE else _BARRIERS)
            continue
        if tag == "p" or tag not in INLINE and tag not in VOID:
            close_to({"p"}, _BARRIERS)
        if tag in _ENDS:
            close_to(_ENDS[tag], _BARRIERS - {tag})
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "article", "section", "main", "span"):
            continue
        marks = _marks(tag, attributes, depth[1] + depth[2] > 0)
        if any(marks[:1]) and tag in INLINE:
            flush()
        within = marks[1] and depth[0] > 0
        if within:
            inner.append(depth[0])
        for i, mark in enumerate(marks):
            depth[i] += mark
        stack.append((tag, marks, within))
    if at < len(html):
        data = html[at:]
        parts.append(unescape(data) if "&" in data else data)
    flush()
    return out


def candidates(lines: list[Line]) -> tuple[list[str], bool]:
    """The lines that structure leaves, and whether an article element holds them."""
    for choice, sure in (
        ([x.text for x in lines if x.article and not x.noise], True),
        ([x.text for x in lines if x.main and not x.noise], False),
        ([x.text for x in lines if x.inner], True),
    ):
        if choice:
            return choice, sure
    rest = [x for x in lines if not x.noise]
    named = [x.text for x in rest if x.named]
    return (named if 2 * sum(map(len, named)) >= sum(len(x.text) for x in rest) else [x.text for x in rest]), False


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``: rows of bits, one for each item of ``a``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mine, theirs = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    places = [i for i in range(head, len(a) - tail) if a[i] in theirs]
    middle = _middle([a[i] for i in places], [x for x in b[head : len(b) - tail] if x in mine])
    return [*range(head), *(places[i] for i in middle), *range(len(a) - tail, len(a))]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each item of ``a``, bits that are 0 where one more item of ``b`` lengthens the common subsequence."""
    where: dict[int, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every beginning of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _middle(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return [*_middle(a[:half], b[:cut]), *(half + i for i in _middle(a[half:], b[cut:]))]
    rows, out, i, j = list(_rows(a, b)), [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            out.append(i)
            i, j = i - 1, j - 1
        elif rows[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def shared_lines(page: tuple, before: list[tuple], after: list[tuple]) -> list[int]:
    """Places of the lines that a page shares with its neighbours; pages are (hashes, lengths) of their lines, nearest first."""
    sides = []
    for side in (before, after):
        for other in side:
            places = aligned(page[0], other[0])
            part = sum(page[1][i] for i in places)
            if part < COPY * min(sum(page[1]), sum(other[1])):
                sides.append(set(places))
                break
    return sorted(set.intersection(*sides)) if sides else []


def _key() -> Column:
    """A row's identity: 128 bits of all it has, so that tasks that run again agree."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x01"))
    return F.unhex(F.md5(F.concat_ws("\x00", text("page_id"), text("url"), text("html"))))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, lengths = [], []
        for html in batch.column("html"):
            texts, _ = candidates(lines_of(html.as_py() or ""))
            hashes.append(b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in texts))
            lengths.append(np.array([len(t) for t in texts], np.int32).tobytes())
        kept = [batch.column(c) for c in ("key", "host", "path")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(hashes, pa.binary()), pa.array(lengths, pa.binary())], names=["key", "host", "path", "hashes", "lengths"])


def _align(table: pa.Table) -> pa.Table:
    """Shared lines of the pages of one block; the others in the group are neighbours of the next blocks."""
    table = table.sort_by("rank")
    hosts, owned = table.column("host").to_pylist(), table.column("owned").to_pylist()
    pages = [
        (np.frombuffer(h, np.int64).tolist(), np.frombuffer(n, np.int32).tolist())
        for h, n in zip(table.column("hashes").to_pylist(), table.column("lengths").to_pylist())
    ]
    keys, shared = [], []
    for i, key in enumerate(table.column("key").to_pylist()):
        if owned[i] and hosts[i]:
            near = lambda step: [pages[j] for j in range(i + step, i + step * (REACH + 1), step) if 0 <= j < len(pages) and hosts[j] == hosts[i]]  # noqa: B023, E731
            found = shared_lines(pages[i], near(-1), near(1))
            if found:
                keys.append(key)
                shared.append(found)
    return pa.table({"key": pa.array(keys, pa.binary()), "shared": pa.array(shared, pa.list_(pa.int32()))})


def site_lines(pages: DataFrame) -> DataFrame:
    """``key`` and ``shared`` (places among the lines that structure leaves) of every page that has lines of its site."""
    url = F.coalesce(F.col("url"), F.lit(""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(_key().alias("key"), host_of(url).alias("host"), path.alias("path"), "html")
    small = map_batches(rows, _summaries, "key binary, host string, path string, hashes binary, lengths binary")
    # identical rows are one page: no other page stands between them, and their result is the same
    small = materialize(small.groupBy("key").agg(*(F.first(c).alias(c) for c in ("host", "path", "hashes", "lengths"))), "pages-lines")
    ordered = materialize(
        small.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("at", F.monotonically_increasing_id()), "pages-ordered"
    )
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets.select("part", "offset")), "part")
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))
    block = F.floor(F.col("rank") / BLOCK)
    place = F.col("rank") % BLOCK
    blocks = F.array_compact(F.array(block, F.when(place < REACH, block - 1), F.when(place >= BLOCK - REACH, block + 1)))
    dealt = ranked.withColumn("own", block).withColumn("block", F.explode(blocks)).withColumn("owned", F.col("own") == F.col("block"))
    found = dealt.select("block", "rank", "owned", "key", "host", "hashes", "lengths").groupBy("block").applyInArrow(_align, "key binary, shared array<int>")
    shared = materialize(found, "pages-shared")
    forget(small, ordered)
    return shared


def _extract(batches: Iterator[pa.RecordBatch], structure_only: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, dropped = [], []
        for html, places in zip(batch.column("html"), batch.column("shared")):
            lines, sure = candidates(lines_of(html.as_py() or ""))
            places = set() if sure or structure_only else set(places.as_py() or ())
            texts.append(" ".join(x for i, x in enumerate(lines) if i not in places))
            dropped.append(len(places))
        kept = [batch.column(c) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=["page_id", "url", "text", "n_site_lines"])


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html).

    Returns page_id, url, text, n_chars (code points) and n_site_lines (lines that went because the site's pages share them).
    Text is decoded, white space within a block is one space, and blocks are joined by one.

    Null html is empty, and gives an empty text. A page with a null or relative URL has no neighbours, nor has the only page of a host;
    there structure alone decides. Identical rows are one page and each keeps its row. Pages of equal paths are ordered by a hash of the row. Broken markup is
    read as far as it goes; pages of any length are read whole. Other columns are left out; an empty table gives none."""
    pages = pages.select("page_id", "url", "html")
    shared = site_lines(pages)
    # Spark broadcasts the smaller side only below its own threshold; beyond, both are shuffled by the key
    joined = pages.withColumn("key", _key()).join(shared, "key", "left").select("page_id", "url", "html", "shared")
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    out = map_batches(joined, partial(_extract), f"page_id {types['page_id']}, url string, text string, n_site_lines bigint")
    return out.withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_site_lines")
