"""Main text of web pages: structure first, then differencing against the page with the nearest URL.

Pages stand in the order of host, URL path and id, in ranges.  Each page is cut into lines (blocks of its markup), each with
what its markup says: dropped (scripts, menus, headers, footers, sidebars, notices, adverts, forms, reader comments),
article, or undecided.  Next to it in that order stands the page with the nearest URL on the same host: of its two
neighbours with any lines the one whose path shares more with its own.  The first and last page of each range are taken
along to the ranges beside it, so every page meets its nearest URL.  The lines of both are aligned by longest common
subsequence and shared lines are deleted, on pages that mark an article too.  Two things are kept in spite of being
shared: lines that the markup places in an article, since copies of articles and common passages are text; and all
lines of a page whose neighbours are copies, since these tell nothing about the template.  A copy shares more than half of the
page's article lines or, where it marks none, has equal lines; the other neighbour is asked then.

A task holds three pages at a time; a host with a third of all pages is spread over many ranges.

Defined cases: null html counts as empty and gives an empty text; a null or malformed URL has an empty host and path; pages
of one host with equal paths stand in the order of ids; a page without lines is nobody's neighbour; repeated rows each give a row;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

# Elements and attribute words by their role.
DROP_TAGS = set("head script style noscript template nav footer aside form button select textarea iframe svg canvas object audio video dialog menu".split())
BLOCK_TAGS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
                 "li main nav ol option p pre section summary table tbody td tfoot th thead tr ul title".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
DROP_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|menu|navbar|navigation|nav|breadcrumbs?|cookies?|consent|gdpr|notice|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|share|sharing|social|related|recommended|comments?|commentlist|disqus|respond|footer|widget|toolbar|pagination|pager|login|signup|search)(?:$|[\s_-])", re.I)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MAIN_ROLES = {"main", "article"}

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title")}
UNDECIDED, ARTICLE, DROPPED = 0, 1, 2


def kind_of(tag: str, attributes: str, inside_article: bool) -> int:
    """What an element's own tag and attributes say about its text."""
    if tag in DROP_TAGS or (tag == "header" and not inside_article):
        return DROPPED
    kind = ARTICLE if tag in ("article", "main") else UNDECIDED
    if attributes and not attributes.isspace():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "role":
                if value.lower() in DROP_ROLES:
                    return DROPPED
                kind = ARTICLE if value.lower() in MAIN_ROLES else kind
            elif name == "itemprop":
                kind = ARTICLE if value.lower() == "articlebody" else kind
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return DROPPED
            elif tag not in ("html", "body", "article", "main") and (DROP_WORDS.search(value) or (not inside_article and HEADER_WORDS.search(value))):
                return DROPPED
    return kind


def lines_of(html: str) -> tuple[list[tuple[str, int]], bool]:
    """Lines of a page with their kind, and whether an article is marked."""
    out: list[tuple[str, int]] = []
    regions: list[list] = []  # [tag, kind, open elements of that tag]
    buffer: list[str] = []
    at, marked = 0, False

    def kind() -> int:
        return max((r[1] for r in regions), default=UNDECIDED)

    def flush():
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                out.append((text, now))
            buffer.clear()

    now, end = UNDECIDED, len(html)
    while at < end:
        m = TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at and now != DROPPED:
            buffer.append(html[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        block, closing = tag in BLOCK_TAGS, m.group(1)
        if block:
            flush()
        elif tag == "br":
            buffer.append(" ")
        if closing:
            if any(r[0] == tag for r in regions):
                while regions[-1][0] != tag:
                    regions.pop()
                    flush()
                regions[-1][2] -= 1
                if not regions[-1][2]:
                    flush()
                    regions.pop()
                now = kind()
            continue
        if regions and (block and regions[-1][0] == "p" or tag == "body" and regions[-1][0] == "head"):
            regions.pop()
            now = kind()
        if tag in VOID_TAGS:
            continue
        own = kind_of(tag, m.group(3), now == ARTICLE)
        if m.group(3).endswith("/") and own != UNDECIDED:
            continue
        if own > now or own == ARTICLE:
            flush()
            marked |= own == ARTICLE and now != DROPPED
            regions.append([tag, own, 1])
            now = kind()
        elif regions and regions[-1][0] == tag:
            regions[-1][2] += 1
        if tag in RAW_END:  # their content is no markup
            e = RAW_END[tag].search(html, at)
            at = e.start() if e else end
    flush()
    return out, marked


def _reached(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and the first 0, 1, 2, ... lines of ``b``, all bits of a row at once."""
    masks: dict[int, int] = defaultdict(int)
    for j, line in enumerate(b):
        masks[line] |= 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        both = row & masks.get(line, 0)
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int], at: int, found: set[int]) -> None:
    """Adds the places (from ``at``) of the lines of ``a`` in one longest common subsequence with ``b``, by halving ``a``."""
    same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    found.update(range(at, at + same))
    a, b, at = a[same:], b[same:], at + same
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            found.add(at)
        return
    half = len(a) // 2
    split = int(np.argmax(_reached(a[:half], b) + _reached(a[half:][::-1], b[::-1])[::-1]))
    _aligned(a[:half], b[:split], at, found)
    _aligned(a[half:], b[split:], at + half, found)


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Numbers of the lines of ``a`` in a longest common subsequence with ``b``, in memory that grows with the lines alone."""
    number = {line: k for k, line in enumerate(dict.fromkeys(b))}
    places = [i for i, line in enumerate(a) if line in number]  # other lines are in no common subsequence
    own, there = [number[a[i]] for i in places], set(a)
    found: set[int] = set()
    _aligned(own, [number[line] for line in b if line in there], 0, found)
    return {places[k] for k in found}


def is_copy(lines: list[tuple[str, int]], shared: set[int], other: list[str]) -> bool:
    """Whether a neighbour is a copy: by the article lines that it shares or, without any, by equal lines."""
    article = [i for i, (_, k) in enumerate(lines) if k == ARTICLE]
    if article:
        return 2 * sum(i in shared for i in article) > len(article)
    return [t for t, _ in lines] == other


def main_text(lines: list[tuple[str, int]], marked: bool, *others: list[str] | None) -> str:
    """Text of a page, given the lines of its neighbours, that with the nearest URL first."""
    own = [t for t, _ in lines]
    shared: set[int] = set()
    if any(k == UNDECIDED for _, k in lines):  # no other line depends on the neighbours
        for other in others:
            found = common_lines(own, other) if other else set()
            if other and not is_copy(lines, found, other):
                shared = found
                break
    return "\n\n".join(t for i, (t, k) in enumerate(lines) if k == ARTICLE or (k == UNDECIDED and i not in shared))


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


ORDER = ["_host", "_path", "page_id", "url", "_hash"]


def _rank(key: tuple) -> tuple:
    """A key of ``ORDER`` as Python compares it, nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in key)


def _keys(batch):
    return zip(*(batch.column(c).to_pylist() for c in ORDER), strict=True)


def _ends(bounds):
    """The first and last page with lines of each range, of the pages of a task."""
    def run(batches):
        ends: dict[int, list] = {}
        for b in batches:
            html = b.column("html")
            for i, key in enumerate(_keys(b)):
                rank = _rank(key)
                at = bisect_right(bounds, rank)
                low_high = ends.get(at)
                if low_high and low_high[0][0] <= rank <= low_high[1][0] or not lines_of(html[i].as_py() or "")[0]:
                    continue
                ends[at] = [min(low_high[0], (rank, key)), max(low_high[1], (rank, key))] if low_high else [(rank, key), (rank, key)]
        rows = [(at, *key) for at, pair in ends.items() for _, key in pair]
        if rows:
            types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["_range", *ORDER])

    return run


def _deal(bounds, guests):
    """Pages with their range; the ends of ranges also as guests of those beside them (``_side`` -1: before all, 1: after all)."""
    def run(batches):
        for b in batches:
            take, where, side = [], [], []
            for i, key in enumerate(_keys(b)):
                for at, s in ((bisect_right(bounds, _rank(key)), 0), *guests.get(key, ())):
                    take.append(i)
                    where.append(at)
                    side.append(s)
            for at in range(0, len(take), 256):
                part = b.take(pa.array(take[at : at + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(where[at : at + 256], pa.int32()), pa.array(side[at : at + 256], pa.int32()), *part.columns], ["_range", "_side", *part.schema.names])

    return run


def _extract(batches):
    """Pages in the order of range, host and path; a page is given out when its successor with lines is known."""
    before = page = None  # (id, url, host, path, lines, marked, range, side)

    def done(after):
        sides = [x for x in (before, after) if x and x[6] == page[6] and x[2] == page[2]]
        sides.sort(key=lambda x: -_near(x[3], page[3]))
        text = main_text(page[4], page[5], *([t for t, _ in x[4]] for x in sides))
        return page[0], page[1], text, len(text)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                          ["page_id", "url", "text", "n_chars"])

    rows, size = [], 0
    for b in batches:
        cols = [b.column(c) for c in ("page_id", "url", "_host", "_path", "html", "_range", "_side")]
        for i in range(len(b)):
            pid, url, host, path, html, at, side = (c[i].as_py() for c in cols)
            new = (pid, url, host, path, *lines_of(html or ""), at, side)
            if not new[4]:  # a page without lines tells nothing about a template
                rows.append((pid, url, "", 0))
                continue
            if page and page[7] == 0:
                rows.append(done(new))
                size += rows[-1][3]
            before, page = page, new
            if size > 1 << 22 or len(rows) > 10_000:
                yield batch(rows)
                rows, size = [], 0
    if page and page[7] == 0:
        rows.append(done(None))
    if rows:
        yield batch(rows)


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``page_id, url, html``, worked on in about so many ranges of pages."""
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html",
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("_host"),
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("_path"), F.xxhash64("html").alias("_hash"))
    n = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds of ranges from a few keys for each (they set the sizes of tasks, never a result).
    some = sorted(_rank(tuple(r)) for r in rows.select(*ORDER).orderBy(F.xxhash64("_hash", "page_id"), *ORDER).limit(16 * n).collect())
    bounds = sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []
    key = F.struct(*ORDER)
    ends = rows.mapInArrow(_ends(bounds), "_range int, _host string, _path string, page_id bigint, url string, _hash bigint")
    ends = ends.groupBy("_range").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("_range").collect()  # a row for each range
    guests: dict[tuple, list] = defaultdict(list)
    for a, b in zip(ends, ends[1:], strict=False):
        guests[tuple(a["high"])].append((b["_range"], -1))
        guests[tuple(b["low"])].append((a["_range"], 1))
    dealt = rows.mapInArrow(_deal(bounds, dict(guests)), "_range int, _side int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))
    return dealt.repartitionByRange("_range").sortWithinPartitions("_range", "_side", *ORDER).mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
