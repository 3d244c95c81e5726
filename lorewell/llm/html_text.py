"""Main text of web pages: markup says what is an article, repeats across a host's pages judge what markup leaves open.

A page becomes blocks of text in zones: ``article`` (inside an article or main
element), ``noise`` (menus, headers, footers, sidebars, notices, adverts, forms
and comments, by element, role, or a class or id that is such a name), ``open``
(anything else) and, in an article or outside, ``doubt`` (a class or id that
only has such a name in it, as ``article-header`` or ``related-work``).
Scripts, styles and markup never become text.

The token streams of a host's pages (all blocks but the article's) are searched
for strings of ``RUN`` tokens or more that stand on several different pages:

1. Each string of RUN tokens (a window) belongs to the place of the smallest
   hash of SEED tokens in it; windows of one place form a piece.  All equal
   windows of a host lie in pieces of one seed, so a host of any size is split
   by seed over the tasks, and equal pieces are one row with the number of
   different pages that have them, however many that are.
2. A task joins the pieces of its seeds, separated, into one sequence and sorts
   its suffixes by prefix doubling.  Neighbours in that suffix array that share
   RUN tokens form an interval; it is a repeat if its pieces stand on enough
   different pages.  Seeds of over ``HOT_PIECES`` different pieces are not put
   into one task: their windows are grouped one by one.

Pages of equal streams count once, so copies do not delete each other, and a
repeat needs three different pages (two, on a host that has only two), so a
pair of near copies does not either.  Open blocks of pages without an article, and
doubtful blocks, go if repeats cover them for the most part; unique ones stay.

Articles are judged by the repeats of the host's articles, page by page, but by
more evidence, as an article's own sentences may also stand in others: a block
goes if strings of RUN tokens cover it that stand in half of the host's
different articles and in ``MIN_ARTICLES`` at least, as a notice does that a
site puts into each of them.  Where these would take more than ``ARTICLE_SHARE``
of an article it is a near copy of the others, and stays whole.  The streams of
a host's different articles are dealt over parts of some ``PART_TOKENS`` tokens,
and a task sorts the suffixes of a part: a string in half of the host's articles
is in half of some part's.  The strings found, by short hashes of
their tokens, are then counted in all articles by whole ones.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm import common, kernel

RUN, SEED = 8, 4
#: Different pages on which a repeat must stand; all of them on a host that has fewer.
MIN_PAGES = 3
#: Share of covered tokens from which a block is boilerplate.
COVERED = 0.6
#: Different articles, at least, in which a string must stand to judge articles' blocks; and half of the host's.
MIN_ARTICLES = 10
#: Share of an article's tokens up to which its repeated blocks go.
ARTICLE_SHARE = 0.25
#: Tokens of a host's different articles that one task sorts, about.
PART_TOKENS = 100_000
#: Different pieces of one seed and host that one task sorts at most.
HOT_PIECES = 20_000
#: Tokens that are sorted together, about.
SORT_TOKENS = 500_000

_U = np.uint64
_OPENS = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "popup menu menus nav navbar navigation breadcrumb breadcrumbs sidebar side-bar footer masthead site-header page-header "
    "site-footer page-footer header comment comments disqus respond reply replies share sharing social recommended newsletter "
    "subscribe signup login pagination pager toolbar contentinfo complementary cookie-banner cookie-notice cookie-consent "
    "ad-slot ad-banner comment-list comments-area main-menu nav-menu share-buttons social-links".split()
)
#: Names that a wrapper of the whole page may have: a main element in it, or the page's only articles, stay.
_LAYOUT_NAMES = frozenset(
    "banner header masthead site-header page-header sidebar side-bar footer site-footer page-footer toolbar menu menus nav navbar "
    "navigation social notice notices share sharing".split()
)
_DOUBTFUL_NAMES = _NOISE_NAMES | frozenset("related modal widget search form".split())
_NOISE_TAG = frozenset("nav header footer aside button select dialog menu".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
_CLOSES_P = _INLINE | _RAW
_SPACE = re.compile(r"\s+")
_ITEMS = frozenset("li dt dd tr td th option".split())


def _tag_end(html: str, at: int) -> tuple[int, int]:
    """(place after the ``>`` that ends the tag whose name ends at ``at``, or -1; how far its quotes were followed in vain)."""
    start = at
    while at < len(html):
        at = _UNQUOTED.match(html, at).end()
        if at >= len(html):
            break
        if html[at] == ">":
            return at + 1, 0
        closing = html.find(html[at], at + 1)
        if closing < 0:
            break
        at = closing + 1
    return html.find(">", start) + 1 or -1, at


def _kind(tag: str, attributes: str) -> str | None:
    """What an element says about the text in it."""
    if tag in _NOISE_TAG:
        return "noise"
    if tag == "form":
        return "form"
    names = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)).lower().split() if attributes else []
    if tag in ("article", "main"):
        return "noise" if any("comment" in n or "reply" in n for n in names) else tag
    if "main" in names:
        return "main"
    if tag in ("html", "body"):
        return None
    if any(n in _NOISE_NAMES for n in names):
        return "noise" if any(n in _NOISE_NAMES and n not in _LAYOUT_NAMES for n in names) else "layout"
    return "doubt" if any(p in _DOUBTFUL_NAMES for n in names for p in re.split("[-_]+", n)) else None


def _zone(kinds: list[str]) -> str:
    """Zone of text inside elements of these kinds, the outermost first.

    An article in a form or a doubtful element is one.  Names of a page's
    layout are noise but for a main element in them; an article in them is one
    only if the page has no other, which :func:`blocks` decides.
    """
    zone = "open"
    for k in kinds:
        if k == "noise":
            return k
        if k == "main":
            zone = "article"
        elif k == "article":
            zone = "article in layout" if zone in ("layout", "article in layout") else "article"
        elif k in ("layout", "form"):
            zone = k
        elif zone not in ("layout", "form"):
            zone = "doubt in article" if "article" in zone else "doubt"
    return "noise" if zone in ("layout", "form") else zone


def blocks(html: str) -> list[tuple[str, str]]:
    """(zone, text) of each block that has text, in page order."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str | None]] = []  # element, what it says
    zone = "open"

    def end_block() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((zone, text))

    def close(k: int) -> None:
        """Close the elements from the k-th on."""
        nonlocal zone
        said = any(z for _, z in stack[k:])
        del stack[k:]
        if said:
            end_block()
            zone = _zone([z for _, z in stack if z])

    at, broken, n = 0, 0, len(html)
    while at < n:
        m = _OPENS.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        tag = m[2]
        if tag is None:
            close_at = html.find("-->", m.end()) + 3 if m[0] == "<!--" else html.find(">", m.end()) + 1
            at = close_at if close_at > m.end() else n if m[0] == "<!--" else m.end()
            continue
        if m.end() < broken:  # quotes that did not close were followed over this place already
            at = html.find(">", m.end()) + 1 or -1
        else:
            at, broken = _tag_end(html, m.end())
        if at < 0:  # no tag ends any more
            parts.append(html[m.start() :])
            break
        attributes = html[m.end() : at - 1]
        tag = tag.lower()
        if m[1]:
            if tag not in _INLINE:
                end_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag == "br" or tag in _INLINE and tag in _VOID:
            parts.append(" ")
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(f"</{tag}", re.I).search(html, at)
                at = n if end is None else html.find(">", end.end()) + 1 or n
            continue
        if tag not in _INLINE:
            end_block()
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag not in _CLOSES_P:  # a block ends an open paragraph, an item the item before it
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or (name == tag and tag in _ITEMS):
                    close(k)
                    break
                if name not in _INLINE:
                    break
        kind = _kind(tag, attributes)
        if kind:
            end_block()
        stack.append((tag, kind))
        if kind:
            zone = _zone([z for _, z in stack if z])
    end_block()
    of_layout = "noise" if any(z == "article" for z, _ in out) else "article"
    return [(of_layout if z == "article in layout" else z, text) for z, text in out]


def _judged(found: list[tuple[str, str]]) -> list[bool]:
    """Which blocks repeats decide; without an article open blocks are among them."""
    has_article = any(z == "article" for z, _ in found)
    return [z == "doubt in article" or not has_article and z in ("open", "doubt") for z, _ in found]


def _kept(found: list[tuple[str, str]], judged: list[bool], boilerplate: list[bool]) -> list[str]:
    return [t for (z, t), j, b in zip(found, judged, boilerplate) if (z == "article" or j) and not b]


class _Streams:
    """Tokens of some pages' articles, or of all their other blocks, page by page."""

    def __init__(self, found: list[list[tuple[str, str]]], article: bool = False):
        texts = [t for f in found for z, t in f if (z == "article") == article]
        data, offsets = kernel.utf8(pa.array(texts, pa.string()))
        w = kernel.Words(data, offsets, kernel.NON_SPACE, lower=True)
        self.words = w.hashes()
        n_blocks = [sum((z == "article") == article for z, _ in f) for f in found]
        self.block = w.first  # token places at which blocks begin
        self.blocks_of = np.cumsum([0, *n_blocks])
        self.page = w.first[self.blocks_of]  # and pages

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ranges of tokens."""
        n = len(self.words)
        up, down = kernel._Powers.of(n + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.words * up[:n])])
        return kernel.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U))

    def tokens(self) -> np.ndarray:
        """The tokens by 32 bits of their hashes."""
        return (self.words >> _U(32)).astype(np.uint32).view(np.int32)

    def short(self) -> np.ndarray:
        """The tokens by 16 bits: equal strings stay equal, others hardly become so."""
        return (self.words >> _U(48)).astype(np.uint16)

    def covered(self, hits: list[list[int] | None]) -> np.ndarray:
        """Which blocks windows at these places of their pages cover for the most part."""
        depth = np.zeros(len(self.words) + 1, np.int64)
        for k, at in enumerate(hits):
            if at:
                begin = self.page[k] + np.array(at)
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + RUN, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
        size = np.diff(self.block)
        return np.diff(covered[self.block]) >= COVERED * np.maximum(size, 1)


def _pieces(batches):
    for batch in batches:
        html = batch["html"].to_pylist()
        for a in range(0, len(html), 256):
            found = [blocks(h or "") for h in html[a : a + 256]]
            s = _Streams(found)
            seeds = kernel.shingles(s.words, np.array([0, len(s.words)]), SEED, whole=False)[0]
            windows = np.maximum(np.diff(s.page) - RUN + 1, 0)
            row, start, count, seed = kernel.window_seeds(seeds, s.page[:-1], windows, RUN - SEED + 1)
            begin = s.page[row] + start
            end = begin + count + RUN - 1
            stream = s.ranges(s.page[:-1], s.page[1:]).view(np.int64)
            at = np.repeat(begin - np.cumsum(end - begin) + (end - begin), end - begin) + np.arange(int((end - begin).sum()))
            places = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
            page_rows = pa.array(a + row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_key"].take(page_rows),
                    batch["host"].take(page_rows),
                    pa.array(np.array([any(_judged(f)) for f in found], bool)[row]),
                    pa.array(stream[row]),
                    pa.array(seed.view(np.int64)),
                    pa.array(s.ranges(begin, end).view(np.int64)),
                    pa.array(start.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(s.tokens()[at])),
                ],
                ["_key", "host", "asked", "page", "seed", "content", "start", "tokens"],
            )


_PIECES = "_key long, host string, asked boolean, page long, seed long, content long, start int, tokens array<int>"


def suffix_groups(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes in the order of their first RUN symbols, and equal ranks where these are equal."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1]
    known = 1
    while known < RUN:
        follow = np.zeros(n, np.int64)
        follow[: n - known] = rank[known:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1]
        known *= 2
    return np.argsort(rank, kind="stable"), rank


def repeated_windows(tokens: list[np.ndarray], group: np.ndarray, pages: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows of RUN tokens that stand on ``needed`` different pages (3 at most) of a group.

    ``pages`` has, of each piece, the smallest and the greatest of its pages and their number.
    """
    piece, window, rank = sorted_windows(tokens, group)
    edge = np.flatnonzero(np.diff(rank, prepend=-1))
    interval = np.cumsum(np.diff(rank, prepend=-1) != 0) - 1
    # pieces of two pages at most name them all, so the union of those counts exactly
    pair = np.stack([np.tile(interval, 2), np.concatenate([pages[piece, 0], pages[piece, 1]])], 1)
    distinct = np.bincount(np.unique(pair, axis=0)[:, 0], minlength=len(edge))
    most = np.maximum.reduceat(pages[piece, 2], edge) if len(edge) else np.zeros(0, np.int64)
    hit = np.maximum(distinct, most)[interval] >= needed[piece]
    return piece[hit], window[hit]


def sorted_windows(tokens: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, window, rank) of all windows of RUN tokens, in suffix order; equal ones of a group have equal ranks."""
    size = np.array([len(t) for t in tokens])
    begin = np.cumsum(size + 1) - (size + 1)
    codes = np.empty(int(size.sum()) + len(tokens), np.int64)
    codes[begin + size] = -1 - np.arange(len(tokens))  # separators, all different
    inside = np.ones(len(codes), bool)
    inside[begin + size] = False
    codes[inside] = np.concatenate(tokens).astype(np.int64) & 0xFFFFFFFF | np.repeat(group, size) << 32
    order, rank = suffix_groups(codes)
    piece = np.searchsorted(begin, order, "right") - 1
    window = order - begin[piece]
    whole = window + RUN <= size[piece]
    return piece[whole], window[whole], rank[order[whole]]


def _repeats(batches):
    """Over rows of pieces sorted by host and seed: the repeated windows of each piece that has some."""

    def solve(held):
        t = pa.Table.from_batches(held).combine_chunks()
        tokens = [x.values.to_numpy() for x in t["tokens"]]
        host = t["host"].to_pylist()
        group = np.cumsum(np.array([True] + [x != y for x, y in zip(host[1:], host)])) - 1
        pages = np.stack([t[c].to_numpy() for c in ("low", "high", "pages")], 1)
        piece, window = repeated_windows(tokens, group, pages, t["needed"].to_numpy())
        order = np.lexsort((window, piece))
        piece, window = piece[order], window[order]
        has = np.unique(piece)
        rows = t.take(pa.array(has)).select(["host", "seed", "content"]).combine_chunks()
        lists = kernel.lists(window.astype(np.int32), np.searchsorted(has, piece), len(has))
        return pa.RecordBatch.from_arrays(
            [*(rows[c].combine_chunks() if rows.num_rows else pa.array([], rows[c].type) for c in rows.column_names), lists],
            ["host", "seed", "content", "windows"],
        )

    held, size, last = [], 0, None
    for batch in batches:
        host, seed = batch["host"].to_pylist(), batch["seed"].to_pylist()
        n_tokens = np.diff(batch["tokens"].offsets.to_numpy())
        begin = 0
        for k in range(len(seed)):
            if size >= SORT_TOKENS and (host[k], seed[k]) != last:
                held.append(batch.slice(begin, k - begin))
                yield solve(held)
                held, size, begin = [], 0, k
            last = host[k], seed[k]
            size += int(n_tokens[k])
        held.append(batch.slice(begin))
    if size:
        yield solve(held)


def _single_windows(batches):
    """Each window of hot seeds' pieces with its hash."""
    for batch in batches:
        tokens = batch["tokens"]
        places = tokens.offsets.to_numpy()
        codes = tokens.values.to_numpy().astype(np.int64).view(_U)
        hashes = kernel.shingles(kernel.mix(codes), places.astype(np.int64), RUN, whole=False)
        n = np.maximum(np.diff(places) - RUN + 1, 0)
        at = np.arange(len(hashes[0])) - np.repeat(np.cumsum(n) - n, n)
        rows = pa.array(hashes[1])
        others = ["host", "seed", "content", "low", "high", "pages", "needed"]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c].take(rows) for c in others), pa.array(at.astype(np.int32)), pa.array(hashes[0].view(np.int64))],
            [*others, "at", "window"],
        )


def _marks(batches):
    """Of each page: whether it has blocks that repeats outside articles decide, its article by hash and size, and its short tokens.

    A task gives the tokens of equal articles of a host once.
    """
    seen = set()
    for batch in batches:
        html, host = batch["html"].to_pylist(), batch["host"].to_pylist()
        for a in range(0, len(html), 256):
            found = [blocks(h or "") for h in html[a : a + 256]]
            s = _Streams(found, article=True)
            size = np.diff(s.page)
            article = s.ranges(s.page[:-1], s.page[1:]).view(np.int64)
            first = np.zeros(len(found), bool)
            for k, x in enumerate(zip(host[a : a + 256], article.tolist())):
                first[k] = size[k] and x not in seen
                seen.add(x)
            tokens = s.short()
            packed = [tokens[s.page[k] : s.page[k + 1]].tobytes() if first[k] else None for k in range(len(found))]
            rows = slice(a, a + 256)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_key"][rows],
                    batch["host"][rows],
                    pa.array([any(_judged(f)) for f in found], pa.bool_()),
                    pa.array(article, mask=size == 0),
                    pa.array(size.astype(np.int64)),
                    pa.array(packed, pa.binary()),
                ],
                ["_key", "host", "asked", "article", "size", "tokens"],
            )


def _string_hashes(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each string of RUN tokens in rows that begin at ``first``."""
    hashes, row = kernel.shingles(kernel.mix(tokens.astype(np.int64).view(_U)), first.astype(np.int64), RUN, whole=False)
    return hashes.view(np.int64), row


def often_strings(tokens: list[np.ndarray]) -> np.ndarray:
    """Hashes of the strings of RUN tokens that stand in half of these articles, by their suffix array."""
    article, window, rank = sorted_windows(tokens, np.zeros(len(tokens), np.int64))
    new = np.diff(rank, prepend=-1) != 0
    interval = np.cumsum(new) - 1
    other = new | (np.diff(article, prepend=-1) != 0)  # equal suffixes stand in the order of their articles
    edge = np.flatnonzero(new)[2 * np.bincount(interval[other]) >= len(tokens)]
    begin = np.cumsum([0, *map(len, tokens)])[article[edge]] + window[edge]
    strings = np.concatenate(tokens)[begin[:, None] + np.arange(RUN)].ravel()
    return _string_hashes(strings, np.arange(0, len(strings) + 1, RUN))[0]


def _often(part: pa.Table) -> pa.Table:
    first = np.unique(part["article"].to_numpy(), return_index=True)[1]
    found = often_strings([np.frombuffer(part["tokens"][int(k)].as_py(), np.uint16) for k in first])
    return pa.table({"host": pa.array([part["host"][0].as_py()] * len(found), pa.string()), "string": pa.array(found)})


def _strings(batches):
    """Places of a host's ``often`` strings in its articles, with hashes of their whole tokens."""
    for batch in batches:
        html, often = batch["html"].to_pylist(), batch["often"].to_pylist()
        for a in range(0, len(html), 256):
            s = _Streams([blocks(h or "") for h in html[a : a + 256]], article=True)
            short, row = _string_hashes(s.short(), s.page)
            string = kernel.shingles(s.words, s.page, RUN, whole=False)[0].view(np.int64)
            at = np.arange(len(row)) - np.searchsorted(row, row)
            edge = np.searchsorted(row, np.arange(len(s.page)))
            keep = [np.isin(short[x:y], w) for x, y, w in zip(edge, edge[1:], often[a : a + 256])]
            keep = np.flatnonzero(np.concatenate(keep))
            rows = pa.array(a + row[keep])
            article = s.ranges(s.page[:-1], s.page[1:]).view(np.int64)[row[keep]]
            yield pa.RecordBatch.from_arrays(
                [batch["_key"].take(rows), batch["host"].take(rows), pa.array(article), pa.array(string[keep]), pa.array(at[keep].astype(np.int32))],
                ["_key", "host", "article", "string", "at"],
            )


def _texts(batches):
    """Text of each page, by its markup and the places where its host's repeats begin outside articles and in them."""
    for batch in batches:
        html = batch["html"].to_pylist()
        hits, article_hits = batch["hits"].to_pylist(), batch["article_hits"].to_pylist()
        out = []
        for a in range(0, len(html), 256):
            found = [blocks(h or "") for h in html[a : a + 256]]
            boilerplate = [[False] * len(f) for f in found]
            for article, at in ((False, hits[a : a + 256]), (True, article_hits[a : a + 256])):
                if not any(at):
                    continue
                s = _Streams(found, article)
                covered, size = s.covered(at), np.diff(s.block)
                for k, f in enumerate(found):
                    of_page = slice(s.blocks_of[k], s.blocks_of[k + 1])
                    if article and size[of_page][covered[of_page]].sum() > ARTICLE_SHARE * size[of_page].sum():
                        continue  # a near copy of other articles
                    places = [i for i, (z, _) in enumerate(f) if (z == "article") == article]
                    for i, c in zip(places, covered[of_page].tolist()):
                        boilerplate[k][i] = c
            out += ["\n\n".join(_kept(f, _judged(f), b)) for f, b in zip(found, boilerplate)]
        yield pa.RecordBatch.from_arrays(
            [batch["_id"], batch["_url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            ["_id", "_url", "text", "n_chars"],
        )


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def repeats(pages: DataFrame) -> DataFrame:
    """(_key, hits): places in the token streams of ``pages(_key, host, html)`` where repeats of RUN tokens begin.

    All pages of a host belong here; only those with blocks that repeats decide have rows.
    """
    pieces = common.saved(pages.select("_key", "host", "html").mapInArrow(_pieces, _PIECES), "page-pieces")
    key = ["host", "seed", "content"]
    asked = pieces.where("asked")
    needed = pieces.select("host", "page").distinct().groupBy("host").agg(F.least(F.count("*"), F.lit(MIN_PAGES)).alias("needed"))
    needed = common.saved(needed.where("needed > 1"), "host-pages")
    on_page = pieces.groupBy(*key, "page").agg(F.first("tokens").alias("tokens"))
    contents = on_page.groupBy(*key).agg(
        F.first("tokens").alias("tokens"), F.min("page").alias("low"), F.max("page").alias("high"), F.count("*").alias("pages")
    )
    contents = common.saved(contents.join(common.if_small(needed), "host"), "page-contents")
    hot = contents.groupBy("host", "seed").count().where(f"count > {HOT_PIECES}").select("host", "seed")
    hot = common.if_small(common.saved(hot, "hot-page-seeds"))
    found = (
        contents.join(hot, ["host", "seed"], "left_anti")
        .repartition("host", "seed")
        .sortWithinPartitions("host", "seed")
        .mapInArrow(_repeats, "host string, seed long, content long, windows array<int>")
    )
    kinds = "host string, seed long, content long, low long, high long, pages long, needed long, at int, window long"
    single = contents.join(hot, ["host", "seed"], "left_semi").mapInArrow(_single_windows, kinds)
    each = single.select("host", "window", "pages", "needed", F.explode(F.array("low", "high")).alias("page"))
    often = (
        each.groupBy("host", "window")
        .agg(F.count_distinct("page").alias("n"), F.max("pages").alias("most"), F.max("needed").alias("needed"))
        .where("greatest(n, most) >= needed")
    )
    of_hot = single.join(often.select("host", "window"), ["host", "window"]).groupBy(*key).agg(F.collect_list("at").alias("windows"))
    flagged = common.saved(found.unionByName(of_hot), "page-repeats")
    places = asked.join(flagged, key).select("_key", F.transform("windows", lambda w: w + F.col("start")).alias("at"))
    return places.groupBy("_key").agg(F.flatten(F.collect_list("at")).alias("hits"))


def article_repeats(pages: DataFrame, marks: DataFrame) -> DataFrame | None:
    """(_key, article_hits): places in articles of ``pages(_key, host, html)`` where strings begin that stand in half of the host's.

    ``marks`` are those of :func:`_marks`.  None if no string stands in that many.
    """
    different = marks.where("article IS NOT NULL").select("host", "article", "size").distinct()
    hosts = different.groupBy("host").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where(f"n >= {MIN_ARTICLES}")
    parts = f"least(size div {PART_TOKENS}, n div {2 * MIN_ARTICLES}) + 1 AS parts"
    hosts = common.saved(hosts.selectExpr("host", f"greatest({MIN_ARTICLES}, (n + 1) div 2) AS needed", parts), "host-articles")
    hosts = common.if_small(hosts)
    streams = marks.where("tokens IS NOT NULL").select("host", "article", "tokens").join(hosts, "host")
    streams = streams.withColumn("part", F.expr("pmod(xxhash64(article), parts)")).select("host", "part", "article", "tokens")
    often = common.saved(streams.groupBy("host", "part").applyInArrow(_often, "host string, string long").distinct(), "often-strings")
    if not often.limit(1).count():
        return None
    often = common.if_small(common.saved(often.groupBy("host").agg(F.collect_list("string").alias("often")), "often-of-host"))
    found = pages.select("_key", "host", "html").join(often, "host")
    found = common.saved(found.mapInArrow(_strings, "_key long, host string, article long, string long, at int"), "string-places")
    spread = found.groupBy("host", "string").agg(F.count_distinct("article").alias("n")).join(hosts, "host")
    shared = common.if_small(common.saved(spread.where("n >= needed").select("host", "string"), "article-strings"))
    hits = found.join(shared, ["host", "string"]).groupBy("_key").agg(F.collect_list("at").alias("article_hits"))
    return common.saved(hits, "article-hits")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Text of every page: ``id_col``, ``url_col``, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined by an empty line.  Null, empty and text-free pages
    give an empty text.  Pages whose url has no host form one host.  Repeated
    rows are pages of their own but count once as evidence.  A tag whose quotes
    don't close ends at its first ``>``; without one, the rest of the page is
    text.  A header element is left out inside an article too.  An empty table
    gives an empty result; other columns are ignored.
    """
    keyed, _ = common.row_keyed(
        pages.select(
            F.col(id_col).alias("_id"),
            F.col(url_col).alias("_url"),
            host_of(F.col(url_col)).alias("host"),
            F.col(html_col).alias("html"),
        ),
        "_id",
        "html",
    )
    kind = pages.schema[id_col].dataType.simpleString()
    kinds = "_key long, host string, asked boolean, article long, size long, tokens binary"
    marks = common.saved(keyed.select("_key", "host", "html").mapInArrow(_marks, kinds), "page-marks")
    judged = keyed
    asked = marks.where("asked")
    if asked.limit(1).count():  # hosts whose pages all have articles and no doubtful blocks have nothing to judge outside them
        hosts = common.if_small(common.saved(asked.select("host").distinct(), "asked-hosts"))
        hits = common.saved(repeats(keyed.join(hosts, "host", "left_semi")), "page-hits")
        judged = judged.join(common.if_small(hits), "_key", "left")
    else:
        judged = judged.withColumn("hits", F.lit(None).cast("array<int>"))
    found = article_repeats(keyed, marks)
    if found is not None:
        judged = judged.join(common.if_small(found), "_key", "left")
    else:
        judged = judged.withColumn("article_hits", F.lit(None).cast("array<int>"))
    out = judged.select("_id", "_url", "html", "hits", "article_hits")
    out = out.mapInArrow(_texts, f"_id {kind}, _url string, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})
