"""Main text of web pages, with a suffix array over the pages of each host.

Each page is cut into blocks, and each block is in one of three zones: the article (article and main elements), furniture
(menus, headers, footers, sidebars, notices, adverts, forms, comments, by element or by a whole name in class, id or
role; inside an article only by element, or if it is named as advert or comment), or open (all else). The token streams of a host's pages are concatenated and their suffixes sorted; substrings of at least
`length` tokens that occur in several distinct pages are boilerplate. Zones are a prior: the text is taken from the
article or, of a page without one, from the open zone. In the open zone all boilerplate goes. In an article runs of at
least `long` tokens of boilerplate go; an article that would lose half of its tokens is an edited copy of other articles
and is kept whole. Pages with equal token streams count as one page, so copies don't erase each other.

A host with more pages than `chunk` is dealt over several groups by a hash of the page, so a group stays small at any
size. Repeats are counted over the whole host all the same, in two exchanges of keys, and the result doesn't depend on `chunk`. First each group sends short keys of its windows' anchors (of each window of `length`
tokens the part of half that length with the smallest hash) and learns which may lie in enough pages; of windows with such
an anchor it then sends whole hashes and the token streams they stand in, and learns which do. Its suffix array covers them.

Nulls and ties: a null html is empty and gives an empty text. A null url is a host of its own, the empty one. Repeated
rows and repeated or null ids each get a row. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import words as W
from arealis.llm.batches import stored

#: Elements whose content is no text, furniture, the article, inline elements and elements without end.
SILENT = frozenset("script style template noscript svg math title iframe object canvas select option textarea button audio video".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title".split())
#: Names in class, id or role that make an element furniture, everywhere and outside articles; only whole names count.
ASIDES = frozenset("ad ads advert advertisement adsbygoogle comment comments comment-list disqus_thread".split())
NAMES = ASIDES | frozenset("""banner sponsor sponsored promo cookie cookies cookie-notice cookie-banner consent notice notices menu main-menu nav navbar
    navigation breadcrumb breadcrumbs sidebar side header site-header masthead footer site-footer disqus share sharing social related popup modal
    newsletter subscribe login signup complementary contentinfo search""".split())
MAIN_NAMES = frozenset("main article articlebody".split())
NAME, STOP = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>]+)))?")
ENDS = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
OPEN, MAIN, OUT = 0, 1, 2


def names(attributes: str) -> set[str]:
    """The names in class, id, role and itemprop."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return {x for k in ("class", "id", "role", "itemprop") for x in found.get(k, "").lower().split()}


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order, without empty ones. One pass over the page, whatever it holds.

    A tag ends at the first > outside quotes. Once a page has a quote that is never closed, quotes count no more in it."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}  # how many of each element are on the stack
    text: list[str] = []
    zone, quotes = OPEN, True
    at = begin = 0  # where to look for a tag; where the text before it begins

    def close() -> None:
        if text:
            if zone >= 0 and (t := " ".join(html.unescape("".join(text)).split())):
                found.append((zone, t))
            text.clear()

    def shut(name: str) -> None:
        nonlocal zone
        while open_.get(name):
            top, zone = stack.pop()
            open_[top] -= 1
            if top == name:
                return

    def end_of(at: int) -> int:
        """The place after a tag's end, or -1."""
        nonlocal quotes
        p = at
        while quotes and (m := STOP.search(page, p)):
            if m[0] == ">":
                return m.end()
            p = page.find(m[0], m.end()) + 1
            if not p:
                quotes = False
        return page.find(">", at) + 1 or -1

    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            mark = next((z for a, z in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(a, at)), None)
            end = page.find(mark or ">", at + 4 if mark else at)
            if end < 0 and not mark:
                break
            text.append(page[begin:at])
            at = begin = len(page) if end < 0 else end + len(mark or ">")
            continue
        closing = page.startswith("/", at + 1)
        if not (m := NAME.match(page, at + 1 + closing)):
            at += 1
            continue
        if (end := end_of(m.end())) < 0:
            break
        name, said = m[0].lower(), page[m.end() : end - 1]
        text.append(page[begin:at])
        at = begin = end
        if name not in INLINE:
            close()
        if closing:
            shut(name)
            continue
        if name in RAW:
            last = ENDS[name].search(page, at)
            at = begin = last.end() if last else len(page)
            continue
        if name in VOID or said.endswith("/"):
            continue
        if name not in INLINE and stack and stack[-1][0] == "p":
            shut("p")
        before = zone
        if zone >= 0:
            called = names(said) if said else set()
            after = zone
            if name in SILENT:
                after = -1
            elif zone == MAIN and (name in FURNITURE and name != "header" or called & ASIDES) or zone == OPEN and (name in FURNITURE or called & NAMES and name not in ("html", "body")):
                after = OUT
            elif zone == OPEN and (name in ARTICLE or called & MAIN_NAMES):
                after = MAIN
            if after != zone:
                close()
                zone = after
        stack.append((name, before))
        open_[name] = open_.get(name, 0) + 1
    rest = page[begin:]
    text.append(rest.split("<", 1)[0] if re.match(r"[^<]*<[a-zA-Z/!]", rest) else rest)
    close()
    return found


def repeated(tokens: np.ndarray, page: np.ndarray, length: int, pages: int, known: np.ndarray | None = None) -> np.ndarray:
    """Which tokens are covered by substrings of at least `length` that occur in at least `pages` distinct pages, or start where `known` says so.

    A suffix array by doubling: suffixes are ranked by 1, 2, 4 ... tokens until `length` tokens are compared; equal
    neighbours then share that prefix."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < length:
        step = min(done, length - done)
        other = np.full(n, -1, np.int64)
        other[: n - step] = np.where(page[: n - step] == page[step:], rank[step:], -1 - np.arange(n - step))
        other[n - step :] = -1 - np.arange(n - step, n)
        order = np.lexsort((other, rank))
        new = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (other[order][1:] != other[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        done += step
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    distinct = np.bincount(r, first)
    if known is not None:
        distinct[rank[known]] = pages
    return W.cover(n, np.flatnonzero(distinct[rank] >= pages), length)


class Streams:
    """The token streams of a group of pages. `one`: the first page of each stream; `salt`: a hash of the host."""

    def __init__(self, table: pa.Table):
        import zstandard as zstd

        unpack = zstd.ZstdDecompressor().decompress
        whole = [unpack(x).decode() for x in table.column("blocks").to_pylist()]
        self.texts = [x.split("\n") if x else [] for x in whole]  # white space in blocks is single spaces
        self.block_page = np.repeat(np.arange(len(self.texts)), [len(x) for x in self.texts])
        self.w = W.words_of(pa.array([t for x in self.texts for t in x], pa.string()))
        self.h = self.w.hashes()
        self.page = self.block_page[self.w.text] if len(self.w) else np.zeros(0, np.int64)
        first = np.searchsorted(self.page, np.arange(len(self.texts) + 1))
        self.spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        self.names = np.array([_digest(self.h[a:b].tobytes()) for a, b in self.spans], np.uint64)
        self.stream = [self.h[a:b].tobytes() for a, b in self.spans]
        seen: dict[bytes, int] = {}
        self.one = np.array([seen.setdefault(x, k) == k for k, x in enumerate(self.stream)], bool)
        self.host, self.part = table.column("host")[0].as_py(), table.column("part")[0].as_py()
        self.salt = np.uint64(_digest(self.host.encode()))

    def windows(self, length: int) -> np.ndarray:
        """Where windows of pages with distinct streams begin."""
        n = len(self.h) - length + 1
        return np.flatnonzero((self.page[:n] == self.page[length - 1 :]) & self.one[self.page[:n]]) if n > 0 else np.zeros(0, np.int64)

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        return W.mix(W.grams(self.h, length)[at] ^ self.salt)

    def anchors(self, at: np.ndarray, length: int) -> np.ndarray:
        half = max(1, length // 2)
        g = W.grams(self.h, half)
        low = g[at]
        for i in range(1, length - half + 1):
            low = np.minimum(low, g[at + i])
        return W.mix(low ^ self.salt)

    def request(self, slices: int, keys: np.ndarray, values: np.ndarray, more: np.ndarray) -> pa.Table:
        """Rows of REQUEST for sorted slices of keys; values are what is sent of them."""
        order = np.lexsort((values, keys % np.uint64(slices)))
        of = (keys % np.uint64(slices))[order].astype(np.int64)
        values, more = values[order], more[order]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        ends = np.concatenate([at[1:], [len(of)]]) if len(of) else at
        cells = [[x[a:b].tobytes() for a, b in zip(at, ends, strict=True)] for x in (values, more)]
        return _rows(self, of[at], *cells)


REQUEST, REPLY = "host string, part long, slice int, keys binary, more binary", "host string, part long, slice int, reply binary"


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")


def _rows(s: Streams, of: np.ndarray, keys: list[bytes], more: list[bytes]) -> pa.Table:
    n = len(of)
    return pa.table([pa.array([s.host] * n, pa.string()), pa.array([s.part] * n, pa.int64()), pa.array(of, pa.int32()), pa.array(keys, pa.binary()), pa.array(more, pa.binary())], ["host", "part", "slice", "keys", "more"])


def _unread(table: pa.Table, kind: str, more: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and rows of all requests of a slice."""
    keys = [np.frombuffer(x, kind) for x in table.column("keys").to_pylist()]
    return np.concatenate(keys), np.concatenate([np.frombuffer(x, more) for x in table.column("more").to_pylist()]), np.repeat(np.arange(len(keys)), [len(x) for x in keys])


def _replies(table: pa.Table, keys: np.ndarray, row: np.ndarray, hit: np.ndarray) -> pa.Table:
    """To each request those of its keys that were hit; requests without any get no row."""
    keys, row = keys[hit], row[hit]
    at = np.searchsorted(row, np.arange(table.num_rows + 1))
    full = np.flatnonzero(np.diff(at))
    return table.select(["host", "part", "slice"]).take(pa.array(full)).append_column("reply", pa.array([keys[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()))


def whole_host(pages: DataFrame, length: int, least: int, slices: int) -> DataFrame:
    """Rows of REPLY: the hashes of each group's windows that lie in at least `least` distinct pages of the host. Groups with part -1 are whole hosts and ask nothing."""
    few = np.uint64(slices)
    empty = pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary())], ["host", "part", "slice", "keys", "more"])

    def first(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return empty
        s = Streams(table)
        at = s.windows(length)
        if not len(at):
            return empty
        key, page = s.anchors(at, length), s.page[at]
        order = np.lexsort((page, key))
        key, page = key[order], page[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        counts = np.add.reduceat((new | np.concatenate([[True], page[1:] != page[:-1]])).astype(np.int64), np.flatnonzero(new))
        key = key[new]
        return s.request(slices, key, (key // few).astype(np.uint32), np.minimum(counts, least).astype(np.uint16))

    def maybe(table: pa.Table) -> pa.Table:
        keys, n, row = _unread(table, "uint32", "uint16")
        _, of = np.unique(keys, return_inverse=True)
        return _replies(table, keys, row, (np.bincount(of, n) >= least)[of])

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows:
            return empty
        s = Streams(table)
        at = s.windows(length)
        key = s.anchors(at, length)
        sent = [(np.frombuffer(x, np.uint32).astype(np.uint64), k) for x, k in zip(replies.column("reply").to_pylist(), replies.column("slice").to_pylist(), strict=True)]
        of, low = key % few, (key // few).astype(np.uint32).astype(np.uint64)
        wanted = np.concatenate([x * few + np.uint64(k) for x, k in sent])
        at = at[np.isin(low * few + of, wanted)]
        key, name = s.keys(at, length), s.names[s.page[at]]
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        pair = new | np.concatenate([[True], name[1:] != name[:-1]])
        key, name, new = key[pair], name[pair], new[pair]
        begin = np.flatnonzero(new)
        rank = np.arange(len(key)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(key)]])))
        key, name = key[rank < least], name[rank < least]  # more pages than needed say nothing more
        return s.request(slices, key, key, name)

    def surely(table: pa.Table) -> pa.Table:
        keys, names, row = _unread(table, "uint64", "uint64")
        distinct, of = np.unique(keys, return_inverse=True)
        order = np.lexsort((names, of))
        o, m = of[order], names[order]
        pair = np.concatenate([[True], (o[1:] != o[:-1]) | (m[1:] != m[:-1])])
        return _replies(table, keys, row, (np.bincount(o[pair], minlength=len(distinct)) >= least)[of])

    groups = ["host", "part"]
    candidates = pages.groupBy(*groups).applyInArrow(first, REQUEST).groupBy("slice").applyInArrow(maybe, REPLY)
    return pages.groupBy(*groups).cogroup(candidates.groupBy(*groups)).applyInArrow(second, REQUEST).groupBy("slice").applyInArrow(surely, REPLY)


def long_runs(marks: np.ndarray, length: int) -> np.ndarray:
    """The marks that stand in runs of at least `length`."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    return W.cover(len(marks), begin[size >= length], size[size >= length])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = 8, least: int = 3, chunk: int = 400, long: int = 16) -> DataFrame:
    """One row per page: page_id, url, text, n_boilerplate (tokens of the article or open zone left out, as they repeat over the host's pages)."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^.*?://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"))
    hot = stored(sizes.where(F.col("n") > chunk).select("host", "n", F.ceil(F.col("n") / chunk).alias("groups")), "large-hosts")
    many = hot.agg(F.sum("n")).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        pack = zstd.ZstdCompressor(level=3).compress
        for b in batches:
            found = [blocks(x or "") for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array([bytes(z for z, _ in x) for x in found], pa.binary()), pa.array([pack("\n".join(t for _, t in x).encode()) for x in found], pa.binary())], ["page_id", "url", "host", "part", "zones", "blocks"])

    def cover_and_keep(table: pa.Table, replies: pa.Table | None) -> pa.Table:
        zones = [np.frombuffer(x, np.uint8) for x in table.column("zones").to_pylist()]
        s = Streams(table)
        texts, block_page, w, h, page = s.texts, s.block_page, s.w, s.h, s.page
        covered = np.zeros(len(w), bool)
        if len(w) >= length:
            distinct = np.flatnonzero(s.one[page])
            known = np.zeros(len(w), bool)
            if replies is not None and replies.num_rows:
                at = s.windows(length)
                sure = np.concatenate([np.frombuffer(x, np.uint64) for x in replies.column("reply").to_pylist()])
                known[at[np.isin(s.keys(at, length), sure)]] = True
            gone = repeated(h[distinct], page[distinct], length, least, known[distinct])
            marks = {s.stream[k]: gone[a:b] for k, a, b in ((k, *np.searchsorted(page[distinct], [k, k + 1])) for k in np.flatnonzero(s.one))}
            for (a, b), stream in zip(s.spans, s.stream, strict=True):
                covered[a:b] = marks[stream]
        out, counts = [], []
        for k, (z, x) in enumerate(zip(zones, texts, strict=True)):
            article = (z == MAIN).any()
            base = np.searchsorted(block_page, k)
            chosen = [j for j in range(len(x)) if z[j] == (MAIN if article else OPEN)]
            spans = [(w.first[base + j], w.first[base + j + 1]) for j in chosen]
            gone = np.concatenate([covered[a:b] for a, b in spans]) if spans else np.zeros(0, bool)
            if article:
                gone = long_runs(gone, long)
                if 2 * gone.sum() >= len(gone):
                    gone[:] = False
            kept, at = [], 0
            for j, (a, b) in zip(chosen, spans, strict=True):
                own = gone[at : at + b - a]
                at += b - a
                if article and not own.any():
                    kept.append(x[j])
                elif not own.all():
                    kept.append(" ".join(w.bytes_of(a + i).decode() for i in np.flatnonzero(~own)))
            out.append(" ".join(kept))
            counts.append(int(gone.sum()))
        return pa.table([table.column("page_id"), table.column("url"), pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_boilerplate"])

    # Spark sends the large hosts to all tasks if they are few by its own measure
    dealt = rows.join(hot.drop("n"), "host", "left").select("page_id", "url", "host", "html", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("groups")), F.lit(-1)).cast("long").alias("part"))
    cut_pages = dealt.mapInArrow(cut, "page_id long, url string, host string, part long, zones binary, blocks binary")
    schema = "page_id long, url string, text string, n_boilerplate long"
    groups = cut_pages.groupBy("host", "part")

    def keep(table: pa.Table) -> pa.Table:
        return cover_and_keep(table, None)

    def keep_known(table: pa.Table, replies: pa.Table) -> pa.Table:
        return cover_and_keep(table, replies)

    if not many:
        return groups.applyInArrow(keep, schema)
    found = whole_host(cut_pages, length, least, max(64, many // 32_000))

    return groups.cogroup(found.groupBy("host", "part")).applyInArrow(keep_known, schema)
