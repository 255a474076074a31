"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is some megabytes of documents inside a Spark task. Its suffix array holds the suffixes that begin as some
benchmark text does; all others can't match. Every distinct window of the benchmark's suffixes is looked up by binary
search, which gives the range of places where it occurs word for word: ranges are kept, not pairs of places and windows,
so repeated words cost no more than others. Matches are then followed to their longest extent and located: documents and
items that meet are ranked together by doubling, and each suffix is compared with its neighbours among the items.
Documents never leave their task, so there is no shuffle. Words are found by a hash and compared byte by byte.

The benchmark is sent to the tasks in blocks of at most `block_bytes`; with several blocks the documents are marked and
stored once for each, so that the driver and the tasks hold one block at a time.

Nulls and ties: a null or wordless text has no windows and is clean. Items with null or wordless text are ignored. An
item with a null id still marks words, but isn't listed. Repeated items count once; repeated documents each get a row.
Of equally long matches at a word, one is named. Other columns of the inputs aren't read. An empty table of documents
gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import words as W
from arealis.llm.batches import blocked, stored, work_dir

MATCH = "array<struct<start:long,length:long,item_id:string,item_start:long>>"
KINDS = {"doc_id": "long", "text": "string", "hit": "binary", "n_words": "long", "items": "array<string>", "matches": MATCH}
_MATCHES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after another."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Tests:
    """The benchmark's suffixes: word ranks, and its distinct windows with their items."""

    def __init__(self, table: pa.Table, window: int):
        w = self.w = W.words_of(table.column("text"), W.NOT_ALNUM, lower=True)
        self.vocabulary, first, ranks = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.at, self.long = w.start[first], (w.end - w.start)[first]
        if not (np.array_equal(self.long[ranks], w.end - w.start) and W.same(w.buf, w.start, w.buf, self.at[ranks], self.long[ranks]).all()):
            raise ValueError("two words of the benchmark share a digest")
        self.ranks = ranks.astype(np.uint64) + np.uint64(1)
        self.ids = table.column("item_id").to_pylist()
        self.per = max(1, 64 // max(1, int(len(self.vocabulary)).bit_length()))
        self.bits = np.uint64(64 // self.per)
        self.depth = -(-window // self.per)
        n, at = w.counts(), np.arange(len(w)) - w.first[w.text] if len(w) else np.zeros(0, np.int64)
        size = np.minimum(n, window)[w.text]
        place = np.flatnonzero(at + size <= n[w.text])
        # equal windows are one: its first place, its number of words, its items
        size, item = size[place], w.text[place]
        keys = [size, *self.bounds(place, size, 0)]
        order = np.lexsort((item, *keys[::-1]))
        new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]) if len(place) else np.zeros(0, bool)
        self.place, self.size = place[order][new], size[order][new]
        self.items = item[order]
        self.first_item = np.concatenate([np.flatnonzero(new), [len(order)]])

    def rank(self, w: W.Words) -> np.ndarray:
        """1 and more for the benchmark's words, 0 for others."""
        h = w.hashes()
        rank = np.searchsorted(self.vocabulary, h)
        rank[rank == len(self.vocabulary)] = 0
        known = np.flatnonzero((self.vocabulary[rank] == h) & (self.long[rank] == w.end - w.start))
        known = known[W.same(w.buf, w.start[known], self.w.buf, self.at[rank[known]], self.long[rank[known]])]
        out = np.zeros(len(w), np.uint64)
        out[known] = rank[known] + 1
        return out

    def keys(self, ranks: np.ndarray, text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The first words of the suffixes at `at`, packed into integers that sort as the words do."""
        out = []
        for d in range(self.depth):
            key = np.zeros(len(at), np.uint64)
            for j in range(d * self.per, (d + 1) * self.per):
                p = np.minimum(at + j, len(ranks) - 1)
                key = (key << self.bits) | np.where((at + j < len(ranks)) & (text[p] == text[at]), ranks[p], np.uint64(0))
            out.append(key)
        return out

    def bounds(self, place: np.ndarray, size: np.ndarray, fill: int) -> list[np.ndarray]:
        """Keys of the windows, with `fill` bits for the words after each."""
        out = []
        for d in range(self.depth):
            key = np.zeros(len(place), np.uint64)
            for j in range(d * self.per, (d + 1) * self.per):
                p = np.minimum(place + j, len(self.ranks) - 1)
                key = (key << self.bits) | np.where(j < size, self.ranks[p], np.uint64(fill * (2 ** int(self.bits) - 1)))
            out.append(key)
        return out


def search(sorted_keys: list[np.ndarray], query: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search for many queries at once; keys and queries are given column by column."""
    n = len(sorted_keys[0])
    lo, hi = np.zeros(len(query[0]), np.int64), np.full(len(query[0]), n)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, q in zip(sorted_keys, query, strict=True):
            less |= same & (k[mid] < q)
            same &= k[mid] == q
        if right:
            less |= same
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def occurrences(ranks: np.ndarray, text: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shard's suffix array as far as it matters, and the range of it where each window of the tests occurs."""
    none = np.zeros(len(tests.place), np.int64)
    known = ranks > 0
    if len(tests.place) and tests.size.min() > 1:  # suffixes that begin with two words that follow each other in no item can't match
        base = np.uint64(len(tests.vocabulary) + 1)
        pairs = np.unique(tests.ranks[:-1] * base + tests.ranks[1:])
        mine = ranks[:-1] * base + ranks[1:]
        found = np.searchsorted(pairs, mine)
        known[:-1] &= pairs[np.minimum(found, len(pairs) - 1)] == mine
        known[-1:] = False
    at = np.flatnonzero(known)
    if not len(at) or not len(tests.place):
        return at[:0], none, none
    keys = tests.keys(ranks, text, at)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    lo = search(keys, tests.bounds(tests.place, tests.size, 0), False)
    hi = search(keys, tests.bounds(tests.place, tests.size, 1), True)
    return at[order], lo, np.maximum(lo, hi)


def longest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a the length of the longest run that starts there and occurs in b, and where in b.

    Values below 0 match nothing. Runs are shorter than `most`. All suffixes are ranked by 1, 2, 4 ... values; neighbours
    in the order are then compared from the longest prefix down."""
    both = np.concatenate([a, b]).astype(np.int64)
    n = len(both)
    alone = np.flatnonzero(both < 0)
    both[alone] = both.max(initial=0) + 1 + np.arange(len(alone))
    levels = [np.unique(both, return_inverse=True)[1].astype(np.int64)]
    while (step := 1 << (len(levels) - 1)) < most and levels[-1].max(initial=0) < n - 1:
        next_ = np.full(n, -1, np.int64)
        next_[: n - step] = levels[-1][step:]
        levels.append(np.unique(levels[-1] * np.int64(n + 1) + next_ + 1, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(levels[-1], kind="stable")
    where = np.where(order >= len(a), np.arange(n), -1)
    before, after = np.maximum.accumulate(where), n - 1 - np.maximum.accumulate(np.where(where >= 0, n - 1 - where, -1)[::-1])[::-1]
    after[after >= n] = -1
    mine = np.flatnonzero(order < len(a))
    length, at = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for near in (before, after):
        p, q = order[mine], np.where(near[mine] >= 0, order[np.maximum(near[mine], 0)], n)
        off = np.zeros(len(p), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = p + off, q + off
            ok = (x < n) & (y < n)
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            off[ok] += 1 << k
        better = off > length[p]
        length[p[better]], at[p[better]] = off[better], q[better] - len(a)
    return length, at


def located(w: W.Words, ranks: np.ndarray, starts: np.ndarray, tests: Tests, docs: np.ndarray, items: np.ndarray) -> pa.Array:
    """The maximal matches of each document; docs and items: those that meet; starts: places where a window begins."""
    d = _ranges(w.first[docs], w.first[docs + 1])
    i = _ranges(tests.w.first[items], tests.w.first[items + 1])
    cut = lambda values, text: np.insert(values, np.flatnonzero(np.diff(text)) + 1, -1)  # noqa: E731  texts don't run into each other
    x = cut(np.where(ranks[d] > 0, ranks[d].astype(np.int64), -1), w.text[d])
    y = np.append(cut(tests.ranks[i].astype(np.int64), tests.w.text[i]), -1)
    size, at = longest(np.append(x, -1), y, int(tests.w.counts()[items].max(initial=0)) + 1)
    # back to places of the shard and of the tests
    size, at = (z[np.arange(len(d)) + np.searchsorted(docs, w.text[d])] for z in (size, at))
    turn = np.full(len(y) + 1, -1, np.int64)
    turn[np.arange(len(i)) + np.searchsorted(items, tests.w.text[i])] = i
    begins = np.zeros(len(w), bool)
    begins[starts] = True
    first = begins[d]
    first[1:] &= ~(begins[d[:-1]] & (w.text[d[1:]] == w.text[d[:-1]]) & (size[:-1] == size[1:] + 1))
    d, size, source = d[first], size[first], turn[at[first]]
    item = tests.w.text[source]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(w.text[d], minlength=len(w.ends)))])
    fields = [pa.array(d - w.first[w.text[d]]), pa.array(size), pa.array([tests.ids[k] for k in item.tolist()], pa.string()), pa.array(source - tests.w.first[item])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "item_id", "item_start"])).cast(_MATCHES)


def marked(b: pa.RecordBatch, tests: Tests) -> list[pa.Array]:
    """The columns of KINDS after doc_id and text."""
    w = W.words_of(b.column(1), W.NOT_ALNUM, lower=True)
    ranks = tests.rank(w) if len(tests.vocabulary) else np.zeros(len(w), np.uint64)
    array, lo, hi = occurrences(ranks, w.text, tests)
    hit = np.zeros(len(w), bool)
    full, pairs, starts = np.flatnonzero(hi > lo), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    windows = np.int64(max(1, len(lo)))
    for size in np.unique(tests.size[full]).tolist():  # ranges of windows of one size don't meet
        here = full[tests.size[full] == size]
        place = array[_ranges(lo[here], hi[here])]
        hit |= W.cover(len(w), place, size)
        starts.append(place)
        pairs.append(np.unique(w.text[place] * windows + np.repeat(here, hi[here] - lo[here])))
    pair = np.concatenate(pairs)
    doc, window = pair // windows, pair % windows
    n = tests.first_item[window + 1] - tests.first_item[window] if len(pair) else pair
    item = tests.items[_ranges(tests.first_item[window], tests.first_item[window] + n)] if len(pair) else pair
    met = np.unique(np.repeat(doc, n) * np.int64(len(tests.ids) + 1) + item)
    doc, item = met // (len(tests.ids) + 1), met % (len(tests.ids) + 1)
    items: list[set] = [set() for _ in range(len(b))]
    for d, t in zip(doc.tolist(), item.tolist(), strict=True):
        if tests.ids[t] is not None:
            items[d].add(tests.ids[t])
    matches = located(w, ranks, np.concatenate(starts), tests, np.unique(doc), np.unique(item)) if len(met) else pa.array([[]] * len(b), _MATCHES)
    marks = pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(w.first.astype(np.int32)), pa.py_buffer(hit.astype(np.uint8))])
    return [marks, pa.array(w.counts(), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), matches.cast(_MATCHES)]


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, text, hit (a byte per word, 1 if inside a window), n_words, items (ids of items with
    occurring windows, sorted), matches (longest verbatim matches: start word, words, item, start word there), and the
    columns to keep. Of runs that start where a window does, those are listed that don't merely end an earlier one."""
    spark = documents.sparkSession
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 16
    total = tests.agg(F.sum(size)).first()[0] or 0
    kinds, keep = dict(documents.dtypes), [c for c in keep or [] if c not in KINDS]
    names = [*KINDS, *keep]
    schema = ", ".join([*[f"{c} {k}" for c, k in KINDS.items()], *[f"`{c}` {kinds[c]}" for c in keep]])
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`") for c in keep])
    if total <= block_bytes:
        known = spark.sparkContext.broadcast(tests.toArrow())

        def look(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Tests(known.value, window)
            for b in W.pieces(rows, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *marked(b, items), *b.columns[2:]], names)

        return docs.mapInArrow(look, schema)
    # each block gives marks for the documents that it hits, without their texts; they meet the documents once
    tests, blocks = blocked(tests, size, block_bytes, "tests")
    docs = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    path, marks = work_dir(spark, "marks"), f"_row long, hit binary, items array<string>, matches {MATCH}"
    for i in range(blocks):
        sent = spark.sparkContext.broadcast(tests.where(F.col("block") == i).select("item_id", "text").toArrow())  # block_bytes and one text

        def mark(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Tests(sent.value, window)
            for b in W.pieces(rows, 1, 4 << 20):
                hit, _, found, matches = marked(b, items)
                some = pa.array([any(x) for x in hit.to_pylist()])
                yield pa.RecordBatch.from_arrays([x.filter(some) for x in (b.column(0), hit, found, matches)], ["_row", "hit", "items", "matches"])

        docs.select("_row", "text").mapInArrow(mark, marks).write.mode("append").parquet(path)
        sent.unpersist()
    parts = spark.read.schema(marks).parquet(path).groupBy("_row").agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))  # a row for each block at most
    rows = docs.join(parts, "_row", "left").select("doc_id", "text", "hits", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("matches", F.array().cast(MATCH)).alias("matches"), *[F.col(f"`{c}`") for c in keep])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, 1, 4 << 20):
            n = W.words_of(b.column(1), W.NOT_ALNUM, lower=True).counts()
            hits = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in found]).tobytes() if found else bytes(k) for found, k in zip(b.column(2).to_pylist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.binary()), pa.array(n), b.column(3), b.column(4), *b.columns[5:]], names)

    return rows.mapInArrow(unite, schema)


def n_hit(hit: str = "hit"):
    """Words inside a window, counted from the marks."""
    return F.length(F.translate(F.hex(hit), "0", "")).cast("long")
