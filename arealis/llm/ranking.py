"""Ranked search over bit-sliced Bloom signatures.

Index: documents lie in shards of some megabytes; within a shard, those with about as many distinct terms form a class.
A class has a bitmap for each row of its signature, with a bit for each document: a document sets some rows, chosen by
hash, for each of its terms. So the rows of a term, and-ed, hold at least the documents that have it. Further slices
hold the terms that occur 2, 4, 8 ... times, so that the rows also bound a term's frequency from above.

Search: a document's score is a sum of integers over an item's terms, each of which grows with the frequency. From the
slices follows a bound for every document and item, as weighted sums of bitmaps. The documents with the highest bounds
are scored exactly from their texts; then all others whose bound isn't below the k-th exact score so far. The rest can't
be among the k best. Shards of a task share their k best; the tasks' lists are merged by rank.

Memory: a shard is a row of some megabytes, and a row group of its own. Tasks write, read and search one after another,
so what a task holds doesn't grow with the shards that it has.

Score: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))); a document adds weight * ((10^9 tf) div (1000 tf + 8m))
for every term of the item, repeats included, where m = 25 + (75nN) div L. N: documents with a term; L: all their terms;
n: the document's; df: the documents that have the term; tf: its occurrences.

Nulls and ties: a null text has no term. Every row of documents counts and is ranked, repeated ones too; equal scores go
by ascending doc_id, null last. Every row of the items is an item, repeated ids too; an item without terms, or whose terms
no document has, gives no row. Other columns aren't read. An empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm import words as W
from arealis.llm.batches import BATCH_ROWS, NO_ID, arrow_bytes, blocked, stored, work_dir

U = np.uint64
SHARD_BYTES = 4 << 20
#: A searching task gets shards of so many bytes together, and one shard more.
READ_BYTES = 1 << 20
#: Slices for terms that occur 1, 2, 4 ... times.
LEVELS = 6
#: Rows that a term sets, and rows of a class for each distinct term of its largest document.
PROBES, ROWS_PER_TERM = 3, 8
#: Numbers in a matrix of bounds or of frequencies.
CELLS = 1 << 21
_HASH_BITS = U(46)
_SALTS = W.factors(PROBES, 7)
INDEX = "docs long, terms long, ids binary, counts binary, ends binary, text binary, classes array<struct<members:binary,slices:array<struct<level:int,rows:int,bits:binary>>>>"
_SLICES = pa.list_(pa.struct([("level", pa.int32()), ("rows", pa.int32()), ("bits", pa.binary())]))
_CLASSES = pa.list_(pa.struct([("members", pa.binary()), ("slices", _SLICES)]))


def probes(h: np.ndarray, rows: int) -> np.ndarray:
    """The rows that each term sets; h: the first bits of its digest."""
    return (W.mix(h[:, None] * _SALTS[None, :]) % U(rows)).astype(np.int64)


def signatures(w: W.Words) -> list[dict]:
    """The classes of a shard, as rows of INDEX. Terms of a document whose digests begin alike count as one, with all their occurrences, so bounds stay bounds."""
    if not len(w):
        return []
    key = np.sort((w.text.astype(U) << _HASH_BITS) | (w.hashes() >> (U(64) - _HASH_BITS)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(new, append=len(key))
    doc, h = (key[new] >> _HASH_BITS).astype(np.int64), key[new] & ((U(1) << _HASH_BITS) - U(1))
    distinct = np.bincount(doc, minlength=len(w.ends))
    size = np.array([(int(n).bit_length() + 1) // 2 for n in distinct.tolist()])  # distinct terms by powers of four; 0: none
    out = []
    for s in np.unique(size[size > 0]).tolist():
        members = np.flatnonzero(size == s)
        number = np.full(len(size), -1, np.int64)
        number[members] = np.arange(len(members))
        mine = number[doc] >= 0
        d, x, n = number[doc[mine]], h[mine], tf[mine]
        slices = []
        for level in range(LEVELS):
            often = n >= 1 << level
            if not often.any():
                break
            rows = ROWS_PER_TERM * int(np.bincount(d[often]).max())
            flat = np.zeros((rows, len(members)), bool)
            flat[probes(x[often], rows), d[often][:, None]] = True
            slices.append({"level": level, "rows": rows, "bits": np.packbits(flat, axis=1, bitorder="little").tobytes()})
        out.append({"members": members.astype(np.int32).tobytes(), "slices": slices})
    return out


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHARD_BYTES) -> DataFrame:
    """Stored shards, a row each: INDEX. ids: int64, NO_ID for null; counts: terms of each document; ends: where its text ends."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [x.split()[0] for x in INDEX.split(", ")], (pa.int64(), pa.int64(), *[pa.binary()] * 4, _CLASSES)
        for b in W.pieces(rows, 1, size):
            for part in (b.slice(i, BATCH_ROWS) for i in range(0, len(b), BATCH_ROWS)):
                buf, ends = W.buffers(part.column(1))
                w = W.Words(W.LOWER[buf], ends, W.NOT_ALNUM)
                n = w.counts()
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                row = [int((n > 0).sum()), int(n.sum()), ids.tobytes(), n.tobytes(), ends.tobytes(), buf.tobytes(), signatures(w)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with arrow_bytes(df.sparkSession, size * 3 // 4):  # mostly a shard, with the row that exceeds it
        return stored(rows.mapInArrow(run, INDEX), "signatures", group_rows=1)


def one_by_one(rows: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards of a task's batches, which arrow_bytes() keeps to about one."""
    for b in rows:
        for i in range(b.num_rows):
            yield Shard(b.slice(i, 1).to_pylist()[0])


class Items:
    """A block of items: the distinct terms of all, and each item's terms with how often it has them."""

    def __init__(self, table: pa.Table):
        w = W.words_of(table.column("text"), W.NOT_ALNUM, lower=True)
        self.ids, self.terms = table.column("item_id").combine_chunks(), W.Vocabulary(w)
        pair, n = np.unique(w.text * np.int64(max(1, len(self.terms))) + self.terms.number, return_counts=True)
        self.item, self.term = pair // max(1, len(self.terms)), pair % max(1, len(self.terms))
        self.repeats, self.first = n, np.searchsorted(self.item, np.arange(len(table) + 1))

    def weigh(self, docs: int, df: np.ndarray) -> None:
        """Weights of the terms, given the number of documents and how many have each term."""
        self.weight = np.array([int(1000 * log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """An item's terms, and for each its weight times its repeats."""
        span = slice(self.first[item], self.first[item + 1])
        return self.term[span], self.weight[self.term[span]] * self.repeats[span]


class Shard:
    """A row of the index in a task."""

    def __init__(self, row: dict):
        self.ids, self.counts, self.ends = (np.frombuffer(row[c], np.int64) for c in ("ids", "counts", "ends"))
        self.text, self.classes = np.frombuffer(row["text"], np.uint8), row.get("classes", [])

    def places(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the texts of some documents begin and end."""
        return np.where(docs > 0, self.ends[docs - 1], 0), self.ends[docs]

    def words(self, docs: np.ndarray) -> W.Words:
        """The words of some documents, which are numbered anew."""
        begin, end = self.places(docs)
        text = np.concatenate([self.text[:0], *(self.text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))])
        return W.Words(W.LOWER[text], np.cumsum(end - begin), W.NOT_ALNUM)

    def frequencies(self, docs: np.ndarray, terms: W.Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in docs, term, occurrences), exactly."""
        w = self.words(docs)
        term = terms.find(w)
        known = term >= 0
        pair, n = np.unique(w.text[known] * np.int64(max(1, len(terms))) + term[known], return_counts=True)
        return pair // max(1, len(terms)), pair % max(1, len(terms)), n


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms."""
    if 75 * int(n.max(initial=0)) * docs >= 1 << 63:  # beyond 64 bits
        return np.array([25 + 75 * x * docs // max(1, terms) for x in n.tolist()], np.int64)
    return 25 + 75 * n * docs // max(1, terms)


class Search:
    """The k best documents of each item among the shards that a task has seen."""

    def __init__(self, items: Items, docs: int, terms: int, k: int):
        self.items, self.docs, self.terms, self.k = items, docs, terms, k
        n = len(items.ids)
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), in order
        self.floor = np.ones(n, np.int64)  # a score below it isn't wanted
        self.heads = items.terms.keys >> (U(64) - _HASH_BITS)

    def see(self, shard: Shard) -> None:
        step = max(8, CELLS // max(1, len(self.items.terms), len(self.items.ids)) // 8 * 8)
        for c in shard.classes:
            members = np.frombuffer(c["members"], np.int32).astype(np.int64)
            width = -(-len(members) // 8)
            slices = [(np.frombuffer(s["bits"], np.uint8).reshape(s["rows"], width), probes(self.heads, s["rows"])) for s in c["slices"]]
            for lo in range(0, len(members), step):
                docs = members[lo : lo + step]
                bound = self.bounds(slices, lo // 8, shard.counts[docs])
                scored = np.zeros(bound.shape, bool)
                for first in (True, False):
                    open_ = (bound >= self.floor[:, None]) & ~scored
                    if first and bound.shape[1] > self.k:  # the highest bounds first: they raise the floor
                        top = np.argpartition(-bound, self.k - 1, axis=1)[:, : self.k]
                        high = np.zeros(bound.shape, bool)
                        np.put_along_axis(high, top, True, axis=1)
                        open_ &= high
                    self.score(shard, docs, open_)
                    scored |= open_

    def bounds(self, slices: list, lo: int, n: np.ndarray) -> np.ndarray:
        """For each item and document a score that it can't exceed. lo: the first byte of the documents' bits."""
        m, out, above = lengths(n, self.docs, self.terms), np.zeros((len(self.items.ids), len(n)), np.int64), np.zeros(len(n), np.int64)
        has = None
        for level, (bits, rows) in enumerate(slices):
            part = bits[:, lo : lo + -(-len(n) // 8)]
            found = np.bitwise_and.reduce(part[rows], axis=1) if len(rows) else np.zeros((0, part.shape[1]), np.uint8)
            has = found if has is None else has & found
            # a term without the next slice's bits occurs less than twice as often
            most = n if level + 1 == LEVELS else np.minimum(n, (2 << level) - 1)
            step, above = impact(most, m) - above, impact(most, m)
            there = np.unpackbits(has, axis=1, count=len(n), bitorder="little").astype(np.float64)
            for i in range(len(out)):
                terms, weight = self.items.of(i)
                out[i] += step * (weight.astype(np.float64) @ there[terms]).astype(np.int64)  # sums of weights are whole and below 2**53
        return out

    def score(self, shard: Shard, docs: np.ndarray, wanted: np.ndarray) -> None:
        """Score the wanted pairs of item and document exactly."""
        some = np.flatnonzero(wanted.any(axis=0))
        if not len(some):
            return
        m = lengths(shard.counts[docs[some]], self.docs, self.terms)
        parts = np.zeros((len(some), len(self.items.terms)), np.int64)
        begin, end = shard.places(docs[some])
        for lo, hi in spans(np.cumsum(end - begin)):
            doc, term, tf = shard.frequencies(docs[some[lo:hi]], self.items.terms)
            parts[lo + doc, term] = impact(tf, m[lo + doc])
        ids = shard.ids[docs[some]]
        for i in np.flatnonzero(wanted.any(axis=1)).tolist():
            mine = np.flatnonzero(wanted[i, some])
            terms, weight = self.items.of(i)
            score = parts[np.ix_(mine, terms)] @ weight
            good = np.flatnonzero(score >= self.floor[i])
            if len(good) > self.k:  # equal scores go by id
                good = good[np.lexsort((ids[mine[good]], -score[good]))[: self.k]]
            if len(good):
                self.best[i] = sorted([*self.best[i], *zip((-score[good]).tolist(), ids[mine[good]].tolist(), strict=True)])[: self.k]
                if len(self.best[i]) == self.k:
                    self.floor[i] = max(1, -self.best[i][-1][0])


def document_frequencies(shards: DataFrame, sent, docs_col: str = "ids") -> np.ndarray:
    """How many documents have each term of a block of items, counted exactly; a task sends a number for each term."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value.terms
        df = np.zeros(len(terms), np.int64)
        for shard in one_by_one(rows):
            for lo, hi in spans(shard.ends):
                df += np.bincount(shard.frequencies(np.arange(lo, hi), terms)[1], minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    found = shards.select("ids", "counts", "ends", "text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    with arrow_bytes(shards.sparkSession, READ_BYTES):
        table = found.toArrow()  # a row for each term of a block
    out = np.zeros(len(sent.value.terms), np.int64)
    out[table.column("term").to_numpy()] = table.column("df").to_numpy()
    return out


def spans(ends: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Documents of about `size` bytes together."""
    lo, begin = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, begin + size, side="right")))
        yield lo, hi
        lo, begin = hi, int(ends[hi - 1])


def search(shards: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20, block_rows: int = 4096) -> DataFrame:
    """The k best documents of an index() for each item, with scores above 0: item_id, rank, doc_id, score.

    Items are taken in blocks of block_bytes and one text more, and of block_rows rows; each block is sent to all tasks and reads the index twice."""
    spark = shards.sparkSession
    kind = dict(items.dtypes)[id_col]
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(block_bytes // block_rows))
    asked, blocks = blocked(asked, size, block_bytes, "items")
    docs, terms = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    schema, path = f"item_id {kind}, item long, part int, doc_id long, score long", work_dir(spark, "ranked")
    for block in range(blocks):
        held = Items(asked.where(F.col("block") == block).select("item_id", "text").toArrow())
        sent = spark.sparkContext.broadcast(held)  # bounded by the block
        df = document_frequencies(shards, sent)
        sent.unpersist()
        held.weigh(docs, df)
        sent = spark.sparkContext.broadcast(held)

        def run(rows: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = Search(sent.value, docs, terms, k)
            for shard in one_by_one(rows):
                found.see(shard)
            item = np.repeat(np.arange(len(found.best)), [len(x) for x in found.best])
            best = np.array([x for y in found.best for x in y], np.int64).reshape(-1, 2)
            part = pa.array(np.full(len(item), TaskContext.get().partitionId()), pa.int32())
            yield pa.RecordBatch.from_arrays([sent.value.ids.take(pa.array(item)), pa.array(item), part, pa.array(best[:, 1], mask=best[:, 1] == NO_ID), pa.array(-best[:, 0])], ["item_id", "item", "part", "doc_id", "score"])

        ranked = shards.select("ids", "counts", "ends", "text", "classes").mapInArrow(run, schema)
        with arrow_bytes(spark, READ_BYTES):
            ranked.withColumn("block", F.lit(block)).write.mode("append").parquet(path)
        sent.unpersist()
    ranked = spark.read.schema(schema + ", block int").parquet(path)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # tasks by groups first, so that no window grows with the number of tasks by itself
    for keys in (["block", "item", F.pmod("part", F.lit(64))], ["block", "item"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
