"""How the sources of a language differ in their words.

Counting: a task takes some megabytes of texts, ordered by group, and packs terms by length. Terms of up to 8 bytes are
one 64-bit word, those of up to 16 bytes are two, both padded with NUL, which no term has; they are sorted by radix, 16
bits at a time. Longer terms lie in buckets by length, each sorted as bytes. All sorts are stable, so that within a run of
equal terms the entries stand by group and document, and runs give counts and numbers of documents. Spark adds them up.

Comparing: each group gives a kept term the proportion p = 1 + floor(10^9 (count + 2) / (N + 2V)), in billionths; two
proportions differ by floor((p - q)^2 / (p + q)). Pairs of groups are compared on dense stretches of terms by sources: the
terms of a language are dealt into buckets, its sources into blocks, and each bucket and pair of blocks gives a sum for
each pair of sources. All numbers are exact: 64-bit integers, decimals where those don't suffice.

Nulls and ties: null text, lang and source are ''. Every row is a document, repeated ones too; ids and other columns
aren't read. Groups without terms take part. Equal values go by the item's UTF-8 bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm import words as W
from arealis.llm.batches import stored

U = np.uint64
#: All of ASCII but letters; capitals are lowered before.
NOT_LETTER = W._table(bytes([*range(0x00, 0x61), *range(0x7B, 0x80)]))
PIECE_BYTES = 4 << 20
#: Kept terms times groups in a bucket; sources in a block; cells of a dense stretch.
BUCKET_ROWS, BLOCK, CELLS = 500_000, 512, 1 << 20
#: Groups that may be sent to all tasks.
SMALL = 100_000


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by 64-bit keys, the first key first: a pass for every 16 bits that differ, from the lowest."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 64, 16):
            digit = (key >> U(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit integers by radix
    return order


def packed(w: W.Words, at: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of up to 8 * words bytes as big-endian integers, which sort as the terms do."""
    padded = np.concatenate([w.buf, np.zeros(8 * words, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded.data, 0, (1,))
    start, size = w.start[at], w.end[at] - w.start[at]
    out = []
    for j in range(words):
        left = np.clip(size - 8 * j, 0, 8)
        mask = np.where(left == 8, ~U(0), (U(1) << (U(8) * left.astype(U) & U(63))) - U(1))
        out.append((eight[start + 8 * j] & mask).byteswap())
    return out


def runs(w: W.Words, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term of each group its first word, its count, and its number of documents. Texts are in order of their group."""
    size = w.end - w.start
    where, counts, docs = [], [], []

    def add(at: np.ndarray, order: np.ndarray, keys: list[np.ndarray]) -> None:
        at, text = at[order], w.text[at[order]]
        term = np.zeros(len(at), bool)
        term[:1] = True
        for k in keys:
            term[1:] |= k[order][1:] != k[order][:-1]
        new = np.flatnonzero(term | np.concatenate([[True], group[text[1:]] != group[text[:-1]]]))
        doc = term | np.concatenate([[True], text[1:] != text[:-1]])
        where.append(at[new])
        counts.append(np.diff(new, append=len(at)))
        docs.append(np.add.reduceat(doc.astype(np.int64), new))

    for words, some in ((1, size <= 8), (2, (size > 8) & (size <= 16))):
        at = np.flatnonzero(some)
        if len(at):
            keys = packed(w, at, words)
            add(at, radix_order(keys), keys)
    long = np.flatnonzero(size > 16)
    for n in np.unique(size[long]).tolist():
        at = long[size[long] == n]
        key = w.buf[w.start[at][:, None] + np.arange(n)].view(f"S{n}").reshape(-1)
        add(at, np.argsort(key, kind="stable"), [key])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (where, counts, docs))


def strings(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    stop = np.cumsum(size)
    data = buf[np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def counted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(rows, 2, PIECE_BYTES):
            groups = pa.StructArray.from_arrays([b.column(0), b.column(1)], ["lang", "source"])
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault((x["lang"], x["source"]), len(known)) for x in groups.to_pylist()], np.int64)
            order = np.argsort(group, kind="stable")
            b, group = b.take(pa.array(order)), group[order]
            w = W.words_of(b.column(2), NOT_LETTER, lower=True)
            at, n, docs = runs(w, group)
            doc = pa.array(w.text[at])
            found = pa.RecordBatch.from_arrays([b.column(0).take(doc), b.column(1).take(doc), strings(w.buf, w.start[at], w.end[at] - w.start[at]), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
            yield from (found.slice(i, 1 << 16) for i in range(0, len(found), 1 << 16))

    rows = _groups(df, lang_col, source_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(df: DataFrame, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), *more)


def proportion(n: Column | str, total: str, kept: str) -> Column:
    """In billionths; decimals, as 10^9 times a count may exceed 64 bits."""
    n = F.col(n) if isinstance(n, str) else n
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", over, (F.col(total) + 2 * F.col(kept)).cast("decimal(20,0)"))


def distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def compared(table: pa.Table) -> pa.Table:
    """Sums over a bucket's terms for each pair of its sources. Rows without a term give a source's p of absent terms."""
    place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    lone = table.column("term").is_null().to_numpy()
    order = np.argsort(place[lone])
    places, absent = place[lone][order], p[lone][order]
    term = table.column("term").filter(pa.array(~lone)).combine_chunks().dictionary_encode().indices.to_numpy()
    source, p = np.searchsorted(places, place[~lone]), p[~lone]
    left, right = np.flatnonzero(places // BLOCK == a), np.flatnonzero(places // BLOCK == b)
    sums = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], p[order]
    step = max(1, CELLS // max(1, len(places)))
    for lo in range(0, int(term.max(initial=-1)) + 1, step):
        s, e = np.searchsorted(term, [lo, lo + step])
        dense = np.repeat(absent[:, None], min(step, int(term[-1]) + 1 - lo), axis=1)
        dense[source[s:e], term[s:e] - lo] = p[s:e]
        other = dense[right]
        for i, x in enumerate(left.tolist()):
            d = other - dense[x]
            sums[i] += (d * d // (other + dense[x])).sum(axis=1)
    x, y = np.repeat(places[left], len(right)), np.tile(places[right], len(left))
    once = x < y
    return pa.table([pa.array([lang] * int(once.sum()), pa.string()), pa.array(x[once], pa.int32()), pa.array(y[once], pa.int32()), pa.array(sums.reshape(-1)[once])], ["lang", "x", "y", "value"])


def audit(df: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the distance to each other source of the language; part `term`: the
    `top` kept terms that the source overuses most against its language. Kept are terms that at least `least` documents of the language have."""
    term = Window.partitionBy("lang", "term")
    kept = counted(df, text_col, lang_col, source_col)
    kept = kept.withColumn("lang_docs", F.sum("docs").over(term)).where(F.col("lang_docs") >= least)
    kept = kept.withColumn("lang_n", F.sum("n").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    kept = stored(kept.select("lang", "source", "term", "n", "lang_n", "first"), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = _groups(df, lang_col, source_col).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    lang = Window.partitionBy("lang")
    groups = groups.withColumn("place", F.row_number().over(lang.orderBy("source")) - 1).withColumn("blocks", F.ceil(F.count("*").over(lang) / BLOCK).cast("int"))
    groups = stored(groups, "groups")
    size, buckets = groups.count(), kept.count() // BUCKET_ROWS + 1
    rows = kept.join(_small(groups, size), ["lang", "source"]).withColumn("p", proportion("n", "total", "v"))

    one = rows.withColumn("q", proportion("lang_n", "lang_total", "v")).where("p > q").select("lang", "source", "term", distance("p", "q").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    best = one.withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)

    # a bucket's rows, and the sources of its language, go to each pair of blocks that has theirs
    keys, own = ["lang", "bucket", "a", "b"], F.expr(f"place div {BLOCK}").cast("int")
    posts = rows.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "place", "blocks", "term", "p")
    lone = groups.where("blocks > 0").select("lang", F.explode(F.expr(f"sequence(0L, {buckets - 1}L)")).alias("bucket"), "place", "blocks", F.lit(None).cast("string").alias("term"), F.when(F.col("v") > 0, proportion(F.lit(0), "total", "v")).otherwise(1).alias("p"))
    dealt = posts.unionByName(lone).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "bucket", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "place", "term", "p")
    sums = dealt.groupBy(*keys).applyInArrow(compared, "lang string, x int, y int, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    both = sums.withColumn("p", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).select("lang", "p.*", "value")
    names = groups.select("lang", "source", "place")
    pairs = both.join(_small(names.withColumnRenamed("place", "x"), size), ["lang", "x"])
    pairs = pairs.join(_small(names.select("lang", F.col("source").alias("item"), F.col("place").alias("y")), size), ["lang", "y"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    columns = lambda x, part: x.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(best, "term"))
