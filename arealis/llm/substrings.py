"""Substring dedup by seed and extend: words that repeat a passage of a document with a smaller id are removed.

Seeds are winnowed anchors: of the word `seed`-grams in each window of `length` words the one with the smallest hash
(the rightmost of equals). The choice depends on the window's words alone, so two documents that share a window share
its anchor. Anchors are joined over all documents. Where an anchor occurs in another document, the match is extended
both ways to the windows around it; equal windows meet by their 128-bit digest, and each learns the smallest document
that holds it. Windows that overlap grow together into maximal repeats. Documents aren't extended pair by pair, as an
anchor that m documents share would then cost m * m.

Nulls and ties: a null text has no words. A null id is larger than any other, never smaller. Rows with the same id do
not remove each other's words. Other columns of the input aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import batches as B
from arealis.llm import words as W

SCHEMA = "doc_id long, n_words long, kept_text string, repeats array<struct<start:long,length:long>>"


def winnow(w: W.Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, and the hash of each window's anchor."""
    g = W.grams(w.hashes(), seed)
    starts = np.flatnonzero(W.window_starts(w, length))
    best = g[starts]
    for j in range(1, length - seed + 1):
        np.minimum(best, g[starts + j], out=best)
    return starts, best


def _least(keys: np.ndarray, ids: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, the smallest and largest id of each, the number of each key's entry, and the second halves of the keys."""
    high = keys if high is None else high
    order = np.argsort(keys, kind="stable")
    k, x = keys[order], high[order]
    if len(k) and ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():  # only the first halves agree
        order = np.lexsort((high, keys))
        k, x = keys[order], high[order]
    i = ids[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])) if len(k) else np.zeros(0, np.int64)
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(k)]])))
    if not len(k):
        return k, i, i, inverse, x
    return k[new], np.minimum.reduceat(i, new), np.maximum.reduceat(i, new), inverse, x[new]


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, seed: int = 5) -> DataFrame:
    """One row per document: doc_id, n_words, kept_text (kept words joined by one space) and repeats, the removed maximal runs of words.

    A word is removed if a window of `length` words that covers it also starts in a document with a smaller id.
    Windows are judged on the input, not on what is left.
    """
    batches = B.stored_batches(df, id_col, text_col)
    buckets = B.bucket_count(batches, 1)

    def anchors(b: B.Batch):
        w = W.Words(b.text, b.ends, W.SPACES)
        starts, anchor = winnow(w, length, seed)
        keys, least, most, inverse, _ = _least(anchor, b.ids[w.text[starts]])
        return w, starts, keys, least < most, inverse

    def shared(table: pa.Table) -> pa.Table:
        asked = B.Asked(table)
        _, inverse, n = np.unique(asked.keys, return_inverse=True, return_counts=True)
        return asked.replies((n[inverse] > 1).astype(np.uint8))

    def extended(b: B.Batch, seeds: pa.Table):
        """Windows around shared anchors: their starts, and their distinct keys with the smallest id of each."""
        w, starts, keys, here, inverse = anchors(b)
        hit = here | (B.answered(seeds, keys, buckets, "uint8") > 0)
        starts = starts[hit[inverse]]
        low, high = (W.grams(h, length, lane)[starts] for lane, h in enumerate(w.digests()))
        return w, starts, _least(low, b.ids[w.text[starts]], high)

    def ask_windows(b: B.Batch, seeds: pa.Table) -> pa.Table:
        _, _, (keys, least, _, _, high) = extended(b, seeds)
        return pa.Table.from_batches([B.request(b.batch, keys, np.stack([high, least.view(np.uint64)], axis=1), buckets)])

    def earlier(table: pa.Table) -> pa.Table:
        asked = B.Asked(table, "int64")
        high, ids = asked.more.reshape(-1, 2).T
        _, least, _, inverse, _ = _least(asked.keys, np.ascontiguousarray(ids), high.view(np.uint64))
        return asked.replies((least[inverse] < ids).astype(np.uint8))

    def finish(b: B.Batch, replies: pa.Table) -> pa.Table:
        kind = replies.column("bucket").to_numpy()
        seeds, found = replies.filter(pa.array(kind < buckets)), replies.filter(pa.array(kind >= buckets))
        w, starts, (keys, least, _, inverse, _) = extended(b, seeds)
        found = found.set_column(1, "bucket", pa.array(found.column("bucket").to_numpy() - buckets))
        elsewhere = B.answered(found, keys, buckets, "uint8") > 0
        own = b.ids[w.text[starts]]
        gone = W.cover(len(w), starts[elsewhere[inverse] | (least[inverse] < own)], length)
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        begins = np.flatnonzero(edge == 1)
        # runs of neighbouring documents may touch: cut them where a document begins
        cuts = w.first[:-1][(w.first[:-1] < len(w)) & (np.diff(w.first) > 0)]
        cuts = cuts[gone[cuts]] if len(cuts) else cuts
        begins = np.union1d(begins, cuts)
        ends = np.union1d(np.flatnonzero(edge == -1), cuts[np.isin(cuts, np.flatnonzero(edge == 1), invert=True)])
        doc = w.text[begins] if len(begins) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(b.ids)))])
        spans = pa.StructArray.from_arrays([pa.array(begins - w.first[doc]), pa.array(ends - begins)], ["start", "length"])
        return pa.table([b.id_list(), pa.array(w.counts()), W.joined(w, ~gone), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc_id", "n_words", "kept_text", "repeats"])

    def ask_seeds(b: B.Batch):
        _, _, keys, _, _ = anchors(b)
        return keys, None

    seeds = B.stored(B.ask(batches, ask_seeds, shared, buckets), "seeds")
    windows = B.settle(batches, seeds, ask_windows, B.REQUEST).groupBy("bucket").applyInArrow(earlier, B.REPLY)
    both = seeds.unionByName(windows.withColumn("bucket", F.col("bucket") + F.lit(buckets)))
    return B.settle(batches, both, finish, SCHEMA)
