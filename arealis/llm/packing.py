"""Packing by concatenation: token streams of all documents end to end, cut into windows of a fixed length.

Pass 1 tokenises each partition, notes for each document how many tokens came before it in its partition, and stores
the ids. Prefix sums over the partitions' totals, a row for each partition, give every document its place in the whole
stream. Pass 2 cuts each document at the window borders; documents that cross a border give a piece on either side, so
no task needs its neighbour's rows. Only the last sequence is padded.

Nulls and ties: a null text is an empty one; it has the separator alone. Repeated rows and repeated or null ids are
documents of their own. Other columns of the input aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm import words as W
from arealis.llm.batches import stored

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP = W._table(b".,")
#: Words whose ids a Python worker remembers, some 50 bytes each.
CACHE = 1_000_000


class Encoder:
    """Ids of texts. Texts are cut at ASCII white space, which no token of the vocabulary crosses, and each distinct word is tokenised once.

    Words are found by a hash and compared byte by byte; a piece where two words share a hash is encoded without the cache."""

    #: Parts words that are tokenised as one text; where a word has it, words are tokenised one by one.
    PART = " \x01 "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        # a vocabulary that lower-cases and parts letters from other signs
        self.folds = all(ids(x + y) == ids(x.lower()) + ids(y) for x, y in (("The", "."), ("X", ",y"), ("is", ".."), ("IS", ",")))
        part = ids(self.PART)
        self.part = part[0] if len(part) == 1 and all(ids(x + self.PART + y) == ids(x) + part + ids(y) for x, y in (("the", "."), (",", "x1"))) else None
        self.forget()

    def forget(self) -> None:
        """keys: sorted hashes of the known words; slot: each one's place in begins and sizes, which point into ids, and in at and long, which point into its bytes."""
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.at, self.long = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.sizes, self.begins = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, and how many each has."""
        if self.part is not None:
            text = self.PART.encode().join(words).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            parts = np.flatnonzero(ids == self.part)
            if len(parts) == len(words) - 1:
                return np.delete(ids, parts), np.diff(parts, prepend=-1, append=len(ids)) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in words], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        # the tokenizer's own results are large, so a few words at a time
        found = [self.tokens(words[lo : lo + 200]) for lo in range(0, len(words), 200)]
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.slot = np.concatenate([self.slot, len(self.sizes) + np.arange(len(hashes))])[order]
        self.keys = keys[order]
        self.ids = np.concatenate([self.ids, *[i.astype(self.kind) for i, _ in found]])
        self.sizes = np.concatenate([self.sizes, *[n for _, n in found]])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.long = np.concatenate([self.long, np.array([len(x) for x in words], np.int64)])
        self.at = np.cumsum(self.long) - self.long

    def unknown(self, h: np.ndarray) -> np.ndarray:
        """Places of those among sorted hashes that aren't known."""
        if not len(self.keys):
            return np.arange(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != h)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and where each text's stop."""
        buf, ends = W.buffers(texts)
        if self.folds and b"<|" not in buf.tobytes():  # the name of a special token counts in small letters only
            buf = W.LOWER[buf]
        # the vocabulary never joins a letter and a point or comma, so words with and without them are one entry
        a, z = buf[:-1], buf[1:]
        cuts = np.flatnonzero((LETTER[a] & STOP[z]) | (STOP[a] & LETTER[z])) + 1 if self.folds else None
        w = W.Words(buf, ends, W.SPACES, cuts)
        h, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        new = self.unknown(h)
        if len(new) and len(self.keys) + len(new) > CACHE:
            self.forget()
            new = self.unknown(h)
        if len(new):
            data, at = buf.tobytes(), first[new]
            self.learn(h[new], [data[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
        word = self.slot[np.searchsorted(self.keys, h)][inverse] if len(h) else np.zeros(0, np.int64)
        size = w.end - w.start
        if not (np.array_equal(self.long[word], size) and W.same(buf, w.start, self.bytes, self.at[word], size).all()):
            return self.plainly(w, end)
        n = self.sizes[word]
        done = np.cumsum(n)
        source = np.repeat(self.begins[word] - (done - n), n)
        source += np.arange(len(source))
        ids = self.ids[source]
        stops = np.concatenate([[0], done])[w.first[1:]]
        return np.insert(ids, stops, end), stops + np.arange(1, len(stops) + 1)


    def plainly(self, w: W.Words, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes."""
        known: dict[bytes, int] = {}
        word = np.array([known.setdefault(w.bytes_of(i), len(known)) for i in range(len(w))], np.int64)
        found = [i.astype(self.kind) for x in known for i in np.split(*(lambda t: (t[0], np.cumsum(t[1])[:-1]))(self.tokens([x])))]
        out = [found[i] for i in word.tolist()]
        stops = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)[w.first[1:]]
        return np.insert(np.concatenate([np.zeros(0, self.kind), *out]), stops, end), stops + np.arange(1, len(stops) + 1)


@cache
def _encoder(path: str) -> Encoder:
    """One in each Python worker: tasks that follow each other there share its words."""
    return Encoder(path)


def tokenised(df: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """Stored rows: part, doc_id, before (tokens earlier in the partition), n, ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in W.pieces(rows, 1, 2 << 20):
            ids, stops = encoder.encode(b.column(1), end)
            n = np.diff(stops, prepend=0)
            width = ids.itemsize
            at = np.concatenate([[0], stops * width]).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part), pa.int32()), b.column(0), pa.array(total + stops - n), pa.array(n), pa.array(np.full(len(b), width), pa.int32()), blobs], ["part", "doc_id", "before", "n", "width", "ids"])
            total += int(stops[-1]) if len(stops) else 0

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "part int, doc_id long, before long, n long, width int, ids binary"), "tokens")


def pack(df: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset (place in the sequence; gapless from 0)."""
    tokens = tokenised(df, tokenizer, end, id_col, text_col)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    places = totals.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # a row for each partition of the input: small at any size
    placed = tokens.join(F.broadcast(places), F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "width", "ids")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            first = at // length
            count = (at + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(at)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(sequence * length, at[row])
            stop = np.minimum((sequence + 1) * length, (at + n)[row])
            whole = [np.frombuffer(x, np.uint16 if k == 2 else np.uint32) for x, k in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            ids = [whole[r][s:e].astype("<u4").tobytes() for r, s, e in zip(row.tolist(), (begin - at[row]).tolist(), (stop - at[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(begin - at[row]), pa.array(stop - begin), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padded_length(used: int, length: int = 2048) -> int:
    """The length a sequence with `used` ids is padded to: none at a power of two, else the full length."""
    return used if used and used & (used - 1) == 0 else length
