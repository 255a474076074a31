"""Language-model scoring with a weighted backoff automaton of order three.

States are the histories seen in training: two tokens, one token, none (the root). c counts n-grams in all training
texts; a history h keeps the mass m(h) = strength * c(h) ** growth for lower orders, in the place of the number of
distinct tokens seen after it, which grows like a power of c(h). From state h an arc for a token w seen after it weighs
log10((c(hw) + m(h) p'(w)) / (c(h) + m(h))), p' being the probability in the state of the shorter history. For any
other w the state's failure arc, weighing log10(m(h) / (c(h) + m(h))), leads to that state; the root's arc for w weighs
log10((c(w) + 1) / (N + V + 1)). So the probabilities of all tokens after a history add up to 1.

A text is scored in one traversal from left to right that carries the state and adds up the weights. Many texts are
traversed at a time; long ones in segments that begin two tokens early at the root, after which the state is the one
that the whole text would have led to.

The automaton grows with the corpus and is never in one place: each batch of texts gets the counts of its own n-grams,
builds the part of the automaton that its texts traverse, and traverses it. In a first exchange a batch learns from short
keys which of its n-grams other batches may have; only these are sent whole to be counted, all others are counted where
they are. All counts cover all training texts. An n-gram's key has 63 bits of its tokens' digests; two n-grams share
one with a chance of 2**-63, and then their counts are added.

Nulls and ties: a null text is empty and has the end token alone. A row with null id is held out. Repeated rows count
and are scored each. Other columns aren't read. An empty table gives an empty result; with no training text every
token has probability 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import batches as B
from arealis.llm import words as W

U = np.uint64
_END, _START = U(0x5DEECE66D1234567), U(0x2545F4914F6CDD1D)
_KEY = ~U(1)
SEGMENT = 256
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
COUNTED = B.REPLY + ", tokens long, distinct long"


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, whose last bit is free, and how many entries of each are for training."""
    s = np.sort(keys | train)
    if not len(s):
        return s, np.zeros(0, np.int64)
    k = s & _KEY
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[new], np.add.reduceat((s & U(1)).astype(np.int64), new)


class Tokens:
    """The tokens of a batch's texts, an end after each text's words, and the keys of the n-grams that end in each."""

    def __init__(self, b: B.Batch, parts: int, held: int):
        w = W.Words(W.LOWER[b.text], b.ends, W.SPACES)
        self.sizes = w.counts() + 1
        token = np.insert(w.hashes(), w.first[1:], _END)
        self.begin = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[_START], token[:-1]])
        before[self.begin] = _START
        self.inner = np.ones(len(token), bool)
        self.inner[self.begin] = False
        x, y = W.factors(2, 2), W.factors(3, 3)
        self.word = W.mix(token) & _KEY
        self.before = W.mix(before) & _KEY
        self.two = W.mix(before * x[0] + token * x[1]) & _KEY
        self.three = W.mix(np.concatenate([[U(0)], before[:-1]]) * y[0] + before * y[1] + token * y[2]) & _KEY
        self.train = np.array([i != B.NO_ID and zlib.crc32(str(i).encode()) % parts != held for i in b.ids.tolist()], bool)
        weight = np.repeat(self.train, self.sizes).astype(U)
        self.grams, self.gram_n = counted(np.concatenate([self.two, self.three[self.inner]]), np.concatenate([weight, weight[self.inner]]))
        start = np.full(len(self.train), W.mix(np.array([_START]))[0] & _KEY)
        self.words, self.word_n = counted(np.concatenate([self.word, start]), np.concatenate([weight, self.train.astype(U)]))
        self.start = start[:1]


class Automaton:
    """The part that a batch's texts traverse. States: 0 is the root, then one for each word, then one for each n-gram of two."""

    def __init__(self, t: Tokens, gram_n: np.ndarray, word_n: np.ndarray, total: int, distinct: int, strength: tuple[float, float], growth: tuple[float, float]):
        n, words = len(t.word), len(t.words)
        self.t, self.word = t, W.locate(t.words, t.word)
        self.two, self.three = W.locate(t.grams, t.two), np.zeros(n, np.int64)
        self.three[t.inner] = W.locate(t.grams, t.three[t.inner])
        before = W.locate(t.words, t.before)
        self.inner, size = t.inner, len(t.grams)
        t.word = t.before = t.two = t.three = t.grams = t.gram_n = None  # 10 bytes and more for each byte of text
        self.two, self.three, before = (x.astype(np.int32) for x in (self.two, self.three, before))
        self.known = word_n > 0
        root = (word_n + 1) / (total + distinct + 1)
        self.root_weight, self.root_next = np.log10(root), np.where(self.known, 1 + np.arange(words), 0)
        # arcs by the number of their n-gram: source, next state, weight; -1 if training has no such n-gram
        self.source, self.next = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        p, self.fall = np.zeros(size), np.zeros(1 + words + size)
        self.fail = np.zeros(len(self.fall), np.int64)
        place = np.full(size, -1, np.int32)  # where an n-gram occurs
        place[self.two] = np.arange(n)
        pairs = np.flatnonzero(place >= 0)
        c, h, at = gram_n[pairs], word_n[before[place[pairs]]], place[pairs]
        mass = self.mass(word_n, strength[0], growth[0])
        seen = c > 0
        m = mass[before[at]]
        with np.errstate(divide="ignore", invalid="ignore"):
            p[pairs] = np.where(h > 0, (c + m * root[self.word[at]]) / (h + m), 0)
            self.fall[1 : 1 + words] = np.where(self.known, np.log10(mass / (word_n + mass)), 0)
        self.source[pairs] = np.where(seen, 1 + before[at], -1)
        self.next[pairs] = 1 + words + pairs
        state, mass = 1 + words + pairs, self.mass(c, strength[1], growth[1])
        self.fail[state] = np.where(word_n[self.word[at]] > 0, 1 + self.word[at], 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.fall[state] = np.where(seen, np.log10(mass / (c + mass)), 0)
        inner = np.flatnonzero(self.inner)
        place[:] = -1
        place[self.three[inner]] = inner
        threes = np.flatnonzero(place >= 0)
        at = place[threes]
        c, h = gram_n[threes], gram_n[self.two[at - 1]]
        m = self.mass(h, strength[1], growth[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            p[threes] = np.where(c > 0, (c + m * p[self.two[at]]) / (h + m), 0)
            self.weight = np.log10(p)
        self.source[threes] = np.where(c > 0, 1 + words + self.two[at - 1], -1)
        self.next[threes] = 1 + words + self.two[at]
        start = int(np.searchsorted(t.words, t.start)[0]) if len(t.start) else 0
        self.start = 1 + start if len(t.start) and word_n[start] > 0 else 0

    @staticmethod
    def mass(c: np.ndarray, strength: float, growth: float) -> np.ndarray:
        return strength * np.maximum(c, 1).astype(float) ** growth

    def traverse(self) -> np.ndarray:
        """The weight of each token."""
        t, out = self.t, np.zeros(len(self.word))
        segments = -(-t.sizes // SEGMENT)
        text = np.repeat(np.arange(len(segments)), segments)
        number = np.arange(len(text)) - np.repeat(np.cumsum(segments) - segments, segments)
        lead = np.where(number > 0, 2, 0)
        at = t.begin[text] + number * SEGMENT - lead
        stop = np.minimum(at + lead + SEGMENT, (t.begin + t.sizes)[text])
        order = np.argsort(at - stop, kind="stable")  # the longest first
        at, lead, length = at[order], lead[order], (stop - at)[order]
        state = np.where(lead > 0, 0, self.start)
        for step in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -step))  # those longer than step
            here, s = at[:live] + step, state[:live]
            weight, to = np.zeros(live), np.zeros(live, np.int64)
            open_ = np.arange(live)
            for arcs in (self.three, self.two):
                a = arcs[here[open_]]
                if arcs is self.three:
                    a = np.where(self.inner[here[open_]], a, -1)
                took = (a >= 0) & (s[open_] > 0) & (self.source[a] == s[open_])
                hit = open_[took]
                weight[hit] += self.weight[a[took]]
                to[hit] = self.next[a[took]]
                open_ = open_[~took]
                fall = open_ if arcs is self.two else open_[s[open_] > len(t.words)]
                weight[fall] += self.fall[s[fall]]
                s[fall] = self.fail[s[fall]]
            weight[open_] += self.root_weight[self.word[here[open_]]]
            to[open_] = self.root_next[self.word[here[open_]]]
            state[:live] = to
            scored = step >= lead[:live]
            out[here[scored]] = weight[scored]
        return out


def _packed(batch: int, keys: np.ndarray, values: np.ndarray, of: np.ndarray, buckets: int, shift: int) -> pa.Table:
    """Rows of REQUEST: for each bucket the steps between its sorted values, and what is said of each."""
    at = B.cut(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    ks = [B.planes(np.diff(values[at[i] : at[i + 1]], prepend=values.dtype.type(0))) for i in full]
    ms = [B.planes(of[at[i] : at[i + 1]]) if len(of) else b"" for i in full]
    return pa.table([pa.array(full + shift, pa.int32()), pa.array(np.full(len(full), batch), pa.int64()), pa.array(ks, pa.binary()), pa.array(ms, pa.binary())], ["bucket", "batch", "keys", "more"])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, strength: tuple[float, float] = (5.0, 3.0), growth: tuple[float, float] = (0.7, 0.5)) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    strength and growth: of the mass that histories of one and of two tokens keep for lower orders."""
    batches = B.stored_batches(df, id_col, text_col)
    buckets = B.bucket_count(batches)
    bits = min(63, (batches.count() * B.BATCH_BYTES).bit_length() + 4)  # of a short key; other batches share one by chance for a few in a hundred n-grams
    tiny = np.uint32 if bits - (buckets.bit_length() - 1) <= 31 else U

    def short(keys: np.ndarray) -> np.ndarray:
        """The first bits of the keys, counted from their bucket's beginning."""
        at = B.cut(keys, buckets)
        edges = (np.arange(buckets, dtype=object) * (2**64 // buckets)).astype(U)
        return ((keys >> U(64 - bits)) - np.repeat(edges >> U(64 - bits), np.diff(at))).astype(tiny)

    def ask_short(rows):
        for b in B.each_batch(rows):
            t = Tokens(b, parts, held)
            yield from _packed(b.batch, t.grams, short(t.grams), np.zeros(0, np.uint8), buckets, 0).to_batches()

    def elsewhere(table: pa.Table) -> pa.Table:
        """A bit for each key: whether another batch has it."""
        keys = [np.cumsum(B.numbers(x, tiny), dtype=tiny) for x in table.column("keys").to_pylist()]
        s = np.sort(np.concatenate(keys))
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        flags = [np.packbits(twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k if len(twice) else np.zeros(len(k), bool)).tobytes() for k in keys]
        return table.select(["batch", "bucket"]).append_column("reply", pa.array(flags, pa.binary()))

    def flagged(t: Tokens, replies: pa.Table) -> np.ndarray:
        out, at = np.zeros(len(t.grams), bool), B.cut(t.grams, buckets)
        for k, blob in zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist(), strict=True):
            out[at[k] : at[k + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(at[k + 1] - at[k]))
        return out

    def ask_counts(b: B.Batch, replies: pa.Table) -> pa.Table:
        t = Tokens(b, parts, held)
        sent = flagged(t, replies)
        grams = _packed(b.batch, t.grams[sent], t.grams[sent], t.gram_n[sent].astype(np.uint32), buckets, buckets)
        return pa.concat_tables([grams, _packed(b.batch, t.words, t.words, t.word_n.astype(np.uint32), buckets, 2 * buckets)])

    def counts(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(B.numbers(x, U), dtype=U) for x in table.column("keys").to_pylist()]
        n = np.concatenate([B.numbers(x, np.uint32) for x in table.column("more").to_pylist()]).astype(np.int64)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        k = every[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sums = np.add.reduceat(n[order], new)
        back = np.empty(len(k), np.int64)
        back[order] = np.repeat(sums, np.diff(np.concatenate([new, [len(k)]])))
        at, bucket = np.cumsum([0, *map(len, keys)]), table.column("bucket")[0].as_py()
        tokens = distinct = 0
        if bucket >= 2 * buckets:
            words = sums[k[new] != W.mix(np.array([_START]))[0] & _KEY]
            tokens, distinct = int(words.sum()), int((words > 0).sum())
        rows = len(keys)
        said = [B.planes(back[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
        first = lambda x: pa.array([x, *[0] * (rows - 1)], pa.int64())
        return pa.table([table.column("batch"), table.column("bucket"), pa.array(said, pa.binary()), first(tokens), first(distinct)], ["batch", "bucket", "reply", "tokens", "distinct"])

    said = B.stored(batches.mapInArrow(ask_short, B.REQUEST).groupBy("bucket").applyInArrow(elsewhere, B.REPLY), "elsewhere")
    found = B.stored(B.settle(batches, said, ask_counts, B.REQUEST).groupBy("bucket").applyInArrow(counts, COUNTED), "counts")
    total, distinct = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def finish(b: B.Batch, replies: pa.Table) -> pa.Table:
        t = Tokens(b, parts, held)
        bucket = replies.column("bucket").to_numpy()
        sent = flagged(t, replies.filter(pa.array(bucket < buckets)))
        grams, places, words = t.gram_n.copy(), np.flatnonzero(sent), np.zeros(len(t.words), np.int64)
        at, word_at = B.cut(t.grams[sent], buckets), B.cut(t.words, buckets)
        for k, blob in zip(bucket.tolist(), replies.column("reply").to_pylist(), strict=True):
            if k >= 2 * buckets:
                words[word_at[k - 2 * buckets] : word_at[k - 2 * buckets + 1]] = B.numbers(blob, np.int64)
            elif k >= buckets:
                grams[places[at[k - buckets] : at[k - buckets + 1]]] = B.numbers(blob, np.int64)
        machine = Automaton(t, grams, words, total, distinct, strength, growth)
        docs = len(b.ids)
        text = np.repeat(np.arange(docs), t.sizes)
        add = lambda x: np.bincount(text, x, docs)  # noqa: E731  from left to right
        known, base = add(machine.known[machine.word].astype(float)).astype(np.int64), add(machine.root_weight[machine.word])
        return pa.table([b.id_list(), pa.array(~t.train), pa.array(t.sizes), pa.array(known), pa.array(base), pa.array(add(machine.traverse()))], [x.split()[0] for x in SCHEMA.split(", ")])

    both = said.unionByName(found.select("batch", "bucket", "reply"))
    return B.settle(batches, both, finish, SCHEMA).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
