"""Words of whole texts and their digests, computed with numpy over the bytes of many texts at once.

These helpers run inside Spark tasks. A word is a maximal run of bytes that are not separators; separators
are ASCII, so a word never cuts a UTF-8 character. Texts never run into each other: each ends its last word.

A word's digest has 128 bits: SipHash-1-3 of its bytes under a fixed key, for many words at once; words of more than
`LONG` bytes take BLAKE2b. Unlike a polynomial it has no families of texts that collide. Where a whole digest decides
that two words or windows are equal, chance can mislead with a probability of about pairs / 2**128; where 64 bits do, the
operators compare bytes (`same`), or meet only within one pair of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words hashed at a time, so that temporary arrays stay in the cache.
STEP = 1 << 14


def _table(separators: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(separators)] = True
    return t


#: ASCII white space.
SPACES = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: All of ASCII but digits and lower-case letters.
NOT_ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: ASCII capitals to small letters, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of more bytes are hashed one by one.
LONG = 64
_KEY = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))  # digits of pi
_INIT = (U(0x736F6D6570736575), U(0x646F72616E646F6D ^ 0xEE), U(0x6C7967656E657261), U(0x7465646279746573))  # fixed values of SipHash
_REST = np.array([(1 << 8 * i) - 1 for i in range(8)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of some texts. start, end: bytes in buf; text: number of each word's text; first: index of each text's first word, and the total."""

    def __init__(self, buf: np.ndarray, ends: np.ndarray, separators: np.ndarray, cuts: np.ndarray | None = None):
        """cuts: places inside words where a word ends and the next begins."""
        self.buf, self.ends = buf, ends
        inside = ~separators[buf] if len(buf) else np.zeros(0, bool)
        edge = np.zeros(len(buf) + 1, bool)  # a text begins here
        edge[0] = True
        edge[ends] = True
        if cuts is not None:
            edge[cuts] = True
        before = np.concatenate([[False], inside[:-1]]) if len(buf) else inside
        after = np.concatenate([inside[1:], [False]]) if len(buf) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(ends, self.start, side="right")
        self.first = np.concatenate([np.searchsorted(self.text, np.arange(len(ends))), [len(self.start)]])

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def digests(self, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit halves of each word's digest; the second is empty unless `both`."""
        low, high = np.empty(len(self), U), np.empty(len(self) if both else 0, U)
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded.data, 0, (1,))  # eight bytes from each place
        size = self.end - self.start
        for lo in range(0, len(self), STEP):
            part = slice(lo, lo + STEP)
            x, y = _sip(eight, self.start[part], np.minimum(size[part], LONG), both)
            low[part] = x
            if both:
                high[part] = y
        for i in np.flatnonzero(size > LONG).tolist():
            d = hashlib.blake2b(self.buf[self.start[i] : self.end[i]], digest_size=16).digest()
            low[i] = int.from_bytes(d[:8], "little")
            if both:
                high[i] = int.from_bytes(d[8:], "little")
        return low, high

    def hashes(self) -> np.ndarray:
        """The first half of each word's digest."""
        return self.digests(False)[0]

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def _round(v: list[np.ndarray]) -> None:
    a, b, c, d = v
    a += b
    b[:] = (b << U(13)) | (b >> U(51))
    b ^= a
    a[:] = (a << U(32)) | (a >> U(32))
    c += d
    d[:] = (d << U(16)) | (d >> U(48))
    d ^= c
    a += d
    d[:] = (d << U(21)) | (d >> U(43))
    d ^= a
    c += b
    b[:] = (b << U(17)) | (b >> U(47))
    b ^= c
    c[:] = (c << U(32)) | (c >> U(32))


def _sip(eight: np.ndarray, start: np.ndarray, size: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """SipHash-1-3 with 128 bits of the byte strings at `start`; eight: the eight bytes from each place."""
    v = [np.full(len(start), k ^ x, U) for k, x in zip(_KEY * 2, _INIT, strict=True)]
    for j in range(0, int(size.max(initial=0)) // 8 * 8, 8):
        at = np.flatnonzero(size >= j + 8)
        block, some = eight[start[at] + j], [x[at] for x in v]
        some[3] ^= block
        _round(some)
        some[0] ^= block
        for x, y in zip(v, some, strict=True):
            x[at] = y
    rest = size & 7
    block = (eight[np.minimum(start + size - rest, len(eight) - 1)] & _REST[rest]) | (size.astype(U) << U(56))
    v[3] ^= block
    _round(v)
    v[0] ^= block
    v[2] ^= U(0xEE)
    for _ in range(3):
        _round(v)
    low = v[0] ^ v[1] ^ v[2] ^ v[3]
    if not both:
        return low, low[:0]
    v[1] ^= U(0xDD)
    for _ in range(3):
        _round(v)
    return low, v[0] ^ v[1] ^ v[2] ^ v[3]


def same(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each of some byte strings of `a` equals one of `b` of the same size, byte by byte."""
    out = np.ones(len(size), bool)
    x, y = (np.ndarray(len(z) + 1, "<u8", np.concatenate([z, np.zeros(8, np.uint8)]).data, 0, (1,)) for z in (a, b))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(a[a_at[i] : a_at[i] + size[i]], b[b_at[i] : b_at[i] + size[i]])
    open_, j = np.flatnonzero(size <= LONG), 0
    while len(open_):
        left = size[open_] - j
        differ = x[a_at[open_] + j] ^ y[b_at[open_] + j]
        differ = np.where(left < 8, differ & _REST[np.minimum(left, 7)], differ)
        out[open_[differ != 0]] = False
        j += 8
        open_ = open_[(left > 8) & (differ == 0)]
    return out


def factors(k: int, lane: int = 0) -> np.ndarray:
    """Odd factors without structure, one for each place of a window."""
    return mix(np.arange(1, k + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U((lane + 1) << 32)) | U(1)


def grams(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of every k consecutive values; windows that cross texts are among them and must be masked."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    f = factors(k, lane)
    out = h[:n] * f[0]
    for i in range(1, k):
        out += h[i : n + i] * f[i]
    return mix(out + U(k))


def locate(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of evenly spread sorted keys; all wanted ones are among them. A table of their first bits leaves few to compare."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    bits = max(1, int(len(keys)).bit_length())
    table = np.searchsorted(keys, np.arange(1 << bits, dtype=U) << U(64 - bits))
    at = table[wanted >> U(64 - bits)]
    open_ = np.flatnonzero(keys[at] < wanted)
    while len(open_):
        at[open_] += 1
        open_ = open_[keys[at[open_]] < wanted[open_]]
    return at


class Vocabulary:
    """The distinct words of some texts, by number. Other texts' words are found by a digest and compared byte by byte."""

    def __init__(self, w: Words):
        self.keys, first, self.number = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.buf, self.at, self.size = w.buf, w.start[first], (w.end - w.start)[first]
        if not (np.array_equal(self.size[self.number], w.end - w.start) and same(w.buf, w.start, w.buf, self.at[self.number], self.size[self.number]).all()):
            raise ValueError("two words share a digest")

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, w: Words) -> np.ndarray:
        """The number of each word, -1 if it isn't among the vocabulary's."""
        out = np.full(len(w), -1, np.int64)
        if len(self.keys) and len(w):
            h = w.hashes()
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = np.flatnonzero((self.keys[at] == h) & (self.size[at] == w.end - w.start))
            known = known[same(w.buf, w.start[known], self.buf, self.at[at[known]], self.size[at[known]])]
            out[known] = at[known]
        return out


def window_starts(w: Words, k: int) -> np.ndarray:
    """Whether k words of one text start at each word."""
    ok = np.zeros(len(w), bool)
    if len(w) >= k:
        ok[: len(w) - k + 1] = w.text[: len(w) - k + 1] == w.text[k - 1 :]
    return ok


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after another, and where each ends. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"") if len(column) else pa.array([], pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at[1:] - at[0]


def words_of(column: pa.Array | pa.ChunkedArray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    buf, ends = buffers(column)
    return Words(LOWER[buf] if lower else buf, ends, separators)


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the given spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, n), -1)
    return np.cumsum(d[:n]) > 0


def pieces(rows, column: int, size: int = 8 << 20):
    """Arrow batches cut where their texts exceed `size` bytes; a longer text stands alone."""
    for b in rows:
        _, ends = buffers(b.column(column))
        lo, begin = 0, 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, begin + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo, begin = hi, int(ends[hi - 1])


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """For each text, its kept words joined by one space."""
    at = np.flatnonzero(keep)
    size = w.end[at] - w.start[at]
    leads = np.ones(len(at), np.int64)  # a space before each word but a text's first
    if len(at):
        leads[0] = 0
        leads[1:] = w.text[at][1:] == w.text[at][:-1]
    total = size + leads
    stop = np.cumsum(total)
    source = np.repeat(w.start[at] - leads - (stop - total), total)
    source += np.arange(len(source))
    data = w.buf[np.maximum(source, 0)] if len(source) else np.zeros(0, np.uint8)
    data[(stop - total)[leads > 0]] = 32
    kept = np.cumsum(np.bincount(w.text[at], minlength=len(w.ends)))
    offsets = np.concatenate([[0], np.concatenate([[0], stop])[kept]]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(w.ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
