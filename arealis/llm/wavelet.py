"""Token ids as wavelet matrices: one compressed file for each shard of documents.

A shard holds the ids of some documents, one after another. Level by level, from the highest bit down, a plane keeps
one bit of every id, in an order in which ids with a zero in the level above come before those with a one. With the
number of ones before any place of a plane (rank) and the place of its k-th one (select), the file answers which id
stands at a place, how often an id occurs in a span, and where it occurs, without decoding the ids.

File: the planes in blocks, each a zstandard frame of its own (or as it is, if that is shorter); then the directory, one
frame: ids of the documents, their sizes, and for each block its place, its size and the ones before it; then the
directory's size and a magic number. A reader takes the directory from the end and fetches only the blocks that it needs.

Order: documents lie in ascending order of doc_id, null ids last; rows with the same id by number of ids, then by
checksum, so that their places are defined. Null text: empty, so the end id alone. Repeated rows and repeated ids are
documents of their own. Other columns aren't read. An empty table gives no file and an empty result. A document is
never cut; one longer than a shard has a shard of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.batches import NO_ID, shared_uri, stored, work_dir
from arealis.llm.packing import tokenised

MAGIC = b"WVLTMTX1"
#: Bytes of a plane in a block.
BLOCK = 1 << 15
INDEX = "part int, number int, name string, before long, docs long, tokens long"
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_HEAD = "<QQBQ"  # ids, documents, planes, bytes of a block


def encode(ids: np.ndarray, sizes: np.ndarray, doc_ids: np.ndarray) -> bytes:
    """A file's bytes. sizes: ids of each document; doc_ids: NO_ID for null."""
    import zstandard as zstd

    packer = zstd.ZstdCompressor(level=1)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    out, at, where, size, before, zeros = [], 0, [], [], [], []
    row = ids
    for level in range(bits - 1, -1, -1):
        ones = ((row >> row.dtype.type(level)) & row.dtype.type(1)).astype(bool)
        plane, total = np.packbits(ones, bitorder="little"), 0
        for lo in range(0, len(plane), BLOCK):
            raw = plane[lo : lo + BLOCK]
            blob = packer.compress(raw.tobytes())
            blob = blob if len(blob) < len(raw) else raw.tobytes()
            out.append(blob)
            where.append(at)
            size.append(len(blob))
            before.append(total)
            at += len(blob)
            total += int(_ONES[raw].sum())
        zeros.append(len(row) - total)
        row = np.concatenate([row[~ones], row[ones]])
    directory = struct.pack(_HEAD, len(ids), len(sizes), bits, BLOCK) + b"".join(np.asarray(x, "<i8").tobytes() for x in (doc_ids, sizes, zeros, where, size, before))
    directory = packer.compress(directory)
    return b"".join([*out, directory, struct.pack("<Q", len(directory)), MAGIC])


class Shard:
    """Reads a file through seek and read."""

    def __init__(self, source, length: int):
        import zstandard as zstd

        self.source, self.opener, self.held = source, zstd.ZstdDecompressor(), {}
        tail = self._bytes(length - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack("<Q", tail[:8])[0]
        head = self.opener.decompress(self._bytes(length - 16 - size, size))
        self.n, docs, self.bits, self.block = struct.unpack_from(_HEAD, head)
        rest = np.frombuffer(head, "<i8", offset=struct.calcsize(_HEAD))
        self.blocks = -(-(-(-self.n // 8)) // self.block)
        every = self.bits * self.blocks
        self.doc_ids, self.sizes, self.zeros, self.where, self.size, self.before = np.split(rest, np.cumsum([docs, docs, self.bits, every, every]))
        self.ends = np.cumsum(self.sizes)

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _raw(self, number: int) -> np.ndarray:
        """Bytes of a block; blocks are numbered through all planes."""
        plane_bytes = -(-self.n // 8)
        want = min(self.block, plane_bytes - number % self.blocks * self.block)
        blob = self._bytes(int(self.where[number]), int(self.size[number]))
        return np.frombuffer(blob if len(blob) == want else self.opener.decompress(blob), np.uint8)

    def _block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Its bytes, and the ones of the shard's plane before each of them."""
        if number not in self.held:
            if len(self.held) >= 256:
                self.held.pop(next(iter(self.held)))
            raw = self._raw(number)
            self.held[number] = raw, self.before[number] + np.cumsum(_ONES[raw], dtype=np.int64) - _ONES[raw]
        return self.held[number]

    def _look(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each place of a plane, and the ones before it. At the end of the plane the bit is 0."""
        bit, ones = np.zeros(len(places), np.int64), np.full(len(places), self.n - int(self.zeros[level]), np.int64)
        block = places // (8 * self.block)
        for k in np.unique(block[places < self.n]).tolist():
            here = np.flatnonzero((block == k) & (places < self.n))
            raw, before = self._block(level * self.blocks + k)
            at = places[here] - k * 8 * self.block
            byte = raw[at >> 3]
            bit[here] = (byte >> (at & 7).astype(np.uint8)) & 1
            ones[here] = before[at >> 3] + _ONES[byte & ((1 << (at & 7)) - 1).astype(np.uint8)]
        return bit, ones

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("a place outside the shard")
        for level in range(self.bits):
            bit, ones = self._look(level, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _down(self, token: int, at: np.ndarray) -> np.ndarray:
        """Follow an id's bits from some borders of the shard to the last order, where equal ids stand together."""
        for level in range(self.bits):
            _, ones = self._look(level, at)
            at = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        return at

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs from place lo to place hi."""
        if token >> self.bits or token < 0:
            return 0
        a, b = self._down(token, np.array([lo, self.n if hi is None else hi], np.int64)).tolist()
        return max(0, b - a)

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one (or zero) of a plane, from 0, for ascending k."""
        span = slice(level * self.blocks, (level + 1) * self.blocks)
        ones = self.before[span]
        start = np.arange(self.blocks) * 8 * self.block
        block = np.searchsorted(ones if bit else start - ones, k, side="right") - 1
        out = np.zeros(len(k), np.int64)
        for b in np.unique(block).tolist():
            here = np.flatnonzero(block == b)
            raw, _ = self._block(level * self.blocks + b)
            places = np.flatnonzero(np.unpackbits(raw, bitorder="little") == bit)
            out[here] = places[k[here] - int(ones[b] if bit else start[b] - ones[b])] + start[b]
        return out

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of an id's k-th occurrences, from 0, for ascending k."""
        k = np.asarray(k, np.int64)
        if len(k) and not (0 <= k.min() and k.max() < self.count(token)):
            raise IndexError("fewer occurrences")
        at = self._down(token, np.zeros(1, np.int64))[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))

    def all(self) -> np.ndarray:
        """All ids, from the last plane up."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            raw = [self._raw(level * self.blocks + k) for k in range(self.blocks)]
            ones = np.unpackbits(np.concatenate([np.zeros(0, np.uint8), *raw]), bitorder="little", count=self.n).astype(bool)
            above = np.empty_like(row)
            above[~ones] = row[: self.zeros[level]]
            above[ones] = row[self.zeros[level] :] | row.dtype.type(1 << (self.bits - 1 - level))
            row = above
        return row


def ordered(tokens: DataFrame) -> DataFrame:
    """Stored rows of tokenised() in the shards' order, in range partitions. Rows that tie in every key are equal, and may lie in two partitions."""
    spark = tokens.sparkSession
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (1 << 25) + 1)
    keys = [F.col("doc_id").asc_nulls_last(), F.col("n"), F.crc32("ids"), F.col("part"), F.col("before")]
    return tokens.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("doc_id", "n", "width", "ids")


def write(df: DataFrame, tokenizer: str, path: str, end: int = 2, shard_tokens: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents below `path`, a folder that all executors share; returns the stored index: INDEX.

    part and number order the shards; before: ids of earlier shards of the part. A file's name has its task attempt, and the
    index names the files of attempts that ended."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        held: list[np.ndarray] = []
        docs: list[int] = []
        filled = before = number = 0

        def close() -> pa.RecordBatch:
            nonlocal filled, before, number
            name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.wvm"
            with files.open_output_stream(f"{folder}/{name}", compression=None) as sink:
                sink.write(encode(np.concatenate(held), np.array([len(x) for x in held], np.int64), np.array(docs, np.int64)))
            row = [task.partitionId(), number, name, before, len(docs), filled]
            held.clear()
            docs.clear()
            before, filled, number = before + filled, 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)], ["part", "number", "name", "before", "docs", "tokens"])

        for b in rows:
            for doc, width, ids in zip(b.column(0).fill_null(NO_ID).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                x = np.frombuffer(ids.as_buffer(), np.uint16 if width == 2 else np.uint32)
                if held and filled + len(x) > shard_tokens:
                    yield close()
                held.append(x.copy())  # else it holds its whole Arrow batch
                docs.append(doc)
                filled += len(x)
        if held:
            yield close()

    return stored(ordered(tokenised(df, tokenizer, end, id_col, text_col)).mapInArrow(run, INDEX), "wavelet-index")


def placed(index: DataFrame) -> DataFrame:
    """The index with `at`: the ids of all shards before each. Prefix sums over a row for each part."""
    totals = index.groupBy(F.col("part").alias("p")).agg(F.sum("tokens").alias("total"))
    bases = totals.select("p", (F.sum("total").over(Window.orderBy("p")) - F.col("total")).alias("base"))
    return index.join(bases, F.col("part") == F.col("p")).select("name", (F.col("base") + F.col("before")).alias("at"), "docs", "tokens")


def _each(index: DataFrame, path: str, look, schema: str) -> DataFrame:
    """Run look(shard, row) over the files of an index's rows. Rows are few bytes, so they are dealt out by number, not by size."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        for b in rows:
            for row in b.to_pylist():
                with files.open_input_file(f"{folder}/{row['name']}") as source:
                    yield from look(Shard(source, source.size()), row)

    return index.repartition(max(1, min(index.count(), 20_000)), "name").mapInArrow(run, schema)


def _ids(shard: Shard) -> pa.Array:
    return pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID)


def read(index: DataFrame, path: str) -> DataFrame:
    """All documents from their files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""

    def look(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        ids, begin = shard.all(), shard.ends - shard.sizes
        if len(ids) != row["tokens"] or len(shard.sizes) != row["docs"]:
            raise ValueError(f"{row['name']} isn't what the index says")
        names, lo = ["doc_id", "start", "n_tokens", "ids"], 0
        while lo < len(begin):  # some megabytes at a time
            hi = max(lo + 1, int(np.searchsorted(shard.ends, begin[lo] + (1 << 20), side="right")))
            blobs = [ids[s:e].astype("<u4").tobytes() for s, e in zip(begin[lo:hi].tolist(), shard.ends[lo:hi].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_ids(shard).slice(lo, hi - lo), pa.array(row["at"] + begin[lo:hi]), pa.array(shard.sizes[lo:hi]), pa.array(blobs, pa.binary())], names)
            lo = hi

    return _each(placed(index), path, look, "doc_id long, start long, n_tokens long, ids binary")


def counts(index: DataFrame, path: str, tokens: list[int]) -> DataFrame:
    """How often some ids occur in all shards, by rank alone: token, n. An id that is asked for twice counts once."""
    tokens = sorted(set(tokens))

    def look(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return _each(index.select("name"), path, look, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(index: DataFrame, path: str, tokens: list[int]) -> DataFrame:
    """Where some ids occur, by select: token, doc_id, place (in the document), at (in the stream of all documents)."""
    tokens = sorted(set(tokens))

    def look(shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        docs = _ids(shard)
        for token in tokens:
            at = shard.occurrences(token)
            doc = np.searchsorted(shard.ends, at, side="right")
            place = at - (shard.ends - shard.sizes)[doc]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token), pa.int64()), docs.take(pa.array(doc)), pa.array(place), pa.array(row["at"] + at)], ["token", "doc_id", "place", "at"])

    return _each(placed(index), path, look, "token long, doc_id long, place long, at long")


def tokens_at(index: DataFrame, path: str, places: DataFrame, width: int = 1 << 22) -> DataFrame:
    """The ids at some places of the stream (column at), by access: at, token. Places outside it have no row.

    Shards and places meet by stretches of `width` ids; then each place goes to its shard, in bounded lists."""
    shards = placed(index).withColumnRenamed("at", "begin")
    last = F.col("begin") + F.col("tokens") - 1
    spans = shards.withColumn("stretch", F.explode(F.sequence(F.expr(f"begin div {width}"), F.floor(last / width).cast("long"))))
    wanted = places.select(F.col("at").cast("long").alias("at")).where("at >= 0").distinct().withColumn("stretch", F.expr(f"at div {width}"))
    met = wanted.join(spans, "stretch").where("at >= begin and at < begin + tokens")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pafs.FileSystem.from_uri(path)
        for b in rows:
            names, at, begin = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()
            for name in np.unique(names).tolist():
                here = np.flatnonzero(names == name)
                with files.open_input_file(f"{folder}/{name}") as source:
                    found = Shard(source, source.size()).access(at[here] - begin[here])
                yield pa.RecordBatch.from_arrays([pa.array(at[here]), pa.array(found)], ["at", "token"])

    return met.select("name", "at", "begin").repartition("name", F.expr("at div 65536")).sortWithinPartitions("name", "at").mapInArrow(run, "at long, token long")


def archive(df: DataFrame, tokenizer: str, path: str | None = None, **names) -> tuple[DataFrame, str]:
    """Write all documents; returns the index and the folder of the files."""
    path = shared_uri(path or work_dir(df.sparkSession, "wavelet"))
    return write(df, tokenizer, path, **names), path
