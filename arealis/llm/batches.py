"""Texts in batches, and a key exchange between them.

Operators that compare every word window of a corpus would shuffle a row for each window. Here the texts are
stored once as batches of some megabytes. A batch asks about its distinct keys: one row for each bucket of the
key space, holding that bucket's keys as a sorted array. The reduce side answers each row, and the answers go
back to the batch. A key occurs once in a batch, so a very frequent key has at most a row for each batch, and no
key makes a group large. The table of batches is bucketed by batch, so that texts aren't shuffled for the answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NO_ID = np.iinfo(np.int64).max
BATCH_BYTES = 8 << 20
#: Rows of a batch at most: a row's number in its batch has 20 bits.
BATCH_ROWS = 1 << 18
REQUEST = "bucket int, batch long, keys binary, more binary"
REPLY = "batch long, bucket int, reply binary"
#: Folders and tables made so far, so that they can be released.
MADE: list[tuple[str, str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the cluster names in spark.checkpoint.dir; it is set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"  # one machine: any folder is shared
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    MADE.append(("folder", path))
    return path


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders and drop the tables that this session made after the first `since`, but for the last `keep`. Nothing that still reads them may be used again."""
    for kind, name in MADE[since : len(MADE) - keep]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del MADE[since : len(MADE) - keep]


def shared_uri(path: str) -> str:
    """The folder's address for file systems outside Spark."""
    if "://" in path:
        return path
    return path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"


def stored(df: DataFrame, name: str, codec: str = "zstd", group_rows: int | None = None) -> DataFrame:
    """Write df below the shared folder and read it again: its lineage ends there, and it survives lost executors.

    group_rows: rows of a row group at most. Else a task holds up to 100 rows before it writes any, however large they are, and
    reads as many at once. Such groups have no statistics: a writer would hold each group's least and largest values until its file ends."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    grouped = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows, "parquet.column.statistics.enabled": False}
    df.write.options(compression=codec, **grouped).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries that run meanwhile hand rows to Python in batches of `most` bytes and one row more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, had)


def stored_batches(df: DataFrame, id_col: str, text_col: str, size: int = BATCH_BYTES) -> DataFrame:
    """Columns batch, ids, ends, text, nulls: some texts in one row. A row has one text at least, about `size` bytes and BATCH_ROWS texts at most.

    ids: int64 (a null id is the largest integer); ends: where each text ends in `text`; nulls: a byte for each text, 1 if it is null.
    """
    spark = df.sparkSession

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from arealis.llm.words import buffers

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        filled = count = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            bufs, sizes = [h[0] for h in held], np.concatenate([h[1] for h in held])
            row = [(part << 24) | number, np.concatenate([h[2] for h in held]).tobytes(), np.cumsum(sizes).tobytes(), np.concatenate(bufs).tobytes(), np.concatenate([h[3] for h in held]).tobytes()]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["batch", "ids", "ends", "text", "nulls"])

        for b in rows:
            buf, ends = buffers(b.column(1))
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            nulls = b.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            lo, begin = 0, 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, begin + size - filled, side="right")))
                hi = min(hi, lo + BATCH_ROWS - count)
                stop = int(ends[hi - 1])
                held.append((buf[begin:stop], np.diff(ends[lo:hi], prepend=begin), ids[lo:hi], nulls[lo:hi]))
                filled, count = filled + stop - begin, count + hi - lo
                lo, begin = hi, stop
                if filled >= size or count >= BATCH_ROWS or lo < len(ids):
                    yield out()
                    filled = count = 0
        if held:
            yield out()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    packed = rows.mapInArrow(pack, "batch long, ids binary, ends binary, text binary, nulls binary")
    n = max(1, min(50_000, rows.rdd.getNumPartitions()))
    name = f"batches_{uuid.uuid4().hex[:12]}"
    MADE.append(("table", name))
    packed.write.option("compression", "zstd").option("path", work_dir(spark, name)).bucketBy(n, "batch").format("parquet").saveAsTable(name)
    return spark.table(name)


def blocked(df: DataFrame, size: Column, most: int, name: str) -> tuple[DataFrame, int]:
    """Stored rows with `block`, and the number of blocks. A block holds rows of `most` bytes and at most one row more; size: a row's bytes.

    Blocks are cut from running sums within a partition and prefix sums over a row for each partition."""
    rows = stored(df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"), size.cast("long").alias("_size")), name)
    totals = rows.groupBy("_part").agg(F.sum("_size").alias("_total"))
    bases = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_base"))
    begin = F.col("_base") + F.sum("_size").over(Window.partitionBy("_part").orderBy("_row")) - F.col("_size")
    cut = rows.join(bases, "_part").withColumn("_begin", begin)
    out = stored(cut.select(*df.columns, F.floor(F.col("_begin") / most).cast("long").alias("block")), name)
    return out, (out.agg(F.max("block")).first()[0] or 0) + 1


class Batch:
    """A row of stored_batches() in a task."""

    def __init__(self, table: pa.Table | pa.RecordBatch, row: int = 0):
        get = lambda c: table.column(c)[row].as_py()
        self.batch = get("batch")
        self.ids = np.frombuffer(get("ids"), np.int64)
        self.ends = np.frombuffer(get("ends"), np.int64)
        self.text = np.frombuffer(get("text"), np.uint8)
        self.nulls = np.frombuffer(get("nulls"), np.uint8).astype(bool)

    def id_list(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)


def each_batch(rows: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for b in rows:
        for i in range(b.num_rows):
            yield Batch(b, i)


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted 64-bit keys, and their number: buckets are equal ranges of the key space."""
    edges = (np.arange(buckets, dtype=object) * (2**64 // buckets)).astype(np.uint64)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def request(batch: int, keys: np.ndarray, more: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Rows of REQUEST for sorted distinct keys, with a value for each if `more` is given."""
    at = cut(keys, buckets)
    full = np.flatnonzero(np.diff(at))
    ks = [keys[at[b] : at[b + 1]].tobytes() for b in full]
    ms = [more[at[b] : at[b + 1]].tobytes() if more is not None else b"" for b in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), batch), pa.int64()), pa.array(ks, pa.binary()), pa.array(ms, pa.binary())], ["bucket", "batch", "keys", "more"])


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first bytes first: bytes that are mostly zero then compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def numbers(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class Asked:
    """All requests of a bucket in a task: keys and values of all, and the row each came from."""

    def __init__(self, table: pa.Table, kind: str | None = None):
        parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        self.keys = np.concatenate(parts)
        self.sizes = np.array([len(x) for x in parts])
        self.batches = table.column("batch").to_numpy()
        self.bucket = table.column("bucket")[0].as_py()
        if kind:
            self.more = np.concatenate([np.frombuffer(x, kind) for x in table.column("more").to_pylist()])

    def replies(self, values: np.ndarray) -> pa.Table:
        """values: one for each key, in the order of keys."""
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        blobs = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"batch": pa.array(self.batches, pa.int64()), "bucket": pa.array(np.full(len(blobs), self.bucket), pa.int32()), "reply": pa.array(blobs, pa.binary())})


def ask(batches: DataFrame, requests: Callable[[Batch], tuple[np.ndarray, np.ndarray | None]], answer: Callable[[pa.Table], pa.Table], buckets: int, schema: str = REPLY) -> DataFrame:
    """requests: sorted distinct keys of a batch, with values; answer: from the rows of one bucket."""

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(rows):
            keys, more = requests(b)
            yield request(b.batch, keys, more, buckets)

    return batches.mapInArrow(emit, REQUEST).groupBy("bucket").applyInArrow(answer, schema)


def settle(batches: DataFrame, replies: DataFrame, finish: Callable[[Batch, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each batch with its replies. finish gets the batch and a table of its replies."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(Batch(left), right)

    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(meet, schema)


def answered(replies: pa.Table, keys: np.ndarray, buckets: int, kind: str) -> np.ndarray:
    """The values of a batch's replies, in the order of its sorted keys."""
    out = np.zeros(len(keys), kind)
    at = cut(keys, buckets)
    for b, blob in zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist(), strict=True):
        out[at[b] : at[b + 1]] = np.frombuffer(blob, kind)
    return out


def bucket_count(batches: DataFrame, per_batch: int = 2) -> int:
    """As many buckets as batches, times per_batch: a bucket then holds about as much as a batch. With very many batches it
    holds as much as four, so that fewer rows are exchanged."""
    n = batches.count()
    return max(8, min(n * per_batch, 256 + n // 4))
