"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about `frame_bytes`, each compressed on its own, so that one record is read by
decompressing one frame. A bundle ends with a skippable frame that holds the seek table of the public seekable format:
compressed and decompressed size of each frame, their number, and a magic number. The writer returns an index that maps
each record to its bundle, its frame and its place in the frame.

Of records with equal payloads, the one with the smallest id is written as response, the others as revisits without
payload. The decision is a join on the payload's digest; both sides are plain shuffles, so Spark can split a payload
that very many pages share.

Nulls and ties: a null payload is empty. A null id is larger than all others; if all ids of a payload are null, all are
responses. Rows that repeat the response's id and payload are responses too. A null url is left out of the record. Other
columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.batches import shared_uri, stored, work_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_size long, place long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = 0) -> DataFrame:
    """page_id, url, payload, first: the smallest id with the same payload, if it is another's and the payload has `least` bytes."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    joined = rows.join(stored(groups, "payloads"), "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n"))
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    body = http + (payload if first is None else b"")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, place: int = 0) -> Iterator[tuple]:
    """Records of a decompressed frame, from `place` on, as rows of RECORD."""
    while place < len(data):
        end = data.index(b"\r\n\r\n", place)
        head = dict(x.split(": ", 1) for x in data[place:end].decode().split("\r\n")[1:])
        body = data[end + 4 : end + 4 + int(head["Content-Length"])]
        place = end + 8 + len(body)
        http, _, payload = body.partition(b"\r\n\r\n")
        size = next(int(x[15:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
        number = lambda x: int(x[10:-1]) if len(x) > 11 else None
        url = head.get("WARC-Target-URI")
        if url is not None and "\\" in url:
            url = re.sub(r"\\(.)", lambda m: {"r": "\r", "n": "\n"}.get(m[1], m[1]), url)
        digest, kind = head["WARC-Payload-Digest"][5:], head["WARC-Type"]
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"record {head['WARC-Record-ID']}: the payload doesn't have its digest")
        yield number(head["WARC-Record-ID"]), url, kind, number(head.get("WARC-Refers-To", "<urn:page:>")), size, digest, payload


def write_bundles(records: DataFrame, path: str, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write rows of roles() to bundles under `path`, a folder that all executors share; returns the stored index.

    A bundle's name has its task attempt, and the index names the bundles of attempts that ended: leftovers of lost
    executors are never read."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        packer, task = zstd.ZstdCompressor(level=level), TaskContext.get()
        frame, spans, sizes, done, index, sink, name, number = bytearray(), [], [], 0, [], None, "", 0

        def close_frame() -> None:
            nonlocal done
            if frame:
                packed = packer.compress(bytes(frame))
                index.extend((i, name, len(sizes), done, len(packed), place, size) for i, place, size in spans)
                sizes.append((len(packed), len(frame)))
                sink.write(packed)
                done += len(packed)
                frame.clear()
                spans.clear()

        def close() -> pa.RecordBatch:
            nonlocal sink
            close_frame()
            table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
            sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
            sink.close()
            sink = None
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], ["page_id", "bundle", "frame", "frame_at", "frame_size", "place", "length"])
            index.clear()
            sizes.clear()
            return out

        for b in rows:
            for page_id, url, payload, first in zip(*(b.column(c) for c in range(4)), strict=True):
                if sink is None:
                    name, number, done = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.zst", number + 1, 0
                    sink = files.open_output_stream(f"{folder}/{name}", compression=None)
                text = record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py())
                spans.append((page_id.as_py(), len(frame), len(text)))
                frame += text
                if len(frame) >= frame_bytes:
                    close_frame()
                    if done >= bundle_bytes:
                        yield close()
        if sink is not None:
            yield close()

    return stored(records.select("page_id", "url", "payload", "first").mapInArrow(run, INDEX), "warc-index")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def seek_table(source, size: int) -> list[tuple[int, int]]:
    """(place, compressed size) of each frame, from the footer."""
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    source.seek(size - 9 - 8 * n)
    sizes = [x for x, _ in struct.iter_unpack("<II", source.read(8 * n))]
    return list(zip(accumulate(sizes, initial=0), sizes, strict=False))


def read_bundles(index: DataFrame, path: str) -> DataFrame:
    """All records of all bundles of an index, frame by frame through each bundle's own seek table."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        files, folder = pafs.FileSystem.from_uri(path)
        opener = zstd.ZstdDecompressor()
        for b in rows:
            for name in b.column(0).to_pylist():
                with files.open_input_file(f"{folder}/{name}") as source:
                    for at, size in seek_table(source, source.size()):
                        source.seek(at)
                        yield _rows(list(parse(opener.decompress(source.read(size)))))

    bundles = index.select("bundle").distinct()
    # the names are few bytes, so adaptive execution would read all bundles in one task
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(run, RECORD)


def fetch(index: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """The records of some ids (column page_id), each by decompressing its frame alone."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        files, folder = pafs.FileSystem.from_uri(path)
        opener = zstd.ZstdDecompressor()
        for b in rows:
            for x in b.to_pylist():
                with files.open_input_file(f"{folder}/{x['bundle']}") as source:
                    source.seek(x["frame_at"])
                    yield _rows([next(parse(opener.decompress(source.read(x["frame_size"])), x["place"]))])

    return index.join(ids.select("page_id").distinct(), "page_id", "left_semi").mapInArrow(run, RECORD)


def archive(pages: DataFrame, path: str | None = None, **names: str) -> tuple[DataFrame, str]:
    """Write all pages; returns the index and the folder of the bundles."""
    path = shared_uri(path or work_dir(pages.sparkSession, "warc"))
    return write_bundles(roles(pages, **names), path), path
