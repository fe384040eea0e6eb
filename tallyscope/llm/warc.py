"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle is
a file of such frames followed by a seek table in a skippable frame (compressed and plain
size of each frame, then the footer), so that any reader of plain Zstandard can still
decompress it whole.  The index maps a record id to bundle, frame and offset inside the
frame: a record is read by one seek and one frame.

Of records with equal payloads of at least ``REVISIT_BYTES``, those with the largest page
id are responses and the others revisits that refer to it.  Bundles go to the shared folder
under names that depend on the partition and attempt; only the bundles that a finished task
reports are in the index, so a task that is run again leaves no wrong record behind.  The id of a
record is made of its page id and payload digest, so a revisit can name the response it refers to;
equal page ids with equal payloads share it.

Archives are read back through the index: tasks get runs of neighbouring frames, of as many bundles
as there are, seek each frame and take its records from their offsets.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, land

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
LEVEL = 3
#: Salts that a payload shared by many pages is split over.
SALTS = 16
#: Fixed values of the seekable format: skippable frame, footer, and the bytes of both.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes of archives that a reading task gets.
READ_BYTES = 1 << 26
#: Object stores under the names that Spark and Arrow give them.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

INDEX = ("page_id bigint, record_id string, bundle string, frame int, frame_start bigint, frame_bytes int, "
         "offset int, length int")


class BundleWriter:
    """Writes frames and the seek table to a binary stream."""

    def __init__(self, out) -> None:
        self.out, self.frames, self.start = out, [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, plain: bytes) -> tuple[int, int, int]:
        """Append a frame: (number, start, compressed bytes)."""
        frame = self.packer.compress(plain)
        self.out.write(frame)
        self.frames.append((len(frame), len(plain)))
        self.start += len(frame)
        return len(self.frames) - 1, self.start - len(frame), len(frame)

    def finish(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack(
            "<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of each frame, from the end of a bundle."""
    stream.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    stream.seek(size - 9 - 8 * n)
    out, start = [], 0
    for packed, plain in struct.iter_unpack("<II", stream.read(8 * n)):
        out.append((start, packed, plain))
        start += packed
    return out


def record_id(page_id: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}/{digest}')}"


def record(kind: str, rid: str, url: str, payload: bytes, digest: str, refers: int | None,
           page_id: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, its full length stays in a header."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8",
            f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += [f"WARC-Refers-To: <{record_id(refers, digest)}>", f"X-Refers-To-Page: {refers}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(plain: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, where the next record starts) of the record at an offset of a frame."""
    end = plain.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in plain[at:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    return head, plain[start:stop], stop + 4


def _uri(folder: str) -> str:
    if "://" not in folder and not folder.startswith("file:"):
        return f"file://{os.path.abspath(folder)}"
    scheme, sep, rest = folder.partition("://")
    return SCHEMES.get(scheme, scheme) + sep + rest


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(_uri(uri))


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _folder(folder)
        task = TaskContext.get()
        tag, number = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out = bundle = None
        frame, rows, size = [], [], 0

        def flush():
            nonlocal frame, rows, size
            where = bundle.add(b"".join(frame))
            got = [(*r[:2], name, *where, *r[2:]) for r in rows]
            frame, rows, size = [], [], 0
            return got

        def table(done):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), (
                    pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                ["page_id", "record_id", "bundle", "frame", "frame_start", "frame_bytes", "offset", "length"])

        k = 0
        for batch in batches:
            done = []
            cols = [batch[c] for c in ("page_id", "url", "payload", "digest", "kind", "refers")]
            for i in range(len(batch)):
                page, url, payload, digest, kind, refers = (c[i].as_py() for c in cols)
                if out is None:
                    name = f"{tag}-{number:04d}.warc.zst"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    bundle, number = BundleWriter(out), number + 1
                # records without a page id, which nothing refers to, are told apart by their place
                rid = record_id(page, digest) if page is not None else record_id(-1, f"{digest}/{tag}/{k}")
                k += 1
                url = " ".join((url or "").split())
                data = record(kind, rid, url, payload, digest, refers, page)
                rows.append((page, rid, size, len(data)))
                frame.append(data)
                size += len(data)
                if size >= FRAME_BYTES:
                    done += flush()
                    if bundle.start >= BUNDLE_BYTES:
                        bundle.finish()
                        out.close()
                        out = None
            if done:
                yield table(done)
        if out is not None:
            done = flush() if rows else []
            bundle.finish()
            out.close()
            if done:
                yield table(done)
    return write


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        store, root = _folder(folder)
        unpack = zstandard.ZstdDecompressor()
        name = f = None
        for batch in batches:
            for bundle, start, packed, places in zip(*(batch[c].to_pylist() for c in (
                    "bundle", "frame_start", "frame_bytes", "places"))):
                if bundle != name:
                    if f is not None:
                        f.close()
                    name, f = bundle, store.open_input_file(f"{root}/{bundle}")
                f.seek(start)
                plain = unpack.decompress(f.read(packed))
                if sum(p["length"] for p in places) != len(plain):
                    raise ValueError(f"the index does not cover the frame at {start} of {bundle}")
                out = []
                for p in places:
                    head, body, end = parse(plain, p["offset"])
                    if end - p["offset"] != p["length"] or head["WARC-Record-ID"] != f"<{p['record_id']}>":
                        raise ValueError(f"record {p['record_id']} is not where the index says")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of {p['record_id']} does not match its digest")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                    out.append((None if page is None else int(page), int(head["X-Payload-Length"]), digest, kind,
                                None if refers is None else int(refers), p["record_id"], head["WARC-Target-URI"], body))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
                        pa.binary()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id",
                     "url", "body"])
        if f is not None:
            f.close()
    return read


READ = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "record_id string, url string, body binary")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers) of every page: the revisit rule."""
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(
        F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    big = src.where(F.octet_length("payload") >= REVISIT_BYTES)
    heads = big.groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and head is not null").select("digest", "head", F.explode(F.sequence(
            F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    src = src.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    src = src.join(heads, ["digest", "salt"], "left")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return src.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias(
        "kind"), F.when(again, F.col("head")).alias("refers"))


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write one record per page; returns the index (one row per record) and the folder.

    Null html is an empty payload, a null url an empty one.  Repeated rows each get a record;
    rows that share the largest page id of a payload are all responses.  A null page id is
    never referred to.  Records of any size are written whole; an empty table writes nothing.
    """
    if folder is None:
        folder = os.path.join(ensure_checkpoint_dir(pages.sparkSession), "warc", uuid.uuid4().hex[:12])
    store, root = _folder(folder)
    store.create_dir(root, recursive=True)
    return land(records(pages).mapInArrow(_writer(folder), INDEX), "warc-index"), folder


def frames(index: DataFrame) -> DataFrame:
    """One row a frame with the ``places`` of its records (a frame holds about ``FRAME_BYTES`` of them), dealt out to
    tasks in runs of neighbours."""
    places = F.array_sort(F.collect_list(F.struct("offset", "length", "record_id")))
    found = index.groupBy("bundle", "frame_start", "frame_bytes").agg(places.alias("places"))
    size = index.select("bundle", "frame_start", "frame_bytes").distinct().agg(F.sum("frame_bytes").alias("n")).first().n or 0
    # a number that holds at every size: by the few bytes of the rows, all frames would meet in one task
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    return found.repartitionByRange(tasks, "bundle", "frame_start")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index names, from its frame and offset; payloads are checked against their
    digests, and each frame against the index that covers it."""
    return frames(index).mapInArrow(_reader(folder), READ)


def read_record(index_row, folder: str) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record by its index row: one seek, one frame."""
    store, root = _folder(folder)
    with store.open_input_file(f"{root}/{index_row['bundle']}") as f:
        f.seek(index_row["frame_start"])
        frame = f.read(index_row["frame_bytes"])
    head, body, _ = parse(zstandard.ZstdDecompressor().decompress(frame), index_row["offset"])
    return head, body
