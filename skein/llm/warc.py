"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some records, and ends in a skippable frame:
the seek table (compressed and plain size of each frame) with its footer, so any Zstandard reader can
read the whole and a seeking one can open a single frame. An index maps each record id to its bundle,
frame and offset within the plain frame. Records of equal payloads (SHA-256 and length) of at least
`min_revisit` bytes become revisits of the one with the smallest id.

Bundles are written under names of their own by each attempt of a task, whole and then renamed; the index,
committed by Spark, names only those of the attempts that counted. Null html is an empty payload; a null
url gives no target header. Repeated rows give repeated records: equal smallest ids are all responses. One id
with different payloads is a record each, judged by its own payload. Null ids are responses and never referred to.
An empty table gives no bundle and an empty index. The id is a long; null ids are written as records without one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import Scratch, hot_limit, join_hot

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

MIN_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Up to so many revisits (an id, a digest and an id, about 60 bytes each) are broadcast and payloads stay where they are; more take a shuffle of the pages.
BROADCAST_REVISITS = 200_000
DATE = "2026-01-01T00:00:00Z"
INDEX = "page_id long, record_type string, path string, frame int, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def classify(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit: int = MIN_REVISIT, scratch: Scratch | None = None) -> DataFrame:
    """(id, digest, bytes, refers_to) of each row: refers_to is null for responses. Only digests are shuffled; a common payload is dealt over tasks."""
    scratch = scratch or Scratch(df.sparkSession)
    payload = _payload(payload_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), _digest(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = scratch.save(rows, "warc_digests")
    firsts = rows.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.save(firsts.where("n > 1"), "warc_firsts")
    repeats = firsts.agg(F.sum("n")).first()[0] or 0
    joined = join_hot(rows, firsts, ["digest", "bytes"], "n", hot_limit(repeats), ["id"], "left")
    return joined.select("id", "digest", "bytes", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def _payload(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit holds no payload but its digest and length."""
    digest = hashlib.sha256(payload).hexdigest()
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        safe = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, offset: int = 0) -> tuple[dict, int]:
    """The record at offset, and the offset of the next."""
    end = plain.index(b"\r\n\r\n", offset)
    version, *lines = plain[offset:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {offset}")
    head = dict(line.split(": ", 1) for line in lines)
    start, n = end + 4, int(head["Content-Length"])
    block = plain[start : start + n]
    inner = block.index(b"\r\n\r\n")
    length = next(int(x[16:]) for x in block[:inner].decode().split("\r\n") if x.startswith("Content-Length: "))
    kind = head["WARC-Type"]
    payload = block[inner + 4 :] if kind == "response" else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"damaged payload of {head.get('X-Page-Id')}")
    number = lambda k: int(head[k]) if k in head else None
    return {"page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "payload": payload}, start + n + 4


class BundleWriter:
    """Frames in memory until close(): a bundle is bounded by its caller."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.frame_bytes, self.frames, self.sizes, self.plain, self.size = frame_bytes, [], [], bytearray(), 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of what is added."""
        if self.plain and len(self.plain) + len(data) > self.frame_bytes:
            self._end_frame()
        at = len(self.frames), len(self.plain)
        self.plain += data
        self.size += len(data)
        return at

    def _end_frame(self) -> None:
        if self.plain:
            self.frames.append(self.compress(bytes(self.plain)))
            self.sizes.append((len(self.frames[-1]), len(self.plain)))
            self.plain = bytearray()

    def close(self) -> bytes:
        self._end_frame()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def _open(path: str):
    """(filesystem, path in it) of a path or URI: executors reach shared storage by Arrow's file systems."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class BundleReader:
    def __init__(self, path: str):
        import zstandard

        files, at = _open(path)
        self.file = files.open_input_file(at)
        self.decompressor = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {path}")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        plain = self.decompressor.decompressobj().decompress(self.file.read_at(self.sizes[k][0], self.starts[k]))
        if len(plain) != self.sizes[k][1]:
            raise ValueError(f"damaged frame {k}")
        return plain

    def record(self, frame: int, offset: int) -> dict:
        return parse(self.frame(frame), offset)[0]

    def records(self):
        for k in range(len(self.sizes)):
            plain, at = self.frame(k), 0
            while at < len(plain):
                out, at = parse(plain, at)
                yield out


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches):
        import pyarrow as pa

        files, at = _open(folder)
        files.create_dir(at, recursive=True)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("path", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

        def finish(writer, rows):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{at}/.{name}", compression=None) as out:
                out.write(writer.close())
            files.move(f"{at}/.{name}", f"{at}/{name}")
            ids, kinds, frames, offsets, lengths = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, kinds, [f"{folder}/{name}"] * len(ids), frames, offsets, lengths), schema.types, strict=True)], schema=schema)

        writer, rows = BundleWriter(frame_bytes), []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(n) for n in ("id", "url", "html", "refers_to")), strict=True):
                refers_to = refers_to.as_py()
                data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to)
                frame, offset = writer.add(data)
                rows.append((page_id.as_py(), "response" if refers_to is None else "revisit", frame, offset, len(data)))
                if writer.size >= bundle_bytes:
                    yield finish(writer, rows)
                    writer, rows = BundleWriter(frame_bytes), []
        if rows:
            yield finish(writer, rows)

    return write


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Writes df's records into bundles in folder (a path or URI that executors share); returns the index."""
    scratch = scratch or Scratch(df.sparkSession)
    found = classify(df, id_col, payload_col, min_revisit, scratch).where(F.col("refers_to").isNotNull())
    # A row is a revisit by its id and its payload: the same id may stand with other bytes, which are a response.
    revisits = scratch.save(found.select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to").distinct(), "warc_revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    same = (F.col("id") == F.col("rid")) & (_digest(_payload("html")) == F.col("rdigest"))
    rows = pages.join(F.broadcast(revisits) if few else revisits, same, "left").select("id", "url", "html", "refers_to")
    index = scratch.save(rows.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX), "warc_index")
    scratch.drop("warc_digests", "warc_firsts", "warc_revisits")
    return index


def read_archives(spark: SparkSession, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the index's bundles, parsed and its payload checked; a revisit's payload is null (see resolve)."""
    columns = [c for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload") if with_payload or c != "payload"]
    schema = RECORDS if with_payload else RECORDS.replace(", payload binary", "")

    def read(batches):
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        shape = pa.schema([(c, kinds[c]) for c in columns])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in BundleReader(path).records():
                    rows.append({c: r[c] for c in columns})
                    size += r["payload_bytes"]
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, shape)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    return index.select("path").distinct().mapInArrow(read, schema)


def look_up(index: DataFrame, page_ids: list[int]) -> DataFrame:
    """The records of a few ids: each by opening one frame."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [BundleReader(x["path"]).record(x["frame"], x["offset"]) for x in batch.to_pylist()]
            for r in rows:
                yield pa.RecordBatch.from_pylist([r], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return index.where(F.col("page_id").isin(page_ids)).mapInArrow(read, RECORDS)
