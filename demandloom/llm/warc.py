"""WARC archives with Zstandard: one frame per record and the dictionary in a leading skippable frame.

The writer puts every task's records into archives of bounded size in the shared folder. The reader takes archives from
Spark's binary reader, loads the dictionary from the leading frame (raw or itself compressed), decodes one frame per
record, so that memory holds one record at a time, and checks: frame borders, version line, mandatory headers,
Content-Length against the block, and for responses the payload digest.

Null payloads count as empty. Of records with equal payloads of at least ``LEAST_BYTES`` bytes, that with the largest
id is a response and the others revisit it; several records with that id are all responses. Records without an id
lose against others.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import fresh_path, rows_of

LEAST_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
SAMPLE_PAGES = 500
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# The dictionary frame's magic number, and that of ordinary frames.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PIECE_BYTES = 1 << 14
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2026-01-01T00:00:00Z"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class BadRecord(ValueError):
    """An archive or record that breaks the format."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit's block holds the HTTP head alone, which still states the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    address = "".join(c if 32 < ord(c) < 127 else "%" + c.encode("utf-8", "replace").hex("%").upper() for c in url or "")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", address),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    lines = "\r\n".join(f"{k}: {v}" for k, v in head)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, payload and digest of a decoded record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0].encode() not in (b"WARC/1.0", VERSION):
        raise BadRecord("no version line")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    if missing := [k for k in REQUIRED if k not in headers]:
        raise BadRecord(f"headers missing: {missing}")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {length}, block {len(rest) - 4}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not gap or stated is None:
        raise BadRecord("no HTTP head")
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if stated != len(payload):
            raise BadRecord(f"HTTP length {stated}, payload {len(payload)}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise BadRecord("payload digest differs")
    elif payload:
        raise BadRecord("a revisit with a payload")
    return {"headers": headers, "payload": payload, "stated": stated, "digest": digest}


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def records_of(archive: bytes) -> Iterator[bytes]:
    """Decoded records of an archive, one frame at a time."""
    import zstandard

    at, dictionary, view = 0, None, memoryview(archive)
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        content = archive[8 : 8 + size]
        if len(content) != size:
            raise BadRecord("the dictionary is cut off")
        if size >= 4 and struct.unpack_from("<I", content)[0] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
        at = 8 + size
    while at < len(archive):
        if len(archive) - at < 8:
            raise BadRecord("bytes behind the last frame")
        magic, size = struct.unpack_from("<II", archive, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:  # other skippable frames
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise BadRecord(f"no frame at byte {at}")
        decoder, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while not decoder.eof:  # by pieces: what lies behind a frame is handed back, and would be for every record
            piece = view[at : at + PIECE_BYTES]
            if not len(piece):
                raise BadRecord("the last frame is cut off")
            parts.append(decoder.decompress(piece))
            at += len(piece)
        at -= len(decoder.unused_data)
        yield b"".join(parts)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from about ``SAMPLE_PAGES`` pages (drawn by a hash of page_id); a plain one if they are too few."""
    import zstandard

    total = max(1, pages.count())
    draw = F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 30))
    drawn = pages.filter(draw <= int((1 << 30) * min(1.0, SAMPLE_PAGES / total))).select(
        F.col("page_id").cast("long").alias("page_id"), F.substring(F.coalesce("html", F.lit("")), 1, 20_000).alias("html")
    )
    sample = [record(r["page_id"], "", r["html"].encode(), "0" * 40, "response", None) for r in drawn.limit(2 * SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return (sample or [record(0, "", b"", "0" * 40, "response", None)])[0][:4000]


def roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, and for repeats the id of the response they refer to."""
    digested = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    winners = (
        digested.filter(F.octet_length("html") >= LEAST_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "winner")
    )
    return digested.join(winners, "digest", "left").withColumn(
        "refers_to", F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    ).drop("winner")


def _store(folder: str):
    """The file system of a folder or URI, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` as archives and return their folder, one the whole cluster shares.

    File names follow from partition and number; a repeated task replaces its files, each in one step.
    """
    from pyspark import TaskContext

    folder = path or fresh_path(pages.sparkSession, "archives")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    content = train_dictionary(pages)
    shared = pages.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        import pyarrow as pa
        import zstandard

        store, root = _store(folder)
        task = TaskContext.get()
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value), write_content_size=True)
        lead = dictionary_frame(shared.value)
        buffer, size, number, written = [lead], len(lead), 0, 0

        def close():
            nonlocal buffer, size, number
            if size > len(lead):
                name = f"{root}/part-{task.partitionId():06d}-{number:04d}"
                with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                    out.write(b"".join(buffer))
                store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.warc.zst")
                number += 1
            buffer, size = [lead], len(lead)

        for batch in batches:
            for part in rows_of(batch, 256):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    kind = "response" if refers_to is None else "revisit"
                    frame = compressor.compress(record(page_id, url, html.encode(), digest, kind, refers_to))
                    if size + len(frame) > ARCHIVE_BYTES:
                        close()
                    buffer.append(frame)
                    size += len(frame)
                    written += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["n"])

    todo = roles(pages).select("page_id", "url", "html", "digest", "refers_to")
    todo.mapInArrow(run, "n long").agg(F.sum("n")).first()
    return folder


def _id(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(spark, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``, with its payload (null for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in records_of(content.as_py()):
                    r = parse(raw)
                    h = r["headers"]
                    response = h["WARC-Type"] == "response"
                    rows.append((_id(h["WARC-Record-ID"]), r["stated"], r["digest"], h["WARC-Type"], _id(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), r["payload"] if response else None))
                    size += len(raw)
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, READ)
