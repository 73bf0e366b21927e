"""WARC archives compressed with Zstandard: one frame for each record, and the dictionary in a leading skippable frame.

An archive is a row (path, content), as spark.read.format("binaryFile") gives for files: reading and writing never open
a path in a task, so archives may be in any store that Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import byte_slices, join_hot

#: The magic numbers of a Zstandard frame and of the skippable frame that holds an archive's dictionary.
FRAME, DICTIONARY_FRAME = 0xFD2FB528, 0x184D2A5D
#: An archive is closed beyond this many compressed bytes. A dictionary is trained on an archive's first payloads, up to
#: SAMPLE_BYTES, and is at most DICTIONARY_BYTES long; fewer than SAMPLES payloads make an archive without one.
ARCHIVE_BYTES, SAMPLE_BYTES, SAMPLES, DICTIONARY_BYTES = 16 << 20, 1 << 20, 16, 32 << 10
SHORTEST_REVISITED = 1000
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that isn't as its frames or headers say."""


def encode_record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    body = b"" if kind == "revisit" else payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", datetime(2020, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(size)),
        ("Content-Type", "text/html"),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"malformed header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"no {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ArchiveError("content-length isn't a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{len(rest) - 4} bytes of content; the header says {length}")
    body = rest[:length]
    if headers["warc-type"] != "revisit" and (told := headers.get("warc-payload-digest")):
        if told != "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode():
            raise ArchiveError("the payload isn't as its digest says")
    return headers, body


class ArchiveWriter:
    """Collects records; close() gives the archive's bytes."""

    def __init__(self, level: int = 3):
        self.level, self.waiting, self.waiting_bytes = level, [], 0
        self.out, self.compressor = bytearray(), None

    def add(self, record: bytes) -> None:
        if self.compressor:
            self.out += self.compressor.compress(record)
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        trained = None
        if len(self.waiting) >= SAMPLES:
            try:
                trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.waiting_bytes // 8), [r[:16384] for r in self.waiting])
            except zstandard.ZstdError:
                trained = None  # too little to learn from; the archive goes without
        plain = zstandard.ZstdCompressor(level=self.level)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained) if trained else plain
        if trained:
            packed = plain.compress(trained.as_bytes())
            self.out += struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        for record in self.waiting:
            self.out += self.compressor.compress(record)
        self.waiting = []

    def __len__(self) -> int:
        return len(self.out) + self.waiting_bytes * (self.compressor is None)

    def close(self) -> bytes:
        if self.compressor is None:
            self._begin()
        return bytes(self.out)


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an archive."""
    at, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise ArchiveError("the dictionary's frame is cut off")
        data = content[8 : 8 + size]
        if data[:4] == struct.pack("<I", FRAME):
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary = zstandard.ZstdCompressionDict(data)
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        if len(content) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", content, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        one = decompressor.decompressobj()
        # A frame that tells its content's size is decoded from the bytes it can have at most; others from the rest.
        size = zstandard.frame_content_size(content[at : at + 18])
        ahead = len(content) if size < 0 else at + size + (size >> 7) + 4096
        try:
            data = one.decompress(view[at:ahead])
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the frame at byte {at} can't be decoded: {e}") from e
        if not one.eof:
            raise ArchiveError(f"the frame at byte {at} is cut off")
        at = min(ahead, len(content)) - len(one.unused_data)
        yield parse_record(data)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = SHORTEST_REVISITED) -> DataFrame:
    """(page_id, url, payload, size, sha1, kind, refers_to) for each row of pages.

    Of rows with equal payloads of at least shortest bytes, that with the largest id is a response, and others revisit
    it. Rows that repeat that id are responses all. A null id is smaller than others; if all are null, all are responses.
    A null html is an empty payload. The rows of a payload that many have are dealt to several tasks. A very long payload
    is one record as others; an empty table has no rows. Other columns of pages are not read.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    copies = rows.where(F.col("size") >= shortest).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    spread = F.xxhash64("page_id", "url")
    rows = join_hot(rows, copies.where("n > 1"), ["sha1", "size"], "n", pages.count(), spread, "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", "payload", "size", "sha1", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _writing(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, writer = TaskContext.get().partitionId(), 0, ArchiveWriter()

        def closed() -> pa.RecordBatch:
            name = f"part-{part:06d}-{k:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.close()], pa.binary())], ["path", "content"])

        names = ("kind", "page_id", "url", "payload", "size", "sha1", "refers_to")
        for batch in batches:
            for some in byte_slices(batch, "payload"):
                for row in zip(*(some.column(c).to_pylist() for c in names), strict=True):
                    writer.add(encode_record(*row))
                    if len(writer) >= most:
                        yield closed()
                        k, writer = k + 1, ArchiveWriter()
        if len(writer):
            yield closed()

    return run


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content) archives of rows as with_revisits gives them, each closed when it has archive_bytes; a partition
    without rows makes none."""
    return rows.mapInArrow(_writing(archive_bytes), "path string, content binary")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda told: int(told[10:-1]) if len(told) > 11 else None
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, body in read_archive(content.as_py()):
                kind = headers["warc-type"]
                size = int(headers.get("warc-payload-length", len(body)))
                if kind != "revisit" and size != len(body):
                    raise ArchiveError(f"a payload of {len(body)} bytes; the header says {size}")
                digest = base64.b32decode(headers.get("warc-payload-digest", "")[5:]).hex()
                refers = number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None
                rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), body, size, digest, kind, refers))
                held += len(body)
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each record of archives
    (path, content). payload_bytes and payload_digest are of the full payload, which a revisit doesn't hold. An archive
    that isn't valid fails the query with ArchiveError, which tells where."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("content").mapInArrow(_reading, schema)
