"""WARC archives compressed with Zstandard: one frame per record, the dictionary in the leading skippable frame.

Each task writes its records to archives of its own under a shared folder and returns their names; the list of names
is a table that Spark commits, so archives of a failed or repeated attempt are never read. Reading deals out archives,
loads the dictionary from the first frame, decodes a frame at a time and validates every header and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_uri
from .common import LOWEST, as_null, narrow, null_as, sample_ids, store, whole

VERSION = "WARC/1.1"
#: Fixed by the format: the skippable frame that holds a dictionary, a trained dictionary, a compressed one.
SKIPPABLE, TRAINED, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
#: Bytes of an archive after which a task begins the next, and bytes read at a time.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 18
#: Dictionary: size, and the bounded sample of pages (in order of a hash of the id) that it is trained on.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_CHARS = 32 << 10, 300, 16_384
DATE = "1970-01-01T00:00:00Z"


class BadArchive(ValueError):
    """An archive that breaks the format; the text names it and the record."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def build(page_id: int, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit without the payload if another page holds it already."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url) if url else _urn(page_id)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(lines: bytes, where: str) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8").split("\r\n"):
        name, mark, value = line.partition(":")
        if not mark or not name or name != name.strip():
            raise BadArchive(f"{where}: header line {line!r}")
        out[name.lower()] = value.strip()
    return out


def _length(fields: dict[str, str], where: str) -> int:
    value = fields.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise BadArchive(f"{where}: Content-Length {value!r}")
    return int(value)


def parse(data: bytes, where: str = "record") -> Record:
    """One record, with its version, mandatory headers, lengths, end and digest checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not mark or version != VERSION.encode():
        raise BadArchive(f"{where}: not a {VERSION} record")
    headers = _fields(lines, where)
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if not headers.get(name):
            raise BadArchive(f"{where}: no {name}")
    length = _length(headers, where)
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: Content-Length {length}, but {len(rest) - 4} bytes and the end")
    block = rest[:length]
    status, mark, payload = block.partition(b"\r\n\r\n")
    first, _, lines = status.partition(b"\r\n")
    if not mark or not first.startswith(b"HTTP/"):
        raise BadArchive(f"{where}: no HTTP response")
    http = _fields(lines, where)
    promised = _length(http, where)
    if headers["warc-type"] == "response":
        if len(payload) != promised:
            raise BadArchive(f"{where}: payload of {len(payload)} bytes, promised {promised}")
        if headers["warc-payload-digest"] != f"sha1:{_digest(payload)}":
            raise BadArchive(f"{where}: payload digest differs")
    elif headers["warc-type"] == "revisit":
        if payload or not headers.get("warc-refers-to"):
            raise BadArchive(f"{where}: a revisit refers to a record and has no payload")
    else:
        raise BadArchive(f"{where}: type {headers['warc-type']}")
    return Record(headers, block, http, payload)


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    kind = int.from_bytes(data[:4], "little")
    if kind == FRAME:
        return _as_dictionary(zstandard.ZstdDecompressor().decompressobj().decompress(data))
    return zstandard.ZstdCompressionDict(
        data, dict_type=zstandard.DICT_TYPE_FULLDICT if kind == TRAINED else zstandard.DICT_TYPE_RAWCONTENT
    )


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def read_archive(uri: str) -> Iterator[Record]:
    """The records of one archive; memory is that of one record and ``READ_BYTES``."""
    system, path = _place(uri)
    with system.open_input_stream(path, compression=None) as stream:
        start = stream.read(8)
        if len(start) < 8 or int.from_bytes(start[:4], "little") != SKIPPABLE:
            raise BadArchive(f"{uri}: no leading dictionary frame")
        size = int.from_bytes(start[4:], "little")
        dictionary = stream.read(size)
        if len(dictionary) != size:
            raise BadArchive(f"{uri}: dictionary frame cut short")
        decompressor = zstandard.ZstdDecompressor(dict_data=_as_dictionary(dictionary))
        data, number = stream.read(READ_BYTES), 0
        while data:
            frame, parts = decompressor.decompressobj(), []
            where = f"{uri}, record {number}"
            while True:
                try:
                    parts.append(frame.decompress(data))
                except zstandard.ZstdError as broken:
                    raise BadArchive(f"{where}: {broken}") from broken
                if frame.eof:
                    data = frame.unused_data or stream.read(READ_BYTES)
                    break
                data = stream.read(READ_BYTES)
                if not data:
                    raise BadArchive(f"{where}: frame cut short")
            yield parse(b"".join(parts), where)
            number += 1


def with_originals(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """``(id, url, payload, refers_to)``: of equal payloads of ``min_bytes`` or more the largest id is the original.

    Others refer to it; rows that repeat its id are originals too. A missing payload is empty, a missing id is the
    lowest.
    """
    rows = narrow(pages, id=null_as(page_id, LOWEST), url=url, payload=whole(payload).cast("binary"))
    rows = rows.withColumn("mark", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("mark")
        .agg(F.max("id").alias("original"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("mark", "original")
    )
    repeated = store(repeated, "warc-originals")
    refers = F.when(F.col("original") != F.col("id"), F.col("original"))
    return rows.join(repeated, "mark", "left").select("id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``(id, url, payload, refers_to)`` and return the stored list ``(archive, records, bytes)``."""
    shipped = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        settings = _as_dictionary(shipped.value)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=settings, write_checksum=True)
        system, path = _place(folder)
        system.create_dir(path, recursive=True)
        stream, name, records, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            stream.close()
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], names=["archive", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "refers_to")]
            for row in range(batch.num_rows):
                frame = compressor.compress(build(*(c[row].as_py() for c in columns)))
                if stream is not None and size + len(frame) > archive_bytes:
                    yield done()
                    stream = None
                if stream is None:
                    name, records, start = f"{uuid.uuid4().hex}.warc.zst", 0, dictionary_frame(shipped.value)
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                    stream.write(start)
                    size = len(start)
                stream.write(frame)
                records, size = records + 1, size + len(frame)
        if stream is not None:
            yield done()

    return store(rows.mapInArrow(run, "archive string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """``(id, url, payload_bytes, payload_digest, record_type, refers_to)`` of every record, read from the archives.

    The number of records is checked against the list; a broken archive raises ``BadArchive``.
    """

    def number(urn: str) -> int:
        return int(urn.removeprefix("<urn:page:").removesuffix(">"))

    def run(batches):
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                seen, held = 0, []
                for record in read_archive(archive):
                    seen += 1
                    h = record.headers
                    refers = number(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    held.append((number(h["warc-record-id"]), h.get("warc-target-uri"), int(record.http["content-length"]), digest, h["warc-type"], refers))
                    if len(held) == 4096:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)
                if seen != records:
                    raise BadArchive(f"{archive}: {seen} records, {records} written")

    files = max(archives.count(), 1)
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.repartition(files).mapInArrow(run, schema)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)


def sample_dictionary(pages: DataFrame, payload: str = "html", page_id: str = "page_id") -> bytes:
    """Trained on at most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` each."""
    rows = narrow(pages, id=page_id, payload=whole(payload))
    ids = sample_ids(rows.select("id"), SAMPLE_PAGES, 6)
    some = rows.filter(F.length("payload").between(1, SAMPLE_CHARS)).join(F.broadcast(ids), "id")  # at most SAMPLE_PAGES
    return train_dictionary([x.encode() for x in sorted(r["payload"] for r in some.dropDuplicates(["id"]).collect())])


def report(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back. No pages give no archives and no rows."""
    folder = scratch_uri(pages.sparkSession, "warc")
    archives = write_archives(with_originals(pages), folder, sample_dictionary(pages))
    return read_archives(archives).select(
        as_null("id", LOWEST).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        as_null("refers_to", LOWEST).alias("refers_to"),
    )
