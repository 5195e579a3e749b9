"""WARC archives whose records are Zstandard frames sharing an embedded dictionary.

Each archive begins with a skippable frame that holds a dictionary trained on records of that archive;
every record then is one frame compressed with it, so a record can be read alone. Equal payloads are
stored once: later ones are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.sources.storage import new_path, stage

DICTIONARY_FRAME = 0x184D2A5D  # magic number of the skippable frame that holds the dictionary
ARCHIVE_BYTES = 32 << 20  # raw records of one archive; also what a task holds at once
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # records that the dictionary of an archive is trained on
READ_BYTES = 1 << 17
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, page: str, url: str | None, size: int, digest: str, body: bytes, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        *([f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"] if refers else []),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(body)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def trained_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the archive, SAMPLE_BYTES of them at most. Too few records
    to train on serve as the dictionary themselves."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=1024, d=8)
    except zstandard.ZstdError:
        content = b"".join(r[:4096] for r in sample)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(content.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(target, records: list[bytes], level: int = 3) -> None:
    dictionary = trained_dictionary(records)
    content = dictionary.as_bytes()
    target.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
    for r in records:
        target.write(compressor.compress(r))


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one by one."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    content = source.read(size)
    trained = content[:4] == struct.pack("<I", 0xEC30A437)  # else the bytes are the dictionary
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    frame, out = decompressor.decompressobj(), []
    data = source.read(READ_BYTES)
    while data:
        out.append(frame.decompress(data))
        data = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(out)
            frame, out = decompressor.decompressobj(), []
        data = data or source.read(READ_BYTES)


_FIELD = re.compile(rb"^([\w-]+): (.*?)\r?$", re.M)
_URN = re.compile(r"<urn:page:(-?\d+)>")


def parse_record(record: bytes) -> dict:
    """page_id, record_type, refers_to, payload (None for a revisit), payload_bytes, payload_digest."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.decode(): v.decode() for k, v in _FIELD.findall(head)}
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(_FIELD.findall(http))[b"Content-Length"])
    page, refers = _URN.match(fields["WARC-Record-ID"]), _URN.match(fields.get("WARC-Refers-To", ""))
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": int(page[1]) if page else None, "record_type": fields["WARC-Type"], "refers_to": int(refers[1]) if refers else None,
        "payload": payload if response else None, "payload_bytes": len(payload) if response else size,
        "payload_digest": base32_sha1(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def _opened(path: str):
    return fs.FileSystem.from_uri(path)


def write_archives(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, level: int = 3,
) -> DataFrame:
    """Write one record per page; returns the archives: path, records.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least `min_bytes` bytes the
    one with the smallest id is a response and the others revisit it; rows that share that id are all
    responses, as are payloads whose pages have no id. Other columns are not archived. `folder` is one
    that all workers reach through pyarrow's file systems (default: the shared folder). The list of
    archives is stored, so that a task that runs twice leaves a stray file but no record twice.
    """
    folder = folder or new_path(pages.sparkSession, "warc", "archives")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary"))
    )
    shared = stage(
        rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
        "shared_payloads",
    )
    ready = rows.join(shared, "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    )

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)

        def flush() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(posixpath.join(base, name)) as out:
                write_archive(out, held, level)
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(held)]})

        held: list[bytes] = []
        size = 0
        for frame in frames:
            for page, link, text, refers in zip(frame.page_id, frame.url, frame.html, frame.refers_to, strict=True):
                payload = text.encode()
                revisit = not pd.isna(refers)
                held.append(
                    _record(
                        "revisit" if revisit else "response", "none" if pd.isna(page) else str(int(page)), None if pd.isna(link) else link,
                        len(payload), base32_sha1(payload), b"" if revisit else payload, str(int(refers)) if revisit else None,
                    )
                )
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    # ids beyond 2^53 would lose digits as floats beside nulls, so they travel as text
    as_text = ready.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stage(as_text.mapInPandas(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """One row per record of the listed archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and the payload if asked for (binary, null for revisits). Each archive is read by one
    task in pieces of READ_BYTES."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame.path:
                system, name = _opened(path)
                with system.open_input_stream(name) as source:
                    rows: list[dict] = []
                    for record in read_archive(source):
                        rows.append(parse_record(record))
                        if len(rows) >= 2000:
                            yield _frame(rows, names)
                            rows = []
                    if rows:
                        yield _frame(rows, names)

    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInPandas(read, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.assign(page_id=pd.array([r["page_id"] for r in rows], "Int64"), refers_to=pd.array([r["refers_to"] for r in rows], "Int64"))
