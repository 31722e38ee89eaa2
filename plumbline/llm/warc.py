"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive is a row (``archive``, ``content``); Spark keeps such rows in any store it can write. ``export`` puts them out
as ``.warc.zst`` files and ``files`` reads such files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.base import keep

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_DICTIONARY = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes after which a task begins a new archive, dictionary bytes, and bytes of payloads it is trained on.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
TRAINING_BYTES = 512 << 10
DATE = "1970-01-01T00:00:00Z"
#: Bytes that are handed to the decompressor at a time.
STEP = 64 << 10


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id, url, payload: bytes, refers_to=None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that refers to another record."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(records: list[bytes]) -> bytes:
    samples, held = [], 0
    for r in records:
        if held >= TRAINING_BYTES:
            break
        samples.append(r[: DICTIONARY_BYTES])
        held += len(samples[-1])
    try:
        content = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:  # too little to train on
        content = b""
    if not content:
        content = b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"
    writer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(content))
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content + b"".join(map(writer.compress, records))


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == ZSTD_DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


def write(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Archives (``archive`` string, ``content`` binary) with one record per row.

    Of the rows with equal payloads of at least ``min_revisit_bytes``, the one with the largest id is a response and the
    others revisit it; shorter ones are all responses. A null html is an empty payload. Rows that share the largest
    id are each a response; a null id comes after all others, and if all ids of a group are null each row is a response. A null url leaves the field out. An
    empty table gives no archives.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # most digests occur once; only those of several rows are joined
    leaders = (
        rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("sha", "leader")
    )
    rows = rows.join(leaders, "sha", "left").select("id", "url", "html", F.when((F.col("id") != F.col("leader")) | F.col("id").isNull(), F.col("leader")).alias("refers_to"))

    def run(batches):
        held, size = [], 0

        def done():
            content = _archive(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{digest(content)}.warc.zst"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for key, link, text, refers in zip(*(batch.column(c) for c in ("id", "url", "html", "refers_to")), strict=True):
                held.append(record_bytes(key.as_py(), link.as_py(), text.as_py().encode(), refers.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return rows.mapInArrow(run, "archive string, content binary")


def frames(content: bytes):
    """The bytes of each record in turn, with the dictionary of the leading skippable frame if there is one."""
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at) if at + 8 <= len(view) else (0,)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                body = bytes(view[8 : 8 + size])
                if len(body) < size:
                    raise ValueError("the dictionary frame is cut short")
                if body[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                dictionary = _dictionary(body)
            at += 8 + size
            continue
        reader = (zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()).decompressobj()
        out = []
        while not reader.eof:
            step = view[at : at + STEP]
            if not len(step):
                raise ValueError("a frame is cut short")
            out.append(reader.decompress(step))
            at += len(step) - len(reader.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Check one record and take it apart; ``problem`` says what is wrong, or is None."""
    out = dict.fromkeys(("record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload", "problem"))
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def key(name):
        m = re.fullmatch(r"<urn:record:(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    out |= {"record_id": key("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": key("warc-refers-to")}
    if "warc-target-uri" in fields:
        out["url"] = re.sub(r"%([01][0-9A-F]|20|25)", lambda m: chr(int(m[1], 16)), fields["warc-target-uri"])
    length = fields.get("content-length", "")
    if not found or not re.match(r"WARC/\d", lines[0]) or "warc-record-id" not in fields or "warc-type" not in fields:
        return out | {"problem": "header"}
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "length"}
    block = rest[:-4]
    if fields.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        return out | {"problem": "block digest"}
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length: *(\d+)", http)
    out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    out["payload_bytes"] = int(size[1]) if size else len(payload)
    if out["record_type"] == "response":
        out["payload"] = payload
        if len(payload) != out["payload_bytes"] or digest(payload) != out["payload_digest"]:
            return out | {"problem": "payload"}
    return out


FIELDS = "record_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"


def read(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of each archive, in its order, with its payload (null for a revisit).

    Heads, lengths and digests are checked; ``problem`` names what fails (null when the record is sound). A null or empty
    content gives no rows; one that breaks off in a frame gives the records before it and one row with problem ``frame``.
    """
    types = pa.schema(
        [("record_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64())]
        + [("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())]
    )

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                held, size = [], 0
                try:
                    for raw in frames(value.as_py() or b""):
                        held.append(parse(raw))
                        size += len(raw)
                        if size > ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=types)
                            held, size = [], 0
                except (ValueError, zstandard.ZstdError):
                    held.append({"problem": "frame"})
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=types)

    return archives.select(F.col(content)).mapInArrow(run, FIELDS)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Archives from ``.warc.zst`` files in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("path").alias("archive"), "content")


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as a file below ``uri`` (a folder that every executor reaches); rows (``archive``, ``bytes``).
    Names follow from the content, so a task that runs again writes the same file."""

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")


def through_archives(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read their records back."""
    return read(keep(write(pages, id_column, url, html, min_revisit_bytes)))
