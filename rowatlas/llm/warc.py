"""Zstandard WARC archives: a writer, and a reader of one frame per record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is one frame. An archive holds about ARCHIVE_BYTES (a larger record alone more), so a
reader may take it whole. The writer is Spark's own text writer with one archive as the one row of a file, so files
are committed by the job's output committer in any store: an archive ends in
the header of a one-byte skippable frame, and the line end that the writer
adds is that byte. The reader takes whole files through Spark's ``binaryFile``; frames with and without
a content size are read.

The reader fails on: a missing or damaged dictionary frame, a frame that does not
decode, a wrong version line, a missing or repeated mandatory header, a content or
payload length or digest that differs, a revisit that names nothing, bytes after the record.

Defined cases: a null html is an empty payload; a null url is an empty header; control
characters in a url are percent-encoded; a null page_id is carried as null; rows
that repeat the largest page_id of a payload are all responses; an empty table
writes no record; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowatlas.llm import scratch
from rowatlas.llm.hot import join_counted
from rowatlas.llm.sampling import smallest

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
_LINE_END = struct.pack("<II", SKIPPABLE_MAGIC, 1)  # the writer's "\n" is its content
_VERSION = b"WARC/1.1\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages, and first bytes of each, from which the dictionary is trained. It only makes frames smaller; records hold whole pages.
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 32 << 10
#: Bytes of frames after which an archive ends.
ARCHIVE_BYTES = 16 << 20
#: Groups of equal payloads that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages, those with the smallest hash; empty if there is too little."""
    import zstandard

    body = F.coalesce(F.col(html), F.lit(""))
    fit = pages.select("page_id", body.alias("h")).where(F.octet_length("h") >= 64).select("page_id", F.substring(F.col("h").cast("binary"), 1, DICTIONARY_PAGE_BYTES).alias("h"))
    texts = sorted(bytes(r.h) for r in smallest(fit, F.xxhash64("page_id", "h"), DICTIONARY_PAGES).select("h").collect())
    if len(texts) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on
        return b""


def plan_records(pages: DataFrame, tables: scratch.Tables, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, html, digest, refers_to``; refers_to is null for responses.

    Payloads are grouped by digest with map-side aggregation, so a payload that a third
    of the pages share is one row per task. Only groups of two and more are joined
    back: by broadcast while their counted number is bounded, else by a shuffle on the digest, hot ones aside.
    """
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    body = body.withColumn("digest", F.sha1("html"))
    groups = body.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1")
    groups = tables.write(groups.select(F.col("digest").alias("of"), "n", "last"), "payload-groups")
    # Only payloads of that size look for a group.
    body = body.withColumn("of", F.when(F.octet_length("html") >= min_bytes, F.col("digest")))
    joined = body.join(F.broadcast(groups), "of", "left") if groups.count() <= BROADCAST_GROUPS else join_counted(body, groups, "of", "n", body.count(), True)
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    key = "" if page_id is None else str(page_id)
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    block = b"" if refers_to is not None else (_HTTP % len(payload)).encode() + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{key}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return _VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writing(dictionary: bytes, level: int, archive_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        held, size = [head], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([*held, _LINE_END])], pa.binary())], ["value"])

        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                for r in whole.slice(k, 64).to_pylist():
                    held.append(packer.compress(_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield archive()
                        held, size = [head], 0
        if size:
            yield archive()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, path: str, min_bytes: int = 1000, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every page, in archives of about ``archive_bytes``.

    The bytes pass through the text writer as a string that is never looked into.
    """
    tables = scratch.Tables(spark)
    archives = plan_records(pages, tables, min_bytes).mapInArrow(_writing(train_dictionary(pages), level, archive_bytes), "value binary")
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    tables.drop("payload-groups")


def _frame_end(data: memoryview, at: int) -> int:
    """End of the frame that starts at ``at``: walks its block headers."""
    import zstandard

    end = at + zstandard.frame_header_size(data[at : at + 18])
    checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("cut frame")
        word = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * checksum
    if end > len(data):
        raise ValueError("cut frame")
    return end


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded record of each frame of an archive."""
    import zstandard

    view, at, unpacker = memoryview(data), 0, None
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + size > len(view):
                raise ValueError("cut skippable frame")
            if at == 0:
                if magic != DICTIONARY_MAGIC:
                    raise ValueError("the first frame holds no dictionary")
                held = bytes(view[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            if unpacker is None:
                raise ValueError("the archive does not start with a dictionary frame")
            end = _frame_end(view, at)
            yield unpacker.decompressobj().decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"unknown frame magic {magic:#x}")


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one record, checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark or not head.startswith(_VERSION):
        raise ValueError("not a WARC/1.1 record")
    fields: dict[str, str] = {}
    for line in head[len(_VERSION) :].decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length"} - fields.keys():
        raise ValueError(f"missing headers {sorted(missing)}")
    n, kind = int(fields["content-length"]), fields["warc-type"]
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the content length differs")
    if kind == "response":
        http, mark, payload = rest[:n].partition(b"\r\n\r\n")
        said = re.search(rb"\r\nContent-Length: (\d+)", http)
        if not mark or not said or int(said[1]) != len(payload) or int(fields["x-payload-length"]) != len(payload):
            raise ValueError("the payload length differs")
        if fields["warc-payload-digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            raise ValueError("the payload digest differs")
    elif kind == "revisit":
        payload = None
        if n or "warc-refers-to" not in fields:
            raise ValueError("a revisit has a block or names no record")
    else:
        raise ValueError(f"unknown record type {kind!r}")
    return {"headers": fields, "payload": payload}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", urn or "")
    return int(m[1]) if m and m[1] else None


_READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _reading(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for data in batch.column("content"):
                out = []
                for raw in frames(data.as_py()):
                    r = parse_record(raw)
                    h = r["headers"]
                    out.append({"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload": r["payload"] if with_payload else None, "payload_bytes": int(h["x-payload-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": _page(h.get("warc-refers-to"))})
                    if len(out) == 500:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_reading(with_payload), _READ)
