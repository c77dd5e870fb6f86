"""WARC archives compressed record by record with Zstandard and a dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw or itself compressed;
then each record is one frame.  The reader takes the dictionary from that frame, decodes frame by frame, and checks
version lines, mandatory headers, Content-Length, the closing blank lines and both digests; a record that fails
raises ``WarcError``.  Other skippable frames are passed over.

The writer deduplicates by payload: of records with equal payloads of at least ``min_bytes`` bytes, the one with
the largest id is a response, the others revisit it; smaller payloads are all responses.  Rows that share that
largest id are all responses.  A null id counts as smaller than any other.

Payloads aren't shuffled: only digests, lengths and ids are.  The payloads that several pages share are a table of
digest and largest id; the pages of those, and no others, look theirs up in it, a bitmap telling nearly all others apart.

Archives are written through Spark's own file writer, so they go to any store Spark reaches and failed tasks
leave nothing behind.  That writer puts a separator after each row; the separator used is an empty skippable frame,
which every Zstandard decoder passes over.  An archive is closed after ``max_records`` records or ``max_bytes`` bytes of
frames, whichever comes first, so a reader holds little more than that (one record may be larger); its dictionary is
trained on its first records.  An archive is whole: it begins with its dictionary frame.

Rows: a null or empty payload is a record of 0 bytes; null urls are empty.  Payloads are kept whole, one record in
memory at a time; a reading task holds one archive.  Rows that share a page_id are records of their own: a payload that
several pages have is a response in each row with the largest id, and a revisit in all others.  An empty table writes
no archive and reads as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, written

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame of magic 0x184D2A50; all its bytes are ASCII, so it can serve as a text separator.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 256, 4 << 20, 32 << 10
#: Bytes of frames after which an archive is closed; a writing or reading task holds one archive.
MAX_BYTES = 64 << 20
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, uri: str, record_type: str, payload: bytes | None, refers_to: str | None, size: int | None = None, digest: str | None = None) -> bytes:
    """One response or revisit record; a revisit carries the response's HTTP headers and no payload.

    A revisit needs no ``payload`` if its ``size`` and its ``digest`` (base32) are given.
    """
    size, digest = (len(payload), sha1_base32(payload)) if payload is not None else (size, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"not a header line: {line[:80]!r}")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def parse_record(raw: bytes) -> dict:
    """Headers, payload and payload length of one whole record, checked."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not blank or not version.startswith(b"WARC/1."):
        raise WarcError(f"not a WARC record: {raw[:40]!r}")
    h = _headers(fields)
    if missing := [k for k in MANDATORY if k not in h]:
        raise WarcError(f"mandatory headers are missing: {missing}")
    if not h["content-length"].isdigit():
        raise WarcError(f"Content-Length is {h['content-length']!r}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, Content-Length says {n}")
    block = rest[:n]
    if "warc-block-digest" in h and h["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("the block doesn't have its digest")
    payload, size = block, n
    if h.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise WarcError("the block isn't an HTTP response")
        size = int(_headers(http.partition(b"\r\n")[2]).get("content-length", len(payload)))
    if h["warc-type"] == "response":
        if size != len(payload):
            raise WarcError(f"the payload has {len(payload)} bytes, its headers say {size}")
        if "warc-payload-digest" in h and h["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}":
            raise WarcError("the payload doesn't have its digest")
    elif h["warc-type"] == "revisit" and "warc-refers-to" not in h:
        raise WarcError("a revisit that refers to nothing")
    return {"headers": h, "payload": payload, "payload_bytes": size}


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, object | None]:
    """The leading skippable frame, and the dictionary for the compressor (None if the samples are too few)."""
    import zstandard

    data = b""
    if len(samples) >= 8:
        try:
            data = zstandard.train_dictionary(max(1024, min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)), samples, level=3).as_bytes()
        except zstandard.ZstdError:  # samples too short or too alike to train on: no dictionary
            data = b""
    packed = zstandard.ZstdCompressor(level=3).compress(data) if data else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed, zstandard.ZstdCompressionDict(data) if data else None


def archive_frames(records: Iterable[bytes], limit: int, max_bytes: int = MAX_BYTES) -> Iterator[bytes]:
    """Frames of archives of up to ``limit`` records, closed once they hold ``max_bytes`` bytes: a dictionary frame, then one frame a record."""
    import zstandard

    records = iter(records)
    while True:
        head: list[bytes] = []
        size = 0
        for r in records:
            head.append(r)
            size += len(r)
            if len(head) >= min(limit, TRAIN_RECORDS) or size >= TRAIN_BYTES:
                break
        if not head:
            return
        frame, dictionary = dictionary_frame(head)
        compressor = zstandard.ZstdCompressor(level=3, write_content_size=True, **({"dict_data": dictionary} if dictionary else {}))
        yield frame
        size = len(frame)
        for r in itertools.islice(itertools.chain(head, records), limit):
            packed = compressor.compress(r)
            size += len(packed)
            yield packed
            head = head[1:]
            if size >= max_bytes:
                break
        records = itertools.chain(head, records) if head else records


def archives(records: Iterable[bytes], limit: int, max_bytes: int = MAX_BYTES) -> Iterator[bytes]:
    """Whole archives of ``records``."""
    own: list[bytes] = []
    for frame in archive_frames(records, limit, max_bytes):
        if frame.startswith(struct.pack("<I", DICTIONARY_MAGIC)) and own:
            yield b"".join(own)
            own = []
        own.append(frame)
    if own:
        yield b"".join(own)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decoded frame by frame."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise WarcError("the archive ends inside a skippable frame")
            if at == 0 and magic == DICTIONARY_MAGIC and size:
                raw = bytes(view[8 : 8 + size])
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
                dictionary = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        d = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {})).decompressobj()
        out = [d.decompress(view[at : at + 65536])]
        end = at + 65536
        while not d.eof and end < len(view):
            out.append(d.decompress(view[end : end + 65536]))
            end += 65536
        if not d.eof:
            raise WarcError("the archive ends inside a record's frame")
        at = min(end, len(view)) - len(d.unused_data)
        yield b"".join(out)


def _typed(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``key, uri, body, n, digest, refers``: every row of ``rows`` (``key, uri, body, n, digest``) as a response, or as a revisit without body.

    Only bodies of the responses among shared payloads meet a shuffle, and of the few rows that a bitmap takes for them.
    """
    columns = ["key", "uri", "body", "n", "digest"]
    none = F.lit(None).cast("long").alias("refers")
    keeper = rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("key").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    keeper = written(keeper.select("digest", "keeper"), "keepers")
    told = marked(rows, keeper, "digest", "maybe")
    slim = told.filter(F.col("maybe") & (F.col("n") >= min_bytes)).select("key", "uri", "n", "digest").join(keeper.withColumn("shared", F.lit(True)), "digest", "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("key").eqNullSafe(F.col("keeper"))
    revisits = slim.filter(revisit).select("key", "uri", F.lit(None).cast("binary").alias("body"), "n", "digest", F.col("keeper").alias("refers"))
    who = F.xxhash64("key", "digest")
    rest = slim.filter(~revisit).select(who.alias("who"), "key", "digest").distinct()
    rest = written(rest.select("who", F.col("key").alias("key_"), F.col("digest").alias("digest_")), "responses")
    again = marked(told.filter(F.col("maybe") & (F.col("n") >= min_bytes)).withColumn("who", who), rest, "who", "wanted").filter("wanted")
    shared = again.join(rest.withColumnRenamed("who", "who_"), (F.col("who") == F.col("who_")) & F.col("key").eqNullSafe(F.col("key_")) & (F.col("digest") == F.col("digest_")), "left_semi")
    alone = told.filter(~F.col("maybe") | (F.col("n") < min_bytes))
    return alone.select(*columns, none).unionAll(shared.select(*columns, none)).unionAll(revisits)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, records: int = 100_000, max_bytes: int = MAX_BYTES) -> None:
    """Write one record per row of ``pages`` to archives under ``path`` (files ``*.txt``, each a Zstandard stream)."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("uri"), body.alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body").cast("long"), "digest": F.unhex(F.sha1("body"))})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for batch in batches:
                cols = [batch.column(c) for c in ("key", "uri", "body", "n", "digest", "refers")]
                for at in range(0, batch.num_rows, 256):
                    for k, u, b, n, d, r in zip(*[c.slice(at, 256).to_pylist() for c in cols]):
                        uri = u.replace("\r", "%0D").replace("\n", "%0A")
                        name, other = f"urn:page:{'' if k is None else k}", None if r is None else f"urn:page:{r}"
                        yield record_bytes(name, uri, "response" if b is not None else "revisit", b, other, n, base64.b32encode(d).decode())

        for archive in archives(each(), records, max_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    # one row is one archive and one file
    whole = _typed(rows, min_bytes).mapInArrow(encode, "archive binary")
    whole.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """The records of all archives under ``path``: ``archive, warc_type, record_id, refers_to, target_uri, payload_digest, payload_bytes, payload``."""
    names = ["archive", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column("path")[k].as_py(), batch.column("content")[k].as_buffer()
                rows, size = [], 0
                for raw in read_archive(data):
                    r = parse_record(raw)
                    h = r["headers"]
                    bare = lambda s: None if s is None else s.strip("<>")
                    rows.append((name, h["warc-type"], bare(h["warc-record-id"]), bare(h.get("warc-refers-to")), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, r["payload_bytes"], r["payload"]))
                    size += len(raw)
                    if size >= 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # one archive a batch: what a task holds is one file
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(decode, "archive string, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary")
