"""WARC archives compressed with Zstandard: one frame for each record.

An archive may begin with a skippable frame that holds the dictionary its
records were compressed with, raw or itself a Zstandard frame.  The reader
loads that dictionary, decodes frame after frame without holding the file, and
checks each record: version line, header syntax, the length of the block, the
closing blank lines, that the frame ends with its record, and the payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .scratch import Scratch, tidy

DICTIONARY_MAGIC = 0x184D2A5D
"""Fixed value of the format: the skippable frame that holds a dictionary."""
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ROLL_BYTES = 32 << 20
"""A new archive is begun past this many bytes."""
READ_BYTES = 1 << 20
STEP_BYTES = 4096


class WarcError(ValueError):
    """An archive that breaks the format."""


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def record(kind: str, record_id: str, uri: str, date: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record; a revisit carries the HTTP header and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record, or WarcError."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC version line or header end")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"header line without a name: {line[:60]!r}")
        headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no {need}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest):
        raise WarcError("the block is not as long as its header says")
    if rest[-4:] != b"\r\n\r\n":
        raise WarcError("no blank lines after the block")
    return headers, rest[:-4]


def frames(source) -> Iterator[bytes]:
    """The content of each frame of a file-like object, one at a time."""
    data, at, dictionary, first = b"", 0, None, True

    def need(n: int) -> bool:
        """Reads on until n bytes are there from ``at`` on, if the source has them."""
        nonlocal data, at
        while len(data) - at < n:
            more = source.read(READ_BYTES)
            if not more:
                return False
            data, at = data[at:] + more, 0
        return True

    while need(1):
        if need(8) and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            magic, size = struct.unpack_from("<II", data, at)
            if not need(8 + size):
                raise WarcError("the archive ends in a skippable frame")
            if magic == DICTIONARY_MAGIC and first:
                content = bytes(data[at + 8 : at + 8 + size])
                if content[:4] == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            at, first = at + 8 + size, False
            continue
        first = False
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        try:
            while not one.eof:
                if not need(1):
                    raise WarcError("the archive ends in a frame")
                # By small steps: what a step holds of the next frame is copied.
                step = data[at : at + STEP_BYTES]
                parts.append(one.decompress(step))
                at += len(step) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"not a Zstandard frame: {e}") from e
        yield b"".join(parts)


def _id(text: str) -> int | None:
    tail = text.strip("<>").rpartition(":")[2]
    return None if tail in ("", "none") else int(tail)


def read_record(raw: bytes) -> dict:
    """The fields of one record, with its payload checked against its digest."""
    headers, block = parse(raw)
    top, gap, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    length = next((int(v) for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(payload))
    said = headers.get("warc-payload-digest", "").partition(":")[2]
    digest = base64.b32decode(said).hex() if said else None
    if kind == "response" and (len(payload) != length or digest is not None and hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("the payload is not what its header says")
    return {
        "page_id": _id(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": _id(headers["warc-refers-to"]) if "warc-refers-to" in headers else None, "payload": payload if kind == "response" else None,
    }


def _writer(folder: str, dictionary: bytes, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
        out, name, written, count = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            ids, urls, htmls, digests, kinds, refs = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, written, count = fs.open_output_stream(f"{root}/{name}"), 0, 0
                    if dictionary:
                        out.write(dictionary_frame(dictionary))
                page, html = ids[i].as_py(), htmls[i]
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                uri = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in urls[i].as_py() or "")
                digest = base64.b32encode(bytes.fromhex(digests[i].as_py())).decode()
                ref = refs[i].as_py()
                raw = pack.compress(record(kinds[i].as_py(), f"urn:page:{'none' if page is None else page}", uri, date, digest, payload, f"urn:page:{ref}"))
                out.write(raw)
                written, count = written + len(raw), count + 1
                if written >= ROLL_BYTES:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["archive", "records"])

    return run


def _reader(folder: str, with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{root}/{archive}") as source:
                    rows, size, seen = [], 0, 0
                    for raw in frames(source):
                        rows.append(read_record(raw))
                        seen += 1
                        size += len(raw) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)
                            rows, size = [], 0
                    if seen != records:
                        raise WarcError(f"{archive} has {seen} records; {records} were written")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return run


class WarcArchive:
    """Writes pages to archives in ``folder`` (a URI that driver and executors share) and reads them back.

    A null page is an empty payload, a null url an empty one, a null id is kept
    as such.  Rows may repeat: each is a record.  Of records with equal payloads
    of ``least`` bytes or more, the one with the largest id is the response, and
    the others revisit it; of rows that repeat that id too, each is a response.
    Other columns are ignored; an empty table writes no archive.  The dictionary is trained on
    at most ``sample`` pages, ``sample_chars`` characters of each; records are whole.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 1000, level: int = 3, sample: int = 300, sample_chars: int = 8192, date: str = "1970-01-01T00:00:00Z"):
        self.scratch = Scratch(spark)
        self.folder = (folder or self.scratch.path("warc")).rstrip("/")
        if self.folder.startswith("/"):
            self.folder = "file://" + self.folder
        self.least, self.level, self.sample, self.sample_chars, self.date = least, level, sample, sample_chars, date

    def dictionary(self, pages: DataFrame, count: int) -> bytes:
        """Trained on the pages with the least hashes; a bound on the hash leaves few of them before any text is gathered."""
        share = min(1.0, 4.0 * self.sample / max(1, count))
        some = pages.withColumn("h", F.shiftrightunsigned(F.xxhash64("page_id", "url"), 1)).where((F.col("h") <= min(2**63 - 1, int(share * 2**63))) & (F.length("html") > 0))
        some = some.select("h", F.substring("html", 1, self.sample_chars).alias("html"))
        texts = [r.html.encode() for r in some.orderBy("h", "html").limit(self.sample).select("html").collect()]
        try:
            return zstandard.train_dictionary(32_768, texts).as_bytes() if len(texts) >= 20 else b""
        except zstandard.ZstdError:
            return b""

    def write(self, pages: DataFrame) -> DataFrame:
        """(archive, records) of the archives written."""
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"))
        rows = rows.withColumn("large", F.octet_length(F.coalesce("html", F.lit(""))) >= self.least).withColumn("key", F.xxhash64("digest"))
        count = pages.count()
        words = bloom.words_for(count)
        seen = bloom.flagged(rows, "key", bloom.of(rows.where("large").select("key"), "key", words, least=2), words, "maybe")
        shape = ["page_id", "url", "html", "digest"]
        alone = seen.where("not (maybe and large)").select(*shape, F.lit("response").alias("kind"), F.lit(None).cast("long").alias("ref"))
        some = seen.where("maybe and large")
        best = self.scratch.keep(some.groupBy("digest").agg(F.max("page_id").alias("best")), "best")
        same = some.join(best, "digest")
        first = F.col("page_id").eqNullSafe(F.col("best"))
        same = same.select(*shape, F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("best")).alias("ref"))
        run = _writer(self.folder, self.dictionary(pages, count), self.level, self.date)
        return self.scratch.keep(alone.union(same).mapInArrow(tidy(run), "archive string, records long"), "manifest")

    def read(self, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
        """A row for each record of the archives; WarcError where one is not valid."""
        shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
        spread = manifest.repartition(max(1, manifest.count()), "archive")
        return spread.mapInArrow(tidy(_reader(self.folder, with_payload)), shape + ", payload binary" * with_payload)
