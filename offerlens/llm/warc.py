"""WARC archives as individually compressed Zstandard records with an embedded dictionary.

An archive is a leading skippable frame that holds the dictionary, then one frame for each record. Records are built and
compressed where pages are read; only frames are shuffled, to as many archives as the raw bytes ask for, so the size of
an archive does not grow with the input. Spark's text writer puts the frames into files: its line separator is an empty
skippable frame, so every file is a valid Zstandard stream, on any file system that Spark writes to.

Of records with equal payloads of ``revisit_bytes`` or more (same SHA-1 and length) that with the largest page_id is the
response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

#: Fixed values of the formats: magic numbers of the dictionary's and of an empty skippable frame, the revisit profile.
DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

NULL_ID = -(2**63)
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(0x77617263 << 96) | (page_id & (2**64 - 1)))}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record[10:-1]).int & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def warc_record(page_id: int, url: str | None, size: int, sha1: bytes, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """One record; ``payload`` is None for revisits, whose HTTP header still names the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(sha1).decode(), "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if payload is None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    body = http + (payload or b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def train_dictionary(pages: DataFrame, total: int, sample: int, sample_chars: int, size: int) -> bytes:
    """Dictionary from a bounded, seeded sample of ``total`` records: at most ``sample`` pages, ``sample_chars`` characters of each."""
    near = F.pmod(F.xxhash64(F.lit(5), "page_id", "url"), F.lit(1_000_000_000))
    few = pages.where(near < F.lit(min(1_000_000_000, 1 + 4_000_000_000 * sample // max(1, total))))  # about four times the sample
    rows = few.select("page_id", "url", F.substring("html", 1, sample_chars).alias("html")).orderBy(near).limit(sample).collect()
    records = []
    for r in rows:
        raw = r["html"].encode()
        records.append(warc_record(r["page_id"], r["url"], len(raw), hashlib.sha1(raw).digest(), raw, None, "2000-01-01T00:00:00Z"))
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: their end is the dictionary's content
        return b"".join(records)[-size:]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _responses(dictionary: bytes, level: int, date: str):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _compressor(dictionary, level)
        for batch in batches:
            sizes, digests, out = [], [], []
            for page_id, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"], strict=True):
                raw = html.as_py().encode()
                sizes.append(len(raw))
                digests.append(hashlib.sha1(raw).digest())
                out.append(z.compress(warc_record(page_id, url, len(raw), digests[-1], raw, None, date)))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, pa.binary())],
                names=["page_id", "url", "size", "sha1", "frame"],
            )

    return frames


def _archive(dictionary: bytes, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, begun = _compressor(dictionary, level), False
        for batch in batches:
            out = []
            if not begun and batch.num_rows:
                begun = True
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
            for page_id, url, size, sha1, frame, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "size", "sha1", "frame", "refers_to")), strict=True):
                out.append(frame if refers_to is None else z.compress(warc_record(page_id, url, size, sha1, None, refers_to, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return write


def write_warc(
    pages: DataFrame, path: str, *, revisit_bytes: int = 1000, archive_bytes: int = 48 << 20, level: int = 3, dictionary_bytes: int = 64 << 10,
    sample: int = 400, sample_chars: int = 16384, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives under ``path``.

    A null html is an empty payload, a null url leaves the target out, a null page_id counts as the smallest. Rows that
    repeat the page_id of a group's response are responses too. An empty table writes no archive. The dictionary is
    trained on the driver from at most ``sample`` records of ``sample_chars`` characters. ``archive_bytes`` bounds an
    archive's raw bytes but for chance and for single pages that are larger.
    """
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    digests = rows.select("page_id", F.unhex(F.sha1("html")).alias("sha1"), F.octet_length("html").alias("size"))
    count, total = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    dictionary = train_dictionary(rows, count, sample, sample_chars, dictionary_bytes)
    groups = digests.where(F.col("size") >= revisit_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    revisits = digests.join(groups.where("n > 1"), ["sha1", "size"]).where("page_id <> refers_to").groupBy("page_id", "sha1").agg(F.max("refers_to").alias("refers_to"))
    n = max(1, -(-total // archive_bytes))
    frames = rows.mapInArrow(_responses(dictionary, level, date), "page_id long, url string, size long, sha1 binary, frame binary")
    records = frames.repartition(n, "page_id").join(revisits.repartition(n, "page_id"), ["page_id", "sha1"], "left")
    records = records.select("page_id", "url", "size", "sha1", "frame", "refers_to")
    out = records.mapInArrow(_archive(dictionary, level, date), "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def dictionary_of(content: bytes) -> bytes:
    magic, size = struct.unpack("<II", content[:8])
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    return content[8 : 8 + size]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for content in batch["content"]:
            raw = content.as_buffer()
            if not len(raw):
                continue
            size = struct.unpack("<II", raw[:8].to_pybytes())[1]
            dictionary = dictionary_of(raw[: 8 + size].to_pybytes())
            z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            rows, held = [], 0
            with z.stream_reader(raw[8 + size :], read_across_frames=True) as reader:
                for head, block in read_records(io.BufferedReader(reader, 1 << 20)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    kind = head["WARC-Type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                    url = head.get("WARC-Target-URI")
                    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((page_of(head["WARC-Record-ID"]), length, digest.hex(), kind, refers, url, payload.decode() if kind == "response" else None))
                    held += len(payload)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html.

    html is null for revisits. Payloads are checked against their digests; a damaged record fails the read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("content").mapInArrow(_read, RECORDS)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return rows.select(real("page_id"), *[c.split()[0] for c in RECORDS.split(", ")[1:4]], real("refers_to"), "url", "html")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
