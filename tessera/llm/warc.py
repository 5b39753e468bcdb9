"""WARC archives, written once per payload and read back by index.

Writing: pages are dealt to files by page_id, and every record is a gzip member of its own; of records with equal
payloads (SHA-1 and length) of at least ``least`` bytes the one with the smallest page_id is a ``response``, the others
are ``revisit`` records that name it. Each file comes with rows of an index: page_id, file, offset, length, URL and
digest of every record.

Reading: the records wanted are selected in the index; for each file their byte ranges are sorted, ranges closer than
``gap`` bytes are coalesced into one read of at most ``most`` bytes (or one record, if that is longer), and each record
is parsed from its own bytes and checked against its digest.

Payloads are the block's bytes after the HTTP headers; a null html is an empty payload; a null URL is ``about:blank``;
control characters in a URL are percent-encoded. A null page_id sorts after all others when it competes for the
response. Of rows with equal page_id and payload the first is the response and the others revisit it. An empty table
writes no file. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import files
from tessera.llm.common import blocks, scratch

INDEX = "page_id long, file string, offset long, length long, url string, digest string"
CONTROL = re.compile(rb"[\x00-\x20\x7f]")
#: Payload bytes that a reader returns at a time.
OUT = 2 << 20
DATE = b"2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _name(page_id: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"null" if page_id is None else b"%d" % page_id)


def record(page_id: int | None, url: bytes | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record."""
    uri = CONTROL.sub(lambda m: b"%%%02X" % m[0][0], url) if url else b"about:blank"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _name(page_id),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + uri,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
    ]
    block = HTTP % len(payload)
    if revisit:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + _name(refers_to),
        ]
    else:
        block += payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[bytes, bytes], dict[bytes, bytes], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *fields = head.split(b"\r\n")
    named = dict(f.split(b": ", 1) for f in fields)
    block = rest[: int(named[b"Content-Length"])]
    if not version.startswith(b"WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("no WARC record at this place")
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, dict(f.split(b": ", 1) for f in http.split(b"\r\n")[1:]), payload


def write(pages: DataFrame, folder: str, least: int = 0, rows_per_file: int = 4096) -> DataFrame:
    """Writes the archives and their index, a Parquet table in the same folder; returns the index."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # narrow rows decide who is the response; equal payloads meet as counts, never as rows
    narrow = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    first = narrow.where(F.col("n") >= least).groupBy("sha1", "n").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")
    )
    # one key for rows of one id, one for each payload without an id; per key the payloads that are not alone
    key = lambda page_id: F.coalesce(page_id.cast("string"), F.concat(F.lit("-"), F.col("sha1")))
    repeats = (
        narrow.join(first.where("copies > 1"), ["sha1", "n"])
        .groupBy(key(F.col("page_id")).alias("key"))
        .agg(F.map_from_entries(F.collect_set(F.struct("sha1", F.struct("first")))).alias("repeats"))
    )
    counted = pages.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    keyed = pages.withColumn("sha1", F.sha1(payload)).withColumn("key", key(F.col("page_id")))
    # the one shuffle of payloads serves the join and the files
    joined = keyed.repartition(max(1, -(-counted // rows_per_file)), "key").join(repeats, "key", "left")
    found = F.try_element_at("repeats", F.col("sha1"))
    dealt = joined.select(
        "page_id", "url", "html", found.isNotNull().alias("repeats"), found["first"].alias("first")
    ).sortWithinPartitions(F.col("page_id").asc_nulls_last(), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = path = last = None
        offset = 0
        for batch, texts in blocks(batches, "html", 2 << 20):
            if sink is None:
                path = files.attempt(folder, "pages", ".warc.gz")
                system, inside = files.opened(path)
                sink = system.open_output_stream(inside, compression=None)
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "repeats", "first"))
            for page_id, url, again, to, text in zip(*columns, texts, strict=True):
                text = text or b""
                digest = base32(hashlib.sha1(text).digest())
                # the first row of the smallest id is the response; rows that repeat it follow it here
                revisit = again and (page_id != to or last == (page_id, digest, len(text)))
                last = (page_id, digest, len(text))
                data = record(page_id, url.encode() if url else None, text, digest, to, revisit)
                data = gzip.compress(data, 6, mtime=0)
                sink.write(data)
                rows.append((page_id, path, offset, len(data), url, digest))
                offset += len(data)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, k)
                    for c, k in zip(
                        zip(*rows, strict=True),
                        (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()),
                        strict=True,
                    )
                ],
                ["page_id", "file", "offset", "length", "url", "digest"],
            )
        if sink:
            sink.close()

    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(selected: DataFrame, gap: int = 64 << 10, most: int = 4 << 20, files_per_task: int = 1) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the records selected in the
    index; a revisit has a null payload. Any selection of index rows can be read, without the others' bytes."""
    schema = (
        "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long"
    )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def number(name: bytes) -> int | None:
        text = name.removeprefix(b"<urn:x-page:").removesuffix(b">")
        return None if text == b"null" else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[list[tuple[str, int, int]]]:
            """Runs of records that one read gets."""
            held: list[tuple[str, int, int]] = []
            for batch in batches:
                for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if held and (
                        file != held[-1][0]
                        or offset - (held[-1][1] + held[-1][2]) > gap
                        or offset + length - held[0][1] > most
                    ):
                        yield held
                        held = []
                    held.append((file, offset, length))
            if held:
                yield held

        source = opened = None
        for part in ranges():
            file, start, _ = part[0]
            if file != opened:
                system, inside = files.opened(file)
                source, opened = system.open_input_file(inside), file
            data = source.read_at(part[-1][1] + part[-1][2] - start, start)
            rows, size = [], 0
            for k, (_, offset, length) in enumerate(part):
                named, http, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
                kind = named[b"WARC-Type"].decode()
                digest = named[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                whole = kind == "response"
                if whole and base32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"{file} at {offset}: the payload does not match its digest")
                rows.append(
                    (
                        number(named[b"WARC-Record-ID"]),
                        named[b"WARC-Target-URI"].decode(),
                        payload.decode() if whole else None,
                        int(http[b"Content-Length"]),
                        digest,
                        kind,
                        None if whole else number(named[b"WARC-Refers-To"]),
                    )
                )
                size += len(payload)
                if size >= OUT or k == len(part) - 1:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                    rows, size = [], 0

    placed = selected.select("file", "offset", "length")
    tasks = -(-placed.agg(F.countDistinct("file")).first()[0] // files_per_task)
    placed = placed.repartition(max(1, tasks), "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, list_reduce(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', h[i + 1]) - 1), 4, '0')),
    lambda a, x: a || x) AS bits, min(page_id) OVER (PARTITION BY h, n) AS first_id FROM p
)
SELECT page_id, n AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST('0b' || bits[5 * i + 1 : 5 * i + 5] AS BIGINT) + 1]),
    lambda a, x: a || x) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
