"""WARC archives: written per partition, indexed, and read back by byte ranges (operator 4).

Writing emits the index first-hand: offset, length, URL and digest of every record.
The index is a table of its own, so a lost executor never makes archives and index
disagree: a task that runs again writes an archive under a new name, and only the
index that was committed names archives.

Reading selects records from the index, sorts them by archive and offset, joins
ranges that lie within ``GAP`` bytes into one read of at most ``READ`` bytes, and
parses the records. Records are gzip members, as is usual for WARC.

Of records with equal payloads of at least ``REVISIT_BYTES``, the one with the smallest
page_id is the response; among rows with that page_id (or where all are NULL) it is the
one with the smallest url, and of rows equal in that as well any one. The others revisit
it, by the standard ``WARC-Refers-To`` and, for rows, by its page_id. NULL page_ids come last.

NULL html is an empty payload, NULL urls are empty; every row gets a record, payloads of
any length. An empty table gives no archive and an empty index.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanmill.llm.common import counted, cut, fresh_path, small, small_arrow_batches

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
GAP, READ, TASK_BYTES = 64 << 10, 4 << 20, 64 << 20
INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest, revisit, refers_to, first_url: which record each page gets. Html moves only to tell rows of one page_id apart."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"size": F.octet_length("html").cast("bigint"), "digest": F.sha2(F.col("html").cast("binary"), 256)})
    large = p.where(F.col("size") >= REVISIT_BYTES).select("page_id", "url", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    equal = large.groupBy("digest", "page_id", "url").agg(F.count("*").alias("c"))
    firsts = equal.groupBy("digest").agg(F.min(order).alias("x"), F.min_by("c", order).alias("again"), F.sum("c").alias("n")).where("n > 1")
    firsts, n = counted(firsts.select("digest", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"), "again"), "repeated")  # only payloads that repeat
    same = F.col("page_id").eqNullSafe(F.col("first")) & (F.col("url") == F.col("first_url"))
    p = p.join(small(firsts, n), "digest", "left").withColumn("revisit", (F.col("size") >= REVISIT_BYTES) & F.col("first_url").isNotNull() & ~same)
    if not firsts.where("again > 1").isEmpty():  # rows equal in all: one of them is the response
        tied = F.coalesce((F.col("again") > 1) & ~F.col("revisit") & (F.col("size") >= REVISIT_BYTES), F.lit(False))
        split = p.where(tied).withColumn("revisit", F.row_number().over(Window.partitionBy("digest").orderBy("url")) > 1)
        p = p.where(~tied).unionByName(split)
    return p.withColumn("refers_to", F.when(F.col("revisit"), F.col("first")))


def record_id(digest: str | None) -> str:
    """Of a response that others may revisit, by its payload; of any other record, a new one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'sha256:' + digest) if digest else uuid.uuid4()}>"


def record(page_id, url: str, payload: bytes, size: int, digest: str, revisit: bool, refers_to) -> bytes:
    """One record, uncompressed. A revisit has no block, but its payload's size and digest."""
    block = b"" if revisit else payload
    own = record_id(digest if not revisit and size >= REVISIT_BYTES else None)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}",
    ]
    if "\r" in url or "\n" in url:  # a header line can't hold these
        head.append(f"X-Target-URI-JSON: {json.dumps(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(digest)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.partition(": ")[::2] for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_archives(records: DataFrame, path: str, level: int = 1) -> DataFrame:
    """Write planned records under ``path`` (any URI that pyarrow's file systems open); returns the index, not yet run."""

    def write(batches):
        files, root = _filesystem(path)
        files.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = []
                for page_id, url, html, size, digest, revisit, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "revisit", "refers_to")), strict=True):
                    if out is None:
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = pack.compress(record(page_id, url, html, size, digest, revisit, refers_to)) + pack.flush()
                    out.write(data)
                    rows.append((f"{path}/{name}", at, len(data), url, digest, page_id, "revisit" if revisit else "response"))
                    at += len(data)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return records.select("page_id", "url", F.col("html").cast("binary").alias("html"), "size", "digest", "revisit", "refers_to").mapInArrow(write, INDEX)


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) joined into (start, end, records) reads."""
    out: list = []
    for at, n in rows:
        if out and at - out[-1][1] <= GAP and at + n - out[-1][0] <= READ:
            start, end, records = out[-1]
            out[-1] = (start, max(end, at + n), records)
            records.append((at, n))
        else:
            out.append((at, at + n, [(at, n)]))
    return out


def _read(batches, payloads: bool):
    for batch in batches:
        by: dict[str, list] = {}
        for a, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            by.setdefault(a, []).append((at, n))
        for archive, rows in by.items():
            files, name = _filesystem(archive)
            with files.open_input_file(name) as f:
                for start, end, records in ranges(sorted(rows)):
                    data, out = f.read_at(end - start, start), []
                    for at, n in records:
                        headers, block = parse(zlib.decompress(data[at - start : at - start + n], 31))
                        revisit = headers["WARC-Type"] == "revisit"
                        digest = headers["WARC-Payload-Digest"].partition(":")[2] if revisit else hashlib.sha256(block).hexdigest()
                        size = int(headers["X-Payload-Length"]) if revisit else len(block)
                        url = json.loads(headers["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in headers else headers["WARC-Target-URI"]
                        page, first = headers["X-Page-ID"], headers.get("X-Refers-To-Page")
                        out.append((int(page) if page else None, url, headers["WARC-Type"], digest, size, int(first) if first else None, block if payloads and not revisit else None))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"])


RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` (or a selection of it; a table) names, digests computed from what was read; ``payloads`` False leaves the blocks out.

    Stretches of ``READ`` bytes are dealt out whole, to as many tasks as their bytes ask for.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), min(-(-total // READ), 2 * spark.sparkContext.defaultParallelism), 1)
    stretch = F.expr(f"offset div {READ}L")
    parts = index.select("archive", "offset", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return parts.mapInArrow(lambda batches: _read(batches, payloads), RECORDS)


def round_trip(pages: DataFrame, path: str | None = None, payloads: bool = True) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, then read every record back."""
    path = path or fresh_path(pages.sparkSession, "warc")
    records = plan_records(pages.select("page_id", "url", "html"))
    with small_arrow_batches(pages.sparkSession, 1_000, 8 << 20):
        index = cut(write_archives(records, path), "index")
    return read_records(index, payloads)
