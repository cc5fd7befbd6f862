"""WARC archives: written by tasks, indexed record by record, read back through coalesced byte ranges.

Archives are plain WARC/1.1 files, each record a gzip member of its own, so that any record can be read alone.  The
index (one row a record: archive, offset, length, URL, digest, type) is a Parquet table written with the archives;
only archives that the index names count, so files of failed or repeated tasks are ignored.
"""

from __future__ import annotations

import datetime
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm.common import materialize, scratch_dir, table

INDEX_SCHEMA = "archive string, offset long, length long, url string, payload_digest string, record_type string, page_id long, refers_to long, payload_bytes long"
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

#: Records with smaller payloads are never revisits.
LEAST_REVISIT = 100
#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Gaps up to this many bytes are read through; a read is no longer than READ_BYTES unless one record is.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: A task reads records of about this many archive bytes; small selections are dealt over the cores, in LEAST_SPLIT bytes
#: at least.
SPLIT_BYTES, LEAST_SPLIT = 32 << 20, 1 << 20
_DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
_CRLF = b"\r\n"


def classify(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) as records to write: payload, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload.  Of equal payloads of at least `least` bytes the row with the smallest page_id is
    the response (rows that repeat that page_id are responses too), the others revisit it; a group without any
    page_id consists of responses.  Digests of repeated payloads only are shuffled apart from the pages; pages meet
    them in a join whose frequent digests adaptive execution can split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    full = full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = full.filter(F.col("payload_bytes") >= least)
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL")
    firsts = materialize(firsts.select(F.col("payload_digest").alias("_digest"), "_first"))
    joined = full.join(firsts, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _line(name: str, value: object) -> bytes:
    # a header is one line: control characters in URLs are percent-coded
    text = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))
    return f"{name}: {text}".encode("utf-8", "replace") + _CRLF


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _record(page_id, url, payload, size, digest, kind, refers) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + _line("Content-Length", size) + _CRLF + (payload or b"")
    head = b"WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", _record_id(page_id, digest)) + _line("WARC-Date", _DATE)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha256:{digest}") + _line("X-Payload-Length", size)
    if page_id is not None:
        head += _line("X-Page-Id", page_id)
    if kind == "revisit":
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += _line("WARC-Refers-To", _record_id(refers, digest)) + _line("X-Refers-To-Page", refers)
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(body))
    return head + _CRLF + body + _CRLF + _CRLF


def _whole(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the records below `folder` (a URI that executors can write) and return the index, read from Parquet."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, size, digest, kind, refers in batch.itertuples(index=False):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"archives/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    page, refers = _whole(page), _whole(refers)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    coded = squeeze.compress(_record(page, url, payload, size, digest, kind, refers)) + squeeze.flush()
                    out.write(coded)
                    rows.append((name, at, len(coded), url, digest, kind, page, refers, size))
                    at += len(coded)
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    index = records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInPandas(write, INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return records.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def parse_record(data: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(_CRLF + _CRLF)
    lines = head.split(_CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    found = dict(x.decode("utf-8").split(": ", 1) for x in lines[1:])
    body = rest[: int(found["Content-Length"])]
    if rest[len(body) :] != _CRLF + _CRLF:
        raise ValueError("record length and headers disagree")
    found["payload"] = body.partition(_CRLF + _CRLF)[2]
    return found


def read_records(selected: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES, split: int = SPLIT_BYTES) -> DataFrame:
    """The records that the index rows `selected` name: rows of an archive meet in order of offset, neighbouring
    ranges become one read, and a task has records of about `split` bytes at most.  Payloads are held against their digests; a revisit has none of its own."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        name = source = None
        for batch in batches:
            spans = list(zip(batch["archive"], batch["offset"].tolist(), batch["length"].tolist()))
            i, rows = 0, []
            while i < len(spans):
                j, (archive, begin, length) = i + 1, spans[i]
                end = begin + length
                while j < len(spans) and spans[j][0] == archive and spans[j][1] <= end + gap and max(end, spans[j][1] + spans[j][2]) - begin <= most:
                    end = max(end, spans[j][1] + spans[j][2])
                    j += 1
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, store.open_input_file(f"{root}/{archive}")
                block = source.read_at(end - begin, begin)
                for _, offset, length in spans[i:j]:
                    r = parse_record(zlib.decompress(block[offset - begin : offset - begin + length], 31))
                    kind, payload, digest = r["WARC-Type"], r["payload"], r["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload and digest of {r['WARC-Record-ID']} disagree")
                    page, refers = r.get("X-Page-Id"), r.get("X-Refers-To-Page")
                    rows.append((page and int(page), r.get("WARC-Target-URI"), payload if kind == "response" else None, int(r["X-Payload-Length"]), digest, kind, refers and int(refers)))
                i = j
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    placed = selected.select("archive", "offset", "length")
    # index rows are small, so their own size says nothing about a task's work: the number of tasks comes from the bytes
    # that the rows stand for
    total = placed.agg(F.sum("length")).first()[0] or 0
    cores = min(selected.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_SPLIT))
    tasks = max(1, cores, -(-total // split))
    placed = placed.withColumn("_split", F.floor(F.col("offset") / max(1, -(-total // tasks))))
    placed = placed.repartition(tasks, "archive", "_split").sortWithinPartitions("archive", "offset")
    return placed.select("archive", "offset", "length").mapInPandas(read, RECORD_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    index = write_archives(classify(table(spark, sf_dir, "pages")), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, url
FROM f
"""
