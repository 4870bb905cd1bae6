"""WARC archives as chunked record tables.

``write_archives`` turns rows into ``.warc.gz`` files, a gzip member for each record; ``read_chunks`` reads archives
back as a stream of ``(record_id, chunk_no, data)`` rows. A payload goes through a fixed-size window, with a running
SHA-1 carried from chunk to chunk, so neither side holds a whole decoded record; the last chunk of a record has the
digest of the full payload. Files lie in the folder that driver and executors share. A task writes a name of its own
and reports it in a manifest that Spark commits, so a lost executor's half-written file is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import StageTables, fresh_path

#: Bytes of payload in a chunk, the least size at which equal payloads become revisits, and bytes of a header at most.
CHUNK_BYTES, REVISIT_BYTES, MOST_HEADER = 256 * 1024, 1000, 1 << 20
CHUNKS = "archive string, record_id string, record_type string, target_uri string, refers_to string, chunk_no long, data binary, payload_bytes long, payload_digest string, declared_digest string, last boolean"


def _name(page: int | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{salt}-{page}')}>"


def plan_records(rows: DataFrame, id_col: str, payload_col: str, tables: StageTables, least: int = REVISIT_BYTES) -> DataFrame:
    """``rows`` with ``refers_to``: for a payload of at least ``least`` bytes that a row with a larger id has too, the
    largest such id; else null.

    Payloads count as equal by length and SHA-256. The largest id of each payload is combined before the shuffle and
    written out, then joined as a plain exchange, which adaptive execution splits if one payload holds many rows.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = rows.withColumn("__size", F.octet_length(payload).cast("long"))
    keyed = keyed.withColumn("__same", F.when(F.col("__size") >= least, F.sha2(payload, 256)))
    holders = keyed.filter("__same IS NOT NULL").groupBy("__same").agg(F.max(id_col).alias("__holder"), F.count("*").alias("__n"))
    holders = tables.keep(holders.filter("__n > 1").drop("__n"), "warc-holders")
    joined = keyed.join(holders, "__same", "left")
    return joined.withColumn("refers_to", F.when(F.col("__holder") != F.col(id_col), F.col("__holder"))).drop("__same", "__holder", "__size")


def _header(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_archives(rows: DataFrame, folder: str, id_col: str, uri_col: str, payload_col: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes a record for every row and returns the manifest ``(archive, records)``, committed as a table in ``folder``.

    A row with a ``refers_to`` becomes a revisit: its payload's digest and length are in the header, the block is
    empty. Null payloads are empty. The payload is compressed chunk by chunk into the open file.
    """
    narrow = rows.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("payload"), "refers_to")
    salt = uuid.uuid5(uuid.NAMESPACE_URL, folder).hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        place, sink, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for at in range(batch.num_rows):
                page, uri, text, refers = (batch.column(k)[at] for k in range(4))
                view = memoryview(text.as_buffer() if text.is_valid else b"")
                sha = hashlib.sha1()
                for i in range(0, len(view), CHUNK_BYTES):
                    sha.update(view[i : i + CHUNK_BYTES])
                page, refers = page.as_py(), refers.as_py()
                target = " ".join((uri.as_py() or "").split())
                fields = [("WARC-Record-ID", _name(page, salt)), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha.hexdigest()}"), ("X-Payload-Length", str(len(view))), ("X-Page-ID", "" if page is None else str(page))]
                if refers is not None:
                    fields += [("WARC-Refers-To", _name(refers, salt)), ("X-Refers-To-Page", str(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                if sink is None:
                    sink = system.open_output_stream(place, compression=None)
                gz = zlib.compressobj(level, wbits=31)
                sink.write(gz.compress(_header("response" if refers is None else "revisit", [*fields, ("Content-Type", "text/html")], 0 if refers is not None else len(view))))
                if refers is None:
                    for i in range(0, len(view), CHUNK_BYTES):
                        sink.write(gz.compress(view[i : i + CHUNK_BYTES]))
                sink.write(gz.compress(b"\r\n\r\n") + gz.flush())
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [place], "records": [n]})

    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    manifest = narrow.mapInArrow(run, "archive string, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return rows.sparkSession.read.schema("archive string, records long").parquet(f"{folder}/manifest")


class _Inflated:
    """Decompressed bytes of a stream of gzip members (or of a plain file), a window at a time."""

    def __init__(self, stream, window: int = 1 << 16):
        self.stream, self.window, self.rest, self.raw, self.z = stream, window, b"", b"", None
        self.plain: bool | None = None

    def more(self) -> bool:
        """Append some bytes to ``rest``; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.window)
                if not self.raw:
                    return False
            if self.plain is None:
                self.plain = self.raw[:2] != b"\x1f\x8b"
            if self.plain:
                self.rest, self.raw = self.rest + self.raw, b""
                return True
            if self.z is None:
                self.z = zlib.decompressobj(wbits=31)
            made = self.z.decompress(self.raw, 4 * self.window)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, None
            if made:
                self.rest += made
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is taken too; None at the end of the file. A header has MOST_HEADER bytes."""
        seen = 0
        while (at := self.rest.find(mark, seen)) < 0:
            seen = max(0, len(self.rest) - len(mark) + 1)
            if len(self.rest) > MOST_HEADER:
                raise ValueError("a header does not end")
            if not self.more():
                return None
        found, self.rest = self.rest[:at], self.rest[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        while len(self.rest) < most and self.more():
            pass
        found, self.rest = self.rest[:most], self.rest[most:]
        return found


def parse(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunk rows of one archive; an empty payload gives one chunk without data. Cut files raise."""
    source = _Inflated(stream)
    while True:
        while source.rest[:2] == b"\r\n":
            source.rest = source.rest[2:]
        if not source.rest and not source.more():
            return
        head = source.until(b"\r\n\r\n")
        if head is None:
            if source.rest.strip():
                raise ValueError("an archive ends inside a header")
            return
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:60]!r}")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left, chunk, sha, size = int(field["content-length"]), 0, hashlib.sha1(), 0
        common = {"record_id": field.get("warc-record-id"), "record_type": field.get("warc-type"), "target_uri": field.get("warc-target-uri"), "refers_to": field.get("warc-refers-to"), "declared_digest": field.get("warc-payload-digest"), "fields": field}
        while True:
            data = source.take(min(chunk_bytes, left))
            if not data and left:
                raise ValueError("an archive ends inside a payload")
            left, size = left - len(data), size + len(data)
            sha.update(data)
            yield common | {"chunk_no": chunk, "data": data, "payload_bytes": size, "payload_digest": sha.hexdigest(), "last": not left}
            chunk += 1
            if not left:
                break
        source.take(4)


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``manifest(archive)`` lists, a task for each file.

    ``payload_bytes`` and ``payload_digest`` run over the payload so far; on the row with ``last`` they are those of
    the whole payload. Extra columns ``page_id`` and ``refers_to_page`` come from the headers that ``write_archives``
    sets. A batch of rows holds about 4 MB.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["page_id", "refers_to_page", "declared_bytes"]
    kinds = {"chunk_no": pa.int64(), "data": pa.binary(), "payload_bytes": pa.int64(), "last": pa.bool_(), "page_id": pa.int64(), "refers_to_page": pa.int64(), "declared_bytes": pa.int64()}

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for place in batch.column(0).to_pylist():
                system, path = _filesystem(place)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in parse(stream, chunk_bytes):
                        f = row.pop("fields")
                        row |= {"archive": place, "page_id": number(f.get("x-page-id")), "refers_to_page": number(f.get("x-refers-to-page")), "declared_bytes": number(f.get("x-payload-length"))}
                        held += len(row["data"])
                        if not with_data:
                            row["data"] = None
                        rows.append(row)
                        if held > 4_000_000 or len(rows) >= 5000:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    schema = f"{CHUNKS}, page_id long, refers_to_page long, declared_bytes long"
    return manifest.select("archive").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", with_data: bool = True) -> DataFrame:
    """Writes archives of all rows, reads them back and returns their chunked record table.

    Null payloads are empty. Rows that share an id and a payload of at least REVISIT_BYTES are both responses. An empty
    table gives no record.
    """
    spark: SparkSession = pages.sparkSession
    planned = plan_records(pages.select(id_col, uri_col, payload_col), id_col, payload_col, StageTables(spark))
    manifest = write_archives(planned, fresh_path(spark, "warc"), id_col, uri_col, payload_col)
    files = manifest.count()
    return read_chunks(manifest.repartition(max(1, files)), with_data=with_data)


def op3_query(spark, sf_dir: str) -> DataFrame:
    chunks = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("last").select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared_digest", "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("refers_to_page")).alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM d
"""
