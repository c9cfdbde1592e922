"""WARC archives as a PySpark Python data source.

Writing: one archive file a task, one record a row, whole payloads only for responses; the commit of
each job lists the files of its tasks that succeeded, so a retried or lost task leaves nothing that is
read. ``append`` adds a job's list to those that are there; ``overwrite`` puts it in their place.
Reading: one partition a file. Each record's header block is parsed first; pushed predicates on the
record type and other header fields are tested there, and a record that fails them, or whose payload
was not asked for, has its block skipped (plain archives seek over it) and never decoded.

Options: ``path`` (any URI that Arrow's file systems open: file, hdfs, s3, gs), ``compression``
(``none`` or ``gzip``, a member a record), ``payload`` (``true``: read payloads), ``verify`` (``true``:
the SHA-1 of each payload read must be the one in its header).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from parleylake.llm._shared import shared_dir, table

MANIFEST = re.compile(r"_files-[0-9a-f]{32}\.json")
#: Archives of this writer are read only if a commit lists them; others in the folder always are.
OWN = re.compile(r"part-[0-9a-f]{32}\.warc(\.gz)?")
#: Header fields by column; the order is that of the schema.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length"}
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ARROW = pa.schema([*((c, pa.int64() if c == "payload_bytes" else pa.string()) for c in FIELDS), ("payload", pa.binary())])
BATCH_BYTES = 8 << 20
#: Up to so many payloads that occur more than once are broadcast; beyond, the join shuffles.
MAX_BROADCAST_REPEATS = 200_000


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_bytes(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit with the header only."""
    block = HTTP + (row["payload"] or b"") if row["record_type"] == "response" else b""
    lines = ["WARC/1.1", *(f"{FIELDS[c]}: {_one_line(row[c])}" for c in FIELDS if row[c] is not None)]
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _one_line(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int


def _listed(path: str) -> tuple[list[str], list[str]]:
    """The names of all committed archives and archives of other writers below a folder, and of the lists themselves."""
    from pyarrow import fs

    system, root = _open(path)
    found = [x.path.removeprefix(root).lstrip("/") for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))]
    lists, names = sorted(x for x in found if MANIFEST.fullmatch(x)), []
    for name in lists:
        with system.open_input_stream(f"{root}/{name}") as held:
            names += json.loads(held.read())
    return names + sorted(x for x in found if x.endswith((".warc", ".warc.gz")) and not OWN.fullmatch(x)), lists


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.gz, self.overwrite = options["path"].rstrip("/"), options.get("compression", "none") == "gzip", overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, records = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gz, 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    held = record_bytes(row)
                    out.write(gzip.compress(held, 5) if self.gz else held)
                    records += 1
        return Written(name, records)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names, lists = _listed(self.path) if self.overwrite else ([], [])
        with system.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.file for m in messages if m and m.records]).encode())
        for old in [*lists, *names]:  # the lists first: no list ever names a file that is gone
            system.delete_file(f"{root}/{old}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.file}")


@dataclass
class ArchiveFile(InputPartition):
    file: str | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload, self.verify = options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and not-null of header fields; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FIELDS and isinstance(f, EqualTo | In | IsNotNull):
                self.tests.append((column, None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [ArchiveFile(n) for n in _listed(self.path)[0]] or [ArchiveFile(None)]  # Spark wants a partition

    def _wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (values is None or row[c] in values) for c, values in self.tests)

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition.file is None:
            return
        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{partition.file}") as held:
            stream = gzip.GzipFile(fileobj=held) if partition.file.endswith(".gz") else held
            rows, size = [], 0
            for row in self._records(stream):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _records(self, stream) -> Iterator[dict]:
        lines = LineReader(stream)
        while (head := lines.header()) is not None:
            fields, length = head, int(head.get("content-length", 0))
            row = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
            row["payload_bytes"] = int(row["payload_bytes"]) if (row["payload_bytes"] or "").isdigit() else None
            row["payload"] = None
            if self.payload and row["record_type"] == "response" and self._wanted(row):
                block = lines.take(length)
                row["payload"] = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                if self.verify and row["payload_digest"] != digest(row["payload"]):
                    raise ValueError(f"{row['record_id']}: the payload's SHA-1 isn't {row['payload_digest']}")
                yield row
            else:
                lines.skip(length)
                if self._wanted(row):
                    yield row


class LineReader:
    """A buffered reader that gives header blocks, and gives or skips what follows them."""

    def __init__(self, stream, chunk: int = 1 << 16):
        self.stream, self.chunk, self.held = stream, chunk, b""

    def _more(self) -> bool:
        got = self.stream.read(self.chunk)
        self.held += got
        return bool(got)

    def header(self) -> dict[str, str] | None:
        self.held = self.held.lstrip(b"\r\n")
        while (end := self.held.find(b"\r\n\r\n")) < 0 or not self.held.strip(b"\r\n"):
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends within a header")
                return None
            self.held = self.held.lstrip(b"\r\n")
        block, self.held = self.held[:end], self.held[end + 4 :]
        first, *lines = block.decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:60]!r}")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def take(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n:
            got = self.stream.read(n - have)
            if not got:
                raise ValueError("the archive ends within a block")
            parts.append(got)
            have += len(got)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if n > len(self.held) and self.stream.seekable() and not isinstance(self.stream, gzip.GzipFile):
            self.stream.seek(self.stream.tell() + n - len(self.held))
            self.held = b""
        else:
            self.take(n)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``, after ``register(spark)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with predicates pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def digest(payload: bytes) -> str:
    """The header's form of a payload's SHA-1."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, max_broadcast: int = MAX_BROADCAST_REPEATS) -> DataFrame:
    """The record of every page, in the source's schema: of equal payloads of at least ``least`` bytes, the largest id is the response.

    Null texts are empty payloads. Rows that share the largest id are all responses; null ids are the
    smallest. Payloads that occur once never meet others beyond one pre-aggregated row.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("n"), F.col(url_col).alias("target_uri"), F.coalesce(F.encode(F.col(html_col), "utf-8"), F.encode(F.lit(""), "utf-8")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    repeats = rows.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("n").alias("top"), F.count("*").alias("c")).where("c > 1 and top is not null").select("sha", "top")
    if repeats.count() <= max_broadcast:
        repeats = F.broadcast(repeats)
    rows = rows.join(repeats, "sha", "left")
    revisit = F.coalesce(~F.col("n").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c, F.lit("")), F.lit(">"))

    @F.pandas_udf("string")
    def header_digest(hexes):
        return hexes.map(lambda h: "sha1:" + base64.b32encode(bytes.fromhex(h)).decode())

    return rows.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, urn(F.col("top").cast("string"))).alias("refers_to"), header_digest("sha").alias("payload_digest"),
        F.col("bytes").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back, each record type by a predicate that the source tests on headers.

    Responses are read with their payloads, of which lengths are taken and digests checked; revisits need
    their headers only, so their scan skips every payload.
    """
    register(spark)
    path = shared_dir(spark)
    records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", path).save()
    whole = spark.read.format("warc").option("path", path).option("verify", "true").load().where("record_type = 'response'")
    headers = spark.read.format("warc").option("path", path).option("payload", "false").load().where("record_type = 'revisit'")
    back = whole.unionByName(headers)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return back.select(
        number("record_id").alias("page_id"), F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "target_uri",
    )


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), t AS (SELECT s, max(page_id) AS top FROM p GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (j // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, url AS target_uri
FROM p JOIN t USING (s)
"""
