"""WARC archives as a PySpark Python data source, to read and to write.

Reading plans one partition for about `split_bytes` of files.  Predicates on `warc_type`, `record_id`,
`target_uri` and `refers_to` (equality, IN, null tests) are pushed into the reader, which parses a record's
headers first: a record that they rule out is passed over, in plain files by seeking, in gzip
members by inflating without decoding.  With the option payload=false no payload is decoded at all.

Writing gives each task a file of its own under a fresh name, and the commit lists the files
of successful tasks in `_files.json`; readers take only those, so lost or repeated tasks do no harm.
Null payloads are empty; null headers are left out.

`archive_pages` is the round trip with revisit records: of pages with equal payloads of at least
`min_bytes`, the one with the largest id is the response and the others refer to it.  Pages
with a null id rank below all others; repeated rows with the largest id are all responses.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from papertide.llm.shared import new_folder, own
from papertide.llm.token_files import open_folder

SCHEMA = "record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
# Header names of the format.
_HEADER = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(row: dict) -> bytes:
    """One record; the block of a revisit has the HTTP headers only."""
    payload = row["payload"] or b""
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if row["warc_type"] != "revisit":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {row['warc_type'] or 'response'}"]
    head += [f"WARC-Record-ID: <{_line(row['record_id'])}>"] if row["record_id"] is not None else []
    head += [f"WARC-Target-URI: {_line(row['target_uri'])}"] if row["target_uri"] is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}"] if row["payload_digest"] else []
    if row["warc_type"] == "revisit":
        head += [f"WARC-Profile: {_PROFILE}"]
        head += [f"WARC-Refers-To: <{_line(row['refers_to'])}>"] if row["refers_to"] is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(stream: io.BufferedReader) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    found: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _skip(stream: io.BufferedReader, n: int) -> None:
    if isinstance(stream.raw, gzip.GzipFile):
        while n > 0:
            n -= len(got := stream.read(min(n, 1 << 20)))
            if not got:
                return
    else:
        stream.seek(n, 1)


def records(stream: io.BufferedReader, tests: list, payloads: bool = True) -> Iterator[tuple]:
    """Tuples as SCHEMA of the records that pass all tests."""
    while (head := _headers(stream)) is not None:
        length = int(head.get("content-length", 0))
        row = {k: head.get(v) for k, v in _HEADER.items()}
        row = {k: _unline(v.strip("<>") if k in ("record_id", "refers_to") else v) if v is not None else None for k, v in row.items()}
        if not all(test(row) for test in tests):
            _skip(stream, length)
            continue
        size = length
        is_http = head.get("content-type", "").startswith("application/http")
        if is_http:
            http, used = {}, 0
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                used += len(line)
                name, _, value = line.decode("latin-1").partition(":")
                http[name.strip().lower()] = value.strip()
            used += len(line)
            length -= used
            size = int(http.get("content-length", length)) if row["warc_type"] == "revisit" else length
        payload = None
        if payloads and row["warc_type"] != "revisit":
            payload = stream.read(length)
        else:
            _skip(stream, length)
        digest = head.get("warc-payload-digest")
        if digest:
            digest = base64.b32decode(digest.partition(":")[2]).hex()
        yield (row["record_id"], row["warc_type"], row["target_uri"], row["refers_to"], digest, size, payload)


@dataclass
class _Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in _HEADER or not isinstance(f, EqualTo | In | IsNull | IsNotNull):
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            else:
                self.wanted.append((name, "null" if isinstance(f, IsNull) else "not null", ()))

    def partitions(self) -> list[_Files]:
        fs, base = open_folder(self.path)
        info = {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.is_file}
        listed = f"{base}/_files.json"
        if listed in info:
            with fs.open_input_file(listed) as f:
                names = [f"{base}/{n}" for n in json.loads(f.read())]
        else:
            names = [n for n in info if n.endswith((".warc", ".warc.gz"))]
        parts: list[list[str]] = [[]]
        size = 0
        for name in sorted(names):
            if parts[-1] and size + info[name] > self.split:
                parts.append([])
                size = 0
            parts[-1].append(name)
            size += info[name]
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        def test(name: str, kind: str, values: tuple):
            if kind == "in":
                return lambda row: row[name] in values and row[name] is not None
            return lambda row: (row[name] is None) == (kind == "null")

        tests = [test(*w) for w in self.wanted]
        fs, _ = open_folder(self.path)
        for name in partition.names:
            with fs.open_input_file(name) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw, 1 << 18)
                rows, size = [], 0
                for r in records(stream, tests, self.payloads):
                    rows.append(r)
                    size += len(r[-1] or b"") + 100
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.compress = options["path"], options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, base = open_folder(self.path)
        fs.create_dir(base, recursive=True)
        name, out, n = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compress else ""), None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = record_bytes(row)
                    out.write(gzip.compress(data, 6, mtime=0) if self.compress else data)
                    n += 1
        finally:
            if out is not None:
                out.close()
        return _Written(name if n else None)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = open_folder(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/_files.json") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, base = open_folder(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{base}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, and lets filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1_000, compression: str = "gzip") -> str:
    """Writes the pages as archives and returns their folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or new_folder(spark, "warc")
    rows = own(pages, page_id=id_col, url=F.col(url_col).cast("string"), payload=F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    large = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("chief"), F.count("*").alias("k")).where("k > 1").drop("k")
    # Smaller payloads are never revisits and stay where they are, however many of them are equal.
    small = rows.where(F.col("n") < min_bytes).withColumn("chief", F.lit(None).cast(rows.schema["page_id"].dataType))
    joined = rows.where(F.col("n") >= min_bytes).join(large, "digest", "left").unionByName(small)
    revisit = F.col("chief").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("chief"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    out = joined.select(
        urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"), F.when(revisit, urn("chief")).alias("refers_to"),
        F.col("digest").alias("payload_digest"), F.col("n").cast("long").alias("payload_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("compression", compression).save(folder)
    return folder


def read_pages(spark: SparkSession, folder: str, id_type: str = "long", id_col: str = "page_id") -> DataFrame:
    """Rows (id_col, payload_bytes, payload_digest, record_type, refers_to): of responses from the payload itself, of revisits from their headers."""
    register(spark)
    found = spark.read.format("warc").load(folder).where(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.try_cast(F.regexp_replace(c, "^urn:page:", ""), id_type) if hasattr(F, "try_cast") else F.col(c).substr(10, 100).try_cast(id_type)
    whole = F.col("warc_type") == "response"
    return found.select(
        number("record_id").alias(id_col), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"),
    )
