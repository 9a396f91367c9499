"""Files as rows, and their decoding to typed rows.

Decoding is the one step in Python: Arrow batches of file contents go in, typed rows
come out, and contents never reach a shuffle.  The rows are written to the folder that driver and executors
share, since all plans read them and executors may be lost.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "format string, kind string, part string, part_no long, i int, j int, n long, a string, b string"
_ARROW = pa.schema([("format", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("part_no", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("a", pa.string()), ("b", pa.string())])


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of a folder; what matches neither a ZIP nor a compound file becomes an error row later."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "content")


def spread(table: DataFrame) -> DataFrame:
    """A table as read; only if it has fewer partitions than there are cores its rows are dealt out, which large tables never need."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(2 * cores)


def is_zip(content: Column) -> Column:
    return F.substring(content, 1, 4).isin(*(F.lit(m) for m in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")))


def is_compound(content: Column) -> Column:
    return F.substring(content, 1, 8) == F.lit(bytes.fromhex("D0CF11E0A1B11AE1"))


def container(content: Column) -> Column:
    """'zip', 'cfb' or 'none', by the first bytes."""
    return F.when(is_zip(content), "zip").when(is_compound(content), "cfb").otherwise("none")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands files to Python a few at a time: a batch of 10,000 files would be held whole there."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "128", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _decode(id_type: pa.DataType | None, by_path: bool, keep_blank: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from papertide.decode.items import decode

        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            size = 0
            for k, content in enumerate(batch.column(1)):
                found = decode(content.as_py(), by_path, keep_blank)
                rows += found
                owner += [k] * len(found)
                size += sum(len(r[-2] or "") + len(r[-1] or "") for r in found)
                if len(rows) > 20_000 or size > 2 << 20:
                    yield out(batch, owner, rows)
                    rows, owner, size = [], [], 0
            if rows:
                yield out(batch, owner, rows)

    def out(batch: pa.RecordBatch, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [batch.column(0).take(pa.array(owner, pa.int32()))]
        columns += [pa.array([_text(v) for v in c] if f.type == pa.string() else c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *_ARROW.names])

    return run


def _text(v: str | None) -> str | None:
    return v if v is None or v.isascii() else v.encode("utf-8", "replace").decode()


_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, and driver and executors are one process, one of our own."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # a setting without a default raises when unset
        found = None
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="papertide-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name of its own in the shared folder; `release` removes what was written there."""
    path = f"{shared_folder(spark)}/papertide-{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: it outlives executors and cuts the lineage.  by: a column to lay the files out by."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def release(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; DataFrames made before can no longer be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def formats(files: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(id, container, format) of each file that has a format, in one pass that reads directories only."""
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from papertide.decode.items import format_of

        for batch in batches:
            files = [(v[:8], format_of(v)) for v in (c.as_py() or b"" for c in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in files], pa.binary()), pa.array([f for _, f in files], pa.string())], [id_col, "head", "format"])

    with small_batches(files.sparkSession):
        found = written(files.select(id_col, content_col).mapInArrow(run, f"{id_col} {kind}, head binary, format string"), "formats")
    return found.where("format IS NOT NULL").select(id_col, container(F.col("head")).alias("container"), "format")


def typed_rows(files: DataFrame, id_col: str = "doc_id", content_col: str = "content", by_path: bool = False, keep_blank: bool = False) -> DataFrame:
    """(doc_id, items...) of each file, not yet run."""
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("content"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decode(None, by_path, keep_blank), f"doc_id {kind}, {ITEM}")


def decoded(files: DataFrame, id_col: str = "doc_id", content_col: str = "content", by_path: bool = False, keep_blank: bool = False) -> DataFrame:
    """The rows of all kinds, laid out by kind, so that a plan reads only those that it needs."""
    with small_batches(files.sparkSession):
        return written(typed_rows(files, id_col, content_col, by_path, keep_blank), "items", by="kind")
