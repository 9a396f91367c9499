"""Tables in the folder that driver and executors share, columns under our own names, joins on hot keys, and batches in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.sources.files import new_folder, shared_folder, written

__all__ = ["CHUNK", "join_salted", "new_folder", "own", "parts", "pieces", "row_key", "shared_folder", "written"]

#: Bytes of text that a Python worker takes up at once.
CHUNK = 500_000


def own(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the given columns under our names, so that other columns cannot clash."""
    return df.select(*(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by where ids may repeat or be null: rows of one key have equal ids and texts."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\0"), F.coalesce(text, F.lit("")))))


def join_salted(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """many joined with one, which has at most one row a key: a key with very many rows of many goes to `salts` tasks, dealt by the column by."""
    salt = F.pmod(F.xxhash64(by), F.lit(salts))
    left = many.withColumn("__salt", F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(by), F.lit(1 << 20))).otherwise(salt).cast("int"))  # rows without a key are dealt out too
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes in a column of strings; a longer one stands alone.  A batch may be a hundred times larger."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(size), 0
        while begin < len(size):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The `parts` of batches and their texts, null as empty."""
    for part in parts(batches, text, limit):
        yield part, [t or b"" for t in part.column(text).cast(pa.binary()).to_pylist()]
