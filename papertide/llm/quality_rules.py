"""Quality rules: base rules on a document alone, and lines that many documents of a host share.

Base: a document fails with fewer than `min_words` words, or when more than half of its
words lie in three-word windows that it has twice or more.

Cross-document line frequency: lines are normalised (ASCII lower case, single blanks) and
hashed together with their host; each counts the distinct documents of the host that
hold it (equal texts are one document there, so that copies do not make a line common).  A
line in more than `max_share` of the host's distinct documents, and in `min_docs` at least, is
above the limit and removed; a document that loses more than `max_removed` of its words is
depleted and rejected.  Hot hosts and hot lines are combined in each task before a shuffle,
and what comes back to a document is only its own lines.

Null or empty texts have no words and fail the base rules.  A null host is a host of its
own.  Repeated rows get equal verdicts.  Extra columns are ignored by `verdicts` and kept by
`filtered`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.shared import own, pieces, written

SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    dense = text.translate(None, _BLANK)
    seen: set[bytes] = set()
    dup_lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup_lines += 1
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(grams) > len(set(grams)):
        count, end = Counter(grams), 0
        for i, gram in enumerate(grams):
            if count[gram] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(dense.decode()), len(text) - len(text.translate(None, SYMBOLS)), dup_lines, repeat


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "text"):
        hosts = batch.column(3).to_pylist()
        stats, keys, sizes, content = [], [], [], []
        for text, host in zip(texts, hosts, strict=True):
            stats.append(base_stats(text))
            content.append(xxhash.xxh64_intdigest(text) - (1 << 63))
            prefix = b"\0" if host is None else str(host).encode() + b"\1"
            k, n = [], []
            for line in text.split(b"\n"):
                words = line.lower().split()
                n.append(len(words))
                k.append(xxhash.xxh64_intdigest(prefix + b" ".join(words)) - (1 << 63) if words else None)
            keys.append(k)
            sizes.append(n)
        columns = [pa.array(c, pa.int64()) for c in zip(*stats, strict=True)] if stats else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), *columns, pa.array(content, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
            ["rid", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "line_keys", "line_words"],
        )


def _row_key(id_col: str, text_col: str, host_col: str) -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\1"))
    return F.unhex(F.md5(F.concat(part(id_col), F.lit("\0"), part(host_col), F.lit("\0"), F.coalesce(F.col(text_col), F.lit("")))))


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, min_docs: int = 20, max_share: float = 0.01, max_removed: float = 0.5) -> DataFrame:
    """Rows (rid, id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words, common_lines, kept).

    common_lines: the numbers, from 0, of the lines above the limit; rid: an MD5 of id, host and text.
    """
    rows = own(df, doc_id=id_col, text=text_col, host=host_col).withColumn("rid", _row_key("doc_id", "text", "host")).select("rid", "doc_id", "text", "host")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    listed = written(rows.mapInArrow(_read, f"rid binary, doc_id {kinds['doc_id']}, host {kinds['host']}, {_STATS}, content long, line_keys array<long>, line_words array<int>"), "lines")

    hosts = listed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    lines = listed.select("host", "content", F.explode(F.array_distinct("line_keys")).alias("key")).where("key is not null")
    often = lines.distinct().groupBy("key").agg(F.count("*").alias("n"), F.first("host").alias("host")).where(F.col("n") >= min_docs)
    above = often.join(hosts, often.host.eqNullSafe(hosts.host)).where(F.col("n") > F.lit(max_share) * F.col("docs")).select("key")

    each = listed.select("rid", F.posexplode(F.arrays_zip("line_keys", "line_words")).alias("at", "x")).select("rid", "at", F.col("x.line_keys").alias("key"), F.col("x.line_words").alias("words"))
    hit = each.join(above, "key").groupBy("rid").agg(F.collect_set(F.struct("at", "words")).alias("hit"))
    full = listed.drop("line_keys", "line_words", "content", "host").join(hit, "rid", "left")
    lost = F.coalesce(F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x.words), F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    full = full.select("*", failed.alias("base_failed"), lost.alias("n_common_words"), F.coalesce(F.array_sort(F.transform("hit", lambda x: x.at)), F.array().cast("array<int>")).alias("common_lines")).drop("hit")
    return full.withColumn("kept", ~F.col("base_failed") & (F.col("n_common_words") <= F.lit(max_removed) * F.col("n_words"))).withColumnRenamed("doc_id", id_col)


def filtered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str | None = "n_chars", **limits: float) -> DataFrame:
    """The kept rows with all their columns; lines above the limit are gone from their texts."""
    found = verdicts(df, id_col, text_col, host_col, **limits).where("kept").select(F.col("rid").alias("__rid"), F.col("common_lines").alias("__common")).dropDuplicates(["__rid"])
    names = df.columns
    joined = df.withColumn("__rid", _row_key(id_col, text_col, host_col)).join(found, "__rid")
    split = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains("__common", i))
    text = F.when(F.size("__common") > 0, F.array_join(split, "\n")).otherwise(F.col(text_col))
    out = joined.withColumn(text_col, text)
    if length_col in names:
        out = out.withColumn(length_col, F.when(F.size("__common") > 0, F.length(text_col).cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*names)
