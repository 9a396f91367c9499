"""What users call: extract, extract_bytes, extract_files, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.functions.text import clean_slide, is_blank
from papertide.decode.items import MAIN
from papertide.plans.sections import LEGACY, legacy, packages
from papertide.sources.files import decoded, read_files, written


class ExtractionError(RuntimeError):
    pass


def assemble(items: DataFrame) -> DataFrame:
    """Typed rows -> (doc_id, format, text, status, error_code, error); a failed document has no text."""
    marks = F.max(F.when(F.col("kind") == "error", F.struct(F.col("a").alias("code"), F.col("b").alias("message"))))
    docs = items.where(F.col("kind").isin("part", "error", "encrypted")).groupBy("doc_id").agg(F.max("format").alias("format"), marks.alias("e"), F.max(F.col("kind") == "encrypted").alias("locked"))
    formats = {r.format for r in items.where("kind = 'part'").select("format").distinct().collect()}  # six at most
    kinds = {r.kind for r in items.select("kind").distinct().collect()}  # a folder each
    plans = [plan(items, formats, kinds) for plan, known in ((packages, MAIN), (legacy, LEGACY)) if formats & {*known}]
    texts = reduce(DataFrame.unionByName, plans) if plans else docs.where("false").select("doc_id", F.lit("").alias("text"))
    full, locked = docs.join(texts, "doc_id", "left"), F.col("locked")
    if {"atom", "encrypted"} <= kinds:  # else nothing that is locked is shown
        atoms = items.where("kind = 'atom'").select("doc_id", "a")
        shown = atoms.where(~is_blank(clean_slide(F.col("a")))).select("doc_id").distinct().withColumn("shown", F.lit(True))
        full, locked = full.join(shown, "doc_id", "left"), F.col("locked") & F.col("shown").isNull()
    code = F.coalesce(F.col("e.code"), F.when(locked, "encrypted"))
    message = F.coalesce(F.col("e.message"), F.when(locked, "the presentation is encrypted"))
    return full.select("doc_id", F.when(code.isNull(), F.col("format")).alias("format"), F.when(code.isNull(), F.coalesce("text", F.lit(""))).alias("text"), F.when(code.isNull(), "ok").otherwise("error").alias("status"), code.alias("error_code"), message.alias("error"))


def extract(files: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "PERMISSIVE", by_path: bool = False, keep_blank: bool = False) -> DataFrame:
    """(id, content) -> (id, format, text, status, error_code, error); ids must be unique.

    mode FAILFAST raises at the first failed document.  keep_blank: parts, slides, atoms and cells without a visible
    character count too, and line feeds at the ends of parts stay; else they go, as the formats' users expect it.
    """
    out = assemble(decoded(files, id_col, content_col, by_path, keep_blank))
    if mode.upper() == "FAILFAST":
        out = written(out, "extracted")  # so that looking for failures is not a second extraction
        bad = out.where("status = 'error'").select("doc_id", "error").first()
        if bad:
            raise ExtractionError(f"{bad.doc_id}: {bad.error}")
    return out.withColumnRenamed("doc_id", id_col)


def extract_bytes(files: DataFrame, **options) -> DataFrame:
    """As extract, with the text as UTF-8; null for an empty text."""
    return extract(files, **options).withColumn("text", F.when(F.col("text") != "", F.encode("text", "UTF-8")))


def extract_files(spark: SparkSession, path: str, pattern: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Files of a folder: a file that opens as a ZIP is a package whatever its first bytes are."""
    return extract(read_files(spark, path, pattern), "path", mode=mode, by_path=True)


def report(extracted: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, output, message): what a command line would print for each file; headers only if there are several."""
    extracted = written(extracted, "report")
    several = extracted.limit(2).count() > 1
    text = F.col("text") if not several else F.concat(F.lit("==> "), F.col(id_col).cast("string"), F.lit(" <==\n"), "text", F.lit("\n"))
    ok = F.col("status") == "ok"
    return extracted.select(id_col, F.when(ok, text).otherwise("").alias("output"), F.when(~ok, F.concat(F.col(id_col).cast("string"), F.lit(": "), "error")).alias("message"))
