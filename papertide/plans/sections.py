"""Plans from typed rows to sections: (doc_id, sec_ord, sub_ord, name, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertide.functions.text import clean_document, clean_slide, is_blank, normalize_source, resolve_target, rtrim_lines
from papertide.operators.lines import in_order, joined, keep_last

SECTION = ["doc_id", "sec_ord", "sub_ord", "name", "text"]


def _of(items: DataFrame, fmt: str | None, kind: str) -> DataFrame:
    found = items.where(F.col("kind") == kind)
    return found if fmt is None else found.where(F.col("format") == fmt)


def _section(df: DataFrame, sec_ord: int, sub_ord: Column | str, name: Column | str, text: Column) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select("doc_id", F.lit(sec_ord).alias("sec_ord"), col(sub_ord).cast("long").alias("sub_ord"), col(name).alias("name"), text.alias("text"))


# The roles of text parts, each with the format it stands in (None: any), its place among the sections and its label.
_PARTS = (
    ("docx", "body", 0, ""), ("docx", "aux", 1, ""), ("pptx", "note", 1, "=== Notes ===\n"), ("pptx", "comment", 2, "=== Comments ===\n"), ("pptx", "master", 3, "=== Layout ===\n"),
    ("xlsx", "comment", 1, "=== Comments ===\n"), ("xlsx", "shape", 2, "=== Shapes ===\n"), (None, "chart", 10, "=== Chart ===\n"),
)


def text_parts(items: DataFrame) -> DataFrame:
    """Parts in numeric order within each role, all roles in one reading; the decoder drops blank ones."""
    sec_ord, label = F.lit(None).cast("int"), F.lit("")
    for fmt, role, place, title in _PARTS:
        here = (F.col("b") == role) & (F.col("format") == fmt if fmt else F.lit(True))
        sec_ord, label = F.when(here, place).otherwise(sec_ord), F.when(here, title).otherwise(label)
    found = _of(items, None, "text").select("doc_id", sec_ord.alias("sec_ord"), F.col("part_no").alias("sub_ord"), F.col("part").alias("name"), F.concat(label, "a").alias("text"))
    return found.where("sec_ord IS NOT NULL")


def targets(items: DataFrame, fmt: str, base: str) -> DataFrame:
    """(doc_id, i, title, part): sheets or slides of the main part, in its order, resolved by its relationships."""
    rels = keep_last(_of(items, fmt, "rel").select("doc_id", "i", "a", "b"), ["doc_id", "a"], "i")
    rels = rels.select("doc_id", F.col("a").alias("rel"), resolve_target(base, F.col("b")).alias("part"))
    refs = _of(items, fmt, "ref").select("doc_id", "i", F.col("a").alias("title"), F.col("b").alias("rel"))
    return refs.join(rels, ["doc_id", "rel"]).select("doc_id", "i", "title", "part")


def with_fallback(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Where nothing was resolved, the parts in numeric order under ordinal names."""
    w = Window.partitionBy("doc_id").orderBy("part_no", "part")
    rest = parts.join(found.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("k", F.row_number().over(w))
    return found.unionByName(rest.select("doc_id", (F.col("k") - 1).cast("int").alias("i"), F.concat(F.lit("Sheet"), "k").alias("title"), "part"))


def slide_order(items: DataFrame) -> DataFrame:
    slides = _of(items, "pptx", "part").where(F.col("part").startswith("ppt/slides/slide") & F.col("part").endswith(".xml")).select("doc_id", "part_no", "part")
    return with_fallback(targets(items, "pptx", "ppt"), slides)


def pptx(items: DataFrame) -> DataFrame:
    texts = _of(items, "pptx", "text").where("b = 'slide'").select("doc_id", "part", "a")
    slides = slide_order(items).join(texts, ["doc_id", "part"])
    return _section(slides, 0, "i", "part", F.col("a"))


def sheet_order(items: DataFrame) -> DataFrame:
    sheets = _of(items, "xlsx", "part").where(F.col("part").startswith("xl/worksheets/sheet") & F.col("part").endswith(".xml")).select("doc_id", "part_no", "part")
    return with_fallback(targets(items, "xlsx", "xl"), sheets)


def xlsx(items: DataFrame) -> DataFrame:
    grids = _of(items, "xlsx", "grid").select("doc_id", "part", F.concat(F.lit("\n"), "a").alias("grid"))
    sheets = sheet_order(items).join(grids, ["doc_id", "part"], "left")
    text = F.concat(F.lit("=== Sheet: "), F.coalesce("title", F.lit("")), F.lit(" ==="), F.coalesce("grid", F.lit("")))
    return _section(sheets, 0, "i", "part", text)


def macro_text(items: DataFrame) -> DataFrame:
    """(doc_id, macros): the modules' sources under their headers, in project order."""
    found = items.where("kind = 'module'").select("doc_id", "i", F.coalesce("a", F.lit("")).alias("title"), normalize_source(F.col("b")).alias("source")).where(~is_blank(F.col("source")))
    line = F.concat(F.lit("=== VBA Module: "), "title", F.lit(" ===\n"), "source", F.when(F.col("source").endswith("\n"), "").otherwise("\n"))
    return found.groupBy("doc_id").agg(joined(line, "", "i").alias("macros"))


def extras(items: DataFrame, kinds: set[str]) -> list[DataFrame]:
    """Properties and macros of packages, where there are any."""
    package, found = items.where(F.col("format").isin("docx", "xlsx", "pptx")), []
    if "property" in kinds:
        properties = package.where("kind = 'property'").groupBy("doc_id").agg(joined("a", "\n", "i").alias("t"))
        found.append(_section(properties, 11, F.lit(0), F.lit(""), F.concat(F.lit("=== Properties ===\n"), "t")))
    if "module" in kinds:
        found.append(_section(macro_text(package), 12, F.lit(0), F.lit(""), F.concat(F.lit("=== Macros ===\n"), rtrim_lines(F.col("macros")))))
    return found


def doc(items: DataFrame) -> DataFrame:
    """(doc_id, text) of Word pieces in order."""
    return _of(items, "doc", "piece").groupBy("doc_id").agg(joined("a", "", "i").alias("t")).select("doc_id", clean_document(F.col("t")).alias("text"))


def ppt(items: DataFrame) -> DataFrame:
    atoms = _of(items, "ppt", "atom").select("doc_id", "i", "b", clean_slide(F.col("a")).alias("t")).where(F.col("b").isNotNull() | ~is_blank(F.col("t")))
    return atoms.groupBy("doc_id").agg(joined("t", "\n", "i").alias("t")).select("doc_id", F.concat("t", F.lit("\n")).alias("text"))


def xls(items: DataFrame) -> DataFrame:
    """(doc_id, text): a binary workbook is walked where it is decoded."""
    return _of(items, "xls", "book").select("doc_id", F.col("a").alias("text"))


def legacy(items: DataFrame, formats: set[str], kinds: set[str]) -> DataFrame:
    """(doc_id, text) of compound files, macros behind the text; only plans of formats and kinds that occur."""
    text = reduce(DataFrame.unionByName, [plan(items) for name, plan in LEGACY.items() if name in formats])
    if "module" not in kinds:
        return text
    macros = macro_text(items.where(F.col("format").isin("doc", "xls", "ppt")))
    both = text.join(macros, "doc_id", "full")
    t, m = F.coalesce("text", F.lit("")), F.coalesce("macros", F.lit(""))
    gap = F.when((m == "") | (t == "") | t.endswith("\n"), "").otherwise("\n")
    return both.select("doc_id", F.concat(t, gap, m).alias("text"))


def packages(items: DataFrame, formats: set[str], kinds: set[str]) -> DataFrame:
    """(doc_id, text) of ZIP packages: sections in order; those of workbooks have a blank line between."""
    sections = reduce(DataFrame.unionByName, [text_parts(items)] + [plan(items) for name, plan in PACKAGES.items() if name in formats] + extras(items, kinds))
    texts = sections.groupBy("doc_id").agg(in_order("text", "sec_ord", "sub_ord", "name").alias("texts"))
    books, text = items.where("kind = 'part' and format = 'xlsx'").select("doc_id").distinct().withColumn("book", F.lit(True)), F.array_join("texts", "\n")
    if "xlsx" in formats:
        texts = texts.join(books, "doc_id", "left")
        text = F.when(F.col("book"), F.array_join("texts", "\n\n")).otherwise(text)
    return texts.select("doc_id", F.concat(text, F.lit("\n")).alias("text"))


PACKAGES = {"pptx": pptx, "xlsx": xlsx}  # those of documents are text parts alone
LEGACY = {"doc": doc, "xls": xls, "ppt": ppt}
