"""Whole outputs of small files, and volume."""

import pytest
from pyspark.sql import functions as F

from papertide.api import ExtractionError, extract, extract_bytes, extract_files, report
from papertide.fixtures import legacy as old
from papertide.fixtures import packages as new
from papertide.functions import text as T

SHEET = new.sheet_part([[new.cell("onions"), new.cell("4")], [new.cell("leeks"), new.cell("12")]])
ROWS = "=== Sheet: Stall ===\nonions\t4\nleeks\t12\n"
SOURCE = "Option Explicit\r\nFunction Twice(n)\r\n  Twice = 2 * n ' doubled\r\nEnd Function\r\n"
CASES = {
    "docx charts": (new.docx_bytes("Harvest\nof the year", {f"word/charts/chart{n}.xml": new.drawing_part(f"Axis {n}") for n in (10, 2)}), "Harvest\nof the year\n=== Chart ===\nAxis 2\n=== Chart ===\nAxis 10\n"),
    "docx diagram": (new.docx_bytes("Who does what", {"word/diagrams/data3.xml": f"<d {new.A}><dgm:t><a:p><a:r><a:t>sow</a:t></a:r></a:p></dgm:t><dgm:t><a:p><a:r><a:t>reap</a:t></a:r></a:p></dgm:t></d>"}), "Who does what\n=== Chart ===\nsowreap\n"),
    "pptx order": (new.pptx_bytes(["alpha", "beta\nbeta two", "gamma"], [2, 0, 1]), "gamma\nalpha\nbeta\nbeta two\n"),
    "pptx comment": (new.pptx_bytes(["A plan"], [0], {"ppt/comments/comment7.xml": "<l><p:text>too long</p:text><p:text>by half</p:text></l>"}), "A plan\n=== Comments ===\ntoo longby half\n"),
    "xlsx phonetic": (new.xlsx_bytes([("Stall", new.sheet_part([[new.cell("1", "s"), new.cell("0", "s")]]))], ["葱", "玉葱"]), "=== Sheet: Stall ===\n玉葱\t葱\n"),
    "xlsx remarks": (new.xlsx_bytes([("Stall", SHEET)], more={"xl/threadedComments/threadedComment2.xml": "<l><text>weigh again</text></l>", "xl/comments1.xml": "<l><t>fresh?</t></l>"}), ROWS + "\n=== Comments ===\nfresh?\n\n=== Comments ===\nweigh again\n"),
    "xlsx drawing": (new.xlsx_bytes([("Stall", SHEET)], more={"xl/drawings/drawing4.xml": new.drawing_part("see overleaf")}), ROWS + "\n=== Shapes ===\nsee overleaf\n"),
    "xlsx headings": (new.xlsx_bytes([("Stall", new.sheet_part([[new.cell("x")]], '<headerFooter><oddHeader>&LMay&C&"Mono,Italic"Prices&R&9today</oddHeader><evenHeader>&CPage &P</evenHeader><oddFooter>&RNo refunds</oddFooter></headerFooter>'))]), "=== Sheet: Stall ===\nx\nMay Prices today\nPage\nNo refunds\n"),
    "xlsx macros": (new.xlsx_bytes([("Stall", SHEET)], more={"xl/vbaProject.bin": new.macro_part([("Sums", SOURCE), ("More", "x = 1\r\n")])}), ROWS + "\n=== Macros ===\n=== VBA Module: Sums ===\n" + SOURCE.replace("\r\n", "\n") + "=== VBA Module: More ===\nx = 1\n"),
    "xlsx fallback": (new.xlsx_bytes([("x", new.sheet_part([[new.cell("one")]])), ("y", "<worksheet/>")], linked=False), "=== Sheet: Sheet1 ===\none\n\n=== Sheet: Sheet2 ===\n"),
    "doc": (old.doc_bytes([("a\x13 F \x14b\x15\r", True), ("日\x13 open \x15 lost", False)], [("M", "x")]), "ab\n日\n=== VBA Module: M ===\nx\n"),
    "ppt": (old.ppt_bytes([("a\rb", True), (" ", True), ("日", False)]), "a\nb\n日\n"),
    "empty ppt": (old.ppt_bytes([]), ""),
}


def test_whole_outputs(spark):
    names = list(CASES)
    files = spark.createDataFrame([(n, CASES[n][0]) for n in names], "name string, content binary")
    found = {r.name: (r.status, r.text) for r in extract(files, "name").collect()}
    assert found == {n: ("ok", CASES[n][1]) for n in names}


def test_errors_modes_and_report(spark):
    files = spark.createDataFrame([(1, b"junk"), (2, new.docx_bytes("x")), (3, old.doc_bytes([("x", True)], encrypted=True)), (4, old.ppt_bytes([]))], "doc_id int, content binary")
    found = {r.doc_id: (r.status, r.error_code, r.text) for r in extract(files).collect()}
    assert found == {1: ("error", "unrecognized", None), 2: ("ok", None, "x\n"), 3: ("error", "encrypted", None), 4: ("ok", None, "")}
    with pytest.raises(ExtractionError):
        extract(files, mode="FAILFAST")
    assert {r.doc_id: r.text for r in extract_bytes(files).collect()} == {1: None, 2: b"x\n", 3: None, 4: None}
    shown = {r.doc_id: (r.output, r.message) for r in report(extract(files), "doc_id").collect()}
    assert shown[2] == ("==> 2 <==\nx\n\n", None)
    assert shown[1][0] == "" and shown[1][1].startswith("1: ")


def test_files_of_a_folder_and_as_they_arrive(spark, tmp_path):
    from papertide.streaming.arriving import extract_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"stub before the archive" + new.docx_bytes("by path"))
    (tmp_path / "in/b.doc").write_bytes(old.doc_bytes([("legacy", True)]))
    found = {r.path.rsplit("/", 1)[1]: r.text for r in extract_files(spark, str(tmp_path / "in")).collect()}
    assert found == {"a.bin": "by path\n", "b.doc": "legacy"}
    stream = extract_arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_volume(spark):
    n = 20_000
    marks = [f"MK{i:06d}" for i in range(n)]
    files = [("docx", new.docx_bytes("\n".join(marks))), ("xlsx", new.xlsx_bytes([("S", new.sheet_part([[new.cell(m), new.cell("日本")] for m in marks]))])), ("doc", old.doc_bytes([("\r".join(marks), False)])), ("ppt", old.ppt_bytes([(m, True) for m in marks]))]
    found = extract(spark.createDataFrame(files, "name string, content binary"), "name")
    each = found.select("name", F.explode(F.regexp_extract_all("text", F.lit(r"MK[0-9]{6}"), F.lit(0))).alias("m"))
    counts = each.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("m").alias("d")).collect()
    assert {(r.name, r.n, r.d) for r in counts} == {(f, n, n) for f, _ in files}


def test_text_functions(spark):
    def one(f, value):
        return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]

    for value, expected in {'&L&"open': "", "a&": "a", "&&&&": "&&", "&K12345678": "78", "x&Py": "xy", "&CA&RB": "A B", "&12 3": "3"}.items():
        assert one(T.strip_heading_codes, value) == expected, value
    assert one(T.clean_document, "a\x13x\x13y\x14z\x15\x14b\x15c") == "abc"
    assert one(T.clean_document, "a\x13x\x15b") == "a"
    assert one(T.clean_aux, "\r\nA\x0b\tB\x01\n") == "A\n\tB"
    for target, expected in {"slides/s1.xml": "ppt/slides/s1.xml", "/x/y": "x/y", "../a/./b": "a/b", "//r": "/r"}.items():
        assert one(lambda c: T.resolve_target("ppt", c), target) == expected


def test_heading_codes_whole_and_by_token_agree(spark):
    import random

    r = random.Random(3)
    values = ["".join(r.choice(["&", "&&", '"', "L", "C", "K", "F0", "12", " ", "x", "&P", '&"A,B"', "\n"]) for _ in range(r.randint(0, 25))) for _ in range(600)] + ["a\uFFFE\uFDD0&&b", None]
    found = spark.createDataFrame([(v,) for v in values], "s string").select(T.strip_heading_codes(F.col("s")).alias("a"), T._strip_by_token(F.col("s")).alias("b")).collect()
    assert len(found) == len(values) and all(x.a == x.b for x in found)


def test_release_removes_what_was_written(spark, tmp_path):
    import os

    from papertide.sources import files

    before = dict(files._WRITTEN)
    files._WRITTEN.clear()
    path = files.new_folder(spark, "x")
    spark.range(3).write.parquet(path)
    files.release(spark)
    assert not os.path.exists(path.removeprefix("file:")) and not files._WRITTEN
    files._WRITTEN.update(before)


def test_command_line(spark, tmp_path, capsys):
    from papertide.__main__ import main

    good, bad = tmp_path / "a.docx", tmp_path / "b"
    good.write_bytes(new.docx_bytes("text"))
    bad.write_bytes(b"junk")
    assert main([]) == 2
    assert main([str(good)]) == 0
    assert capsys.readouterr().out == "text\n"
    assert main([str(good), str(bad), str(tmp_path / "none")]) == 1
    shown = capsys.readouterr()
    assert shown.out == f"==> {good} <==\ntext\n\n" and f"papertide: {bad}: file too small" in shown.err and "none" in shown.err
