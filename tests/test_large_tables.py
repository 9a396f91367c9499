"""What grows with the tables: rows behind the decoder, and what a Python worker holds at once."""

import struct
import sys

import pyarrow as pa
import pytest

from papertide.decode import items, macros, sheets
from papertide.decode.compound import CompoundFile
from papertide.fixtures import legacy as old
from papertide.fixtures import packages as new


def _label(row: int, text: str) -> bytes:
    return old.record(0x204, struct.pack("<HHH", row, 0, 0) + old.short_string(text, 2))


def test_a_workbook_is_a_row_whatever_its_cells():
    book = old.xls_bytes(["S"], [b"".join(_label(i // 2, f"c{i}") for i in range(2_000))])
    rows = items.decode(book)
    assert len(rows) < 5
    assert [r[7] for r in rows if r[1] == "book"] == ["=== Sheet: S ===\n" + "\n".join(f"c{i}\tc{i + 1}" for i in range(0, 2_000, 2)) + "\n"]


def test_workbook_walk():
    bof, name, string = lambda n: (0, 0, "bof", n, None), lambda t: (0, 0, "name", None, t), lambda t: (0, 0, "string", None, t)
    eof, cell = (0, 0, "eof", None, None), lambda row, t: (0, 0, "cell", row, t)
    pending, result = lambda row: (0, 0, "pending", row, None), lambda t: (0, 0, "result", None, t)
    shared, aux, heading = lambda row, i: (0, 0, "shared", row, str(i)), lambda t: (0, 0, "aux", None, t), lambda t: (0, 0, "heading", None, t)
    found = [bof(1), name("One"), eof, eof, bof(2), cell(0, "a"), shared(0, 1), shared(0, 9), pending(1), cell(2, "b"), result("late"), result("none waits")]
    found += [bof(3), cell(2, "chart"), eof, aux(" "), cell(2, "c"), cell(2, "d"), heading("&L&P&12Top&&x"), cell(2, ""), cell(2, "e"), eof, bof(3), cell(2, "f"), eof, bof(2), cell(2, "g"), eof, string("s0"), string("s1"), name("Two"), name("Three")]
    assert sheets.book(iter(found)) == "=== Sheet: One ===\na\ts1\nb\nlate\nchart\tc\td\nTop&x\ne\nf\n=== Sheet: Three ===\ng\n"
    assert sheets.book(iter([bof(1), eof])) == ""
    assert sheets.book(sheets.rows(CompoundFile(old.xls_bytes(["S"], [_label(0, "x")])))) == "=== Sheet: S ===\nx\n"


def test_workers_hold_few_files_at_once():
    from papertide.sources.files import _decode

    files = [new.docx_bytes("x" * 300_000)] * 40
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(files, pa.binary())], ["doc_id", "content"])
    found = list(_decode(None, False)(iter([batch])))
    assert max(b.nbytes for b in found) < 4 << 20 and sum(b.num_rows for b in found) == 80


def test_rows_of_structs_become_tuples_without_their_batch():
    from papertide.queries import _value

    rows = pa.array([[{"a": 1, "b": "x"}, {"a": 2, "b": None}], []])
    assert [_value(v) for v in rows] == [[(1, "x"), (2, None)], []]


def test_lenient_and_strict_readers_of_a_sheet_are_not_slow():
    import time

    from papertide.decode import markup

    rows = [[new.cell(str(i), ""), new.cell("0", "s"), "<c/>", new.cell("x")] for i in range(20_000)]
    part = new.sheet_part(rows, "<headerFooter><oddHeader>&C&P</oddHeader></headerFooter>").encode()
    took = []
    for _ in range(3):
        began = time.process_time()
        sum(i * i % 7 for i in range(3_000_000))  # what this machine does in a while
        unit, began = time.process_time() - began, time.process_time()
        found = markup.grid(part)
        took.append((time.process_time() - began) / unit)
    assert len(found.cells) == 80_000 and found.headings == ["&C&P"]
    assert min(took) < 4.5  # 2.4 to 3.4 and, with a count of every open element at every event, 5.6 to 7.6


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_workbooks_need_no_window_and_no_join_with_what_is_not_there(spark):
    from papertide.api import extract

    files = spark.createDataFrame([(1, old.xls_bytes(["S"], [_label(0, "x")]))], "doc_id int, content binary")
    plan = _plan(extract(files))
    assert "Window" not in plan and plan.count("Join") == 1


def test_text_parts_are_read_once(spark):
    from papertide.api import extract

    files = spark.createDataFrame([(1, new.docx_bytes("x", {"word/header1.xml": new.word_part("y")}))], "doc_id int, content binary")
    found = extract(files)
    assert _plan(found).count("Relation [") == 2 and found.first().text == "x\ny\n"


def test_batches_are_small_while_files_are_decoded_only(spark):
    from papertide.sources.files import small_batches

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark):
        assert int(spark.conf.get(name)) <= 128
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("make", ["_compressed", "_every_text", "_fields"])
def test_decoded_files_leave_in_pieces(make):
    from papertide import queries
    from papertide.sources.files import _decode

    files = [getattr(queries, make)(k, "word " * 40_000) for k in range(1, 60, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(files))), pa.array(files, pa.binary())], ["doc_id", "content"])
    found = list(_decode(None, False)(iter([batch])))
    assert max(b.nbytes for b in found) < 3 << 20 and {*found[0].column(0).to_pylist(), *found[-1].column(0).to_pylist()} >= {0, len(files) - 1}


def test_formats_are_found_in_one_pass(spark):
    from papertide.sources.files import formats

    files = [(1, new.docx_bytes("x")), (2, new.pptx_bytes(["x"])), (3, old.doc_bytes([("x", True)])), (4, old.ppt_bytes([])), (5, b"PK\x03\x04 cut"), (6, None), (7, old.old_xls_bytes(["S"], []))]
    found = formats(spark.createDataFrame(files, "doc_id int, content binary"))
    assert "MapInArrow" not in _plan(found) and "Join" not in _plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "zip", "docx"), (2, "zip", "pptx"), (3, "cfb", "doc"), (4, "cfb", "ppt"), (7, "cfb", "xls")]


def _lines(f, *args) -> int:
    """How many lines of Python a call runs."""
    n, before = 0, sys.gettrace()

    def trace(frame, event, arg):
        nonlocal n
        n += event == "line"
        return trace

    sys.settrace(trace)
    try:
        f(*args)
    finally:
        sys.settrace(before)
    return n


def test_macros_are_packed_and_read_in_runs():
    source = b"x = 1\r\n" * 585
    packed, out = old._chunk(source), bytearray()
    assert macros._chunk(packed, out) and out == source
    assert _lines(old._chunk, source) < 1_000  # 8,252 byte by byte
    assert _lines(macros._chunk, b"\0abcdefgh" * 400, bytearray()) < 5_000  # 20,803 byte by byte
