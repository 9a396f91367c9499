"""Hand vectors, damage and volume for the byte decoders."""

import random
import struct
import time

import pytest

from papertide.decode import items, macros, markup, sheets, slides
from papertide.decode.chars import cp1252, format_number, rk_number, utf16
from papertide.decode.compound import CompoundFile, Damaged
from papertide.fixtures import legacy as old
from papertide.fixtures import packages as new
from papertide.fixtures.compound import compound_bytes


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        (bytes.fromhex("0105B008") + b"ABC" + bytes.fromhex("0020"), b"ABCABC"),
        (bytes.fromhex("0103B002") + b"A" + bytes.fromhex("0200"), b"AAAAAA"),
        (b"\1" + 2 * (bytes.fromhex("05B008") + b"ABC" + bytes.fromhex("0020")), b"ABCABCABCABC"),
        (bytes.fromhex("010230") + b"XYZ", b"XYZ"),
        (bytes.fromhex("000102"), b""),
        (b"", b""),
    ],
)
def test_macro_containers(data, expected):
    assert macros.decompress(data) == expected


@pytest.mark.parametrize(("v", "text"), [(42, "42"), (100000, "100000"), (1e6, "1e+06"), (1234567, "1.234567e+06"), (0.00001, "1e-05"), (0.0001, "0.0001"), (-0.0, "-0"), (12.5, "12.5"), (float("inf"), "+Inf"), (1e22, "1e+22"), (123456.789, "123456.789"), (5e-324, "5e-324")])
def test_numbers(v, text):
    assert format_number(v) == text


def test_rk():
    assert rk_number(old.rk(-7)) == -7
    assert rk_number(old.rk(12.34)) == 12.34
    assert rk_number(struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32) == 1.5


def test_characters():
    assert cp1252(bytes([0x80, 0x81, 0x92])) == "€\x81’"
    assert utf16("a𝄞".encode("utf-16-le")[:-2] + b"x") == "a�"


@pytest.mark.parametrize("version", [3, 4])
@pytest.mark.parametrize("sizes", [[0, 1, 63, 64, 65, 4095, 4096, 4097, 20000], [9_000_000]])
def test_compound_round_trip(version, sizes):
    streams = {f"s{n}": random.Random(n).randbytes(n) for n in sizes}
    file = CompoundFile(compound_bytes(streams, version))
    assert file.names() == list(streams)
    assert all(file.stream(n) == d for n, d in streams.items())
    with pytest.raises(Damaged):
        file.stream("missing")


def test_corrupt_difat_ends():
    data = bytearray(2560)
    data[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HHH", data, 26, 3, 0xFFFE, 9)
    struct.pack_into("<IIIIIIIII", data, 44, 0xFFFFFFFA, 1, 0, 0, 0, 0xFFFFFFFA, 2, 0, 0xFFFFFFFA)
    struct.pack_into("<I", data, 512 * 3 + 508, 2)
    began = time.time()
    with pytest.raises(Damaged):
        CompoundFile(bytes(data)).stream("x")
    assert time.time() - began < 2


def test_shared_strings_over_continue_records():
    strings = ["plain", "é" * 9000, "日" * 9000, "", "end"]
    out = old.xls_bytes([], [], strings)
    assert [r[4] for r in sheets.rows(CompoundFile(out)) if r[2] == "string"] == strings


def test_nested_slides_stop_at_a_depth():
    atom = struct.pack("<HHI", 0, 0x0FA8, 1) + b"x"
    for depth in (32, 33):
        data = atom
        for _ in range(depth):
            data = struct.pack("<HHI", 0xF, 1, len(data)) + data
        assert bool(list(slides.atoms(data))) == (depth <= 32)


def test_markup_is_lenient():
    assert markup.running_text(b"<p><t>a & b &unknown; <![CDATA[x & y]]></t></p>") == "a & b &unknown; x & y"
    assert markup.running_text(b"\xef\xbb\xbf<x><p><t>kept</t></p><p><t>open") .startswith("kept")
    assert markup.running_text(b'<!DOCTYPE a [<!ENTITY b "bbb">]><a><t>&b;</t></a>') == ""
    assert markup.running_text(b"<a:p><dgm:t><a:p><a:t>x</a:t></a:p></dgm:t><dgm:t>y</dgm:t></a:p>") == "xy"


@pytest.mark.parametrize(
    ("part", "text"),
    [
        (b"<d><p><b><t>one</p><p><t>two</t></p></d>", "one\ntwo"),  # missing ends are made up
        (b"<d><p><t>one</t></q></p><p><t>two</t></p></d>", "one"),  # an end of nothing ends the part
        (b"<d a=1 b><p c='<'><t x=y>one</t></p></d>", "one"),
        (b"<d><p><t>1 < 2</t></p></d>", "1"),
        (b"<d><p><t>&#65;&#x42;&#0;&amp;&nbsp;&lt; & so</t><br/><t>x</t></p></d>", "AB&#0;&&nbsp;< & so\nx"),
        (b"<d><p><t>one</t><!-- <t>no</t> --><t><![CDATA[<two>&amp;]]></t></x:p><p><t>cut", "one<two>&amp;\ncut"),
        (b"<d><p><t>one &</t></p><mc:Fallback><p><t>no</t></p></mc:Fallback><p><t>a\r\nb</t></p>", "one &\na\nb"),
        (b"<d><p><t>good & \xff bad</t></p></d>", "good &"),
    ],
)
def test_parts_that_are_not_well_formed(part, text):
    assert markup.running_text(part).rstrip() == text


def test_events_of_both_readers_agree():
    r = random.Random(5)

    def element(depth):
        name = r.choice(["p", "t", "w:r", "c", "v", "row", "Fallback", "tab"])
        inner = "".join(element(depth + 1) if r.random() < 0.6 and depth < 5 else r.choice(["", "a b", "&amp;", "&#x41;", "<![CDATA[<x>]]>", "<!-- - -->"]) for _ in range(r.randint(0, 4)))
        return f"<{name} t=\"s&lt;\" r:id='1'>{inner}</{name}>" if inner else f"<{name}/>"

    for _ in range(200):
        part = f"<d>{element(0)}</d>".encode()
        joined = lambda events: [(k, n if k == markup.TEXT else (n, tuple(sorted(a.items())))) for k, n, a in events]
        flat = lambda events: "".join(str(x) if k != markup.TEXT else x for k, x in joined(events))
        assert flat(markup.strict(part)) == flat(markup.tolerant(part))
        assert markup.running_text(part) == markup.running_text(part + b"\n")


def test_grid_and_strings_of_broken_parts():
    found = markup.grid(b"<s><row><c t=s><v>1</v></c><c><v>&x;</row><row><c><is><t>in</t></is></c></row><row><c><v>open")
    assert found.cells == [(0, 0, "s", "1"), (0, 1, "", "&x;"), (1, 0, "", "in")]
    assert markup.shared_strings(b"<sst><si><t>a & b</t><rPh><t>no</t></rPh></si><si><r><t>c</t></r><r><t>d</t></r></si><si><t>cut") == ["a & b", "cd"]
    assert markup.properties(b"<p><dc:title> A & B </dc:title><revision>1</revision><dc:creator>me</dc:creator>") == ["A & B", "me"]


@pytest.mark.parametrize("gap", [b"", bytes(4)])
def test_modules_of_a_project(gap):
    record = lambda kind, data: struct.pack("<HI", kind, len(data)) + data
    body = record(0x0F, b"\2\0")
    for k, name in enumerate(["One", "Zwé"]):
        body += record(0x19, b"old") + record(0x47, name.encode("utf-16-le")) + record(0x1A, b"s%d" % k) + record(0x32, b"") + record(0x31, struct.pack("<I", k)) + record(0x2B, b"") + gap
    assert [(m.name, m.stream, m.offset) for m in macros.module_table(b"junk" + body + record(0x10, b""))] == [("One", "s0", 0), ("Zwé", "s1", 1)]
    assert [m.name for m in macros.module_table(body[:-7])] == ["One", "Zwé"]
    assert macros.module_table(b"none") == []


def test_hyperlinks():
    counted = lambda s: struct.pack("<I", len(s) + 1) + (s + "\0").encode("utf-16-le")
    url = "http://x\0".encode("utf-16-le")
    moniker = bytes.fromhex("E0C9EA79F9BACE118C8200AA004BA90B") + struct.pack("<I", len(url)) + url
    link = lambda flags, body: next(sheets._hyperlink(bytes(28) + struct.pack("<I", flags) + body, [], False))[2]
    assert link(0x1, moniker) == "http://x"
    assert link(0x1 | 0x8 | 0x10 | 0x80, counted("shown") + counted("frame") + moniker + counted("A1")) == "http://x#A1"
    assert link(0x101, counted("c:\\f")) == "c:\\f"
    assert link(0x8, counted("A1")) == "A1"
    assert link(0x1 | 0x8, bytes(16) + counted("B2")) == "B2"  # another moniker
    assert link(0x8, struct.pack("<I", 99) + b"ab") == "" and link(0x1, b"") == ""


@pytest.mark.parametrize("seed", range(6))
def test_damage_never_raises(seed):
    r = random.Random(seed)
    text = "line one\nZeile zwei é\n" * 20
    files = [
        new.docx_bytes(text, {"word/vbaProject.bin": new.macro_part([("M", "x\r\n")])}), new.xlsx_bytes([("S", new.sheet_part([[new.cell("a")]]))], ["x"]), new.pptx_bytes([text], [0]),
        old.doc_bytes([(text, True)], [("M", "Sub\r\n")]), old.ppt_bytes([(text, False)]), old.xls_bytes(["S"], [old.record(0x204, struct.pack("<HHH", 0, 0, 0) + old.short_string(text, 2))], ["s"]),
    ]
    for data in files:
        for _ in range(60):
            bad = bytearray(data)
            for _ in range(r.randint(1, 12)):
                bad[r.randrange(len(bad))] = r.randrange(256)
            if r.random() < 0.3:
                del bad[r.randrange(len(bad)) :]
            began = time.time()
            assert items.decode(bytes(bad))
            assert time.time() - began < 5


def test_part_numbers():
    assert [items.part_number(n) for n in ("ppt/slides/slide12.xml", "a/b", "x7.y8", "n1/m", "header10.xml")] == [12, 0, 7, 0, 10]
