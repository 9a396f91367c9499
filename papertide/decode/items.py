"""One file to its typed rows: what the DataFrame plans work on.

An item is (format, kind, part, part_no, i, j, n, a, b).  Kinds:
    part       a: name of a package part or stream
    text       running text of a part in a; b: its role (body, aux, slide, note, comment, master, shape, chart)
    rel        i: order; a: id; b: target          (part: the owner)
    ref        i: order; a: sheet name; b: rel id  (sheets and slides of the main part)
    grid       a: the lines of a sheet, its page headings behind them
    property   i: order; a: text
    module     i: order; a: name; b: source; part: stream; n: offset
    piece      i: index; j: 1 if 8-bit; n: file place; a: text
    atom       i: order; j: depth; n: record type; a: text; b: set if it counts though it is blank
    encrypted  a mark in a presentation
    book       a: the text of a binary workbook
    error      a: code; b: message
"""

from __future__ import annotations

import io
import lzma
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

from papertide.decode import macros, markup, sheets, slides, word
from papertide.decode.chars import is_blank
from papertide.decode.compound import NO_PART, NO_STREAM, CompoundFile, Damaged

Item = tuple[str | None, str, str | None, int | None, int | None, int | None, int | None, str | None, str | None]
MAIN = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
SHARED = "xl/sharedStrings.xml"
ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
#: What zipfile raises on damaged archives.
_UNREADABLE = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, OSError, EOFError, RuntimeError, ValueError, IndexError)
#: An atom of marks alone is no text, however blanks are taken.
_MARKS = re.compile(r"[\x00-\x08\x0B-\x1F]")
_DIGITS = re.compile(r"([0-9]+)(?:\.[^./]*)?$")


def part_number(name: str) -> int:
    """The digits that end the base name before its extension; 0 without any."""
    m = _DIGITS.search(name)
    return min(int(m[1]), (1 << 63) - 1) if m else 0


def item(fmt: str | None, kind: str, part: str | None = None, i: int | None = None, j: int | None = None, n: int | None = None, a: str | None = None, b: str | None = None) -> Item:
    return fmt, kind, part, part_number(part) if part else None, i, j, n, a, b


def decode(content: bytes | None, by_path: bool = False, keep_blank: bool = False) -> list[Item]:
    """by_path: anything that opens as a ZIP is one, as for named files; else its first bytes decide.

    keep_blank: parts, atoms and cells without a visible character count, and parts keep line feeds at their ends.
    """
    data = content or b""
    try:
        if data[:4] in ZIP_MAGIC or (by_path and zipfile.is_zipfile(io.BytesIO(data))):
            return list(_package(data, keep_blank))
        return list(_compound(data, keep_blank))
    except Damaged as e:
        return [item(None, "error", a=e.code, b=str(e))]


def format_of(data: bytes) -> str | None:
    """The format by the names of parts or streams; None where there is none."""
    try:
        return _package_format(_opened(data)) if data[:4] in ZIP_MAGIC else _compound_format(CompoundFile(data).names())
    except Damaged:
        return None


def _opened(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except _UNREADABLE as e:
        raise Damaged(f"the archive cannot be opened: {e}", "unrecognized") from None


def _package_format(package: zipfile.ZipFile) -> str:
    names = {*package.namelist()}
    fmt = next((f for f, main in MAIN.items() if main in names), None)
    if fmt is None:
        raise Damaged(NO_PART, "unrecognized")
    return fmt


def _compound_format(names: list[str]) -> str:
    fmt = next((f for f, wanted in (("doc", ("WordDocument",)), ("xls", ("Workbook", "Book")), ("ppt", ("PowerPoint Document",))) if any(w in names for w in wanted)), None)
    if fmt is None:
        raise Damaged(NO_STREAM.format(", ".join(names)), "unrecognized")
    return fmt


def _payload(package: zipfile.ZipFile, info: zipfile.ZipInfo, whole: bool = False) -> bytes:
    """What can be read of a part; with whole, nothing unless all of it can."""
    parts: list[bytes] = []
    try:
        with package.open(info) as f:
            while block := f.read(1 << 20):
                parts.append(block)
    except _UNREADABLE:
        return b"" if whole else b"".join(parts)
    return b"".join(parts)


def _role(fmt: str, name: str, targets: set[str]) -> tuple[str, tuple[str, ...]] | None:
    """The role of a text part and the further elements that hold its text."""
    if fmt == "pptx" and name in targets:
        return "slide", ()
    if not name.endswith(".xml"):
        return None
    if "/charts/chart" in name or "/diagrams/data" in name:
        return "chart", ()
    if fmt == "docx":
        if name == MAIN["docx"]:
            return "body", ()
        if name in ("word/footnotes.xml", "word/endnotes.xml", "word/comments.xml") or name.startswith(("word/header", "word/footer")):
            return "aux", ()
    elif fmt == "pptx":
        if name.startswith("ppt/notesSlides/notesSlide"):
            return "note", ()
        if name.startswith("ppt/comments/"):
            return "comment", ("text",)
        if name.startswith(("ppt/slideMasters/slideMaster", "ppt/slideLayouts/slideLayout")):
            return "master", ()
        if name.startswith("ppt/slides/slide"):
            return "slide", ()
    elif name.startswith(("xl/comments", "xl/threadedComments/")):
        return "comment", ("text",)
    elif name.startswith("xl/drawings/drawing"):
        return "shape", ()
    return None


def _package(data: bytes, keep_blank: bool) -> Iterator[Item]:
    package = _opened(data)
    fmt = _package_format(package)
    infos = {info.filename: info for info in package.infolist()}  # of equal names the last counts
    base, _, main = MAIN[fmt].partition("/")
    rels = f"{base}/_rels/{main}.rels"
    links = markup.relationships(_payload(package, infos[rels])) if fmt != "docx" and rels in infos else []
    refs = markup.slide_ids if fmt == "pptx" else markup.sheet_ids
    named = {r if fmt == "pptx" else r[1] for r in refs(_payload(package, infos[MAIN[fmt]]))} if links else set()
    targets = {t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(base, t)) for i, t in links if i in named}
    strings = markup.shared_strings(_payload(package, infos[SHARED])) if fmt == "xlsx" and SHARED in infos else []
    for name, info in infos.items():
        yield item(fmt, "part", name, a=name)
        role = _role(fmt, name, targets)
        if role is not None:
            text = markup.running_text(_payload(package, info), *role[1], keep_blank=keep_blank)
            if text is not None and (keep_blank or not is_blank(text)):
                yield item(fmt, "text", name, a=text, b=role[0])
        if name == rels:
            for i, (rel, target) in enumerate(links):
                yield item(fmt, "rel", name, i, a=rel, b=target)
        elif name == MAIN[fmt]:
            if fmt == "pptx":
                for i, rel in enumerate(markup.slide_ids(_payload(package, info))):
                    yield item(fmt, "ref", name, i, b=rel)
            elif fmt == "xlsx":
                for i, (title, rel) in enumerate(markup.sheet_ids(_payload(package, info))):
                    yield item(fmt, "ref", name, i, a=title, b=rel)
        elif name == "docProps/core.xml":
            for i, text in enumerate(markup.properties(_payload(package, info))):
                yield item(fmt, "property", name, i, a=text)
        elif name == f"{base}/vbaProject.bin":
            try:
                yield from _modules(fmt, CompoundFile(_payload(package, info, whole=True)))
            except Damaged:
                pass
        if fmt == "xlsx" and (name in targets or (name.startswith("xl/worksheets/sheet") and name.endswith(".xml"))):
            text = markup.grid_text(markup.grid(_payload(package, info)), strings, keep_blank)
            if text is not None:
                yield item(fmt, "grid", name, a=text)


def _modules(fmt: str, file: CompoundFile) -> Iterator[Item]:
    for i, name, stream, offset, source in macros.modules(file):
        yield item(fmt, "module", stream, i, n=offset, a=name, b=source.decode("utf-8", "replace"))


def _compound(data: bytes, keep_blank: bool) -> Iterator[Item]:
    file = CompoundFile(data)
    names = file.names()
    fmt = _compound_format(names)
    for i, name in enumerate(names):
        yield item(fmt, "part", name, i, a=name)
    if fmt == "doc":
        for i, _, _, fc, narrow, text in word.pieces(file):
            yield item(fmt, "piece", None, i, int(narrow), fc, text)
    elif fmt == "xls":
        if text := sheets.book(sheets.rows(file), keep_blank):
            yield item(fmt, "book", a=text)
    else:
        for i, (depth, kind, text) in enumerate(slides.atoms(file.stream("PowerPoint Document"))):
            kept = keep_blank and text is not None and is_blank(text) and not _MARKS.search(text)
            yield item(fmt, "atom" if text is not None else "encrypted", None, i, depth, kind, text, "kept" if kept else None)
    yield from _modules(fmt, file)
