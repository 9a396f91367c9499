"""Writers of OPC packages."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from papertide.fixtures.compound import compound_bytes
from papertide.fixtures.legacy import vba_streams

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zip_bytes(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def paragraphs(text: str, tag: str = "w") -> str:
    """A paragraph for each line."""
    return "".join(f"<{tag}:p><{tag}:r><{tag}:t>{escape(line)}</{tag}:t></{tag}:r></{tag}:p>" for line in text.split("\n"))


def word_part(text: str) -> str:
    return f"<w:document {W}><w:body>{paragraphs(text)}</w:body></w:document>"


def drawing_part(text: str) -> str:
    return f"<p:sld {A}>{paragraphs(text, 'a')}</p:sld>"


def rels(targets: dict[str, str]) -> str:
    return "<Relationships>" + "".join(f"<Relationship Id={quoteattr(i)} Target={quoteattr(t)}/>" for i, t in targets.items()) + "</Relationships>"


def core(fields: dict[str, str]) -> str:
    return "<cp:coreProperties>" + "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in fields.items()) + "</cp:coreProperties>"


def macro_part(modules: list[tuple[str, str]]) -> bytes:
    return compound_bytes(vba_streams(modules))


def docx_bytes(text: str, more: dict[str, str | bytes] | None = None) -> bytes:
    return zip_bytes({"word/document.xml": word_part(text)} | (more or {}))


def pptx_bytes(slides: list[str], order: list[int] | None = None, more: dict[str, str | bytes] | None = None) -> bytes:
    """order: which slide stands where; None leaves out the relationships."""
    parts: dict[str, str | bytes] = {f"ppt/slides/slide{i + 1}.xml": drawing_part(t) for i, t in enumerate(slides)}
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 1}"/>' for i in order or [])
    parts["ppt/presentation.xml"] = f"<p:presentation {R}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    if order is not None:
        parts["ppt/_rels/presentation.xml.rels"] = rels({f"rId{i + 1}": f"slides/slide{i + 1}.xml" for i in range(len(slides))})
    return zip_bytes(parts | (more or {}))


def cell(value: str, kind: str = "inlineStr") -> str:
    if kind == "inlineStr":
        return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c t="{kind}"><v>{escape(value)}</v></c>' if kind else f"<c><v>{escape(value)}</v></c>"


def sheet_part(rows: list[list[str]], headings: str = "") -> str:
    """rows: cells that are markup already."""
    return "<worksheet><sheetData>" + "".join(f"<row>{''.join(r)}</row>" for r in rows) + f"</sheetData>{headings}</worksheet>"


def xlsx_bytes(sheets: list[tuple[str, str]], strings: list[str] | None = None, order: list[int] | None = None, linked: bool = True, more: dict[str, str | bytes] | None = None) -> bytes:
    """sheets: (name, part); order: which sheet stands where in the workbook."""
    order = list(range(len(sheets))) if order is None else order
    tags = "".join(f'<sheet name={quoteattr(sheets[i][0])} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i in order)
    parts: dict[str, str | bytes] = {f"xl/worksheets/sheet{i + 1}.xml": p for i, (_, p) in enumerate(sheets)}
    parts["xl/workbook.xml"] = f"<workbook {R}><sheets>{tags}</sheets></workbook>"
    if linked:
        parts["xl/_rels/workbook.xml.rels"] = rels({f"rId{i + 1}": f"worksheets/sheet{i + 1}.xml" for i in range(len(sheets))})
    if strings is not None:
        parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{escape(s)}</t><rPh><t>reading</t></rPh></si>" for s in strings) + "</sst>"
    return zip_bytes(parts | (more or {}))
