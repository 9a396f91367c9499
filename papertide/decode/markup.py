"""XML parts of OPC packages as streams of events, and what each kind of part yields.

`read` gives a part's events to a taker: expat's as long as the part is well formed.  If it is not, the taker starts again
with the events of `tolerant`, which follows the rules of a non-strict reader: unknown entities and bare ampersands stay as
text, attributes may lack quotes or a value, and an end tag closes all elements up to the one it names.  An end tag that names
no open element, a cut tag, or an entity declaration ends the part; what was read until then stays.

Elements go by local name, prefixes are cut off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby
from xml.parsers import expat

from papertide.decode.chars import BLANK, strip_heading_codes

# Core properties that people write, page heading elements, and elements that stand for white space.
PROPERTIES = ("title", "subject", "creator", "keywords", "description", "lastModifiedBy", "category", "contentStatus")
HEADINGS = ("oddHeader", "oddFooter", "evenHeader", "evenFooter", "firstHeader", "firstFooter")
SPACES = {"tab": "\t", "br": "\n", "cr": "\n"}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

OPEN, CLOSE, TEXT = range(3)
Event = tuple[int, str, dict[str, str]]

_BLOCK = 1 << 18
_MARK = re.compile(
    r"<!\[CDATA\[(?P<raw>.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<!(?P<declared>[^<>\[]*(?:\[.*?\])?[^<>\[]*)>|</\s*(?P<shut>[^\s<>/]+)\s*>"
    r"""|<(?P<begun>[^\s<>/!?="']+)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*?)(?P<whole>/?)>|(?P<words>[^<]+)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'/>]*)))?""")
_INDEX = re.compile("[+-]?[0-9]{1,18}")
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]{1,6})|#([0-9]{1,7})|([a-z]+));")


class Malformed(ValueError):
    pass


class _Declared(Exception):
    pass


def _local(name: str) -> str:
    return name.rpartition(":")[2] if ":" in name else name


def strict(payload: bytes) -> Iterator[Event]:
    """Events of a well-formed part, a block at a time."""
    held: list[Event] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    add, closes = held.append, {}

    def close(name: str) -> None:
        event = closes.get(name)
        if event is None:
            event = closes[name] = (CLOSE, _local(name), {})
        add(event)

    parser.StartElementHandler = lambda name, attributes: add((OPEN, _local(name), attributes))
    parser.EndElementHandler = close
    parser.CharacterDataHandler = lambda data: add((TEXT, data, {}))

    def declared(*_) -> None:
        raise _Declared

    parser.EntityDeclHandler = declared
    for at in range(0, len(payload) + 1, _BLOCK):
        block, ended = payload[at : at + _BLOCK], False
        try:
            parser.Parse(block, at + _BLOCK > len(payload))
        except expat.ExpatError as e:
            raise Malformed(str(e)) from None
        except (_Declared, LookupError):
            ended = True
        yield from held
        held.clear()
        if ended:
            return


def _resolved(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return ENTITIES.get(m[3], m[0])
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def tolerant(payload: bytes) -> Iterator[Event]:
    """Events of a part that is not well formed, up to what cannot be read."""
    try:
        text = payload.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        text = payload[: e.start].decode("utf-8-sig")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    path: list[str] = []
    at = 0
    while m := _MARK.match(text, at):
        at = m.end()
        found = m.lastgroup
        if found == "words":
            yield TEXT, _resolved(m["words"]), {}
        elif found == "raw":
            yield TEXT, m["raw"], {}
        elif found == "whole":
            name, attributes = _local(m["begun"]), {}
            if m["attributes"]:
                pairs = ((a[1], next((v for v in a.groups()[1:] if v is not None), _local(a[1]))) for a in _ATTRIBUTE.finditer(m["attributes"]))
                attributes = {k: _resolved(value) for k, value in pairs}
            yield OPEN, name, attributes
            path.append(name)
            if m["whole"]:
                yield CLOSE, path.pop(), {}
        elif found == "shut":
            wanted, closed = _local(m["shut"]), None
            while path and closed != wanted:
                closed = path.pop()
                yield CLOSE, closed, {}
            if closed != wanted:
                return
        elif found == "declared" and "<!ENTITY" in m["declared"]:
            return


def read[T](payload: bytes, take: Callable[[Iterator[Event]], T]) -> T:
    try:
        return take(strict(payload))
    except Malformed:
        return take(tolerant(payload))


def _placed(events: Iterator[Event]) -> Iterator[tuple[int, str, dict[str, str], Counter]]:
    """Each event with the number of open elements of each name: an element counts from its start to its end, both included."""
    inside: Counter[str] = Counter()
    for kind, name, attributes in events:
        if kind == OPEN:
            inside[name] += 1
        yield kind, name, attributes, inside
        if kind == CLOSE:
            inside[name] -= 1


def _any(inside: Counter, names: tuple[str, ...]) -> bool:
    return any(inside[name] for name in names)


class _End(str):
    """The line feed of the end of a paragraph."""


_END = _End("\n")


def running_text(payload: bytes, *more: str, keep_blank: bool = False) -> str | None:
    """Text of `t` and further elements; white space elements count anywhere, the ends of paragraphs outside of text; fallbacks do not.

    Without line feeds at the ends; with keep_blank only the end of the last paragraph goes, and None stands for a part without text and paragraphs.
    """
    holders = ("t", *more)

    def pieces(events: Iterator[Event]) -> Iterator[str]:
        holding = skipped = 0
        for kind, name, _ in events:
            if kind == TEXT:
                if holding and not skipped:
                    yield name
            elif name in holders:
                holding += 1 if kind == OPEN else -1
                if keep_blank and not skipped:
                    yield ""
            elif name == "Fallback":
                skipped += 1 if kind == OPEN else -1
            elif skipped:
                continue
            elif kind == OPEN:
                if name in SPACES:
                    yield SPACES[name]
            elif name == "p" and not holding:
                yield _END

    if not keep_blank:
        return read(payload, lambda events: "".join(pieces(events))).strip("\n")
    parts = read(payload, lambda events: list(pieces(events)))
    return "".join(parts[:-1] if isinstance(parts[-1], _End) else parts) if parts else None


def _starts(payload: bytes, wanted: str) -> list[dict[str, str]]:
    return read(payload, lambda events: [attributes for kind, name, attributes in events if kind == OPEN and name == wanted])


def _attribute(attributes: dict[str, str], name: str) -> str:
    """Of equal local names the last."""
    return {_local(k): v for k, v in attributes.items()}.get(name, "")


def _rel_id(attributes: dict[str, str]) -> str:
    """The id that has a prefix; a bare one is another attribute."""
    return next((v for k, v in attributes.items() if ":" in k and _local(k) == "id"), "")


def relationships(payload: bytes) -> list[tuple[str, str]]:
    pairs = [(_attribute(a, "Id"), _attribute(a, "Target")) for a in _starts(payload, "Relationship")]
    return [p for p in pairs if all(p)]


def slide_ids(payload: bytes) -> list[str]:
    return [_rel_id(a) for a in _starts(payload, "sldId")]


def sheet_ids(payload: bytes) -> list[tuple[str, str]]:
    return [(_attribute(a, "name"), _rel_id(a)) for a in _starts(payload, "sheet")]


def _texts_of(events: Iterator[Event], element: str, holder: str, but: str) -> Iterator[str]:
    """For each closed element the joined text of its holders."""
    held: list[str] = []
    for kind, name, _, inside in _placed(events):
        if kind == TEXT and inside[element] and inside[holder] and not inside[but]:
            held.append(name)
        elif kind != TEXT and name == element:
            if kind == CLOSE:
                yield "".join(held)
            held = []


def shared_strings(payload: bytes) -> list[str]:
    """Phonetic runs are left out."""
    return read(payload, lambda events: list(_texts_of(events, "si", "t", "rPh")))


_HOLD = frozenset(("v", "t", *HEADINGS))


class Grid:
    """cells: (row, cell, type, raw text) of closed rows; headings: raw texts.

    Every closed row, cell and heading is a scope that takes up what stands in it: text goes to the heading or the cell, cells to the row.
    """

    def __init__(self, events: Iterator[Event]):
        self.cells: list[tuple[int, int, str, str]] = []
        self.headings: list[str] = []
        row: list[tuple[str, str]] = []
        kind_of_cell, words, n_rows, holding = "", [], 0, 0
        for kind, name, attributes in events:
            if kind == TEXT:
                if holding:
                    words.append(name)
                continue
            if name in _HOLD:
                holding += 1 if kind == OPEN else -1
            if name == "c":
                if kind == OPEN:
                    kind_of_cell = _attribute(attributes, "t") if attributes else ""
                else:
                    row.append((kind_of_cell, "".join(words)))
                words = []
            elif name == "row":
                if kind == CLOSE:
                    self.cells += [(n_rows, k, *c) for k, c in enumerate(row)]
                    n_rows += 1
                row = []
            elif name in HEADINGS:
                if kind == CLOSE:
                    self.headings.append("".join(words))
                words = []


def grid(payload: bytes) -> Grid:
    return read(payload, Grid)


def grid_text(found: Grid, strings: list[str], keep_blank: bool = False) -> str | None:
    """Lines of tab-separated cells, shared strings looked up, then the distinct page headings; None if there are none.

    Empty cells and lines are left out; with keep_blank the lines of rows that have empty cells only stay.
    """
    lines = []
    for _, cells in groupby(found.cells, key=lambda c: c[0]):
        line = "\t".join(filter(None, (_shared(raw, strings) if kind == "s" else raw for _, _, kind, raw in cells)))
        if line or keep_blank:
            lines.append(line)
    lines += dict.fromkeys(filter(None, map(strip_heading_codes, found.headings)))
    text = "\n".join(lines)
    return (text if lines else None) if keep_blank else text.rstrip("\n") or None


def _shared(index: str, strings: list[str]) -> str:
    index = index.strip(BLANK)
    at = int(index) if _INDEX.fullmatch(index) else -1
    return strings[at] if 0 <= at < len(strings) else ""


def properties(payload: bytes) -> list[str]:
    """Each run of text in a property."""
    found = lambda events: [name.strip(BLANK) for kind, name, _, inside in _placed(events) if kind == TEXT and _any(inside, PROPERTIES)]
    return [text for text in read(payload, found) if text]
