"""PowerPoint 97 and later: text atoms of the record tree, in stream order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from papertide.decode.chars import latin1, utf16

WIDE, NARROW, ENCRYPTED, MOST_DEPTH = 0x0FA0, 0x0FA8, 0x2F14, 32


def atoms(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(depth, record type, text) of text atoms and of the encryption mark (its text is None)."""
    view = memoryview(data)
    todo = [(view, 0, 0)]
    while todo:
        body, at, depth = todo.pop()
        while at + 8 <= len(body):
            head, kind, size = struct.unpack_from("<HHI", body, at)
            inner = body[at + 8 : at + 8 + size]  # a length beyond the end means the rest
            at += 8 + len(inner)
            if head & 0xF == 0xF:
                if depth < MOST_DEPTH:
                    todo += [(body, at, depth), (inner, 0, depth + 1)]
                    break
            elif kind == WIDE:
                yield depth, kind, utf16(bytes(inner))
            elif kind == NARROW:
                yield depth, kind, latin1(bytes(inner))
            elif kind == ENCRYPTED:
                yield depth, kind, None
