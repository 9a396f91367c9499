"""Character sets of the legacy formats, and number rendering."""

from __future__ import annotations

import math
import re

# Windows-1252 for the bytes 80 to 9F; its five unassigned bytes stay C1 controls.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_TO_1252 = dict(zip(range(0x80, 0xA0), _CP1252, strict=True))

#: What counts as blank, as in `functions.text`.
BLANK = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CONTROLS = {c: None for c in range(32) if c != 9} | {10: "\n", 11: "\n", 13: "\n"}
_HEADING = re.compile(r'&&|&"[^"]*(?:"|\Z)|&[0-9]+|&[LCR]|&K[0-9A-Fa-f]{0,6}|&.|&\Z|[^&]+', re.S)


def latin1(data: bytes) -> str:
    return data.decode("latin-1")


def cp1252(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_1252)


def utf16(data: bytes) -> str:
    """Lone surrogates become U+FFFD; an odd last byte is left out."""
    return data[: len(data) // 2 * 2].decode("utf-16-le", "replace")


def is_blank(text: str) -> bool:
    return not text.strip(BLANK)


def clean_aux(text: str) -> str:
    """As the function of that name in `functions.text`."""
    return text.translate(_CONTROLS).strip("\n")


def strip_heading_codes(text: str) -> str:
    """As the function of that name in `functions.text`."""
    shown = ("&" if t == "&&" else " " if t in ("&L", "&C", "&R") else "" if t[0] == "&" else t for t in _HEADING.findall(text))
    return "".join(shown).strip(BLANK)


def format_number(v: float) -> str:
    """Shortest digits that read back as v; exponents below -4 or from 6 on are written out."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    sign = "-" if math.copysign(1, v) < 0 else ""
    if v == 0:
        return sign + "0"
    mantissa, _, exponent = f"{abs(v)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    exp = int(exponent or 0) + (len(whole) - 1 if whole != "0" else -(len(part) - len(part.lstrip("0"))) - 1)
    digits = digits.rstrip("0") or "0"
    if exp < -4 or exp >= 6:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exp < 0 else '+'}{abs(exp):02d}"
    if exp < 0:
        return f"{sign}0.{'0' * (-exp - 1)}{digits}"
    whole, part = digits[: exp + 1].ljust(exp + 1, "0"), digits[exp + 1 :]
    return sign + whole + ("." + part if part else "")


def rk_number(v: int) -> float:
    """A 32-bit RK number: a 30-bit integer or the top of a double, perhaps in hundredths."""
    import struct

    if v & 2:
        f = float((v - (1 << 32) if v >> 31 else v) >> 2)
    else:
        f = struct.unpack("<d", ((v & 0xFFFFFFFC) << 32).to_bytes(8, "little"))[0]
    return f / 100 if v & 1 else f
