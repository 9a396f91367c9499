"""Cleaning of extracted text, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank, everywhere: a regular expression class.
BLANK = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_C1 = "".join(map(chr, range(0x80, 0xA0)))
# Windows-1252 for 80 to 9F, with its five unassigned bytes as C1 controls.
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def trim_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(c: Column) -> Column:
    return trim_blank(c) == ""


def trim_lines(c: Column) -> Column:
    """Without line feeds at either end."""
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def rtrim_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n+\z", "")


def latin1(c: Column) -> Column:
    return F.decode(c, "ISO-8859-1")


def cp1252(c: Column) -> Column:
    return F.translate(latin1(c), _C1, _CP1252)


def clean_slide(c: Column) -> Column:
    """Paragraph and line marks become line feeds; other controls go, but tabs."""
    return F.regexp_replace(F.translate(c, "\r\x0b", "\n\n"), r"[\x00-\x08\x0C\x0E-\x1F]", "")


def clean_aux(c: Column) -> Column:
    """As `clean_slide`, without line feeds at the ends."""
    return trim_lines(clean_slide(c))


def strip_fields(c: Column) -> Column:
    """Word fields: what stands between a begin mark and its separator goes.

    An end mark without a separator closes nothing, so the rest of the text goes with such a field.
    """
    tokens = F.split(c, r"(?<=[\x13\x14\x15])|(?=[\x13\x14\x15])")
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, t: Column) -> Column:
        depth = F.when(t == "\x13", a.depth + 1).when(t == "\x14", F.greatest(F.lit(0), a.depth - 1)).otherwise(a.depth)
        keep = ~t.isin("\x13", "\x14", "\x15") & (a.depth == 0)
        return F.struct(depth.alias("depth"), F.when(keep, F.array_append(a.kept, t)).otherwise(a.kept).alias("kept"))

    return F.when(c.rlike(r"[\x13\x14\x15]"), F.array_join(F.aggregate(tokens, zero, step, lambda a: a.kept), "")).otherwise(c)


def clean_document(c: Column) -> Column:
    """Word's control characters: paragraph, line and page marks, cell marks, hyphens; others go."""
    marked = F.translate(strip_fields(c), "\r\x0b\x0c\x07\x1e", "\n\n\n\t-")
    return F.regexp_replace(marked, r"[\x00-\x08\x0E-\x1F]", "")


_DOUBLED = "\uFFFE\uFDD0"  # stands for a doubled ampersand; text that holds it goes token by token


def strip_heading_codes(c: Column) -> Column:
    """Page headings without format codes; sections become blanks, doubled ampersands single."""
    marked = F.replace(c, F.lit("&&"), F.lit(_DOUBLED))
    bare = F.regexp_replace(marked, r'(?s)&"[^"]*(?:"|\z)|&[0-9]+|&K[0-9A-Fa-f]{0,6}|&[^LCR]|&\z', "")
    whole = F.replace(F.regexp_replace(bare, "&[LCR]", " "), F.lit(_DOUBLED), F.lit("&"))
    return F.when(~c.contains("&"), trim_blank(c)).when(c.contains(_DOUBLED), _strip_by_token(c)).otherwise(trim_blank(whole))


def _strip_by_token(c: Column) -> Column:
    tokens = F.regexp_extract_all(c, F.lit(r'(?s)(&&|&"[^"]*(?:"|\z)|&[0-9]+|&[LCR]|&K[0-9A-Fa-f]{0,6}|&.|&\z|[^&]+)'), F.lit(1))
    shown = F.transform(tokens, lambda t: F.when(t == "&&", "&").when(t.isin("&L", "&C", "&R"), " ").when(t.startswith("&"), "").otherwise(t))
    return trim_blank(F.array_join(shown, ""))


def normalize_source(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"\r\n?", "\n"), F.lit("\0"), F.lit(""))


def resolve_target(base: str, target: Column) -> Column:
    """A relationship's target: rooted ones lose one slash, others are taken from base with dots resolved."""
    steps = F.split(F.concat(F.lit(base + "/"), target), "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.array_append(a, s)),
    )
    return F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.array_join(walked, "/"))
