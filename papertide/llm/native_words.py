"""Lower-cased words as native columns: A-Z become a-z, and words are runs of digits, a-z and everything beyond ASCII."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """lower() would also change letters beyond ASCII."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Null has no words."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def positions(words: Column, wanted: list[str]) -> Column:
    """Where, from 0, the wanted words stand."""
    return F.filter(F.transform(words, lambda w, i: F.when(w.isin(wanted), i)), lambda i: i.isNotNull())


def covered(spans: Column) -> Column:
    """How many places are covered by an array of structs (start, len)."""
    step = lambda a, x: F.struct(F.greatest(a.end, x.start + x.len).alias("end"), (a.n + F.greatest(F.lit(0), x.start + x.len - F.greatest(a.end, x.start))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a.n.cast("long"))
