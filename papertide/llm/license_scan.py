"""License scans by a positional rare-token index, with native functions only.

Templates are licence phrases.  Their words are weighted by inverse document frequency over all
scanned texts, and a template is indexed by its rarest words only, with their places in it
(postings).  A text's occurrences of indexed words vote for the place where the template
would start (own place minus place in the template); equal votes are intersected by sorting.
A start that gets at least `template.share` of the weight is a candidate, and the template's
mandatory key phrase must then stand there word for word.

Null or empty texts have no words, no labels and score 0.  Overlapping and repeated
places all count.  Repeated rows give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.decontaminate import document_frequency
from papertide.llm.native_words import positions, words_of
from papertide.llm.shared import own


@dataclass(frozen=True)
class Template:
    """key: the mandatory phrase, a part of text; share: the weight of aligned rare words a candidate needs."""

    label: str
    text: str
    key: str = ""
    share: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return (self.key or self.text).split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# The phrases and labels that a scan must know.
BASE = [
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
]
#: Further templates: versions of the above, and openings of well-known licence texts.
FURTHER = [
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc"),
    Template("mpl", "mozilla public license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", 0.6),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", 0.6),
    Template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify", 0.6),
    Template("unlicense-text", "this is free and unencumbered software released into the public domain", "free and unencumbered software", 0.6),
]


@dataclass(frozen=True)
class Posting:
    word: str
    at: tuple[int, ...]
    weight: float


def postings(template: Template, idf: dict[str, float], rare: int) -> list[Posting]:
    """The template's `rare` rarest words with their places; weights add up to 1."""
    words = template.words
    chosen = sorted(dict.fromkeys(words), key=lambda w: (-idf[w], words.index(w)))[:rare]
    total = sum(idf[w] * words.count(w) for w in chosen)
    return [Posting(w, tuple(i for i, x in enumerate(words) if x == w), idf[w] / total) for w in chosen]


def _votes(hits: Column, index: list[Posting]) -> Column:
    """Ascending structs (start, weight) of all occurrences of indexed words."""

    def of(word: str, at: int, weight: float) -> Column:
        return F.transform(F.filter(hits, lambda h: h.word == F.lit(word)), lambda h: F.struct((h.pos - at).alias("start"), F.lit(weight).alias("weight")))

    return F.array_sort(F.concat(*(of(p.word, at, p.weight) for p in index for at in p.at)))


def _tally(votes: Column, need: float) -> Column:
    """struct(starts, best): starts with votes of at least `need`, and the greatest sum of votes for one start."""
    none = F.array().cast("array<int>")
    zero = F.struct(none.alias("starts"), F.lit(0.0).alias("best"), F.lit(None).cast("int").alias("start"), F.lit(0.0).alias("sum"))

    def close(a: Column) -> Column:
        return F.when(a.sum >= need - 1e-9, F.array_append(a.starts, a.start)).otherwise(a.starts)

    def step(a: Column, v: Column) -> Column:
        same = a.start == v.start
        return F.when(same, F.struct(a.starts.alias("starts"), F.greatest(a.best, a.sum + v.weight).alias("best"), a.start.alias("start"), (a.sum + v.weight).alias("sum"))).otherwise(
            F.struct(close(a).alias("starts"), F.greatest(a.best, v.weight).alias("best"), v.start.alias("start"), v.weight.alias("sum"))
        )

    return F.aggregate(votes, zero, step, lambda a: F.struct(close(a).alias("starts"), a.best.alias("best")))


def _found(hits: Column, words: Column, template: Template, index: list[Posting]) -> Column:
    """struct(label, base, places, best) of one template."""
    tally = _tally(_votes(hits, index), template.share)
    key, at = template.key_words, template.key_at
    phrase = F.array(*map(F.lit, key))
    verified = lambda s: (s + at >= 0) & (F.slice(words, F.greatest(F.lit(1), s + at + 1), len(key)) == phrase)
    known = F.transform(F.array(tally), lambda t: F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), F.filter(t.starts, verified).alias("places"), t.best.alias("best")))
    return F.get(known, 0)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, rare: int = 4) -> DataFrame:
    """Rows (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, found)."""
    templates = BASE + FURTHER if templates is None else templates
    docs = own(df, doc_id=id_col, words=words_of(F.col(text_col)))
    known = sorted({w for t in templates for w in t.words})
    vocabulary = df.sparkSession.createDataFrame([(w,) for w in known], "word string")
    df_of = {r.word: r.df for r in document_frequency(docs, vocabulary, len(known)).collect()}  # a row for each template word at most
    n = df.count()
    idf = {w: 1 + math.log((n + 1) / (df_of.get(w, 0) + 1)) for w in known}
    indexes = [postings(t, idf, rare) for t in templates]
    indexed = sorted({p.word for index in indexes for p in index})
    hits = F.transform("at", lambda i: F.struct(i.alias("pos"), F.get("words", i).alias("word")))
    found = F.array(*(_found(F.col("hits"), F.col("words"), t, index) for t, index in zip(templates, indexes, strict=True)))
    rows = docs.withColumn("at", positions(F.col("words"), indexed)).withColumn("hits", hits).withColumn("found", F.when(F.size("hits") > 0, found))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce("found", F.filter(found, lambda _: F.lit(False))).alias("found"))
    matched = F.filter("found", lambda x: F.size(x.places) > 0)
    base = F.flatten(F.transform(F.filter("found", lambda x: x.base), lambda x: x.places))
    label = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y.label))), ",")
    score = F.coalesce(F.array_max(F.transform("found", lambda x: F.when(F.size(x.places) > 0, 1.0).otherwise(F.least(F.lit(0.99), x.best)))), F.lit(0.0))
    return rows.select(
        F.col("doc_id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        label(F.filter(matched, lambda x: x.base)).alias("base_labels"), label(matched).alias("labels"), F.round(score, 6).alias("score"), "found",
    )
