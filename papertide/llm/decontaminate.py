"""Benchmark decontamination as a prefix-filtered set join, with native functions only.

Each run of `window` consecutive item words (the whole of a shorter item) is a set to be contained
in a document.  For full containment the necessary prefix is one element, the rarest; rarity
is the number of documents that hold a word, counted over all documents for the words that
items have.  A document's occurrences of such rarest words are its join tokens.  A match of token
and window fixes where the window would start (positional bound), which must lie inside the
document with its whole length (length bound); then the words there are compared one by one.

Windows go to all tasks in blocks of at most `block` of them, a pass over the documents for each
block, so what is broadcast has a bound however large the benchmark is.

Null or empty texts have no words.  Rows of one item id are one item; a null item id
counts as the id "".  Repeated documents give repeated rows.  Of words that are equally rare the first in the alphabet,
then in the window, is the anchor.  A very long text is one row, held by one task; only the words around its tokens
travel.  Empty tables give no rows, and no hits.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.llm.native_words import covered, positions, words_of
from papertide.llm.shared import own, written


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, items): the distinct windows and who has them."""
    listed = own(items, item=F.coalesce(F.col(id_col).cast("string"), F.lit("")), words=words_of(F.col(text_col))).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window))
    each = listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items"))


def document_frequency(documents: DataFrame, vocabulary: DataFrame, limit: int) -> DataFrame:
    """(word, df) of the vocabulary's words that documents (words) have."""
    held = vocabulary.limit(limit + 1).collect()
    if len(held) <= limit:
        known = [r.word for r in held]
        each = documents.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(known)))).alias("word"))
    else:
        each = documents.select(F.explode(F.array_distinct("words")).alias("word")).join(vocabulary, "word", "left_semi")
    return each.groupBy("word").agg(F.count("*").alias("df"))


def _hits(documents: DataFrame, windows: list, reach: int, counted: bool) -> DataFrame:
    """documents (key, n_words, words) -> a row (key, n_words, first, found) for each token, a row for documents without; found: the occurring windows.

    first marks one row of each document, if they are to be counted.
    """
    by_anchor: dict[str, list] = {}
    for w in windows:
        by_anchor.setdefault(w.anchor, []).append((w.q, w.words, w.items))
    side = documents.sparkSession.createDataFrame(list(by_anchor.items()), "anchor string, windows array<struct<q int, words array<string>, items array<string>>>")
    begin = lambda i: F.greatest(F.lit(0), i - (reach - 1))
    token: Column = F.transform("at", lambda i: F.struct(i.alias("pos"), F.get("words", i).alias("word"), begin(i).alias("base"), F.slice("words", begin(i) + 1, 2 * reach - 1).alias("near")))
    tokens = documents.withColumn("at", positions(F.col("words"), sorted(by_anchor))).withColumn("token", token).select("key", "n_words", F.posexplode_outer("token").alias("k", "t"))
    joined = tokens.join(F.broadcast(side), F.col("t.word") == F.col("anchor"), "left")

    def occurs(w: Column) -> Column:
        start, length = F.col("t.pos") - w.q, F.size(w.words)
        same = F.slice("t.near", F.greatest(F.lit(1), start - F.col("t.base") + 1), F.greatest(F.lit(0), length)) == w.words
        return (start >= 0) & (start + length <= F.col("n_words")) & same

    found = F.transform(F.filter("windows", occurs), lambda w: F.struct((F.col("t.pos") - w.q).alias("start"), F.size(w.words).alias("len"), w.items.alias("items")))
    first = F.coalesce(F.col("k"), F.lit(0)) == 0 if counted else F.lit(False)
    return joined.select("key", "n_words", first.alias("first"), found.alias("found")).withColumn("found", F.when(F.size("found") > 0, F.col("found")))


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, min_items: int = 2, block: int = 20_000) -> DataFrame:
    """Rows (id_col, n_words, n_hit, n_items, items_sha256, contaminated, text_md5, items, spans)."""
    docs = own(documents, doc_id=id_col, words=words_of(F.col(text_col)), text_md5=F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    docs = docs.select(F.struct("doc_id", "text_md5").alias("key"), F.size("words").alias("n_words"), "words")
    sets = written(item_windows(benchmark, item_col, item_text_col, window), "windows")
    df = document_frequency(docs, sets.select(F.explode("words").alias("word")).distinct(), block)
    each = sets.select("*", F.posexplode("words").alias("q", "word")).join(df, "word", "left")
    # A window with a word that no document has occurs nowhere.
    rarest = each.groupBy("words", "items").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "q")).alias("r")).where("r.df > 0")
    chosen = written(rarest.select(F.col("r.word").alias("anchor"), F.col("r.q").alias("q"), "words", "items"), "anchors")
    n_blocks = -(-chosen.count() // block) or 1
    parts = []
    for b in range(n_blocks):
        part = (chosen if n_blocks == 1 else chosen.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b)).collect()
        parts.append(_hits(docs, part, window, b == 0))
    # Rows of one id and text are one group, and as many rows again in the end.
    found = reduce(DataFrame.unionByName, parts).groupBy("key", "n_words").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), F.count_if("first").alias("times"))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    found = found.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))).withColumn("spans", F.transform("found", lambda x: F.struct(x.start.alias("start"), x.len.alias("len"))))
    return found.select(
        F.col("key.doc_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), F.col("key.text_md5").alias("text_md5"), "items", "spans",
    )


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns; the verdict depends on the text alone."""
    bad = contamination(documents, benchmark, text_col=text_col, **options).where("contaminated").select(F.col("text_md5").alias("__md5")).distinct()
    return documents.withColumn("__md5", F.md5(F.coalesce(F.col(text_col), F.lit("")))).join(bad, "__md5", "left_anti").drop("__md5")
