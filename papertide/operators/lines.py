"""Ordered string aggregation and keep-first distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(text: Column | str, *order: str) -> Column:
    """An aggregate: an array of the texts in the order of the given columns."""
    value = F.col(text) if isinstance(text, str) else text
    pairs = F.array_sort(F.collect_list(F.struct(*order, value.alias("__text"))))
    return F.transform(pairs, lambda p: p["__text"])


def joined(text: Column | str, separator: str, *order: str) -> Column:
    """An aggregate: the texts in the order of the given columns, joined."""
    return F.array_join(in_order(text, *order), separator)


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
