"""Span reconciliation over rows of spans, as joins and windows.

The array form in ``sparkveil.functions.spans`` is what the engine runs; these
work on exploded spans, for spans that come from tables and for cross-checks.
Overlap is strict: touching spans don't meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """``spans`` with island: equal for spans of a group that overlap in a chain."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_same_label(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """One span per island of a label: its bounds and largest confidence."""
    keys = [*by, "label"]
    return islands(spans, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence")).drop("island")


def cluster_winners(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """``spans`` with the winner of their overlap cluster: the strongest span's label, which stamps every member."""
    w = Window.partitionBy(*by, "island").orderBy(F.col("confidence").desc(), (F.col("end") - F.col("start")).desc(), "start", "label")
    return islands(spans, by).withColumns({"winner": F.first("label").over(w), "wins": F.row_number().over(w) == 1})


def outside(spans: DataFrame, excluded: DataFrame, by: str) -> DataFrame:
    """``spans`` that overlap no excluded range of the same document."""
    e = excluded.select(F.col(by).alias("_doc"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col(by) == F.col("_doc")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return spans.join(e, hit, "left_anti")


def coreference(spans: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """``spans`` with coref: equal for equal labels and values (in any case) of a document."""
    w = Window.partitionBy(*by).orderBy("label", F.lower(value))
    return spans.withColumn("coref", F.dense_rank().over(w))
