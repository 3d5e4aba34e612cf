"""Substring join on character grams: an equi-join, never a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAM = 3


def _grams(text: Column, widths: Column) -> Column:
    """Distinct substrings of those lengths up to ``_GRAM`` that the array ``widths`` holds."""
    def of_width(width: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)))
        grams = F.transform(at, lambda i: F.substring(text, i, F.lit(width)))
        return F.when(F.array_contains(widths, width), grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of_width(w) for w in range(1, _GRAM + 1)])))


def contains_join(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """Pairs of rows where ``text`` contains the non-empty ``needle``; each pair of rows once.

    A needle is looked up by its first three characters (all of them if it is shorter), then checked. The
    planner broadcasts the needles while they are small, so texts are not shuffled; beyond that the join
    shuffles on the gram and adaptive execution splits frequent grams. Which of the three lengths occur is a subquery of the
    same job, so nothing runs while the plan is built.
    """
    keyed = needles.where(F.col(needle) != "").withColumn("_gram", F.substring(needle, 1, _GRAM))
    widths = keyed.agg(F.array_sort(F.collect_set(F.length("_gram"))).alias("_widths")).scalar()  # at most three values
    spread = texts.withColumn("_gram", F.explode(_grams(F.col(text), widths)))
    return spread.join(keyed, "_gram").where(F.contains(F.col(text), F.col(needle))).drop("_gram")
