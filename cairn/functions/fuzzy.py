"""Fuzzy search: a query matches a text that has its characters in order; the tighter they stand, the better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_score(text: Column, wanted: str) -> Column:
    """16 for each character found, 8 more at a word's beginning, 4 more beside the one before, 1 less for each skipped one, 15 at most; null without a match, 0 for an empty query.

    A fold over the query's characters, in the JVM: its state is where the last one was found, from 1, and the score so far.
    """
    if not wanted:
        return F.lit(0)
    low = F.lower(text)

    def step(state: Column, c: Column) -> Column:
        at = F.call_function("locate", c, low, state["at"] + 1)
        first = (at == 1) | ~F.call_function("substring", low, at - 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
        beside = (at == state["at"] + 1) & (state["at"] > 0)
        points = F.lit(16) + F.when(first, 8).otherwise(0) + F.when(beside, 4).otherwise(0) - F.least(F.lit(15), at - state["at"] - 1)
        return F.when(at > 0, F.struct(at.alias("at"), (state["score"] + points).alias("score")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"))
    return F.aggregate(F.array(*map(F.lit, wanted.lower())), start, step)["score"]


def best_score(texts: Column, wanted: str) -> Column:
    """The best score of an item's search strings; null if none matches."""
    return F.array_max(F.transform(texts, lambda t: match_score(t, wanted)))


def search(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """Matching rows with their score; rows of no match don't stay."""
    return rows.withColumn("score", match_score(F.col(column), wanted)).where("score is not null")


def best(rows: DataFrame, column: str, wanted: str, tie: str) -> DataFrame:
    """The best match; without one, no row."""
    return search(rows, column, wanted).orderBy(F.desc("score"), tie).limit(1)
