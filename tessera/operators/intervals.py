"""Joins of places with ranges of lines, by blocks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block. A range stands in each block that it touches, so a place meets only the ranges of its block, and a file
#: with very many lines, ranges and places is spread over its blocks.
BLOCK = 64


def _blocked(spans: DataFrame) -> DataFrame:
    whole = spans.where("start_line IS NOT NULL AND end_line >= start_line")
    first, last = F.floor(F.col("start_line") / BLOCK).cast("int"), F.floor(F.col("end_line") / BLOCK).cast("int")
    return whole.withColumn("block", F.explode(F.sequence(first, last)))


def holding(places: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each place (key, line, ...) with each span (key, start_line, end_line, ...) of its key that holds the line. Columns
    other than the key must have different names. Null keys and lines are in no span; spans without lines hold nothing."""
    at = places.withColumn("block", F.floor(F.col("line") / BLOCK).cast("int"))
    return at.join(_blocked(spans), [key, "block"]).where("line BETWEEN start_line AND end_line").drop("block")


def innermost(places: DataFrame, spans: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, line, span) of the distinct places (key, line) that spans (key, start_line, end_line, span) hold: of several
    spans the least by order and then by name. By default the one that starts last, of these the one that ends first."""
    by = order or (-F.col("start_line"), F.col("end_line"))
    best = F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(by)], F.col("span").alias("span")))
    found = holding(places.select(key, "line").distinct(), spans.select(key, "start_line", "end_line", "span"), key)
    return found.groupBy(key, "line").agg(best.alias("best")).select(key, "line", "best.span")


def overlapping(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each pair of a range a (key, start_line, end_line, ...) and a range b (key, from_line, to_line, ...) of one key that
    share a line. A pair meets in all blocks that both touch and counts in the first of them alone."""
    other = b.withColumnRenamed("from_line", "start_line").withColumnRenamed("to_line", "end_line")
    other = _blocked(other).withColumnRenamed("start_line", "from_line").withColumnRenamed("end_line", "to_line")
    j = _blocked(a).join(other, [key, "block"]).where("from_line <= end_line AND start_line <= to_line")
    return j.where(F.col("block") == F.floor(F.greatest("start_line", "from_line") / BLOCK).cast("int")).drop("block")
