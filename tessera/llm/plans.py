"""Queries of the corpus operators; those that SQL cannot express are tested against brute force and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import docpairs, encode, handwritten, mixture, quantiles, spam
from tessera.llm.sql import SQL
from tessera.session import cut
from tessera.sources.tables import table, texts_table


def _documented(spark: SparkSession, folder: str, with_code: bool = True) -> DataFrame:
    return docpairs.documented_functions(table(spark, folder, "symbols"), table(spark, folder, "source_texts"), with_code)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _documented(spark, folder, with_code=False).select("symbol_id")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of code and description."""
    return _documented(spark, folder).where("code IS NOT NULL").select("symbol_id", "language", "name", "kind", "code", "description")


def p3_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """By language: described functions, those whose comment the lexer found, and those of them whose comment has the
    letters of the given documentation."""
    d = _documented(spark, folder, with_code=False)
    return d.groupBy("language").agg(F.count("*").alias("described"), F.count("agrees").alias("lexed"), F.count_if("agrees").alias("agreeing"))


def p4_files(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.judged_files(table(spark, folder, "files"), table(spark, folder, "source_texts"), table(spark, folder, "skipped_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_files(spark, folder).where("not_by_hand").select("path")


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.duration_percentiles(quantiles.daily_sketches(table(spark, folder, "tool_telemetry")))


def p6_daily_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.daily_sketches(table(spark, folder, "tool_telemetry")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each text comes back from its ids."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = encode.decode(encode.encode(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id", "left").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixture(texts_table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1].where("NOT reachable").select("source")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[1]


def p9_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What each source has and is to give, before anything is drawn."""
    sizes = cut(mixture.sized(texts_table(spark, folder, "documents")), "sizes")
    return mixture.plan(sizes, table(spark, folder, "mix_targets")).drop("rate")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0].where("copies > 0")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_scores(table(spark, folder, "documents"))


def p10_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The host of each page that links to any."""
    return spam.spam_scores(table(spark, folder, "documents")).where("host IS NOT NULL").select("doc_id", "host")


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p3_agreement, p4_found, p4_files, p6_percentiles, p6_daily_sketch, p8_ids, p8_round_trip, p9_found, p9_plan, p9_report, p9_mixture, p10_found, p10_hosts, p10_scores)}

__all__ = ["QUERIES", "SQL"]
