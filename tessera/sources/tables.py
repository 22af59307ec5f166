"""Reading of fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of parts) of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """table(), for texts, of which one row group may take hundreds of MB. Parquet's vectored reads take a column of a row
    group as one array, and on files of the machine as one direct buffer besides, which its thread keeps for a minute; the
    plain reads take it in pieces of 8 MB and need no such buffer."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{folder}/{name}.parquet")


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """df with exactly the named columns, in this order; those that df lacks are null, others are left out."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()
    ])
