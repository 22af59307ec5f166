"""Files of a folder tree as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scan import excluded, is_binary

#: Files of more bytes are listed but not read as text.
MAX_TEXT = 2 * 1024 * 1024


def read_tree(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """(path relative to root, bytes, mtime, content_hash, content) of all files that no exclusion rule names; content is
    null for binary files and for texts over MAX_TEXT bytes."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace("file://", "") + "/", "")
    files = raw.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"),
                       F.when(F.col("length") <= MAX_TEXT, F.try_validate_utf8(F.col("content").cast("string"))).alias("text"))
    files = files.where(~excluded(F.col("path")))
    if not hidden:
        files = files.where(~F.col("path").rlike(r"(^|/)\."))
    return files.select("path", "bytes", "mtime", "content_hash", F.when(~is_binary(F.col("text")), F.col("text")).alias("content"))
