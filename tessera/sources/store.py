"""A versioned store of fact tables: each version is a folder of Parquet tables that ends with a mark of completeness; the
latest complete one is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the latest complete version, None before the first. An answer asks once and reads only from there,
    so it sees one consistent state; there is no moment without a version, as nothing is replaced."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("v-")), reverse=True)
    return next((f"{root}/{n}" for n in names if fs.exists(_fs(spark, f"{root}/{n}/COMPLETE")[1])), None)


def read_version(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_version(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes a new version beside the others and then marks it complete, which makes it current. A crash before that
    changes nothing. Two writers of one number meet at the folder, which only one of them can make."""
    fs, p = _fs(spark, root)
    fs.mkdirs(p)
    numbers = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")]
    folder = f"v-{max(numbers, default=0) + 1:06d}"
    claim = fs.create(_fs(spark, f"{root}/{folder}/CLAIM")[1], False)  # fails where another writer was first
    claim.close()
    for n, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{n}")
    fs.create(_fs(spark, f"{root}/{folder}/COMPLETE")[1], False).close()
    return f"{root}/{folder}"


def compact(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all versions but the latest complete ones; says how many. Incomplete ones older than these go too."""
    fs, p = _fs(spark, root)
    names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-")), reverse=True)
    whole = [n for n in names if fs.exists(_fs(spark, f"{root}/{n}/COMPLETE")[1])][:keep]
    gone = [n for n in names if whole and n < whole[-1]]
    for n in gone:
        fs.delete(_fs(spark, f"{root}/{n}")[1], True)
    return len(gone)


def readable(spark: SparkSession, folder: str, names: list[str]) -> bool:
    """Whether all tables of a version can be opened and their data pages read."""
    try:
        for n in names:
            spark.read.option("ignoreCorruptFiles", "false").parquet(f"{folder}/{n}").write.format("noop").mode("overwrite").save()
        return True
    except Exception:
        return False


def rebuild_if_outdated(spark: SparkSession, root: str, version: str, build) -> bool:
    """Rebuilds by build() -> tables unless the metadata table says this version already; says whether it did."""
    now = current_version(spark, root)
    if now and readable(spark, now, ["metadata"]) and spark.read.parquet(f"{now}/metadata").where((F.col("key") == "version") & (F.col("value") == version)).head(1):
        return False
    tables = dict(build())
    tables["metadata"] = set_key(tables["metadata"], "version", version) if "metadata" in tables else spark.createDataFrame([("version", version)], "key string, value string")
    write_version(spark, root, tables)
    return True


def set_key(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """A key-value table with one key set."""
    one = metadata.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return metadata.where(~F.col("key").eqNullSafe(key)).unionByName(one)


def upsert(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """table with all rows of changed keys replaced by the rows of changed."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed, allowMissingColumns=True)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """table without the rows of some keys."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that comes last in an append-only table; how later facts (such as whether advice was followed)
    replace earlier ones."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
