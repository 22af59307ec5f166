"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables written by cut(); removed when their scratch() ends, else when the driver's Python does.
_written: list[tuple[SparkSession, str]] = []
#: Folders of local applications that name none.
_temporary: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the settings that the operators are tuned for. Any setting can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or the context's checkpoint folder. Where
    neither is set, as in tests, a temporary one is made, on a local master only; on a cluster that is an error. The
    session's settings stay as they are."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _temporary:
        _temporary[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        _written.append((spark, _temporary[app]))
    return _temporary[app]


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, where it has fewer: a small file is one split, but what Python
    does with it may take long. Larger inputs stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    run = df._jdf.queryExecution()
    if "Exchange" in run.executedPlan().toString():  # to count its partitions would run its stages
        return df
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """df, computed once and written to the shared folder as Parquet, then read from there. Ends the lineage, so an
    executor that is lost later costs only a read. Parquet is smaller than the row files of checkpoint(). rows: the most in
    a row group; readers hold up to 4,096 rows of a group at once, with all their array items, so large rows need a bound."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", rows) if rows else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that cut() writes inside are removed at the end; for long sessions that have read or written their results by
    then. Tables that once() keeps are removed too, and made anew when they are asked for."""
    before = len(_written)
    try:
        yield
    finally:
        mine = _written[before:]
        del _written[before:]
        gone = {path for _, path in mine}
        for key in [k for k, (_, path) in _made.items() if path in gone]:
            del _made[key]
        _remove(mine)


#: Derived tables by application, folder and name, with the state of the folder's files that they were made from.
_made: dict[tuple, tuple[DataFrame, str]] = {}


def stamp(spark: SparkSession, folder: str, names: tuple[str, ...]) -> tuple:
    """The files of some tables of a folder with their sizes and times; another stamp means other data."""
    hadoop = spark._jsc.hadoopConfiguration()
    out = []
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        fs = p.getFileSystem(hadoop)
        if fs.exists(p):
            out += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
    return tuple(out)


def once(spark: SparkSession, folder: str, name: str, sources: tuple[str, ...], build: Callable[[], DataFrame], spread: bool = True) -> DataFrame:
    """build(), written once for this application and this state of the source tables, like an index: later calls read it.
    What comes from small tables is written in as many files as the session has cores, as it would else be one split;
    without spread it is written as it comes and not shuffled for that."""
    key = (spark.sparkContext.applicationId, folder, name, stamp(spark, folder, sources))
    if key in _made:  # the shared folder may have been cleared meanwhile
        p = spark._jvm.org.apache.hadoop.fs.Path(_made[key][1])
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            del _made[key]
    if key not in _made:
        cores = spark.sparkContext.defaultParallelism
        small = spread and sum(size for _, size, _ in key[3]) < cores * (128 << 20)
        df = cut(build().repartition(cores) if small else build(), name)
        _made[key] = df, _written[-1][1]
    return _made[key][0]


#: Applications whose Python workers know this package already.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of all executors, whatever folder and path the driver was
    started with: the package is zipped once and added to the session. Code started with --py-files needs no call."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/tessera.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    _written.append((spark, path.rsplit("/", 1)[0]))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return


atexit.register(lambda: _remove(_written))
