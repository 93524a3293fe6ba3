"""Tables that cut lineage, in the folder every executor can reach.

The folder is the session's ``spark.checkpoint.dir``.  Where a session has none (tests, a laptop) a folder of the
driver's machine is used, and only with a local master: executors on other machines could not read it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_tables: list[str] = []
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder for this application's shared tables."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"{SETTING} must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="netloom-")
            atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        _own[app] = f"{root.rstrip('/')}/netloom-{app}"
        atexit.register(release, spark)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def laid_by(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows laid out as cut() lays them by these columns; windows, groups and hash joins on them keep the layout."""
    return df.repartition(_partitions(df.sparkSession), *by)


def cut(df: DataFrame, name: str, by: list[str] | None = None, laid: bool = False) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back.

    What follows reads the table, so a lost executor costs its tasks only, and a frame used several times is computed
    once.  The tables live until the :func:`scope` they were made in ends, or else until :func:`release` or the end of the
    session.  by: lay the rows out by these columns, in as
    many buckets as shuffles have partitions, so that joins on them don't move the rows again; laid: they lie so already
    (see laid_by).
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), None
    if by:
        table = f"netloom_{path.rsplit('-', 1)[1]}"
    for inner in getattr(_scopes, "open", [])[-1:]:
        inner.append((path, table))
    if by:
        n = _partitions(spark)
        (df if laid else laid_by(df, by)).write.option("compression", "zstd").option("path", path).bucketBy(n, *by).saveAsTable(table)
        _tables.append(table)
        return spark.table(table)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What cut() writes inside goes when the block ends; for work that repeats, such as the batches of a stream."""
    mine: list[tuple[str, str | None]] = []
    _scopes.open = [*getattr(_scopes, "open", []), mine]
    try:
        yield
    finally:
        _scopes.open.pop()
        for path, table in mine:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
                _tables.remove(table)
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete the shared tables of this application."""
    try:
        while _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
        path = _own.pop(spark.sparkContext.applicationId, None)
        if path:
            _delete(spark, path)
    except Exception:  # the session may be gone already
        pass
