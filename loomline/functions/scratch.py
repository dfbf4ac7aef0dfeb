"""Folders for what a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: What stored() and bucketed() made in each passing() that is open: folder, frame and table.
_open: list[list[tuple[str, DataFrame, str | None]]] = []
#: Spark's setting to delete a job's shuffle files when it ends; without it they stay until the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: the warehouse; in local mode a temporary folder, removed when Python ends.

    A warehouse on a file: path is each machine's own on a cluster, so it is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        warehouse = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        scheme = warehouse.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset and the warehouse lies on a file: path, which the machines of a cluster do not share; set spark.checkpoint.dir to a shared folder")
        return warehouse.toString().rstrip("/")
    if "dir" not in _own:
        path = tempfile.mkdtemp(prefix="spark-loomline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own["dir"] = "file://" + path
    return _own["dir"]


def session_dir(spark: SparkSession) -> str:
    """One folder for all that this application writes on its way; clear() removes it."""
    return f"{shared_dir(spark)}/loomline-{spark.conf.get('spark.app.id')}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in session_dir()."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _made(path: str, df: DataFrame, table: str | None = None) -> DataFrame:
    if _open:
        _open[-1].append((path, df, table))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder and read again: made once, however many later steps read it, and read again after executors are lost. Shuffle files of the job go when it ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    was = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if was is None else spark.conf.set(FREE_SHUFFLES, was)
    return _made(path, spark.read.schema(df.schema).parquet(path))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what stored() and bucketed() wrote inside, but for the frames given to the function it yields; so what is returned from inside has to be stored itself."""
    _open.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda df: kept.append(df) or df
    finally:
        for path, df, table in _open.pop():
            if any(df is k for k in kept):
                _made(path, df, table)
                continue
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, name: str, buckets: int, by: list[str], order: list[str]) -> DataFrame:
    """df written as an external table of buckets by the hash of `by`, sorted in each, in a new folder. df is best dealt out that way already, so that a bucket is one file.

    Joins and groupings on `by` then need no exchange of this side. The table is known to the session's catalog under a name of its own.
    """
    spark = df.sparkSession
    table = f"loomline_{name}_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    df.write.format("parquet").option("path", path).bucketBy(buckets, *by).sortBy(*order).saveAsTable(table)
    return _made(path, spark.table(table), table)


def clear(spark: SparkSession) -> None:
    """Deletes session_dir(). For the end of an application: results that are not stored elsewhere by then read from it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
