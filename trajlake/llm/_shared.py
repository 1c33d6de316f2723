"""Tables that several jobs of one operator read: written once to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it may be unset, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str, *partition_by: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation.

    Within scratch() the table lives until its end; with keep, until the end of the scratch() around it, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[: len(_scopes) - keep][-1:]:
        scope.append(path)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At its end, deletes the tables that materialize() wrote in it and were not to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by materialize() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.replace("file:///", "/").startswith(shared_dir(spark).replace("file://", "")):
                _delete(spark, folder)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """Within it, the session's setting has this value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Bytes of files up to which Spark may broadcast a table on its own account, in small_broadcasts().
BROADCAST_FILES = 1 << 18


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark broadcasts on its own account only tables of few bytes; a lower limit of the session's stays.

    Spark goes by the size of files, and ids compress well: of its 10 MB, the driver has to hold some three million rows.
    """
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", min(limit, BROADCAST_FILES)):
        yield


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended, not when the driver next collects garbage.

    For steps that each write a table: a DataFrame run again computes its shuffles again.
    """
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True):
        yield


def unused(name: str, columns: list[str]) -> str:
    """The name, or one made from it, that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
