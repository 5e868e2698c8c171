"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and the master is local, where all tasks see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.get(spark.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> None:
    """Remove all work tables of this application; for callers that have stored the results they want."""
    for path in list(_made.get(spark.sparkContext.applicationId, ())):
        _drop(spark, path)


class WorkTables:
    """Tables that are needed no longer than until :meth:`drop`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: cuts the lineage, survives lost executors."""
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            _drop(self.spark, self.paths.pop())


def by_key(df: DataFrame) -> DataFrame:
    """``df`` for a join by sorting, whatever the size of the files beneath.

    Keys repeat, so dictionaries make a work table's files far smaller than its rows. Spark judges by the files, and would
    send hundreds of MB of rows through the driver.
    """
    return df.hint("shuffle_merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it again, for a table that a result reads: it stays until :func:`clear`."""
    return WorkTables(df.sparkSession).written(df, name)
