"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a table there and reading it again, so a lost executor
costs at most the stage that ran on it.  The folder is ``spark.checkpoint.dir``;
only a local session without that setting gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


class Tables:
    """Paths of the tables written while it is open (``with``): its owner deletes them when nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        _OPEN.append(self)
        return self

    def __exit__(self, *error) -> None:
        _OPEN.remove(self)

    def release(self, spark: SparkSession) -> None:
        """Delete the tables; results that still read them must be saved before."""
        while self.paths:
            delete(spark, self.paths.pop())


#: Tables written while no owner is open belong to the first.
_OPEN: list[Tables] = [Tables()]


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder named by the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="loom-"))
    return _FALLBACK[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has; it belongs to the ``Tables`` opened last."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _OPEN[-1].paths.append(path)
    return path


@contextmanager
def set_for(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Shuffle files go when the action ends: what it wrote is read from the table, never computed again.
FILES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with ``options`` of its writer) in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with set_for(spark, FILES_GO):
        df.write.options(**options).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_path = path
    return made


def discard(made: DataFrame) -> None:
    """Delete a table that ``write_table`` wrote and that nothing will read again."""
    for tables in _OPEN:
        if made.written_path in tables.paths:
            tables.paths.remove(made.written_path)
    delete(made.sparkSession, made.written_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that belong to nobody else; results that still read them must be saved before."""
    _OPEN[0].release(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
