"""Tables and files that jobs keep for each other, in the folder all executors share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions sent to executors travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["helixframe"])

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests), a local master gets a temporary folder; on a
    cluster that would be machine-local, so it is an error there.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone with its gateway
            return


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Spark's setting by which files of a shuffle go when the write that made them ends, not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files behind; what the session had set holds again after it."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and so do the shuffles' files. The path is for :func:`superseded`."""
    path = workspace(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def superseded(spark: SparkSession, *paths: str) -> None:
    """Removes paths of :func:`workspace` that no plan will read again."""
    for path in paths:
        _made.remove((spark, path))
        delete(spark, path)
