"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive lost executors without recomputing it.

    instead_of: tables of this function that nothing needs once this one is written; they go.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    discard(*instead_of)
    return written(spark.read.schema(df.schema).parquet(path), path)


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Within it tables are broadcast without a hint only by their measured size.

    Plans go by the size of files: ids and labels of a million rows are a few megabytes there, but hundreds in the driver,
    which builds what is broadcast.  Only what is run within it is planned so.
    """
    plans, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (plans, adaptive)}
    try:
        spark.conf.set(adaptive, before[adaptive] or spark.conf.get(plans))
        spark.conf.set(plans, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df``, known to read nothing but the table at ``path``."""
    df._tessera_path = path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; others are left alone."""
    for t in tables:
        if path := getattr(t, "_tessera_path", None):
            delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once its results are written elsewhere."""
    delete(spark, _own_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
