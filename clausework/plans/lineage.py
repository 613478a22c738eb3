"""Lineage cuts by the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def ensure_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where none is named, one in the warehouse, or on a local master a new temporary one."""
    sc = spark.sparkContext
    inner = sc._jsc.sc()
    if not inner.getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.startswith("local"):
            shared = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/clausework-checkpoints")
    return inner.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Constraints are left out meanwhile: a checkpoint keeps those of columns that it lacks, on which a later union fails.
    """
    spark = df.sparkSession
    ensure_folder(spark)
    before = spark.conf.get(_CONSTRAINTS)
    spark.conf.set(_CONSTRAINTS, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(_CONSTRAINTS, before)


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    store, where = _store(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)
