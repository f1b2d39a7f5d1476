"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster must name one, since a machine-local folder would be lost with its
    executor.
    """
    found = spark.conf.get(_SETTING, None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loreweave-")
    spark.conf.set(_SETTING, made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs no recomputation before this point,
    and non-deterministic columns (generated ids) stay as written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table ``name`` of one scale folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
