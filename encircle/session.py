"""Helpers that read the caller's session; none of them creates or configures one."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_directory(spark: SparkSession) -> str:
    """Folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder: there the driver
    machine is the whole cluster.  Anywhere else a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="encircle-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_directory(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(frame: DataFrame) -> int:
    """Number of partitions the session uses for shuffles."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint: the written copy survives the loss of any executor."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_directory(spark))
    return frame.checkpoint(eager=True)


def local_frame(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows held by the driver as a DataFrame, without starting Python workers for it."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))
