"""The run snapshot kept current while run events arrive.

Every batch is folded into one small state per run; states merge in any order and may be merged
twice, so the query needs no state of its own, and late or repeated events do no harm.  The current
states lie in buckets of run_id: a batch reads and rewrites the buckets its runs are in, as a new
version, and a version that has been replaced is removed.  Reading costs one row per run,
however many updates there were.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from encircle.operators.events import RUN_EVENT_SCHEMA, merged_states, run_state, snapshot_of
from encircle.session import scratch_path

#: Buckets of run_id; the same for all queries that write to a place.
BUCKETS = 32


def read_event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of run events from a folder of JSON lines."""
    return (
        spark.readStream.schema(RUN_EVENT_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )


def start_snapshots(events: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Process what is there, then stop; a restart goes on where the checkpoint ends.

    A batch that is repeated after a failure writes its version again, from the versions before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fold(batch, batch_id, out, buckets)

    return (
        events.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def fold(batch: DataFrame, version: int, out: str, buckets: int = BUCKETS) -> None:
    """Fold a batch of events into the current states below ``out`` as the given version."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = run_state(batch)
    # as many rows as there are buckets
    touched = {row["bucket"] for row in batch.select(bucket).distinct().collect()}
    held = {b: path for b, (v, path) in _current(spark, out, before=version).items() if b in touched}
    if held:
        new = new.unionByName(spark.read.schema(new.schema).parquet(*held.values()))
    states = merged_states(new).withColumn("bucket", bucket)
    states.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/v={version}")
    for path in held.values():
        _delete(spark, path)


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """The state of every run: the newest version of every bucket, nothing else is read."""
    schema = run_state(spark.createDataFrame([], RUN_EVENT_SCHEMA)).schema
    paths = [path for _, path in _current(spark, out).values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current_snapshots(spark: SparkSession, out: str) -> DataFrame:
    """The snapshot of every run."""
    return snapshot_of(current_states(spark, out))


def stream_snapshot(events: DataFrame) -> DataFrame:
    """Run an event stream to its current end and return the snapshots."""
    spark = events.sparkSession
    base = scratch_path(spark, "snapshots")
    start_snapshots(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return current_snapshots(spark, f"{base}/out")


def _files(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _current(spark: SparkSession, out: str, before: int | None = None) -> dict[int, tuple[int, str]]:
    """Newest finished version and folder of every bucket, of versions below ``before`` if given.

    A version counts once its write has ended; there are at most two per bucket.
    """
    finished, fs = _files(spark, f"{out}/v=*/_SUCCESS")
    done = {int(re.search(r"/v=(\d+)/_SUCCESS$", str(f.getPath()))[1]) for f in fs.globStatus(finished) or ()}
    folders, _ = _files(spark, f"{out}/v=*/bucket=*")
    newest: dict[int, tuple[int, str]] = {}
    for folder in fs.globStatus(folders) or ():
        path = str(folder.getPath())
        version, bucket = map(int, re.search(r"/v=(\d+)/bucket=(\d+)$", path).groups())
        if version in done and (before is None or version < before):
            newest[bucket] = max(newest.get(bucket, (version, path)), (version, path))
    return newest


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _files(spark, path)
    fs.delete(place, True)
