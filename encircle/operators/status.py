"""Reports over stored cluster-status documents (``snapshot_id, json``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encircle.functions.numbers import elapsed_text, utilisation

SNAPSHOT_SCHEMA = (
    "status STRING, cores INT, coresused INT, memory INT, memoryused INT, "
    "workers ARRAY<STRUCT<id STRING, host STRING, port INT, cores INT, coresused INT, "
    "memory INT, memoryused INT, state STRING>>, "
    "activeapps ARRAY<STRUCT<name STRING, cores INT, state STRING, starttime BIGINT>>, "
    "completedapps ARRAY<STRUCT<name STRING, state STRING>>"
)

# Utilisation above these percentages changes the severity.
DANGER_ABOVE = 80
WARNING_ABOVE = 50


def parsed(snapshots: DataFrame) -> DataFrame:
    """Documents read with a declared schema; a document that is no JSON has null fields.

    The generator keeps the optimizer from repeating the parse for every field that is used.
    """
    document = F.from_json("json", SNAPSHOT_SCHEMA)
    return snapshots.select("snapshot_id", F.inline_outer(F.array(document)))


def _text(column: str, default: str) -> Column:
    return F.coalesce(column, F.lit(default)).alias(column.split(".")[-1])


def _number(column: str) -> Column:
    return F.coalesce(column, F.lit(0)).alias(column.split(".")[-1])


def worker_rows(snapshots: DataFrame) -> DataFrame:
    """One row per worker, missing fields replaced by their defaults."""
    # the outer form with a filter on top: the plain one would add a filter below that needs
    # the parsed array once more
    workers = parsed(snapshots).select(
        "snapshot_id", F.posexplode_outer("workers").alias("position", "w")
    )
    return workers.where("position IS NOT NULL").select(
        "snapshot_id",
        "position",
        _text("w.id", ""),
        _text("w.host", ""),
        _number("w.port"),
        _number("w.cores"),
        _number("w.coresused"),
        _number("w.memory"),
        _number("w.memoryused"),
        _text("w.state", "UNKNOWN"),
    )


def severity(percent: Column) -> Column:
    """Band of a utilisation percentage."""
    return (
        F.when(percent > DANGER_ABOVE, "danger").when(percent > WARNING_ABOVE, "warning")
    ).otherwise("success")


def worker_utilisation(snapshots: DataFrame) -> DataFrame:
    """CPU and memory utilisation per worker with severity bands and liveness."""
    return (
        worker_rows(snapshots)
        .withColumn("cpu_percent", utilisation(F.col("coresused"), F.col("cores")))
        .withColumn("memory_percent", utilisation(F.col("memoryused"), F.col("memory")))
        .select(
            "snapshot_id",
            "position",
            "host",
            "cpu_percent",
            "memory_percent",
            severity(F.col("cpu_percent")).alias("cpu_band"),
            severity(F.col("memory_percent")).alias("memory_band"),
            (F.col("state") == "ALIVE").alias("alive"),
        )
    )


def cluster_totals(snapshots: DataFrame) -> DataFrame:
    """Totals of each document with defaults for what it lacks."""
    return parsed(snapshots).select(
        "snapshot_id",
        _text("status", "UNKNOWN"),
        _number("cores"),
        _number("coresused"),
        _number("memory"),
        _number("memoryused"),
        F.coalesce(F.array_size("workers"), F.lit(0)).alias("n_workers"),
        F.coalesce(F.array_size("activeapps"), F.lit(0)).alias("n_apps"),
        F.coalesce(F.array_size("completedapps"), F.lit(0)).alias("n_completed"),
    )


def active_apps(snapshots: DataFrame, app_name: str, now_ms: int) -> DataFrame:
    """One row per active application; the first one with the given name is "mine"."""
    first = F.array_position(F.transform("activeapps", lambda a: a["name"]), app_name) - 1
    apps = parsed(snapshots).select(
        "snapshot_id", first.alias("first"), F.posexplode_outer("activeapps").alias("position", "a")
    )
    return apps.where("position IS NOT NULL").select(
        "snapshot_id",
        "position",
        F.col("a.name").alias("name"),
        F.col("a.cores").alias("cores"),
        F.col("a.state").alias("state"),
        elapsed_text(F.col("a.starttime"), F.lit(now_ms)).alias("elapsed"),
        (F.col("position") == F.col("first")).alias("is_mine"),
    )


def cluster_headline(snapshots: DataFrame, app_name: str) -> DataFrame:
    """``snapshot_id, my_state, headline``: what the state of "my" application says of the cluster.

    "My" application is the first active one with the given name; without one, both are null.
    """
    mine = F.get(F.filter("activeapps", lambda a: a["name"] == app_name), 0)["state"]
    return parsed(snapshots).select("snapshot_id", mine.alias("my_state")).select(
        "snapshot_id",
        "my_state",
        F.when(F.col("my_state") == "WAITING", "WAITING FOR RESOURCES...")
        .when(F.col("my_state") == "RUNNING", "CLUSTER RUNNING")
        .alias("headline"),
    )
