"""Points, circles, run events and status snapshots derived from the standard tables.

All derivations are per row or a single key join, in integer arithmetic with one final division,
so every SQL engine gets bit-equal doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per order: 25 clusters by the customer's nation, clamped to the box."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", _cents(F.col("o_totalprice")).alias("cents")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key, cents = F.col("o_orderkey"), F.col("cents")

    def coordinate(a: int, b: int, spread: Column, prime: int) -> Column:
        centre = ((F.col("c_nationkey") * a + b) % BOX).cast("double")
        offset = (spread % 16001 + (key * prime) % 16001 - 16000).cast("double") / 100.0
        return F.least(F.lit(float(BOX)), F.greatest(F.lit(0.0), centre + offset))

    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("point_id"),
        coordinate(379, 83, cents, 7919).alias("x"),
        coordinate(617, 211, cents * 31, 104729).alias("y"),
    )


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate circle per part, radius 31.4 to 100."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("circle_id"),
        (((key * 7919) % 100000).cast("double") / 100.0).alias("cx"),
        (((key * 104729 + 31337) % 100000).cast("double") / 100.0).alias("cy"),
        ((F.lit(300) + F.col("p_size") * 14).cast("double") / 10.0).alias("r"),
    )


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selected set: the circles of the largest economy parts."""
    chosen = table(spark, sf_dir, "part").where("p_type = 'ECONOMY' AND p_size >= 45")
    return circles(spark, sf_dir).join(
        chosen.select(F.col("p_partkey").alias("circle_id")), "circle_id", "left_semi"
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events of many runs: one run per user, in event order."""
    return run_events_from(table(spark, sf_dir, "events"))


def run_events_from(events: DataFrame) -> DataFrame:
    """Per-row mapping, so it serves tables and streams alike."""
    kind = F.col("event_type")
    number = F.get_json_object("props", "$.k").cast("bigint")
    cents = _cents(F.col("value"))
    run_type = (
        F.when(kind == "signup", "INIT")
        .when(kind == "view", "START_GUESS")
        .when(kind == "click", "CIRCLE_ADDED")
        .when(kind == "purchase", "FINAL_SOLUTION")
        .when(number % 2 == 0, "STATUS")
        .otherwise("FINISHED")
    )
    kept = events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        run_type.alias("type"),
        F.col("value").alias("amount"),
        number.alias("number"),
        cents.alias("cents"),
    )
    guess, added, final = (
        F.col("type") == name for name in ("START_GUESS", "CIRCLE_ADDED", "FINAL_SOLUTION")
    )
    number, cents = F.col("number"), F.col("cents")
    return kept.select(
        "run_id",
        "seq",
        "type",
        F.when(F.col("type") == "STATUS", F.concat(F.lit("status "), number.cast("string"))).alias(
            "message"
        ),
        F.when(F.col("type").isin("STATUS", "INIT"), number.cast("int")).alias("total_guesses"),
        F.when(guess, (number % 14).cast("int")).alias("value"),
        F.when(guess | added, F.col("amount")).alias("threshold"),
        F.when(added, number).alias("gain"),
        F.when(added | final, cents).alias("coverage"),
        F.when(added, (number % 10 + 1).cast("int")).alias("step"),
        F.when(final, (number % 14).cast("int")).alias("best_guess"),
        F.when(final, (number % 10 + 1).cast("int")).alias("n_selected"),
        F.when(final, cents + number).alias("total_points"),
        F.when(
            final & (cents + number > 0),
            F.round(
                cents.cast("double") * 100.0
                / F.when(cents + number > 0, (cents + number).cast("double")),
                1,
            ),
        ).alias("coverage_percentage"),
    )


def status_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshot_id, json``: one stored status document per order.

    Some documents lack fields, whole arrays, or report zero capacity.
    """
    key = F.col("o_orderkey")

    def unless(missing: Column, value: Column) -> Column:
        return F.when(~missing, value)

    def worker(i: Column) -> Column:
        both = key + i
        return F.struct(
            unless(both % 5 == 0, F.concat_ws("-", F.lit("worker"), key, i)).alias("id"),
            F.concat_ws(".", F.lit("10.0"), key % 256, i).alias("host"),
            unless(both % 7 == 0, (i + 7000).cast("int")).alias("port"),
            (both % 9).cast("int").alias("cores"),
            ((key * 3 + i) % 9).cast("int").alias("coresused"),
            ((both % 6) * 512).cast("int").alias("memory"),
            ((key * 17 + i) % 2048).cast("int").alias("memoryused"),
            F.when(both % 4 == 0, "DEAD").when(both % 4 < 3, "ALIVE").alias("state"),
        )

    def app(i: Column) -> Column:
        both = key + i
        return F.struct(
            F.when(both % 3 == 0, "report").otherwise("cover-run").alias("name"),
            unless(both % 8 == 0, (both % 9).cast("int")).alias("cores"),
            F.when(both % 2 == 0, "RUNNING").otherwise("WAITING").alias("state"),
            (F.lit(1_700_000_000_000) + (key * 7919 + i * 61_000) % 900_000).alias("starttime"),
        )

    def ended(i: Column) -> Column:
        return F.struct(F.lit("cover-run").alias("name"), F.lit("FINISHED").alias("state"))

    document = F.struct(
        unless(key % 11 == 0, F.lit("ALIVE")).alias("status"),
        unless(key % 13 == 0, (key % 97).cast("int")).alias("cores"),
        (key % 31).cast("int").alias("coresused"),
        (key % 65536).cast("int").alias("memory"),
        unless(key % 10 == 3, (key % 4096).cast("int")).alias("memoryused"),
        # at most three workers, two applications and four ended ones per document
        unless(
            key % 17 == 0, F.filter(_up_to(3, worker), lambda w: w["_i"] < key % 4)
        ).alias("workers"),
        F.filter(_up_to(2, app), lambda a: a["_i"] < (key + 1) % 3).alias("activeapps"),
        unless(key % 19 == 0, F.filter(_up_to(4, ended), lambda a: a["_i"] < key % 5)).alias("completedapps"),
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("snapshot_id"), F.to_json(document).alias("json")
    )


def _up_to(n: int, build) -> Column:
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return F.transform(numbers, lambda i: build(i).withField("_i", i))
