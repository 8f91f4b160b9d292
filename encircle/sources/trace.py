"""A finished run as typed run events, and their JSON form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from encircle.functions.geometry import Bounds
from encircle.functions.numbers import guess_count, percentage
from encircle.plans.greedy import CoverRun, best_guess, solution_from
from encircle.session import local_frame

# The messages of the STATUS events.
CALCULATING = "Calculating max single coverage f(e)..."
STARTING = "Starting guesses..."

#: Points in one event.  INIT holds a first piece; more follow in POINTS events.
PIECE = 1 << 16

_CIRCLE = "STRUCT<cx: DOUBLE, cy: DOUBLE, r: DOUBLE>"
TRACE_EVENT_SCHEMA = (
    "run_id BIGINT, seq BIGINT, type STRING, message STRING, total_guesses INT, "
    "points ARRAY<ARRAY<DOUBLE>>, piece INT, "
    "config STRUCT<n_points: BIGINT, n_circles: BIGINT, k: INT, epsilon: DOUBLE>, "
    "bounds STRUCT<minX: DOUBLE, minY: DOUBLE, maxX: DOUBLE, maxY: DOUBLE>, "
    "sampling STRUCT<is_sampled: BOOLEAN, displayed: BIGINT, total: BIGINT, percentage: DOUBLE>, "
    "value INT, threshold DOUBLE, "
    f"circle {_CIRCLE}, gain BIGINT, coverage BIGINT, step INT, "
    f"circles ARRAY<{_CIRCLE}>, best_guess INT, n_selected INT, total_points BIGINT, "
    "coverage_percentage DOUBLE"
)


def trace_events(
    run: CoverRun,
    circles: DataFrame,
    shown: DataFrame,
    bounds: Bounds,
    run_id: int = 0,
) -> DataFrame:
    """The events of one run in the order they happen.

    The points ``shown`` are dealt into pieces of about PIECE points, each an event with the number
    of INIT and a ``piece``; INIT itself is piece 0, so a usual display sample needs no others.  A
    trace has at most guesses x k rows; ``seq`` leaves room for k picks after each guess start.
    """
    spark = circles.sparkSession
    total = F.lit(run.total_points).cast("bigint")
    selected_circle = F.struct("cx", "cy", "r")

    n_circles = circles.agg(F.count("*")).scalar()
    pieces = F.greatest(F.ceil(F.col("n_points") / PIECE), F.lit(1))
    sampled = shown.agg(F.count("*").alias("n_points"))
    dealt = F.pmod(F.xxhash64("point_id", "x", "y"), F.col("_pieces")).cast("int")
    # joins with one row: a subquery inside another is not resolved where a reader wants few columns
    numbered = shown.crossJoin(F.broadcast(sampled.select(pieces.alias("_pieces"))))
    listed = numbered.groupBy(dealt.alias("piece")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("point_id", "x", "y"))),
            lambda p: F.array(p["x"], p["y"]),
        ).alias("points")
    )
    first = listed.where("piece = 0").agg(F.first("points").alias("_first"))
    box = F.struct(
        *[
            F.lit(float(value)).alias(name)
            for name, value in zip(("minX", "minY", "maxX", "maxY"), bounds, strict=True)
        ]
    )
    init = sampled.withColumn("n_circles", n_circles).crossJoin(F.broadcast(first)).select(
        F.lit(0).alias("seq"),
        F.lit("INIT").alias("type"),
        F.lit(guess_count(run.k, run.epsilon)).alias("total_guesses"),
        F.coalesce("_first", F.array().cast("array<array<double>>")).alias("points"),
        F.lit(0).alias("piece"),
        F.struct(
            "n_points",
            "n_circles",
            F.lit(run.k).alias("k"),
            F.lit(float(run.epsilon)).alias("epsilon"),
        ).alias("config"),
        box.alias("bounds"),
        F.when(
            total > F.col("n_points"),
            F.struct(
                F.lit(True).alias("is_sampled"),
                F.col("n_points").alias("displayed"),
                total.alias("total"),
                percentage(F.col("n_points"), total).alias("percentage"),
            ),
        ).alias("sampling"),
    )

    stride = run.k + 1
    status_rows = [(1, "STATUS", CALCULATING, None)]
    if run.guesses:
        status_rows.append((2, "STATUS", STARTING, guess_count(run.k, run.epsilon)))
    tag = {"seq": pa.int64(), "type": pa.string()}
    status = local_frame(
        spark,
        status_rows,
        pa.schema({**tag, "message": pa.string(), "total_guesses": pa.int32()}),
    )
    starts = local_frame(
        spark,
        [(3 + j * stride, "START_GUESS", j, tau) for j, tau in run.guesses],
        pa.schema({**tag, "value": pa.int32(), "threshold": pa.float64()}),
    )
    added = circles.join(F.broadcast(run.trace), "circle_id").select(
        (F.lit(3) + F.col("guess_j") * stride + F.col("step")).alias("seq"),
        F.lit("CIRCLE_ADDED").alias("type"),
        F.col("tau").alias("threshold"),
        selected_circle.alias("circle"),
        "gain",
        "coverage",
        "step",
    )
    end = 3 + guess_count(run.k, run.epsilon) * stride
    solution = solution_from(run.trace, circles).agg(
        F.array_sort(F.collect_list(F.struct("step", "cx", "cy", "r")))
    )
    final = best_guess(run.trace).withColumn("picked", solution.scalar()).select(
        F.lit(end).alias("seq"),
        F.lit("FINAL_SOLUTION").alias("type"),
        F.transform("picked", lambda c: F.struct(c["cx"], c["cy"], c["r"])).alias("circles"),
        "coverage",
        F.col("guess_j").alias("best_guess"),
        F.col("selected").cast("int").alias("n_selected"),
        total.alias("total_points"),
        percentage(F.col("coverage"), total).alias("coverage_percentage"),
    )
    finished = local_frame(spark, [(end + 1, "FINISHED")], pa.schema(tag))

    events = init.unionByName(
        listed.where("piece > 0").select(F.lit(0).alias("seq"), F.lit("POINTS").alias("type"), "points", "piece"),
        allowMissingColumns=True,
    )
    for part in (status, starts, added, final, finished):
        events = events.unionByName(part, allowMissingColumns=True)
    events = events.withColumn("run_id", F.lit(run_id))
    target = StructType.fromDDL(TRACE_EVENT_SCHEMA)
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def shown_points(events: DataFrame) -> DataFrame:
    """``run_id, x, y``: the points shown by the last INIT of every run, out of all their pieces."""
    listed = events.where(F.col("type").isin("INIT", "POINTS"))
    last = listed.groupBy("run_id").agg(F.max("seq").alias("_last"))
    point = F.explode("points").alias("p")
    return listed.join(last, "run_id").where("seq = _last").select("run_id", point).select(
        "run_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")
    )


def events_as_json(events: DataFrame) -> DataFrame:
    """``run_id, seq, json``; fields an event type does not have are left out."""
    payload = [c for c in events.columns if c not in ("run_id", "seq")]
    return events.select("run_id", "seq", F.to_json(F.struct(*payload)).alias("json"))


def write_trace(events: DataFrame, path: str) -> None:
    """Append run events to a folder of JSON lines."""
    events.write.mode("append").json(path)
