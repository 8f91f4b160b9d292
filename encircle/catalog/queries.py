"""One query per operator over the standard tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encircle.catalog import tables
from encircle.functions.geometry import in_disc
from encircle.operators import events, gains, pairs, sampling, status
from encircle.plans import greedy
from encircle.sources import datasets, generate, trace
from encircle.streaming import snapshot

BOUNDS = generate.DEFAULT_BOUNDS
K = generate.DEFAULT_K
EPSILON = generate.DEFAULT_EPSILON
#: Fixed threshold of the single-pass queries: one point in a hundred.
SHARE = 100
NOW_MS = 1_700_001_000_000
APP_NAME = "cover-run"

Query = Callable[[SparkSession, str], DataFrame]


# --- sources ---------------------------------------------------------------------------------


def points_scan(spark: SparkSession, d: str) -> DataFrame:
    return datasets.points_from(tables.points(spark, d))


def circles_scan(spark: SparkSession, d: str) -> DataFrame:
    return datasets.circles_from(tables.circles(spark, d))


def circle_ordinal(spark: SparkSession, d: str) -> DataFrame:
    bare = tables.circles(spark, d).select("cx", "cy", "r")
    return datasets.with_ordinal(bare, ["cx", "cy", "r"])


def gen_points(spark: SparkSession, d: str) -> DataFrame:
    """A generated point per order, in the cluster of the customer's nation."""
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = tables.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("point_id"), F.col("c_nationkey").cast("int").alias("cluster")
    )
    made = generate.place_points(rows)
    return made.select("point_id", "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def gen_circles(spark: SparkSession, d: str) -> DataFrame:
    """A generated circle per part."""
    rows = tables.table(spark, d, "part").select(F.col("p_partkey").alias("circle_id"))
    made = generate.place_circles(rows)
    return made.select("circle_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "r")])


def gen_preset_counts(spark: SparkSession, d: str) -> DataFrame:
    """A point per order, placed in each preset's number of clusters by customer: points per
    cluster, and how many of them the box holds back at its border."""
    presets = F.array(
        *[F.struct(F.lit(n).alias("preset"), F.lit(p.n_clusters).alias("k")) for n, p in generate.PRESETS.items()]
    )
    orders = tables.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.explode(presets).alias("p"))
    made = generate.place_points(
        orders.select(
            F.col("o_orderkey").alias("point_id"),
            "p.preset",
            F.pmod(F.col("o_custkey"), F.col("p.k")).cast("int").alias("cluster"),
        )
    )
    at_border = F.round("x", 6).isin(0.0, 1000.0) | F.round("y", 6).isin(0.0, 1000.0)
    return made.groupBy("preset", "cluster").agg(
        F.count("*").alias("points"), F.count_if(at_border).alias("at_border")
    )


def trace_json(spark: SparkSession, d: str) -> DataFrame:
    points, circles = tables.points(spark, d), tables.circles(spark, d)
    run = greedy.run_cover(points, circles, K, EPSILON)
    shown = sampling.display_sample(points, BOUNDS)
    written = trace.events_as_json(trace.trace_events(run, circles, shown, BOUNDS))
    read = written.select("seq", F.from_json("json", trace.TRACE_EVENT_SCHEMA).alias("e"))
    return read.select(
        "seq",
        "e.type",
        "e.message",
        "e.total_guesses",
        F.array_size("e.points").alias("n_shown"),
        F.col("e.config.n_circles").alias("n_circles"),
        F.col("e.sampling.percentage").alias("sampling_percentage"),
        "e.value",
        F.round("e.threshold", 6).alias("threshold"),
        F.col("e.circle.cx").alias("cx"),
        F.col("e.circle.cy").alias("cy"),
        F.col("e.circle.r").alias("r"),
        "e.gain",
        "e.coverage",
        "e.step",
        "e.best_guess",
        "e.n_selected",
        "e.total_points",
        "e.coverage_percentage",
    )


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    run = greedy.run_cover(tables.points(spark, d), tables.circles(spark, d), K, EPSILON)
    return greedy.run_summary(run)


# --- projections and filters -----------------------------------------------------------------


def in_circle_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether each customer's orders lie in the disc around the middle of the box."""
    inside = in_disc(F.col("x"), F.col("y"), F.lit(500.0), F.lit(500.0), F.lit(250.0))
    return tables.points(spark, d).select("point_id", inside.alias("inside"))


def clamp_points(spark: SparkSession, d: str) -> DataFrame:
    return sampling.clamp_points(tables.points(spark, d), BOUNDS._replace(min_x=200.0, max_y=750.0))


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return sampling.grid_cells(tables.points(spark, d), BOUNDS).select("point_id", "cell_x", "cell_y")


def candidates_above(spark: SparkSession, d: str) -> DataFrame:
    return gains.candidates_above(marginal_gains(spark, d), _threshold(spark, d))


def remaining_circles(spark: SparkSession, d: str) -> DataFrame:
    return gains.remaining_circles(tables.circles(spark, d), tables.selected(spark, d))


def threshold_ladder(spark: SparkSession, d: str) -> DataFrame:
    return greedy.threshold_ladder(best_single(spark, d), K, EPSILON)


def _threshold(spark: SparkSession, d: str) -> float:
    return tables.table(spark, d, "orders").count() / SHARE


# --- joins and aggregates --------------------------------------------------------------------


def coverage_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.coverage_pairs(tables.points(spark, d), tables.circles(spark, d))


def covered_points(spark: SparkSession, d: str) -> DataFrame:
    return pairs.covered_points(tables.points(spark, d), tables.selected(spark, d))


def uncovered_points(spark: SparkSession, d: str) -> DataFrame:
    return pairs.uncovered_points(tables.points(spark, d), tables.selected(spark, d))


def point_count(spark: SparkSession, d: str) -> DataFrame:
    return gains.point_count(tables.points(spark, d))


def set_coverage(spark: SparkSession, d: str) -> DataFrame:
    return gains.set_coverage(tables.points(spark, d), tables.selected(spark, d))


def coverage_by_circle(spark: SparkSession, d: str) -> DataFrame:
    return gains.coverage_by_circle(tables.points(spark, d), tables.circles(spark, d))


def best_single(spark: SparkSession, d: str) -> DataFrame:
    return gains.best_single(tables.points(spark, d), tables.circles(spark, d))


def _widest_remaining(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with the greatest radius, the lowest id among equals."""
    return remaining_circles(spark, d).orderBy(F.desc("r"), "circle_id").limit(1)


def marginal_gain_one(spark: SparkSession, d: str) -> DataFrame:
    return gains.marginal_gain(
        tables.points(spark, d), tables.selected(spark, d), _widest_remaining(spark, d)
    )


def marginal_gains(spark: SparkSession, d: str) -> DataFrame:
    return gains.marginal_gains(
        tables.points(spark, d), tables.circles(spark, d), tables.selected(spark, d)
    )


def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    return gains.first_candidate_above(marginal_gains(spark, d), _threshold(spark, d))


def set_union_coverage(spark: SparkSession, d: str) -> DataFrame:
    grown = gains.add_circle(tables.selected(spark, d), _widest_remaining(spark, d))
    return gains.set_coverage(tables.points(spark, d), grown)


def cell_density(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cell_density(tables.points(spark, d), BOUNDS)


# --- the greedy cover ------------------------------------------------------------------------


def greedy_single_tau(spark: SparkSession, d: str) -> DataFrame:
    """One pass with the fixed threshold: one point in a hundred."""
    found = greedy.greedy_threshold(
        tables.points(spark, d), tables.circles(spark, d), K, _threshold(spark, d)
    )
    return found.select("step", "circle_id", "gain", "coverage")


def greedy_trace(spark: SparkSession, d: str) -> DataFrame:
    found = greedy.greedy_cover(tables.points(spark, d), tables.circles(spark, d), K, EPSILON)
    return found.select("guess_j", F.round("tau", 6).alias("tau"), "step", "circle_id", "gain")


def best_guess(spark: SparkSession, d: str) -> DataFrame:
    return greedy.best_guess(
        greedy.greedy_cover(tables.points(spark, d), tables.circles(spark, d), K, EPSILON)
    )


def greedy_solution(spark: SparkSession, d: str) -> DataFrame:
    return greedy.greedy_solution(tables.points(spark, d), tables.circles(spark, d), K, EPSILON)


def trace_running_coverage(spark: SparkSession, d: str) -> DataFrame:
    return greedy.running_coverage(
        greedy.greedy_cover(tables.points(spark, d), tables.circles(spark, d), K, EPSILON)
    )


# --- samples ---------------------------------------------------------------------------------


def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    """About a tenth of all points."""
    points = tables.points(spark, d)
    total = points.count()
    return sampling.uniform_sample(points, max_rows=total // 10, total=total)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    found = sampling.stratified_sample(tables.points(spark, d), BOUNDS)
    return found.select("cell_x", "cell_y", "point_id")


def display_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.display_sample(tables.points(spark, d), BOUNDS)


def sampling_info(spark: SparkSession, d: str) -> DataFrame:
    points = tables.points(spark, d)
    return sampling.sampling_info(points, sampling.display_sample(points, BOUNDS))


# --- run events ------------------------------------------------------------------------------


def segment_by_marker(spark: SparkSession, d: str) -> DataFrame:
    found = events.segment_by_marker(
        tables.table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "signup"
    )
    return found.select("user_id", "event_id", "event_type", "segment")


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return events.latest_run(
        tables.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"),
        "user_id", "event_id", F.col("event_type") == "signup",
    )


def guess_series(spark: SparkSession, d: str) -> DataFrame:
    return events.guess_series(tables.run_events(spark, d))


def run_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return events.run_snapshot(tables.run_events(spark, d))


def run_display(spark: SparkSession, d: str) -> DataFrame:
    return events.run_display(run_snapshot(spark, d))


def run_setup(spark: SparkSession, d: str) -> DataFrame:
    """Read back from the JSON of a stored run."""
    points, circles = tables.points(spark, d), tables.circles(spark, d)
    run = greedy.run_cover(points, circles, K, EPSILON)
    shown = sampling.display_sample(points, BOUNDS)
    stored = trace.events_as_json(trace.trace_events(run, circles, shown, BOUNDS))
    read = stored.select("run_id", F.from_json("json", trace.TRACE_EVENT_SCHEMA).alias("e"), "seq")
    fields = ("type", "config", "bounds", "sampling", "total_guesses")
    return events.run_setup(read.select("run_id", "seq", *[f"e.{name}" for name in fields]))


def stream_snapshot(spark: SparkSession, d: str) -> DataFrame:
    schema = tables.table(spark, d, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    return snapshot.stream_snapshot(tables.run_events_from(arriving))


# --- cluster status --------------------------------------------------------------------------


def worker_rows(spark: SparkSession, d: str) -> DataFrame:
    return status.worker_rows(tables.status_snapshots(spark, d))


def worker_utilisation(spark: SparkSession, d: str) -> DataFrame:
    return status.worker_utilisation(tables.status_snapshots(spark, d))


def cluster_totals(spark: SparkSession, d: str) -> DataFrame:
    return status.cluster_totals(tables.status_snapshots(spark, d))


def cluster_headline(spark: SparkSession, d: str) -> DataFrame:
    return status.cluster_headline(tables.status_snapshots(spark, d), APP_NAME)


def active_apps(spark: SparkSession, d: str) -> DataFrame:
    return status.active_apps(tables.status_snapshots(spark, d), APP_NAME, NOW_MS)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        points_scan, circles_scan, circle_ordinal, gen_points, gen_circles, gen_preset_counts,
        trace_json, run_summary,
        in_circle_flag, clamp_points, grid_cells, candidates_above, remaining_circles,
        threshold_ladder,
        coverage_pairs, covered_points, uncovered_points,
        point_count, set_coverage, coverage_by_circle, best_single, marginal_gain_one,
        marginal_gains, first_candidate, set_union_coverage, cell_density,
        greedy_single_tau, greedy_trace, best_guess, greedy_solution, trace_running_coverage,
        uniform_sample, stratified_sample, display_sample, sampling_info,
        segment_by_marker, latest_run, guess_series, run_snapshot, run_display, run_setup, stream_snapshot,
        worker_rows, worker_utilisation, cluster_totals, cluster_headline, active_apps,
    )
}
