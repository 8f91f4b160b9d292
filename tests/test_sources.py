import json
import os

from frames import circles_frame, points_frame, rows
from pyspark.sql import functions as F

from encircle.functions.geometry import Bounds
from encircle.operators import sampling
from encircle.operators.events import run_setup
from encircle.plans import greedy
from encircle.sources import datasets, generate, trace

BOX = generate.DEFAULT_BOUNDS


def test_unusable_rows_are_dropped(spark):
    frame = spark.sql(
        "SELECT * FROM VALUES (1, 1D, 2D), (2, double('NaN'), 1D), (3, double('-inf'), 1D),"
        " (4, NULL, 1D) AS t(k, a, b)"
    )
    assert rows(datasets.points_from(frame, "k", "a", "b")) == [(1, 1.0, 2.0)]
    circles = frame.withColumn("r", F.lit(1.0))
    assert rows(datasets.circles_from(circles, "k", "a", "b", "r")) == [(1, 1.0, 2.0, 1.0)]


def test_ordinals_follow_the_order(spark):
    frame = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), F.lit("x").alias("s"))
    for n in (1, 13):
        numbered = datasets.with_ordinal(frame.repartition(n), ["v"], "number")
        assert rows(numbered, "number", "v") == [(i, i) for i in range(1000)]


def test_presets(spark):
    for name, preset in generate.PRESETS.items():
        points, circles = generate.generate_preset(spark, name)
        sizes = {r.cluster: r["count"] for r in points.groupBy("cluster").count().collect()}
        base, extra = divmod(preset.n_points, preset.n_clusters)
        assert sizes == {i: base + (i < extra) for i in range(preset.n_clusters)}
        assert circles.count() == preset.n_circles
    low, high = circles.agg(F.min("r"), F.max("r")).first()
    assert 30 <= low < high <= 100
    edges = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert min(edges) >= 0 and max(edges) <= 1000


def test_generated_values_depend_on_seed_and_id_only(spark):
    one = generate.generate_points(spark, 500, 7)
    assert rows(one) == rows(generate.generate_points(spark, 500, 7).repartition(9))
    assert rows(one) != rows(generate.generate_points(spark, 500, 7, seed=1))
    few = generate.generate_points(spark, 3, 10)
    assert rows(few, "point_id", "cluster") == [(0, 0), (1, 1), (2, 2)]
    tight = generate.generate_points(spark, 200, 2, Bounds(5, 5, 6, 6), std=0.0)
    assert tight.select("x", "y").distinct().count() == 2


def test_trace_events_in_order(spark, tmp_path):
    p = points_frame(spark, [(0, 0), (1, 0), (10, 0), (99, 99)])
    c = circles_frame(spark, [(0, 0, 2), (10, 0, 1), (55, 5, 1)])
    run = greedy.run_cover(p, c, 2, 0.9)
    events = trace.trace_events(run, c, p.where("point_id < 3"), BOX, run_id=4)
    kinds = [r.type for r in events.orderBy("seq").select("type").collect()]
    assert kinds[:3] == ["INIT", "STATUS", "STATUS"]
    assert kinds[-2:] == ["FINAL_SOLUTION", "FINISHED"]
    assert kinds.count("START_GUESS") == len(run.guesses)
    assert kinds[3:5] == ["START_GUESS", "CIRCLE_ADDED"]
    parsed = [json.loads(r.json) for r in trace.events_as_json(events).orderBy("seq").collect()]
    assert parsed[0]["points"] == [[0.0, 0.0], [1.0, 0.0], [10.0, 0.0]]
    assert parsed[0]["sampling"] == {
        "is_sampled": True, "displayed": 3, "total": 4, "percentage": 75.0
    }
    assert parsed[1] == {"type": "STATUS", "message": trace.CALCULATING}
    final = parsed[-2]
    assert final["coverage"] == 3 and final["coverage_percentage"] == 75.0
    assert [circle["cx"] for circle in final["circles"]] == [0.0, 10.0]
    assert parsed[-1] == {"type": "FINISHED"}
    target = os.fspath(tmp_path / "trace")
    trace.write_trace(events, target)
    assert spark.read.schema(trace.TRACE_EVENT_SCHEMA).json(target).count() == len(kinds)


def test_trace_without_guesses(spark):
    p, c = points_frame(spark, [(50, 50)]), circles_frame(spark, [(0, 0, 1)])
    events = trace.trace_events(greedy.run_cover(p, c, 2, 0.2), c, p, BOX)
    kinds = [r.type for r in events.orderBy("seq").collect()]
    assert kinds == ["INIT", "STATUS", "FINAL_SOLUTION", "FINISHED"]


def test_equal_rows_are_numbered_by_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(datasets, "SLICE", 1000)
    n = 200_000
    frame = spark.range(n).selectExpr("IF(id % 10 = 0, id, 5L) AS v", "cast(null as string) AS s").coalesce(1)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")  # what is small here would be put into one partition again
    try:
        numbered = datasets.with_ordinal(frame, ["v"], "number")
    finally:
        spark.conf.unset(coalesced)
    seen = numbered.agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).first()
    assert tuple(seen) == (n, n, 0, n - 1)
    ordered = numbered.selectExpr("number", "v", "lag(v) OVER (ORDER BY number) AS before")
    assert ordered.where("before > v").isEmpty()
    per_task = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(per_task) >= tasks and max(per_task) < 2 * n / tasks


def test_ordinals_of_repeated_rows_do_not_depend_on_partitions(spark):
    rows = [(i % 3, "ab"[i % 2]) for i in range(60)]
    want = None
    for n in (1, 7):
        frame = spark.createDataFrame(rows, "v INT, s STRING").repartition(n)
        found = sorted(map(tuple, datasets.with_ordinal(frame, ["v"], "number").collect()))
        assert [r[0] for r in found] == list(range(60))
        want = want or found
        assert found == want


def test_many_shown_points_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trace, "PIECE", 50)
    n = 700
    points = spark.range(n).selectExpr("id point_id", "id * 1D x", "id % 7 * 1D y")
    circles = circles_frame(spark, [(3, 3, 5), (90, 3, 9)])
    run = greedy.run_cover(points, circles, 2, 0.5)
    stored = trace.events_as_json(trace.trace_events(run, circles, points, BOX))
    read = stored.select("run_id", "seq", F.from_json("json", trace.TRACE_EVENT_SCHEMA).alias("e"))
    read = read.select("run_id", "seq", *[f"e.{c}" for c in ("type", "points", "piece", "config", "bounds", "sampling", "total_guesses")])
    sizes = [r.n for r in read.where("points is not null").select(F.size("points").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 100
    assert read.where("type = 'INIT'").count() == 1
    assert rows(trace.shown_points(read), "x", "y") == sorted((float(i), float(i % 7)) for i in range(n))
    setup = run_setup(read).first()
    assert (setup.n_circles, setup.k, setup.epsilon, setup.displayed, setup.points_label) == (2, 2, 0.5, n, "700")
    empty = trace.trace_events(run, circles, points.limit(0), BOX)
    assert empty.where("type = 'INIT'").first().points == []


def test_setup_of_a_run_with_a_stratified_sample(spark):
    """The reader wants few columns, so the sample is needed for its size alone."""
    points = spark.range(300).selectExpr("id point_id", "id % 100 * 1D x", "id % 7 * 1D y")
    points = points.join(spark.range(50).toDF("k"), F.col("point_id") % 50 == F.col("k")).drop("k")
    circles = circles_frame(spark, [(3, 3, 5), (90, 3, 9)])
    run = greedy.run_cover(points, circles, 2, 0.5)
    shown = sampling.display_sample(points, BOX, 10, 20)
    stored = trace.events_as_json(trace.trace_events(run, circles, shown, BOX))
    read = stored.select("run_id", F.from_json("json", trace.TRACE_EVENT_SCHEMA).alias("e"), "seq")
    fields = ("type", "config", "bounds", "sampling", "total_guesses")
    setup = run_setup(read.select("run_id", "seq", *[f"e.{name}" for name in fields])).first()
    displayed = shown.count()
    assert (setup.is_sampled, setup.displayed, setup.total) == (displayed < 300, displayed, 300)
