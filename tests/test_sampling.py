from frames import points_frame, rows
from pyspark.sql import functions as F

from encircle.functions.geometry import Bounds
from encircle.operators import sampling

BOX = Bounds(0, 0, 1000, 1000)


def scattered(spark, n):
    x = (F.col("id") * 7919 % 1000).cast("double")
    y = (F.col("id") * 104729 % 1000).cast("double")
    return spark.range(n).select(F.col("id").alias("point_id"), x.alias("x"), y.alias("y"))


def test_cells_truncate_toward_zero(spark):
    points = points_frame(spark, [(-0.5, 0), (-25, 0), (999.9, 20), (1000, 5000), (1e300, -1e300)])
    found = rows(sampling.grid_cells(points, BOX), "point_id", "cell_x", "cell_y")
    assert found == [(0, 0, 0), (1, -1, 0), (2, 49, 1), (3, 49, 49), (4, 49, -2147483648)]


def test_box_without_width(spark):
    points = points_frame(spark, [(1, 2), (3, 4)])
    flat = sampling.cell_density(points, Bounds(5, 0, 5, 10), grid=5)
    assert rows(flat) == [(0, 1, 1), (0, 2, 1)]


def test_stratified_sample_is_bounded_and_repeatable(spark):
    points = scattered(spark, 20_000)
    first = sampling.stratified_sample(points, BOX, grid=5, per_cell=3)
    again = sampling.stratified_sample(points.repartition(16), BOX, grid=5, per_cell=3)
    assert rows(first) == rows(again)
    assert {r["count"] for r in first.groupBy("cell_x", "cell_y").count().collect()} == {3}
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_large_samples_of_a_cell_are_cut_in_slices(spark):
    points = scattered(spark, 4_000)
    whole = sampling.stratified_sample(points, BOX, grid=1, per_cell=1_000)
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(limit, "10")
    try:
        sliced = sampling.stratified_sample(points, BOX, grid=1, per_cell=1_000)
        assert "_slice" in sliced._jdf.queryExecution().optimizedPlan().toString()
        got = rows(sliced)
    finally:
        spark.conf.unset(limit)
    assert got == rows(whole)
    assert len(got) >= 1_000


def test_uniform_sample(spark):
    points = scattered(spark, 20_000)
    found = sampling.uniform_sample(points, max_rows=5_000)
    assert 4_700 < found.count() < 5_300
    assert rows(found) == rows(sampling.uniform_sample(points.repartition(1), max_rows=5_000))
    assert sampling.uniform_sample(points, max_rows=20_000).count() == 20_000


def test_display_sample_by_size(spark):
    assert sampling.display_sample(scattered(spark, 5_000), BOX).count() == 5_000
    assert sampling.display_sample(scattered(spark, 50_000), BOX).count() < 6_000
    large = sampling.display_sample(scattered(spark, 50_001), BOX)
    assert large.columns == ["point_id", "x", "y"]
    assert large.count() <= 25_000
    points = scattered(spark, 3_000)
    assert 800 < sampling.display_sample(points, BOX, all_up_to=1_000).count() < 1_200
    cells = sampling.display_sample(points, BOX, all_up_to=10, uniform_up_to=20)
    assert cells.count() == sampling.stratified_sample(points, BOX).count()


def test_sampling_info(spark):
    points = scattered(spark, 12_336)
    info = sampling.sampling_info(points, points.limit(5_000)).first()
    assert tuple(info) == (5_000, 12_336, True, 40.5, "12,336 (5,000 shown)")
    assert tuple(sampling.sampling_info(points, points).first())[2:] == (False, 100.0, "12,336")


def test_clamp(spark):
    points = points_frame(spark, [(-5, 2000), (3, 4)])
    assert rows(sampling.clamp_points(points, BOX)) == [(0, 0.0, 1000.0), (1, 3.0, 4.0)]
