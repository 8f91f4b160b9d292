import random

import brute
import numpy as np
import pytest
from frames import circles_frame, points_frame, rows

from pyspark.sql import functions as F

from encircle.operators import gains, pairs, tiles
from encircle.operators.grid import Census, CircleGrid, candidate_join, circle_grid, lifted_levels, split_circles, split_depth, weighted, with_cells
from encircle.operators.skew import HOT_SHARE, _slices, hot_products


def cloud(seed, n, m, hot=False):
    rng = random.Random(seed)
    points = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(n)]
    if hot:
        points += [(3.25, -7.5)] * n + [(rng.gauss(3, 0.01), rng.gauss(-7, 0.01)) for _ in range(n)]
    circles = [
        (rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0.01, 1, 7, 30, -20, 500]))
        for _ in range(m)
    ]
    return points, circles


def expected_pairs(points, circles):
    return sorted(
        (i, c) for i, p in enumerate(points) for c, circle in enumerate(circles)
        if brute.inside(p, circle)
    )


@pytest.mark.parametrize("limit", [0, 10**6], ids=["shuffled", "broadcast"])
@pytest.mark.parametrize("hot", [False, True], ids=["even", "hot"])
def test_pairs_and_coverage_equal_brute_force(spark, limit, hot):
    points, circles = cloud(1, 150, 40, hot)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    want = expected_pairs(points, circles)
    assert rows(pairs.coverage_pairs(p, c, limit)) == want
    counts = {i: 0 for i in range(len(circles))}
    for _, circle in want:
        counts[circle] += 1
    assert rows(gains.coverage_by_circle(p, c, limit)) == sorted(counts.items())
    chosen = c.where("circle_id % 7 = 1 AND abs(r) < 100")
    covered = brute.cover(points, [circles[i] for i in range(1, 40, 7) if abs(circles[i][2]) < 100])
    assert {r[0] for r in rows(pairs.covered_points(p, chosen, limit))} == covered
    assert {r[0] for r in rows(pairs.uncovered_points(p, chosen, limit))} == set(
        range(len(points))
    ) - covered
    assert gains.set_coverage(p, chosen, limit).first()[0] == len(covered)


@pytest.mark.parametrize("depth", [1, 3])
@pytest.mark.parametrize("limit", [0, 10**6], ids=["shuffled", "broadcast"])
def test_whole_cells_and_rims_equal_tests(spark, depth, limit):
    points, circles = cloud(4, 300, 60, hot=True)
    points += [(3, 4), (-64, 0), (0, 64), (1e100, 1e100), (1e15, 1e15), (1e15 + 1, 1e15)]
    circles += [(0, 0, 5), (0, 0, -64), (0, 0, 0), (1e15, 1e15, 1), (1e100, 1e100, 1e90), (0, 0, 1e18)]
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    found = pairs.count_by_circle(p, c, "n", limit, depth)
    assert rows(found, "circle_id", "n") == [
        (i, len([p for p in points if brute.inside(p, circle)])) for i, circle in enumerate(circles)
    ]


def test_split_depth_follows_the_work():
    few = CircleGrid(None, (5,), cell_rows=1_000, candidates_per_point=100.0)
    assert split_depth(1_000, few) == 0
    depths = [split_depth(10**e, few) for e in range(4, 13)]
    assert depths == sorted(depths) and depths[-1] > 3


def test_result_does_not_depend_on_partitions(spark):
    points, circles = cloud(2, 120, 25)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    want = expected_pairs(points, circles)
    for n in (1, 16):
        assert rows(pairs.coverage_pairs(p.repartition(n), c.repartition(n))) == want


@pytest.mark.parametrize(
    "point, circle, hit",
    [
        ((3, 4), (0, 0, 5), True),
        ((3, 4), (0, 0, -5), True),
        ((3, 4), (0, 0, 4.999), False),
        ((7, 7), (7, 7, 0), True),
        ((0, 0), (0, 0, 0), True),
        ((1e15, 1e15), (1e15, 1e15, 1), True),
        ((-64, 0), (0, 0, 64), True),
        ((1e100, 0), (1e100, 0, 2), True),
        ((0.1 + 0.2, 0), (0, 0, 0.3), False),
    ],
)
def test_edge_of_the_disc(spark, point, circle, hit):
    p, c = points_frame(spark, [point]), circles_frame(spark, [circle])
    for limit in (0, 10**6):
        assert pairs.coverage_pairs(p, c, limit).count() == int(hit)
        assert pairs.covered_points(p, c, limit).count() == int(hit)


def test_duplicates_count_separately(spark):
    p = points_frame(spark, [(0, 0), (0, 0), (9, 9)])
    c = circles_frame(spark, [(0, 0, 1), (0, 0, 1), (50, 50, 1)])
    assert rows(gains.coverage_by_circle(p, c)) == [(0, 2), (1, 2), (2, 0)]
    assert rows(gains.best_single(p, c)) == [(0, 2)]
    first = c.where("circle_id = 0")
    assert rows(gains.marginal_gains(p, c, first)) == [(1, 0), (2, 0)]
    assert gains.marginal_gain(p, first, c.where("circle_id = 1")).first()[0] == 0
    assert rows(gains.add_circle(first, c.where("circle_id < 2")), "circle_id") == [(0,), (1,)]


def test_empty_inputs(spark):
    p, c = points_frame(spark, [(0, 0)]), circles_frame(spark, [(5, 5, 1)])
    nothing, nowhere = c.limit(0), p.limit(0)
    assert pairs.coverage_pairs(p, nothing).count() == 0
    assert gains.set_coverage(p, nothing).first()[0] == 0
    assert pairs.uncovered_points(p, nothing).count() == 1
    assert gains.best_single(p, nothing).count() == 0
    assert rows(gains.best_single(nowhere, c)) == [(0, 0)]
    assert gains.first_candidate_above(gains.marginal_gains(p, c, nothing), 1).count() == 0
    assert rows(gains.first_candidate_above(gains.marginal_gains(p, c, nothing), 0)) == [(0, 0)]


def test_every_circle_meets_few_cells(spark):
    circles = [(1e3 / 7, -5, 10.0**e) for e in range(-6, 7)]
    grid = circle_grid(circles_frame(spark, circles))
    per_circle = grid.cells.groupBy("circle_id").count().collect()
    assert max(row["count"] for row in per_circle) <= 25


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_plans(spark):
    points, circles = cloud(3, 60, 10)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    for frame in (
        pairs.coverage_pairs(p, c),
        pairs.coverage_pairs(p, c, 0),
        pairs.uncovered_points(p, c),
        gains.marginal_gains(p, c, c.limit(2)),
    ):
        plan = plan_of(frame)
        assert "CartesianProduct" not in plan
        assert "Python" not in plan
    assert "BroadcastNestedLoopJoin" not in plan_of(pairs.coverage_pairs(p, c))
    # small circle sides: the points are filtered where they are
    scanned = pairs.uncovered_points(p, c)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in scanned and "ShuffledHashJoin" not in scanned


def test_existence_tests_are_joins(spark):
    points, _ = cloud(6, 80, 1)
    circles = [(i % 50, i // 50 * 9, 1.5) for i in range(300)] + [(0, 0, 90), (30, 0, 100)]
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    assert {r[0] for r in rows(pairs.covered_points(p, c))} == brute.cover(points, circles)
    for found, kind in ((pairs.covered_points(p, c), "ExistenceJoin"), (pairs.uncovered_points(p, c), "LeftAnti")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert kind in plan and "lambda" not in plan and "collect_list" not in plan
    one = pairs.covered_points(p, circles_frame(spark, [(0, 0, 3)]))
    assert "LeftSemi" in one._jdf.queryExecution().executedPlan().toString()


STACKED = 20_000


def stacked(spark, n):
    """Very many circles and points on one spot, all points in one partition, among quiet ones."""
    spot = spark.range(STACKED).selectExpr("id circle_id", "100.5D cx", "100.5D cy", "1D + id % 7 / 100 r")
    quiet = spark.range(3000).selectExpr("id + 1000000 circle_id", "id * 40D cx", "id * 3D cy", "1D r")
    there = spark.range(n).selectExpr("id point_id", "100.5D + id % 5 / 1000 x", "100.5D y")
    apart = spark.range(n).selectExpr("id + 1000000 point_id", "id * 40D x", "id * 3D y")
    return there.union(apart).coalesce(1), spot.union(quiet)


@pytest.mark.parametrize("limit", [0, 10**7], ids=["shuffled", "broadcast"])
def test_stacked_circles_are_spread_over_all_tasks(spark, limit):
    points, circles = stacked(spark, 400)
    found = pairs.coverage_pairs(points, circles, limit)
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(per_task) >= tasks
    assert sum(per_task) == 400 * STACKED + 400
    assert max(per_task) < 2 * sum(per_task) / len(per_task)


def test_hot_products_cover_the_work(spark):
    left = spark.createDataFrame([(1, 1000), (2, 3), (3, 5000), (4, 1)], "cell LONG, _n LONG")
    right = spark.createDataFrame([(1, 2000), (2, 3), (4, 30), (5, 8)], "cell LONG, _m LONG")
    hot, tests = hot_products(left, right, "cell")
    found = {r[0]: r[1:] for r in hot.collect()}
    assert tests == 1000 * 2000 + 9 + 30
    assert set(found) == {1, 3} and found[3][1] == 1  # key 3 costs its rows only
    across, down = found[1]
    assert HOT_SHARE * 0.8 <= across * down <= HOT_SHARE * 1.2 and across < down
    for n, m, wanted in ((1, 10**6, 200), (10**6, 1, 200), (10**6, 0, 9), (50, 50, 256), (3, 2, 100)):
        a, b = _slices(n, m, wanted)
        assert 1 <= a <= max(1, n) and 1 <= b <= max(1, m) and a * b <= 2 * wanted


def test_density_is_weighted_by_points(spark):
    points, circles = stacked(spark, 2000)
    grid = circle_grid(circles)
    seen, count = weighted(points, grid)
    exact = with_cells(points, grid.exponents).join(grid.cells, "cell").count()
    assert count == 4000 and seen.is_very_dense
    assert seen.candidates_per_point == pytest.approx(exact / 4000, rel=0.02)
    alone, count = weighted(points.where("point_id >= 1000000"), grid)
    assert count == 2000 and not alone.is_dense
    assert weighted(points.limit(0), grid) == (grid, 0)


@pytest.mark.parametrize("limit", [0, 10**6], ids=["shuffled", "broadcast"])
@pytest.mark.parametrize("depth", [None, 0, 1, 3])
def test_counts_by_circle_and_mask(spark, limit, depth):
    points, circles = cloud(8, 200, 40, hot=True)
    masked = [(x, y, 1 + i % 3, (None, 5, 2**40, -1)[i % 4]) for i, (x, y) in enumerate(points)]
    p = spark.createDataFrame([(float(x), float(y), w, m) for x, y, w, m in masked], "x DOUBLE, y DOUBLE, w INT, mask LONG")
    found = pairs.count_by_circle_and(("mask",), p, circles_frame(spark, circles), "n", limit, depth)
    want = {}
    for i, circle in enumerate(circles):
        for x, y, w, mask in masked:
            if brute.inside((x, y), circle):
                want[i, mask] = want.get((i, mask), 0) + w
    assert {(r.circle_id, r.mask): r.n for r in found.collect()} == want


@pytest.mark.parametrize("sizes", [(7, 3), (10**6, 10**6)], ids=["sliced", "whole"])
def test_counts_in_tiles_equal_tests(spark, sizes):
    points, circles = cloud(11, 150, 60, hot=True)
    points += [(3.0, 4.0), (0.0, 5.0), (float("nan"), 1.0)]
    circles += [(0, 0, 5), (0, 0, -5), (3, 4, 0), (3.25, -7.5, 0)]
    weighed = [(float(x), float(y), 1 + i % 3, (None, "a", "b")[i % 3]) for i, (x, y) in enumerate(points)]
    p = spark.createDataFrame([*weighed, (None, 1.0, 1, "a")], "x DOUBLE, y DOUBLE, w INT, kind STRING")
    found = tiles.counts_in_tiles(p, circle_grid(circles_frame(spark, circles)), ("kind",), *sizes)
    want = {}
    for i, circle in enumerate(circles):
        for x, y, w, kind in weighed:
            if brute.inside((x, y), circle):
                want[i, kind] = want.get((i, kind), 0) + w
    summed = found.groupBy("circle_id", "kind").agg(F.sum("_n").alias("n")).collect()
    assert {(r.circle_id, r.kind): r.n for r in summed} == want


def test_very_many_tests_are_no_rows(spark, monkeypatch):
    """Where tests abound, neither pairs nor cells inside circles become rows: the circles' own cells are all that moves."""
    monkeypatch.setattr(pairs, "TILE_TESTS", 1 << 16, raising=False)
    rng = random.Random(3)
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(400)]
    circles = [(rng.uniform(20, 80), rng.uniform(20, 80), rng.uniform(33, 60)) for _ in range(600)]
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    assert pairs.meeting(p, c).tests > 1 << 16
    found = pairs.count_by_circle(p, c, "n", broadcast_rows=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate inline" not in plan
    want = [sum(brute.inside(point, circle) for point in points) for circle in circles]
    assert rows(found, "circle_id", "n") == list(enumerate(want))


def test_disc_counts_do_not_depend_on_the_chunk(monkeypatch):
    rng = np.random.default_rng(4)
    for chunk, unit in ((1, 0.5), (40, 1e-3), (1 << 19, 1.0)):
        monkeypatch.setattr(tiles, "TESTS_AT_ONCE", chunk)
        x, y = (np.round(rng.uniform(-5, 5, 300) / unit) * unit for _ in "xy")
        cx, cy, r = (np.round(rng.uniform(-6, 6, 50) / unit) * unit for _ in range(3))
        w = rng.integers(1, 5, 300)
        inside = (x - cx[:, None]) ** 2 + (y - cy[:, None]) ** 2 <= (r * r)[:, None]
        assert (tiles.disc_counts(x, y, w, cx, cy, r) == (inside * w).sum(axis=1)).all()


def test_disc_tests_fall_with_depth(spark):
    """The mask totals leave the points on the rims alone to be tested."""
    p = spark.range(20_000).selectExpr("id point_id", "id % 141 * 1D x", "id div 141 * 1D y")
    c = spark.range(60).selectExpr("id circle_id", "20D + id x", "70D - id / 2 y", "30D + id % 11 r").toDF("circle_id", "cx", "cy", "r")
    tests = [candidate_join(p, circle_grid(c), ("point_id",)).count()]
    for depth in (1, 2, 3, 4):
        tests.append(candidate_join(p, split_circles(c, depth).rim, ("point_id",)).count())
    assert tests == sorted(tests, reverse=True) and tests[-1] < tests[0] / 5


def test_sparse_grids_are_lifted(spark):
    """30 sizes of circles on few grids, whatever their number on each where lookups pay."""
    rng = random.Random(5)
    circles = [(rng.uniform(0, 1000), rng.uniform(0, 1000), 2.0**e * 1.3) for e in range(-10, 20) for _ in range(2)]
    points = [(rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for _ in range(300)]
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    grid = circle_grid(c)
    assert len(grid.exponents) <= 3
    assert with_cells(p, grid.exponents).count() <= 3 * 300
    want = expected_pairs(points, circles)
    for limit in (0, 10**6):
        assert rows(pairs.coverage_pairs(p, c, limit)) == want
    assert {r[0] for r in rows(pairs.covered_points(p, c.where("r < 50")))} == brute.cover(points, [x for x in circles if x[2] < 50])


def test_levels_follow_the_cost():
    sparse = Census({e: 1 for e in range(30)}, 1e6)
    assert lifted_levels(sparse) == [29]
    assert lifted_levels(Census(dict.fromkeys((0, 5, 10), 10**6), 2.0**24)) == [0, 5, 10]
    assert lifted_levels(Census(dict.fromkeys((0, 5, 10), 10**6), 2.0**80)) == [10]  # rarely met
    # a few small circles are lifted to the crowded grid, not the crowd to the coarse one
    assert lifted_levels(Census({0: 3, 6: 50_000, 20: 2}, 1e6)) == [6, 20]
    assert lifted_levels(Census({4: 9}, 0.0)) == [4] and lifted_levels(Census({}, 0.0)) == []
    assert lifted_levels(Census({-500: 1, 1000: 2}, 0.0)) == [1000]
