import itertools
import random

import brute
import pytest
from frames import circles_frame, points_frame, rows
from pyspark.sql import functions as F

from encircle.functions.numbers import guess_count
from encircle.operators import gains, pairs
from encircle.plans import greedy


def instance(seed, n=60, m=14, size=10.0):
    rng = random.Random(seed)
    points = [(rng.uniform(0, size), rng.uniform(0, size)) for _ in range(n)]
    points += points[: n // 6]
    circles = [
        (rng.uniform(0, size), rng.uniform(0, size), rng.uniform(0.5, size / 3)) for _ in range(m)
    ]
    return points, circles


COLUMNS = ("guess_j", "step", "circle_id", "gain", "coverage")


@pytest.mark.parametrize("seed", range(4))
def test_trace_equals_rescanning(spark, seed):
    points, circles = instance(seed)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    k, epsilon = [(5, 0.2), (1, 0.5), (20, 0.6), (3, 1.5)][seed]
    want = brute.trace(points, circles, k, epsilon)
    for window, limit in ((48, 10**6), (4, 0)) if k > 3 else ((1, 10**6), (48, 0)):
        run = greedy.run_cover(p, c, k, epsilon, window=window, broadcast_rows=limit)
        assert rows(run.trace, *COLUMNS) == want
    j, coverage = brute.best_of(want)
    best = greedy.best_guess(run.trace).first()
    assert (best.guess_j, best.coverage) == (j, coverage)
    picked = rows(greedy.solution_from(run.trace, c), "step", "circle_id")
    assert picked == [(step, circle) for guess, step, circle, _, _ in want if guess == j]
    assert len(picked) <= k


@pytest.mark.parametrize("limit", [0, 10**6], ids=["shuffled", "broadcast"])
def test_rounds_with_cell_totals(spark, monkeypatch, limit):
    """Several rounds whose losses are counted by cell and set of guesses."""
    points, circles = instance(21, n=150, m=30)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    passes = []
    counted = pairs.count_by_circle_and
    monkeypatch.setattr(
        greedy, "count_by_circle_and",
        lambda *a, **k: passes.append(a[0]) or counted(*a, **(k | {"depth": 2})),
    )
    run = greedy.run_cover(p, c, 6, 0.5, window=3, broadcast_rows=limit)
    assert rows(run.trace, *COLUMNS) == brute.trace(points, circles, 6, 0.5)
    assert len(passes) >= 2 and set(passes) == {("lost_to",)}


def test_many_picks_are_folded_into_the_positions(spark, monkeypatch):
    """k larger than what may be held: the driver keeps few picks, the trace is whole."""
    points, circles = instance(23, n=200, m=60)
    circles = [(x, y, r / 3) for x, y, r in circles]
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    want = brute.trace(points, circles, 100_000, 3.0)
    held, folds = [], []
    fold = greedy._fold
    monkeypatch.setattr(greedy, "_fold", lambda *a: folds.append(fold(*a)) or folds[-1])
    in_use = greedy._in_use
    monkeypatch.setattr(greedy, "_in_use", lambda s, first, second: held.append(sum(map(len, second.values()))) or in_use(s, first, second))
    run = greedy.run_cover(p, c, 100_000, 3.0, window=5, broadcast_rows=25 * 20)
    assert rows(run.trace, *COLUMNS) == want
    assert len(folds) >= 2 and len(want) > 60
    guesses = guess_count(100_000, 3.0)
    assert max(held) <= 20 + 5 * guesses  # never more than the limit and one window
    left = [f.count() for f in folds]
    assert left == sorted(left, reverse=True)


def test_ladders_are_one(spark):
    best = spark.createDataFrame([(1_234_567,)], "coverage LONG")
    made = [tuple(r) for r in greedy.threshold_ladder(best, 10, 0.2).orderBy("guess_j").collect()]
    assert made == greedy.ladder(1_234_567, 10, 0.2)


def test_a_candidate_has_one_row(spark, monkeypatch):
    points, circles = instance(22, n=150, m=30)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    rounds = []
    reduce = greedy._reduce_gains
    monkeypatch.setattr(greedy, "_reduce_gains", lambda *a: rounds.append(reduce(*a)) or rounds[-1])
    run = greedy.run_cover(p, c, 6, 0.5, window=2)
    assert rows(run.trace, *COLUMNS) == brute.trace(points, circles, 6, 0.5)
    assert len(rounds) >= 2
    for alive in rounds:
        assert alive.groupBy("circle_id").count().where("count > 1").isEmpty()
        assert alive.where("live = 0").isEmpty()


def test_batches_of_guesses_do_not_change_the_trace(spark, monkeypatch):
    points, circles = instance(7)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    want = rows(greedy.greedy_cover(p, c, 4, 0.2), *COLUMNS)
    monkeypatch.setattr(greedy, "TOGETHER", 3)
    assert rows(greedy.greedy_cover(p, c, 4, 0.2), *COLUMNS) == want


@pytest.mark.parametrize("tau", [0.0, 2.0, 7.0, 1000.0])
def test_single_pass(spark, tau):
    points, circles = instance(11)
    circles.insert(0, (500.0, 500.0, 1.0))  # covers nothing: taken only when tau is 0
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    found = greedy.greedy_threshold(p, c, 6, tau, window=2)
    assert rows(found, "step", "circle_id", "gain", "coverage") == brute.walk(
        points, circles, 6, tau
    )


def test_half_of_the_optimum(spark):
    points, circles = instance(5, n=40, m=9)
    p, c = points_frame(spark, points), circles_frame(spark, circles)
    k, epsilon = 3, 0.2
    optimum = max(
        len(brute.cover(points, chosen)) for chosen in itertools.combinations(circles, k)
    )
    found = greedy.best_guess(greedy.greedy_cover(p, c, k, epsilon)).first()
    assert found.coverage >= 0.5 * (1 - epsilon) * optimum


def test_full_coverage_stops_the_ladder(spark):
    p = points_frame(spark, [(0, 0), (1, 0), (1, 0)])
    c = circles_frame(spark, [(0, 0, 5), (0, 0, 5)])
    run = greedy.run_cover(p, c, 10, 0.2)
    assert rows(run.trace, *COLUMNS) == [(0, 1, 0, 3, 3)]
    assert [j for j, _ in run.guesses] == [0]
    summary = greedy.run_summary(run).first()
    assert tuple(summary) == (0, 1, 3, 3, 100.0)


def test_nothing_to_cover(spark):
    c = circles_frame(spark, [(0, 0, 1), (3, 3, 1)])
    for points in ([], [(100, 100)]):
        run = greedy.run_cover(points_frame(spark, points), c, 10, 0.2)
        assert run.trace.count() == 0
        assert tuple(greedy.run_summary(run).first()) == (0, 0, 0, len(points), 0.0)
    empty = greedy.run_cover(points_frame(spark, [(0, 0)]), c.limit(0), 10, 0.2)
    assert tuple(greedy.run_summary(empty).first()) == (0, 0, 0, 1, 0.0)


def test_duplicate_circles_and_ties(spark):
    p = points_frame(spark, [(0, 0), (10, 0)])
    c = circles_frame(spark, [(0, 0, 1), (0, 0, 1), (10, 0, 1)])
    assert rows(greedy.greedy_cover(p, c, 2, 0.2), *COLUMNS) == [(0, 1, 0, 1, 1), (0, 2, 2, 1, 2)]


@pytest.mark.parametrize("k, epsilon", [(0, 0.2), (-1, 0.2), (3, 0), (3, -0.5), (3, float("nan"))])
def test_invalid_parameters(spark, k, epsilon):
    frame = circles_frame(spark, [(0, 0, 1)])
    with pytest.raises(ValueError):
        greedy.greedy_cover(points_frame(spark, [(0, 0)]), frame, k, epsilon)


def test_guess_count():
    assert guess_count(10, 0.2) == 14
    assert guess_count(1, 0.2) == 1
    assert len(greedy.ladder(88, 10, 0.2)) == 14
    assert greedy.ladder(88, 10, 0.2)[0] == (0, 4.4)


def test_running_coverage(spark):
    points, circles = instance(3)
    trace = greedy.greedy_cover(
        points_frame(spark, points), circles_frame(spark, circles), 5, 0.2
    )
    again = rows(greedy.running_coverage(trace), "guess_j", "step", "running_coverage")
    assert again == rows(trace, "guess_j", "step", "coverage")


def crowded(monkeypatch):
    """Points that all meet some hundred circles, counted as where tests abound; the sizes of all broadcasts."""
    monkeypatch.setattr(pairs, "TILE_TESTS", 1 << 10, raising=False)
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda frame: sent.append(frame.count()) or broadcast(frame))
    rng = random.Random(17)
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(90)]
    circles = [(rng.uniform(30, 70), rng.uniform(30, 70), rng.uniform(33, 60)) for _ in range(500)]
    return points, circles, sent


def test_ladder_of_many_circles_sends_the_driver_no_cells(spark, monkeypatch):
    points, circles, sent = crowded(monkeypatch)
    best = gains.best_single(points_frame(spark, points), circles_frame(spark, circles))
    found = [tuple(row) for row in greedy.threshold_ladder(best, 3, 0.5).orderBy("guess_j").collect()]
    assert found == greedy.ladder(max(len(brute.cover(points, [c])) for c in circles), 3, 0.5)
    assert sum(sent) < len(circles)


def test_single_pass_over_many_circles_sends_the_driver_a_window(spark, monkeypatch):
    points, circles, sent = crowded(monkeypatch)
    found = greedy.greedy_threshold(points_frame(spark, points), circles_frame(spark, circles), 3, 9.0, window=2)
    assert rows(found, "step", "circle_id", "gain", "coverage") == brute.walk(points, circles, 3, 9.0)
    assert max(sent) <= 25 * (2 + 3)  # cells of a window and of the picks, never those of the candidates


def test_cover_of_many_circles_sends_the_driver_windows(spark, monkeypatch):
    points, circles, sent = crowded(monkeypatch)
    reduced, reduce = [], greedy._reduce_gains
    monkeypatch.setattr(greedy, "_reduce_gains", lambda *a: reduced.append(reduce(*a)) or reduced[-1])
    run = greedy.run_cover(points_frame(spark, points), circles_frame(spark, circles), 3, 1.5, window=2)
    assert rows(run.trace, *COLUMNS) == brute.trace(points, circles, 3, 1.5)
    assert reduced and max(sent) <= 25 * (2 + 3) * guess_count(3, 1.5)
