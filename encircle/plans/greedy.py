"""Greedy thresholding for all threshold guesses at once.

The rule: for a threshold tau, walk the candidates by ascending id and take every one whose gain
over the circles taken so far is at least tau, until k are taken.  Gains never grow while the set
grows, so one ascending walk picks exactly what rescanning from the start after each pick would.

Walking one pick per Spark job would cost up to k jobs per guess.  Instead each round settles a
whole *window* of the next candidates of every guess:

1. one pass over the points groups those inside window circles by the exact set of circles that
   hold them.  n circles cut the plane into O(n^2) regions, so the counted groups are bounded by
   the window size, not by the data;
2. from the group counts the driver walks the window and knows every pick exactly;
3. one more pass counts, per remaining candidate, the points the new picks took away, and drops
   the candidates that fell below their threshold.  They can never come back.

The driver holds one window, its group counts and the picks since the last fold, whose number the
broadcast limit bounds.  When there are more, the positions are written anew with the guesses that
cover each (those that all guesses cover are dropped), and the picks go into a table.  Candidates
stay distributed, a row for each with its gain for every guess and the set of guesses it still lives
for, and are checkpointed once per round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from encircle.functions.numbers import check_parameters, guess_count, percentage
from encircle.operators.grid import BROADCAST_ROWS, CELLS_PER_CIRCLE, circle_grid
from encircle.operators.pairs import (
    Meeting, count_by_circle, count_by_circle_and, meeting, positions, with_circles_at,
)
from encircle.session import cut_lineage, local_frame

#: Candidates per guess settled in one round.
WINDOW = 48

#: Guesses worked on together; a set of them is one BIGINT.  Cell rows of their windows at most.
TOGETHER = 62
WINDOW_ROWS = 2_000_000

TRACE_SCHEMA = pa.schema(
    {
        "guess_j": pa.int32(),
        "tau": pa.float64(),
        "step": pa.int32(),
        "circle_id": pa.int64(),
        "gain": pa.int64(),
        "coverage": pa.int64(),
    }
)


def growth(k: int, epsilon: float) -> list[float]:
    """``(1 + epsilon)^j`` for every guess; the one place where it is worked out."""
    return [(1 + epsilon) ** j for j in range(guess_count(k, epsilon))]


def ladder(best_coverage: int, k: int, epsilon: float) -> list[tuple[int, float]]:
    """The guesses ``(j, tau_j)``."""
    return [(j, (factor * best_coverage) / (2 * k)) for j, factor in enumerate(growth(k, epsilon))]


def threshold_ladder(best: DataFrame, k: int, epsilon: float) -> DataFrame:
    """``guess_j, tau`` for the coverage in a ``best_single`` row: the numbers of :func:`ladder`."""
    factors = F.array(*[F.lit(factor) for factor in growth(k, epsilon)])
    guesses = best.where("coverage > 0").select("coverage", F.posexplode(factors).alias("guess_j", "factor"))
    return guesses.select("guess_j", (F.col("factor") * F.col("coverage") / F.lit(float(2 * k))).alias("tau"))


@dataclass
class _Guess:
    """Progress of one threshold guess."""

    j: int
    tau: float
    picks: list[tuple] = field(default_factory=list)  # since the last fold: (circle_id, cx, cy, r, gain)
    folded: int = 0  # picks before, and what they cover
    folded_coverage: int = 0

    @property
    def selected(self) -> int:
        return self.folded + len(self.picks)

    @property
    def coverage(self) -> int:
        return self.folded_coverage + sum(pick[4] for pick in self.picks)

    def trace_rows(self) -> Iterator[tuple]:
        coverage = self.folded_coverage
        for step, pick in enumerate(self.picks, start=self.folded + 1):
            coverage += pick[4]
            yield (self.j, self.tau, step, pick[0], pick[4], coverage)

    def fold(self) -> None:
        self.folded, self.folded_coverage = self.selected, self.coverage
        self.picks = []


@dataclass(frozen=True)
class CoverRun:
    """A finished run over the ladder."""

    trace: DataFrame  #: one row per pick of every guess that was needed
    guesses: list[tuple[int, float]]  #: the guesses that were needed, with their thresholds
    total_points: int
    k: int
    epsilon: float


def run_cover(
    points: DataFrame,
    circles: DataFrame,
    k: int,
    epsilon: float,
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
) -> CoverRun:
    """Run the whole ladder.  Guesses after the first one that covers all points are left out."""
    check_parameters(k, epsilon)
    spark = points.sparkSession
    placed = positions(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        candidates = circles.select("circle_id", "cx", "cy", "r")
        met = meeting(placed, candidates)
        gains = cut_lineage(count_by_circle(placed, candidates, "gain", broadcast_rows, met=met))
        best = gains.agg(F.max("gain")).first()[0] or 0
        guesses = [_Guess(j, tau) for j, tau in ladder(best, k, epsilon)] if best > 0 else []
        parts = _run(spark, placed, met, gains, guesses, k, window, broadcast_rows)
        total_points = placed.agg(F.sum("w")).first()[0] or 0
    finally:
        placed.unpersist()
    needed = _until_full(guesses, total_points)
    return CoverRun(
        _trace(spark, needed, parts), [(g.j, g.tau) for g in needed], total_points, k, epsilon
    )


def greedy_cover(
    points: DataFrame, circles: DataFrame, k: int, epsilon: float, **options
) -> DataFrame:
    """Trace of the whole ladder, see :func:`run_cover`."""
    return run_cover(points, circles, k, epsilon, **options).trace


def greedy_threshold(
    points: DataFrame,
    circles: DataFrame,
    k: int,
    threshold: float,
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Trace of a single pass with a fixed threshold."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    spark = points.sparkSession
    placed = positions(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        candidates = circles.select("circle_id", "cx", "cy", "r")
        met = meeting(placed, candidates)
        gains = cut_lineage(count_by_circle(placed, candidates, "gain", broadcast_rows, met=met))
        guess = _Guess(0, float(threshold))
        parts = _run(spark, placed, met, gains, [guess], k, window, broadcast_rows)
    finally:
        placed.unpersist()
    return _trace(spark, [guess], parts)


def best_guess(trace: DataFrame) -> DataFrame:
    """``guess_j, selected, coverage`` of the best guess; the lowest j among equals.

    An empty trace stands for the empty solution: guess 0, nothing selected, nothing covered.
    """
    per_guess = trace.groupBy("guess_j").agg(
        F.count("*").alias("selected"), F.sum("gain").alias("coverage")
    )
    # ordered by coverage, then by -j: the lowest guess wins a tie
    rank = F.struct(F.col("coverage"), (-F.col("guess_j")).alias("neg_j"), F.col("selected"))
    return per_guess.agg(F.max(rank).alias("b")).select(
        F.coalesce(-F.col("b.neg_j"), F.lit(0)).alias("guess_j"),
        F.coalesce("b.selected", F.lit(0)).alias("selected"),
        F.coalesce("b.coverage", F.lit(0)).alias("coverage"),
    )


def solution_from(trace: DataFrame, circles: DataFrame) -> DataFrame:
    """The circles of the best guess, in the order they were picked."""
    best = best_guess(trace).select("guess_j")
    # a trace has at most guesses x k rows
    picked = trace.join(F.broadcast(best), "guess_j")
    return circles.join(F.broadcast(picked), "circle_id").select(
        "guess_j", "step", "circle_id", "cx", "cy", "r", "gain", "coverage"
    )


def greedy_solution(
    points: DataFrame, circles: DataFrame, k: int, epsilon: float, **options
) -> DataFrame:
    """At most k circles that together cover the most points found by the ladder."""
    return solution_from(greedy_cover(points, circles, k, epsilon, **options), circles)


def run_summary(run: CoverRun) -> DataFrame:
    """One row: best guess, circles selected, points covered, total and percent."""
    total = F.lit(run.total_points).cast("bigint")
    return best_guess(run.trace).select(
        "guess_j",
        "selected",
        "coverage",
        total.alias("total_points"),
        percentage(F.col("coverage"), total).alias("coverage_percentage"),
    )


def running_coverage(trace: DataFrame, keys: tuple[str, ...] = ("guess_j",)) -> DataFrame:
    """Step number and cumulative gain, computed from the gains (at most k rows per guess)."""
    order = Window.partitionBy(*keys).orderBy("step")
    cumulative = F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return trace.select(*keys, "step", "circle_id", "gain", cumulative.alias("running_coverage"))


# ---------------------------------------------------------------------------------------------


def _run(
    spark: SparkSession,
    placed: DataFrame,
    met: Meeting,
    gains: DataFrame,
    guesses: list[_Guess],
    k: int,
    window: int,
    broadcast_rows: int,
) -> list[DataFrame]:
    """Settle all guesses; the parts of the trace that were written on the way.

    They do not depend on each other, so any grouping will do.  A group's windows are broadcast
    whatever the limit for tables that grow, so they have a limit of their own.
    """
    size = max(1, min(TOGETHER, WINDOW_ROWS // (CELLS_PER_CIRCLE * window)))
    parts: list[DataFrame] = []
    for start in range(0, len(guesses), size):
        batch = guesses[start : start + size]
        parts += _run_together(spark, placed, met, gains, batch, k, window, broadcast_rows)
    return parts


def _run_together(
    spark: SparkSession,
    placed: DataFrame,
    met: Meeting,
    gains: DataFrame,
    guesses: list[_Guess],
    k: int,
    window: int,
    broadcast_rows: int,
) -> list[DataFrame]:
    uncovered = placed.withColumn("done", F.lit(0).cast("bigint"))
    parts: list[DataFrame] = []
    taus = {bit: guess.tau for bit, guess in enumerate(guesses)}
    alive = _living(
        gains.select(
            "circle_id", "cx", "cy", "r",
            F.array_repeat("gain", len(guesses)).alias("gains"),
            F.lit((1 << len(guesses)) - 1).cast("bigint").alias("live"),
        ),
        {bit: F.col("gains")[bit] >= F.lit(tau) for bit, tau in taus.items()},
    )
    active = dict(enumerate(guesses))
    while True:
        windows = _next_windows(alive, window)
        active = {bit: guess for bit, guess in active.items() if bit in windows}
        if not active:
            return parts
        before = {bit: list(guess.picks) for bit, guess in active.items()}
        regions = _regions(spark, uncovered, {bit: windows[bit] for bit in active}, before)
        for bit, guess in active.items():
            _walk(guess, windows[bit], regions.get(bit, []), k)
        active = {
            bit: guess
            for bit, guess in active.items()
            if guess.selected < k and len(windows[bit]) == window
        }
        if not active:
            return parts
        new = {bit: guess.picks[len(before[bit]):] for bit, guess in active.items()}
        last = {bit: windows[bit][-1][0] for bit in active}
        behind = _living(alive, {bit: F.col("circle_id") > F.lit(end) for bit, end in last.items()})
        before = {bit: before[bit] for bit in active}
        open_taus = {bit: taus[bit] for bit in active}
        alive = cut_lineage(_reduce_gains(spark, uncovered, met, behind, open_taus, new, before, broadcast_rows))
        if CELLS_PER_CIRCLE * sum(len(guess.picks) for guess in guesses) > broadcast_rows:
            uncovered = _fold(spark, uncovered, active)
            parts.append(cut_lineage(_trace(spark, guesses, [])))
            for guess in guesses:
                guess.fold()


def _fold(spark: SparkSession, uncovered: DataFrame, active: dict[int, _Guess]) -> DataFrame:
    """The positions with what the picks so far cover in ``done``; those no open guess misses are dropped."""
    picked = {bit: guess.picks for bit, guess in active.items() if guess.picks}
    grid = circle_grid(_in_use(spark, {}, picked))
    around = uncovered
    if grid.exponents:
        held = with_circles_at(uncovered, grid, ["second"], keep_outside=True)
        around = held.select("x", "y", "w", F.col("done").bitwiseOR(_union("second")).alias("done"))
    every = F.lit(sum(1 << bit for bit in active)).cast("bigint")
    return cut_lineage(around.where(F.col("done").bitwiseAND(every) != every))


def _living(candidates: DataFrame, conditions: dict[int, Column]) -> DataFrame:
    """Candidates that still live for some guess: ``live`` keeps the guesses whose condition holds.

    One row per candidate, whatever the number of guesses it lives for.
    """
    mask = F.lit(0).cast("bigint")
    for bit, condition in conditions.items():
        mask = mask + F.when(condition, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0))
    return candidates.withColumn("live", F.col("live").bitwiseAND(mask)).where("live <> 0")


def _next_windows(alive: DataFrame, window: int) -> dict[int, list[tuple]]:
    """The next candidates of every guess, by ascending id: guesses x window rows at most.

    A task sends on no more than that either: the rank is cut off before the shuffle.
    """
    each = alive.select("circle_id", "cx", "cy", "r", F.explode(_bits(F.col("live"))).alias("bit"))
    rank = F.row_number().over(Window.partitionBy("bit").orderBy("circle_id"))
    rows = each.withColumn("rank", rank).where(F.col("rank") <= window).collect()
    windows: dict[int, list[tuple]] = {}
    for row in sorted(rows, key=lambda row: (row.bit, row.circle_id)):
        windows.setdefault(row.bit, []).append((row.circle_id, row.cx, row.cy, row.r))
    return windows


def _in_use(
    spark: SparkSession, first: dict[int, list[tuple]], second: dict[int, list[tuple]]
) -> DataFrame:
    """The circles some guess uses, with the set of guesses for either role as a bit mask."""
    masks: dict[tuple, list[int]] = {}
    for role, use in enumerate((first, second)):
        for bit, used in use.items():
            for circle in used:
                masks.setdefault(circle[:4], [0, 0])[role] |= 1 << bit
    schema = pa.schema(
        {
            "circle_id": pa.int64(),
            **dict.fromkeys(("cx", "cy", "r"), pa.float64()),
            **dict.fromkeys(("first", "second"), pa.int64()),
        }
    )
    # one partition: a few hundred rows are not worth a shuffle when they are put into cells
    rows = [(*circle, *mask) for circle, mask in masks.items()]
    return local_frame(spark, rows, schema).coalesce(1)


def _union(field: str) -> Column:
    """Union of the masks of all circles around a point."""
    return F.aggregate(
        "inside", F.lit(0).cast("bigint"), lambda mask, circle: mask.bitwiseOR(circle[field])
    )


def _first_only() -> Column:
    """Guesses that have the point in a circle of the first role, in none of the second and not done."""
    covered = _union("second").bitwiseOR(F.col("done"))
    return _union("first").bitwiseAND(F.bitwise_not(covered))


def _bits(mask: Column) -> Column:
    every = F.sequence(F.lit(0), F.lit(TOGETHER - 1))
    return F.filter(every, lambda bit: F.getbit(mask, bit) == 1)


def _regions(
    spark: SparkSession,
    placed: DataFrame,
    windows: dict[int, list[tuple]],
    taken: dict[int, list[tuple]],
) -> dict[int, list[tuple[list[int], int]]]:
    """Per guess: (window circles holding a point, number of such uncovered points)."""
    grid = circle_grid(_in_use(spark, windows, taken))
    around = with_circles_at(placed, grid, ["circle_id", "first", "second"])
    # identical sets are merged before anything is expanded per guess
    regions = around.groupBy("inside", "done").agg(F.sum("w").alias("n"))
    members = F.transform(
        F.filter("inside", lambda circle: F.getbit(circle["first"], F.col("bit")) == 1),
        lambda circle: circle["circle_id"],
    )
    rows = (
        regions.withColumn("bit", F.explode(_bits(_first_only())))
        .groupBy("bit", members.alias("members"))
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    result: dict[int, list[tuple[list[int], int]]] = {}
    for row in rows:
        result.setdefault(row.bit, []).append((row.members, row.n))
    return result


def _walk(
    guess: _Guess, window: list[tuple], regions: list[tuple[list[int], int]], k: int
) -> None:
    """Take the window's candidates in order while their gain reaches the threshold."""
    regions_of: dict[int, list[int]] = {}
    for number, (members, _) in enumerate(regions):
        for circle_id in members:
            regions_of.setdefault(circle_id, []).append(number)
    covered: set[int] = set()
    for circle in window:
        if guess.selected == k:
            return
        fresh = [n for n in regions_of.get(circle[0], ()) if n not in covered]
        gain = sum(regions[n][1] for n in fresh)
        if gain >= guess.tau:
            guess.picks.append((*circle, gain))
            covered.update(fresh)


def _reduce_gains(
    spark: SparkSession,
    placed: DataFrame,
    met: Meeting,
    behind: DataFrame,
    taus: dict[int, float],
    new: dict[int, list[tuple]],
    before: dict[int, list[tuple]],
    broadcast_rows: int,
) -> DataFrame:
    """Candidates that still reach the threshold of an open guess, with their new gains."""
    around = with_circles_at(placed, circle_grid(_in_use(spark, new, before)), ["first", "second"])
    lost = around.select("x", "y", "w", _first_only().alias("lost_to")).where("lost_to <> 0")
    # read three times, and much less than the rows with their gains and conditions
    candidates = cut_lineage(behind.select("circle_id", "cx", "cy", "r"))
    counted = count_by_circle_and(
        ("lost_to",), lost, candidates, "n", broadcast_rows, met=met.of_some(candidates)
    )
    losses = counted.groupBy("circle_id").agg(
        *[F.sum(F.when(F.getbit("lost_to", F.lit(bit)) == 1, F.col("n"))).alias(f"lost{bit}") for bit in taus]
    )
    left = {bit: F.col("gains")[bit] - F.coalesce(F.col(f"lost{bit}"), F.lit(0)) for bit in taus}
    width = max(taus) + 1
    reduced = behind.join(losses, "circle_id", "left").withColumn(
        "gains", F.array(*[left.get(bit, F.lit(0).cast("bigint")) for bit in range(width)])
    )
    reached = {bit: F.col("gains")[bit] >= F.lit(tau) for bit, tau in taus.items()}
    return _living(reduced.select(*behind.columns), reached)


def _until_full(guesses: list[_Guess], total_points: int) -> list[_Guess]:
    for position, guess in enumerate(guesses):
        if guess.coverage == total_points:
            return guesses[: position + 1]
    return guesses


def _trace(spark: SparkSession, guesses: list[_Guess], parts: list[DataFrame]) -> DataFrame:
    """Trace of the given guesses: what was written of it, and the picks since."""
    rows = list(chain.from_iterable(guess.trace_rows() for guess in guesses))
    trace = local_frame(spark, rows, TRACE_SCHEMA)
    wanted = F.col("guess_j").isin([guess.j for guess in guesses])
    for part in parts:
        trace = trace.unionByName(part.where(wanted))
    return trace
