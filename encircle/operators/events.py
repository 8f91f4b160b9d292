"""Run events: segments, the latest run, per-guess series and the current state of every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encircle.operators.skew import hot_keys, sliced_join
from encircle.session import cut_lineage

#: Consecutive sequence numbers handled by one task.
BUCKET = 1_000_000
#: Buckets whose totals are broadcast (about 100 bytes each); more are shuffled with the log.
BROADCAST_BUCKETS = 200_000
_BUCKET_KEY = ["_log", "_no_log", "_bucket"]

RUN_EVENT_SCHEMA = (
    "run_id BIGINT, seq BIGINT, type STRING, message STRING, total_guesses INT, value INT, "
    "threshold DOUBLE, gain BIGINT, coverage BIGINT, step INT, best_guess INT, n_selected INT, "
    "total_points BIGINT, coverage_percentage DOUBLE"
)


def segment_by_marker(
    events: DataFrame,
    key: str,
    seq: str,
    marker: Column,
    counted: Column | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """Append ``segment``, the number of markers seen so far in the log of ``key``.

    With ``counted``, also append ``position``: how many counted rows the segment holds so far.

    One log may hold a large share of all events, so it is cut into buckets of consecutive
    sequence numbers, and rows are numbered inside their bucket.  What a log's earlier buckets
    contribute is known before that: partial sums, which leave every task as one row per bucket,
    show the logs of several buckets, and a look at these gives what each bucket hands on.  So the
    log itself is shuffled and sorted once, for the numbering.  Rows with a null key form one log;
    rows with a null sequence number come before all others of their log.
    """
    counted = F.lit(False) if counted is None else counted
    flagged = events.withColumns(
        {
            "_log": F.coalesce(F.col(key).cast("string"), F.lit("")),
            "_no_log": F.col(key).isNull(),  # no nulls in what is joined: equal means equal
            "_bucket": F.coalesce(F.floor(F.col(seq) / F.lit(bucket)), F.lit(-(1 << 63))),
            "_marker": F.coalesce(marker, F.lit(False)).cast("bigint"),
            "_counted": F.coalesce(counted, F.lit(False)).cast("bigint"),
        }
    )
    handed = _handed_on(flagged, seq)
    within = Window.partitionBy(*_BUCKET_KEY).orderBy(seq)
    numbered = (
        (flagged if handed is None else flagged.join(handed, _BUCKET_KEY, "left"))
        .withColumns({"_segments": F.sum("_marker").over(within), "_seen": F.sum("_counted").over(within)})
        .withColumn("_start", F.max(F.when(F.col("_marker") == 1, F.col("_seen"))).over(within))
    )
    earlier, open_ = (
        F.lit(0).cast("bigint") if handed is None else F.coalesce(c, F.lit(0)) for c in ("_earlier", "_open")
    )
    # rows in front of the first marker of their bucket go on counting
    position = F.coalesce(F.col("_seen") - F.col("_start"), F.col("_seen") + open_)
    return numbered.select(
        *events.columns, (F.col("_segments") + earlier).alias("segment"), position.alias("position")
    )


def _handed_on(flagged: DataFrame, seq: str) -> DataFrame | None:
    """For every bucket with one before it: the markers ``_earlier`` in its log, and the rows counted
    since the last of them (``_open``).  None where every log has a single bucket.

    ``flagged`` is read twice, without a shuffle of its rows while the buckets of logs that have
    several fit a broadcast, whose number is measured.
    """
    log = Window.partitionBy("_log", "_no_log")
    totals = flagged.groupBy(*_BUCKET_KEY).agg(
        F.sum("_marker").alias("_markers"),
        F.sum("_counted").alias("_all"),
        F.max(F.when(F.col("_marker") == 1, F.col(seq))).alias("_last"),
    )
    several = cut_lineage(totals.withColumn("_buckets", F.count("*").over(log)).where("_buckets > 1"))
    rows = several.count()
    if not rows:
        return None
    small = rows <= BROADCAST_BUCKETS
    # equal sequence numbers are numbered alike, so only later ones come after the marker
    marked = several.where("_markers > 0").select(*_BUCKET_KEY, "_last")
    after = flagged.where("_counted = 1").select(*_BUCKET_KEY, F.col(seq).alias("_seq")).join(
        F.broadcast(marked) if small else marked, _BUCKET_KEY
    )
    tails = after.where(F.col("_seq") > F.col("_last")).groupBy(*_BUCKET_KEY).agg(F.count("*").alias("_tail"))
    upto = log.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    before = log.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = several.join(tails, _BUCKET_KEY, "left").withColumn("_upto", F.sum("_all").over(upto))
    at_marker = F.when(F.col("_markers") > 0, F.col("_upto") - F.coalesce("_tail", F.lit(0)))
    handed = summed.withColumn("_marked", at_marker).select(
        *_BUCKET_KEY,
        F.sum("_markers").over(before).alias("_earlier"),
        (F.max("_upto").over(before) - F.coalesce(F.max("_marked").over(before), F.lit(0))).alias("_open"),
    ).where("_earlier is not null")
    return F.broadcast(handed) if small else handed


def latest_run(events: DataFrame, key: str, seq: str, marker: Column) -> DataFrame:
    """Every log from its last marker on (included); the whole log when it has none.

    Rows with a null key form one log.  Rows with a null sequence number come before all others:
    they belong to logs without a marker, or whose markers have no number either.
    """
    last = events.groupBy(key).agg(
        F.max(F.when(marker, F.col(seq))).alias("_from"),
        F.count("*").alias("_n"),
    )
    hot = hot_keys(last, [key], "_n")
    joined = sliced_join(events, last.select(key, "_from"), [key], hot, (seq,))
    kept = F.col("_from").isNull() | (F.col(seq) >= F.col("_from"))
    return joined.where(kept).select(*events.columns)


def guess_series(events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Gain, threshold and coverage per step, guess by guess.

    A new series starts at INIT and START_GUESS.  The step is the reported one, or the position
    in the series where none is reported.
    """
    starts = F.col("type").isin("INIT", "START_GUESS")
    added = F.col("type") == "CIRCLE_ADDED"
    segmented = segment_by_marker(events, "run_id", "seq", starts, added, bucket)
    return segmented.where(added).select(
        "run_id",
        F.col("segment").alias("series"),
        "seq",
        F.coalesce(F.col("step").cast("bigint"), "position").alias("step"),
        "position",
        "gain",
        "threshold",
        "coverage",
    )


def _reports(events: DataFrame) -> dict[str, Column]:
    """Every metric of a run: the value an event reports, null where it reports none."""
    kind = F.col("type")
    guess, added, final, status, done = (
        kind == name
        for name in ("START_GUESS", "CIRCLE_ADDED", "FINAL_SOLUTION", "STATUS", "FINISHED")
    )
    final_text = F.concat(
        F.lit("BEST: Guess "), (F.col("best_guess") + 1).cast("string"),
        F.lit(" | "), F.col("n_selected").cast("string"),
        F.lit(" circles → "), F.col("coverage").cast("string"), F.lit(" pts"),
    )
    text = (
        F.when(status, F.col("message"))
        .when(guess, F.concat(F.lit("GUESS "), (F.col("value") + 1).cast("string")))
        .when(final, final_text)
        .when(done, F.lit("DONE"))
    )
    return {
        "size": F.when(added, F.col("step")).when(final, F.col("n_selected")),
        "coverage": F.when(added | final, F.col("coverage")),
        "guess_j": F.when(guess, F.col("value")),
        "threshold": F.when(guess | added, F.col("threshold")),
        "total_guesses": F.col("total_guesses"),
        "status_text": text,
        "best_guess": F.when(final, F.col("best_guess")),
        "coverage_percentage": F.when(final, F.col("coverage_percentage")),
        "last_init": F.when(kind == "INIT", F.col("seq")),
        "last_final": F.when(final, F.col("seq")),
        "last_finished": F.when(done, F.col("seq")),
        "last_seq": F.col("seq"),
    }


def run_state(events: DataFrame) -> DataFrame:
    """``run_id`` and what is known of each run: a few values, each with its sequence number.

    States of any parts of a log merge (:func:`merged_states`), in any order and however often a
    part is repeated.  The sequence numbers of additions without a step, and of what starts a set
    anew, are kept: the rule of a run bounds them by guesses x k and by its guesses.
    """
    unsized = (F.col("type") == "CIRCLE_ADDED") & F.col("step").isNull()
    starts = F.col("type").isin("INIT", "START_GUESS")

    def numbers(condition: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(condition, F.col("seq"))))

    return events.groupBy("run_id").agg(
        *[
            F.max(F.when(value.isNotNull() & F.col("seq").isNotNull(), F.struct("seq", value.alias("value")))).alias(name)
            for name, value in _reports(events).items()
        ],
        numbers(unsized).alias("unsized"),
        numbers(starts).alias("starts"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One state per run out of any number of them."""
    lists = ("unsized", "starts")
    return states.groupBy("run_id").agg(
        *[F.max(c).alias(c) for c in states.columns if c != "run_id" and c not in lists],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
    )


def snapshot_of(states: DataFrame) -> DataFrame:
    """Current state of every run: each metric is its last reported value.

    ``k`` is the step of the last addition or the size of a later final set.  Additions without a
    step are counted on from the last step, final set or start of a set in front of them.
    """
    last = F.array_max("unsized")
    started = F.array_max(F.filter("starts", lambda s: s < last))
    sized = F.when(F.col("size.seq") < last, F.col("size.seq"))
    base = F.greatest(started, sized)  # nulls give way
    counted = F.size(F.filter("unsized", lambda s: (s > base) | base.isNull()))
    before = F.when(sized.isNotNull() & (sized == base), F.col("size.value")).otherwise(F.lit(0))
    reported_later = last.isNull() | F.coalesce(F.col("size.seq") > last, F.lit(False))
    k = F.when(reported_later, F.col("size.value")).otherwise((before + counted).cast("int"))
    others = [c for c in states.columns if c not in ("run_id", "size", "unsized", "starts")]
    return states.select("run_id", k.alias("k"), *[F.col(f"{c}.value").alias(c) for c in others])


def run_snapshot(events: DataFrame) -> DataFrame:
    """Current state of every run, see :func:`snapshot_of`; rows without a number report nothing."""
    return snapshot_of(run_state(events))


def run_setup(events: DataFrame) -> DataFrame:
    """Configuration, bounds and sampling of the last INIT of every run, as columns.

    ``events`` are trace events (``sources/trace.py``).  A run that was not sampled shows all its
    points: 100 percent.
    """
    last = F.max(F.when(F.col("type") == "INIT", F.struct("seq", "config", "bounds", "sampling", "total_guesses")))
    sampled = F.coalesce("i.sampling.is_sampled", F.lit(False))
    shown = F.col("i.config.n_points")
    total = F.when(sampled, F.col("i.sampling.total")).otherwise(shown)
    displayed = F.when(sampled, F.col("i.sampling.displayed")).otherwise(shown)
    label = F.when(
        sampled, F.concat(F.format_number(total, 0), F.lit(" ("), F.format_number(displayed, 0), F.lit(" shown)"))
    ).otherwise(F.format_number(shown, 0))
    return events.groupBy("run_id").agg(last.alias("i")).where("i is not null").select(
        "run_id",
        "i.config.n_circles",
        "i.config.k",
        "i.config.epsilon",
        "i.total_guesses",
        *[F.col(f"i.bounds.{side}{axis}").alias(f"{side}_{axis.lower()}") for side in ("min", "max") for axis in "XY"],
        sampled.alias("is_sampled"),
        displayed.alias("displayed"),
        total.alias("total"),
        F.when(sampled, F.col("i.sampling.percentage")).otherwise(F.lit(100.0)).alias("percentage"),
        label.alias("points_label"),
    )


def run_display(snapshot: DataFrame) -> DataFrame:
    """Display fields of a run snapshot: 1-based guess, 2-decimal threshold, coverage, headline, state.

    Once there is a final solution, its percentage stands behind the coverage.
    """
    start = F.coalesce("last_init", F.lit(-1))
    finished = F.coalesce(F.col("last_finished") > start, F.lit(False))
    has_final = F.coalesce(F.col("last_final") > start, F.lit(False))
    guess = F.coalesce(F.when(has_final, F.col("best_guess")), F.col("guess_j"))
    percent = F.regexp_replace(F.format_string("%.1f", "coverage_percentage"), r"\.0$", "")
    covered = F.col("coverage").cast("string")
    return snapshot.select(
        "run_id",
        (guess + 1).alias("guess_number"),
        F.when(
            F.col("threshold").isNotNull(), F.format_string("%.2f", "threshold")
        ).alias("threshold_text"),
        F.when(
            has_final & F.col("coverage_percentage").isNotNull(),
            F.concat(covered, F.lit(" ("), percent, F.lit("%)")),
        ).otherwise(covered).alias("coverage_text"),
        F.when(
            has_final & F.col("coverage_percentage").isNotNull(),
            F.concat(F.lit("FINAL SOLUTION: "), percent, F.lit("% Coverage")),
        )
        .when(finished, F.lit("OPTIMIZATION COMPLETE"))
        .otherwise(F.lit("SYSTEM CONNECTED"))
        .alias("headline"),
        F.when(finished, F.lit("DONE"))
        .when(F.col("last_init").isNotNull(), F.lit("RUNNING"))
        .otherwise(F.lit("IDLE"))
        .alias("state"),
    )
