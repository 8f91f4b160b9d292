import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from encircle.operators import events
from encircle.streaming import snapshot

FIELDS = [part.strip().split()[0] for part in events.RUN_EVENT_SCHEMA.split(",")]


def run_log(spark, entries):
    full = [tuple({"run_id": 1, **entry}.get(name) for name in FIELDS) for entry in entries]
    return spark.createDataFrame(full, events.RUN_EVENT_SCHEMA)


def random_log(seed, runs=4, length=120):
    rng = random.Random(seed)
    entries = []
    for run in range(runs):
        for seq in range(rng.randrange(length)):
            kind = rng.choice(
                ["INIT", "STATUS", "START_GUESS", "CIRCLE_ADDED", "FINAL_SOLUTION", "FINISHED"]
            )
            entry = {"run_id": run, "seq": seq, "type": kind}
            number = rng.randrange(50)
            if kind == "STATUS":
                entry |= {"message": f"m{number}", "total_guesses": rng.choice([None, number])}
            if kind == "START_GUESS":
                entry |= {"value": number, "threshold": number / 4}
            if kind == "CIRCLE_ADDED":
                entry |= {"gain": number, "coverage": number * 3, "threshold": number / 4,
                          "step": rng.choice([None, number])}
            if kind == "FINAL_SOLUTION":
                entry |= {"best_guess": number, "n_selected": 3, "coverage": number,
                          "total_points": 100, "coverage_percentage": float(number)}
            entries.append(entry)
    return entries


@pytest.mark.parametrize("bucket, limit", [(3, 10**5), (3, 0), (17, 10**5), (10**6, 10**5)])
def test_segments_in_buckets(spark, monkeypatch, bucket, limit):
    monkeypatch.setattr(events, "BROADCAST_BUCKETS", limit)
    log = random_log(1)
    marker, counted = F.col("type") == "INIT", F.col("type") == "CIRCLE_ADDED"
    found = events.segment_by_marker(run_log(spark, log), "run_id", "seq", marker, counted, bucket)
    want, state = [], {}
    for entry in log:
        segment, position = state.get(entry["run_id"], (0, 0))
        if entry["type"] == "INIT":
            segment, position = segment + 1, 0
        position += entry["type"] == "CIRCLE_ADDED"
        state[entry["run_id"]] = segment, position
        want.append((entry["run_id"], entry["seq"], segment, position))
    assert rows(found, "run_id", "seq", "segment", "position") == sorted(want)


def exchanges_of_rows(frame):
    """Shuffles of the log's own rows; those of one row per bucket leave partial sums."""
    plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    return [
        line for line, below in zip(plan, plan[1:])
        if "Exchange hashpartitioning" in line and "functions=" not in below
    ]


@pytest.mark.parametrize("bucket, limit", [(5, 10**5), (5, 0), (10**6, 10**5)])
def test_the_log_is_shuffled_once(spark, monkeypatch, tmp_path, bucket, limit):
    monkeypatch.setattr(events, "BROADCAST_BUCKETS", limit)
    run_log(spark, random_log(1)).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    starts = F.col("type") == "INIT"
    found = events.segment_by_marker(log, "run_id", "seq", starts, F.col("type") == "CIRCLE_ADDED", bucket)
    wide = [line for line in exchanges_of_rows(found) if "_bucket" in line and "_log" in line]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the log's scan with all its columns appears once, below one exchange
    assert sum("message" in line for line in plan.splitlines() if "FileScan" in line) == 1
    assert wide


@pytest.mark.parametrize("bucket", [5, 10**6])
def test_guess_series(spark, bucket):
    log = random_log(2)
    found = events.guess_series(run_log(spark, log), bucket)
    want, state = [], {}
    for entry in log:
        series, step = state.get(entry["run_id"], (0, 0))
        if entry["type"] in ("INIT", "START_GUESS"):
            series, step = series + 1, 0
        if entry["type"] == "CIRCLE_ADDED":
            step += 1
            reported = step if entry["step"] is None else entry["step"]
            want.append((entry["run_id"], series, reported, entry["gain"], entry["coverage"]))
        state[entry["run_id"]] = series, step
    assert rows(found, "run_id", "series", "step", "gain", "coverage") == sorted(want)


def test_null_keys_and_numbers_keep_their_rows(spark):
    log = [(1, 5, "b"), (1, None, "a"), (1, 6, "m"), (None, 1, "m"), (None, 2, "b"), (None, None, "b"), (2, None, "b")]
    frame = spark.createDataFrame(log, "run BIGINT, seq BIGINT, type STRING")
    marker = F.col("type") == "m"
    found = events.segment_by_marker(frame, "run", "seq", marker, F.col("type") == "b", bucket=2)
    got = {(r.run, r.seq): (r.segment, r.position) for r in found.collect()}
    assert got == {
        (1, None): (0, 0), (1, 5): (0, 1), (1, 6): (1, 0),
        (None, None): (0, 1), (None, 1): (1, 0), (None, 2): (1, 1), (2, None): (0, 1),
    }
    latest = events.latest_run(frame, "run", "seq", marker).collect()
    assert {(r.run, r.seq) for r in latest} == {(1, 6), (None, 1), (None, 2), (2, None)}
    empty = events.segment_by_marker(frame.limit(0), "run", "seq", marker)
    assert empty.count() == 0


def test_latest_run(spark):
    log = [e for e in random_log(3) if e["run_id"] != 2 or e["type"] != "INIT"]
    log += [{"run_id": 9, "seq": s, "type": "STATUS"} for s in range(400)]  # hot, no marker
    frame = run_log(spark, log)
    found = events.latest_run(frame, "run_id", "seq", F.col("type") == "INIT")
    want = []
    for run in {e["run_id"] for e in log}:
        kept = []
        for entry in (e for e in log if e["run_id"] == run):
            kept = [] if entry["type"] == "INIT" else kept
            kept.append((run, entry["seq"]))
        want += kept
    assert rows(found, "run_id", "seq") == sorted(want)


def test_snapshot_and_display(spark):
    log = [
        {"seq": 0, "type": "INIT", "total_guesses": 14},
        {"seq": 1, "type": "STATUS", "message": "go"},
        {"seq": 2, "type": "START_GUESS", "value": 0, "threshold": 1.5},
        {"seq": 3, "type": "CIRCLE_ADDED", "gain": 5, "coverage": 5, "threshold": 1.5, "step": 1},
        {"seq": 4, "type": "START_GUESS", "value": 1, "threshold": 2.25},
    ]
    now = events.run_snapshot(run_log(spark, log)).first()
    assert (now.k, now.coverage, now.guess_j, now.threshold) == (1, 5, 1, 2.25)
    assert (now.status_text, now.total_guesses) == ("GUESS 2", 14)
    shown = events.run_display(events.run_snapshot(run_log(spark, log))).first()
    assert (shown.guess_number, shown.threshold_text, shown.state) == (2, "2.25", "RUNNING")
    log += [
        {"seq": 5, "type": "FINAL_SOLUTION", "best_guess": 0, "n_selected": 1, "coverage": 5,
         "total_points": 10, "coverage_percentage": 50.0},
        {"seq": 6, "type": "FINISHED"},
    ]
    frame = events.run_snapshot(run_log(spark, log))
    done, shown = frame.first(), events.run_display(frame).first()
    assert done.status_text == "DONE" and done.coverage == 5
    assert shown.headline == "FINAL SOLUTION: 50% Coverage"
    assert (shown.guess_number, shown.state) == (1, "DONE")
    log += [{"seq": 7, "type": "INIT"}]
    again = events.run_display(events.run_snapshot(run_log(spark, log))).first()
    assert (again.headline, again.state) == ("SYSTEM CONNECTED", "RUNNING")


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(4)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    frame = run_log(spark, log)

    def arrive(part):
        part.repartition(3).write.mode("append").json(source)

    arrive(frame.where("seq % 2 = 1"))
    for _ in range(2):  # the second round restarts from the checkpoint with late events
        stream = snapshot.read_event_stream(spark, source, files_per_trigger=2)
        snapshot.start_snapshots(stream, out, checkpoint).awaitTermination()
        arrive(frame.where("seq % 2 = 0"))
    stream = snapshot.read_event_stream(spark, source)
    snapshot.start_snapshots(stream, out, checkpoint).awaitTermination()
    batch = events.run_snapshot(spark.read.schema(events.RUN_EVENT_SCHEMA).json(source))
    got = snapshot.current_snapshots(spark, out)

    def plain(rs):
        return sorted(map(str, rs.select(*batch.columns).collect()))

    assert plain(got) == plain(batch)


def test_stream_without_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = snapshot.stream_snapshot(snapshot.read_event_stream(spark, str(tmp_path / "in")))
    assert found.columns == events.run_snapshot(run_log(spark, [])).columns
    assert found.count() == 0


def k_of(log):
    """Size of the shown set: counted as it is drawn, a reported step overrules."""
    size, shown = 0, None
    for entry in sorted(log, key=lambda e: e["seq"]):
        kind = entry["type"]
        if kind in ("INIT", "START_GUESS"):
            size = 0
        if kind == "CIRCLE_ADDED":
            size = shown = size + 1 if entry.get("step") is None else entry["step"]
        if kind == "FINAL_SOLUTION":
            size = shown = entry["n_selected"]
    return shown


def test_additions_without_step_are_counted(spark):
    log = [{"seq": 1, "type": "START_GUESS"}, {"seq": 2, "type": "CIRCLE_ADDED"}, {"seq": 3, "type": "CIRCLE_ADDED"}]
    assert events.run_snapshot(run_log(spark, log)).first().k == 2
    log = random_log(7, runs=12)
    want = {run: k_of([e for e in log if e["run_id"] == run]) for run in {e["run_id"] for e in log}}
    frame = run_log(spark, log)
    assert {r.run_id: r.k for r in events.run_snapshot(frame).collect()} == want
    # states of any parts merge, also of parts that overlap
    parts = [events.run_state(frame.where(f"seq % 3 {c}")) for c in ("= 0", "< 2", "> 0")]
    states = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = events.snapshot_of(events.merged_states(states))
    plain = events.run_snapshot(frame)
    assert sorted(map(str, merged.collect())) == sorted(map(str, plain.select(merged.columns).collect()))


def test_coverage_text(spark):
    log = [{"seq": 1, "type": "CIRCLE_ADDED", "coverage": 7}]
    assert events.run_display(events.run_snapshot(run_log(spark, log))).first().coverage_text == "7"
    log += [{"seq": 2, "type": "FINAL_SOLUTION", "coverage": 9, "coverage_percentage": 45.0, "n_selected": 2, "best_guess": 1}]
    assert events.run_display(events.run_snapshot(run_log(spark, log))).first().coverage_text == "9 (45%)"


def test_buckets_hold_one_version_and_late_events_count(spark, tmp_path):
    out = str(tmp_path / "out")
    log = random_log(9, runs=9)
    frame = run_log(spark, log)
    snapshot.fold(frame.where("seq >= 40"), 0, out, buckets=4)
    snapshot.fold(frame.where("seq < 40 and run_id < 3"), 1, out, buckets=4)
    late = frame.where("seq < 50 and run_id >= 3")
    snapshot.fold(late, 2, out, buckets=4)
    current = snapshot._current(spark, out)
    snapshot.fold(late, 3, out, buckets=4)  # the same events again
    folders = [p for p in (tmp_path / "out").glob("v=*/bucket=*")]
    assert len(folders) == len(current) <= 4  # what was replaced is gone
    got = snapshot.current_snapshots(spark, out)
    assert got.count() == len({e["run_id"] for e in log})
    want = events.run_snapshot(frame)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_a_version_without_its_mark_does_not_count(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = run_log(spark, random_log(10, runs=3))
    snapshot.fold(frame, 0, out, buckets=1)
    want = sorted(map(str, snapshot.current_snapshots(spark, out).collect()))
    broken = tmp_path / "out" / "v=1" / "bucket=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert sorted(map(str, snapshot.current_snapshots(spark, out).collect())) == want
