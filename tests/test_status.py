import json

from frames import rows

from encircle.operators import status


def snapshots(spark, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    return spark.createDataFrame(list(enumerate(texts)), "snapshot_id BIGINT, json STRING")


FULL = {
    "status": "ALIVE", "cores": 8, "coresused": 4, "memory": 100, "memoryused": 30,
    "workers": [
        {"id": "w", "host": "h", "port": 1, "cores": 3, "coresused": 2, "memory": 1000,
         "memoryused": 810, "state": "ALIVE"},
        {},
    ],
    "activeapps": [
        {"name": "other", "cores": 1, "state": "RUNNING", "starttime": 0},
        {"name": "me", "cores": 2, "state": "WAITING", "starttime": 130_500},
        {"name": "me", "cores": 2, "state": "RUNNING", "starttime": 190_999},
    ],
}


def test_workers_and_defaults(spark):
    frame = snapshots(spark, FULL, {}, "no json", {"workers": []})
    assert rows(status.worker_rows(frame)) == [
        (0, 0, "w", "h", 1, 3, 2, 1000, 810, "ALIVE"),
        (0, 1, "", "", 0, 0, 0, 0, 0, "UNKNOWN"),
    ]
    assert rows(status.worker_utilisation(frame)) == [
        (0, 0, "h", 66.7, 81.0, "warning", "danger", True),
        (0, 1, "", 0.0, 0.0, "success", "success", False),
    ]


def test_totals(spark):
    frame = snapshots(spark, FULL, {"cores": None})
    assert rows(status.cluster_totals(frame)) == [
        (0, "ALIVE", 8, 4, 100, 30, 2, 3, 0),
        (1, "UNKNOWN", 0, 0, 0, 0, 0, 0, 0),
    ]
    ended = snapshots(spark, {"completedapps": [{"name": "a"}, {"name": "b", "state": "FINISHED"}]})
    assert [r.n_completed for r in status.cluster_totals(ended).collect()] == [2]


def test_headline_follows_the_first_application_of_the_name(spark):
    def apps(*named):
        return {"activeapps": [{"name": name, "state": state} for name, state in named]}

    frame = snapshots(
        spark, apps(("other", "RUNNING"), ("me", "WAITING"), ("me", "RUNNING")), apps(("me", "RUNNING")),
        apps(("other", "RUNNING")), apps(("me", None), ("me", "RUNNING")), {}, "no json",
    )
    assert [tuple(r)[1:] for r in status.cluster_headline(frame, "me").orderBy("snapshot_id").collect()] == [
        ("WAITING", "WAITING FOR RESOURCES..."), ("RUNNING", "CLUSTER RUNNING"), *[(None, None)] * 4,
    ]


def test_active_apps(spark):
    found = rows(
        status.active_apps(snapshots(spark, FULL, {}), "me", 191_000),
        "position", "name", "elapsed", "is_mine",
    )
    assert found == [
        (0, "other", "3m 11s", False), (1, "me", "1m 0s", True), (2, "me", "0s", False)
    ]


def test_each_document_is_parsed_once(spark):
    frame = snapshots(spark, FULL)
    for report in (status.worker_utilisation, status.cluster_totals):
        plan = report(frame)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json") == 1


def test_severity_bands(spark):
    from pyspark.sql import functions as F

    values = spark.createDataFrame([(v,) for v in (0.0, 50.0, 50.1, 80.0, 80.1)], "v DOUBLE")
    bands = [r[0] for r in values.select(status.severity(F.col("v"))).collect()]
    assert bands == ["success", "success", "warning", "warning", "danger"]
