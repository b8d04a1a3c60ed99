import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.functions.text import Policy
from quern.operators import reduction, streams
from quern.operators.bounds import newest_bound
from quern.operators.streams import After, All, Any, Is
from quern.plans.declarations import Declared, Profile, Reducer, Stream, StreamField, Type

T0 = dt.datetime(2026, 7, 12, 12, 0, 1)
LOGS = Stream(
    "logs",
    (
        StreamField("sequence", Type.INT64, orderable=True),
        StreamField("category", Type.STRING, orderable=True),
        StreamField("service", Type.STRING, policy=Policy.ASCII_IGNORE_CASE, orderable=True, latest=True),
        StreamField("tags", Type.STRING, multiple=True, policy=Policy.ASCII_IGNORE_CASE),
        StreamField("unicode", Type.STRING, policy=Policy.UNICODE_IGNORE_CASE, latest=True),
    ),
    max_limit=100,
    high_water="sequence",
)
SUMMARY = Profile(
    "service summary",
    "service",
    (
        Reducer("start", "min_instant", "occurred_at"),
        Reducer("end", "max_instant", "occurred_at"),
        Reducer("n", "sum", "sequence"),
        Reducer("tags", "union", "tags"),
        Reducer("status", "max", "sequence"),
        Reducer("root", "first", "category", ("sequence", False)),
    ),
    frozenset({"start", "end", "status"}),
    input_limit=100,
    max_union=8,
)
SCHEMA = "cursor long, record_id string, occurred_at timestamp_ntz, service string, sequence long, category string, tags array<string>, unicode string"
ROWS = [
    (1, "api-1", T0, "API", 1, None, ["blue", "shared"], "Straße"),
    (2, "api-2", T0 + dt.timedelta(seconds=2), "api", 2, "later", ["green", "SHARED"], "STRAßE"),
    (3, "worker-1", T0 + dt.timedelta(seconds=1), "worker", 3, "worker-root", ["red"], None),
    (4, "bare", T0, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def cursors(df, **asked):
    return [r["cursor"] for r in streams.stream_page(df, LOGS, **asked).collect()]


def test_predicates(logs):
    assert cursors(logs, where=Is("service", "equal", ("Api",))) == [1, 2]
    assert cursors(logs, where=Is("tags", "in", ("shared",))) == [1, 2]
    assert cursors(logs, where=Is("tags", "contains", ("EE",))) == [2]
    assert cursors(logs, where=Is("category", "contains", ("",))) == [2, 3]
    assert cursors(logs, where=Is("sequence", "between", (2, 3))) == [2, 3]
    assert cursors(logs, where=Is("unicode", "equal", ("straße",))) == [1, 2]
    assert cursors(logs, where=Is("occurred_at", "between", (T0, T0 + dt.timedelta(seconds=1)))) == [1, 3, 4]
    assert cursors(logs, where=All((Any((Is("service", "equal", ("worker",)), Is("sequence", "equal", (1,)))), Is("tags", "in", ("blue", "red"))))) == [1, 3]


def test_contains_keeps_to_units(spark):
    df = spark.createDataFrame([(1, "r", T0, "x", 1, "ぁ䄀", None, None)], SCHEMA)
    assert cursors(df, where=Is("category", "contains", ("䅁",))) == []  # 3041 4100 has 4141 only across its units


def test_order_snapshot_and_pages(logs):
    assert cursors(logs, order="sequence", descending=True) == [3, 2, 1]
    assert cursors(logs, order="sequence", limit=2, after=After(3, 1, 1)) == [2, 3]
    assert cursors(logs, snapshot=2) == [1, 2]
    assert cursors(logs, descending=True, after=After(4, 3)) == [2, 1]


def test_latest(logs):
    assert cursors(logs, latest="service") == [2, 3]
    assert cursors(logs, latest="service", order="category") == [2, 3]
    assert streams.exact_count(logs, LOGS, latest="service").first()["n"] == 2


def test_refusals(logs):
    for p in [All(()), Is("sequence", "between", (3, 1)), Is("sequence", "contains", ("1",)), Is("service", "in", ()), Is("nope", "equal", (1,))]:
        with pytest.raises(Declared):
            cursors(logs, where=p)
    with pytest.raises(Declared):
        cursors(logs, limit=0)
    with pytest.raises(Declared):
        cursors(logs, latest="category")


def test_statistics_and_trim(logs):
    assert tuple(streams.statistics(logs, LOGS).first()) == (4, 4, 3)
    assert {r["cursor"] for r in streams.keep_newest(logs, 2).collect()} == {3, 4}
    assert streams.keep_newest(logs, 0).count() == 0
    assert streams.keep_newest(logs, 9).count() == 4


def test_bound_by_histogram(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.bounds.SMALL", 3)
    df = spark.range(0, 90_000, 7).select((F.col("id") * F.col("id")).alias("cursor"))
    held = sorted((r["cursor"] for r in df.collect()), reverse=True)
    for n in (1, 3, 4, 100, 5000):
        assert newest_bound(df, n) == held[n - 1]
    assert newest_bound(df, len(held)) is None


def test_grouped_reduction(logs):
    groups = reduction.reduce_groups(logs, LOGS, SUMMARY)
    rows = reduction.group_page(groups, LOGS, SUMMARY, "start", where=Is("status", "between", (2, 3))).collect()
    api, worker = rows
    assert (api["group_value"], api["start"], api["end"], api["n"], api["tags"], api["status"], api["root"]) == ("API", T0, T0 + dt.timedelta(seconds=2), 3, ["blue", "green", "shared"], 2, None)
    assert (worker["group_value"], worker["n"], worker["tags"], worker["status"], worker["root"]) == ("worker", 3, ["red"], 3, "worker-root")
    after = reduction.GroupAfter(T0, api["group_key"])
    assert [r["group_value"] for r in reduction.group_page(groups, LOGS, SUMMARY, "start", after=after).collect()] == ["worker"]


def test_reduction_window_and_bounds(logs, spark):
    small = reduction.reduce_groups(logs, LOGS, SUMMARY, snapshot=3, input_limit=1).collect()
    assert [r["group_value"] for r in small] == ["worker"]
    many = spark.createDataFrame([(i, str(i), T0, "s", i, None, [f"t{i}"], None) for i in range(1, 11)], SCHEMA)
    with pytest.raises(Exception, match="more than 8 values"):
        reduction.reduce_groups(many, LOGS, SUMMARY).collect()
    huge = spark.createDataFrame([(i, str(i), T0, "s", 2**62, None, [], None) for i in range(1, 4)], SCHEMA)
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow|out of range"):
        reduction.reduce_groups(huge, LOGS, SUMMARY).collect()
    with pytest.raises(Declared):
        reduction.reduce_groups(logs, LOGS, SUMMARY, input_limit=101)


def test_first_by_descending_breaks_ties_by_cursor(spark):
    p = Profile("p", "service", (Reducer("f", "first", "category", ("sequence", True)),), frozenset({"f"}))
    df = spark.createDataFrame([(1, "a", T0, "s", 5, "one", None, None), (2, "b", T0, "s", 5, "two", None, None), (3, "c", T0, "s", None, "three", None, None)], SCHEMA)
    assert reduction.reduce_groups(df, LOGS, p).first()["f"] == "one"


def test_one_aggregation(logs):
    p = Profile("p", "service", tuple(r for r in SUMMARY.reducers if r.kind != "union"), SUMMARY.orderable)
    plan = reduction.reduce_groups(logs, LOGS, p)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
