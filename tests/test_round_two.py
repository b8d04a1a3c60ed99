"""Mutated documents, reducers compared by keys, bounds of pages, idempotent trims, whole commits, exact projections."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from quern.functions import documents as json_documents
from quern.functions import values
from quern.functions.text import Policy, key_of
from quern.operators import documents, mutations, reduction
from quern.operators.streams import Is
from quern.plans.declarations import Declared, Field, Mutation, Op, Profile, Query, Reducer, Stream, StreamField, Type, Unit
from quern.plans.requests import Compare, Request
from quern.sources.commits import CommitLog, Conflict
from quern.sources.documents import DocumentStore, Refused, UnitOfWork
from quern.sources.evolution import project
from quern.sources.records import RecordStore, Rejected

T0 = dt.datetime(2026, 7, 12, 12, 0, 1, tzinfo=dt.UTC)
EQ = frozenset({Op.EQUAL})
TICKET = Unit(
    "ticket",
    (Field("status", Type.STRING), Field("rank", Type.INT32)),
    (Query("open", {"status": EQ}, (("rank", False),)),),
    (Mutation("close", "open", "transition", "status", "done", ("new",)), Mutation("rerank", "open", "assign", "rank", 9)),
)
NEW = Request("open", ((Compare("status", Op.EQUAL, "new"),),))


def test_mutations_write_the_document(spark, tmp_path):
    now = [T0]
    store = DocumentStore(spark, str(tmp_path), [TICKET], clock=lambda: now[0])
    store.save_json("ticket", {"a": {"status": "new", "rank": 1, "price": 1.10}, "b": {"status": "old", "rank": 2}})
    now[0] = T0 + dt.timedelta(hours=1)
    assert store.mutate("ticket", "rerank", NEW, "op-0") == (1, False)
    assert store.mutate("ticket", "close", NEW, "op-1") == (1, False)
    assert store.load_json("ticket", "a") == {"status": "done", "rank": 9, "price": 1.1} and store.load_json("ticket", "b") == {"status": "old", "rank": 2}
    a, b = store.load("ticket", "a"), store.load("ticket", "b")
    assert (a["status"], a["rank"], a["version"], b["version"]) == ("done", 9, 3, 1)
    assert a["updated_utc"] - b["updated_utc"] == dt.timedelta(hours=1) and a["created_utc"] == b["created_utc"]
    filled = project(store.read("ticket").drop("status"), TICKET.field("status"))  # a backfill finds what the column says
    assert {r["id"]: r["status"] for r in filled.collect()} == {"a": "done", "b": "old"}
    assert "status" in mutations.explain_mutation(store.read("ticket"), TICKET, "close", NEW)


def test_members_of_documents():
    assert json_documents.with_member('{"a":1.10,"n":12345678901234567890.5,"o":{"x":[1.0]}}', "o.y.z", "v") == '{"a":1.10,"n":12345678901234567890.5,"o":{"x":[1.0],"y":{"z":"v"}}}'
    assert json_documents.with_member('{"a":"\ue000x","b":0.5}', "b", None) == '{"a":"\ue000x","b":null}'
    assert json_documents.with_member("[1]", "a", 2) == "[1]"


def test_set_member_of_columns(spark):
    df = spark.createDataFrame([('{"a":1}',), (None,)], "document string")
    for value, want in ((decimal.Decimal("1.50"), '{"a":1.50}'), (T0, '{"a":"2026-07-12T12:00:01+00:00"}'), (True, '{"a":true}')):
        assert [r[0] for r in df.select(json_documents.set_member(F.col("document"), "a", value)).collect()] == [want, None]


def test_first_document_and_loads_of_a_unit_of_work(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path), [TICKET])
    assert store.first_json("ticket", NEW) is None
    store.save_json("ticket", {"a": {"status": "new", "rank": 2}, "b": {"status": "new", "rank": 1}})
    assert store.first_json("ticket", NEW) == {"status": "new", "rank": 1}
    work = UnitOfWork(store)
    assert work.load("ticket", "a")["rank"] == 2
    store.save_json("ticket", {"a": {"status": "new", "rank": 7}})
    assert work.load("ticket", "a")["rank"] == 2 and store.load("ticket", "a")["rank"] == 7
    work.rollback()
    with pytest.raises(Refused):
        work.load("ticket", "a")


LOGS = Stream("logs", (StreamField("service", Type.STRING, policy=Policy.ASCII_IGNORE_CASE), StreamField("tags", Type.STRING, multiple=True, policy=Policy.ASCII_IGNORE_CASE), StreamField("sequence", Type.INT64)), high_water="sequence")
BY_SERVICE = Profile("p", "service", (Reducer("tags", "union", "tags"), Reducer("first_tag", "first", "service", ("sequence", False)), Reducer("n", "sum", "sequence")), frozenset({"n", "first_tag"}), max_union=2)


def groups_of(spark, rows, bounded=False):
    df = spark.createDataFrame(rows, "cursor long, service string, tags array<string>, sequence long").withColumn("occurred_at", F.current_timestamp())
    return reduction.reduce_groups(df, LOGS, BY_SERVICE, bounded=bounded)


def test_reducers_compare_by_their_policy(spark):
    groups = groups_of(spark, [(1, "b", ["Blue"], 1), (2, "A", ["red"], 2), (3, "C", None, 3)])
    page = lambda where=None, order="n", **more: [r["group_value"] for r in reduction.group_page(groups, LOGS, BY_SERVICE, order, where=where, **more).collect()]
    assert page(Is("tags", "in", ("BLUE",))) == ["b"] and page(Is("tags", "contains", ("LU",))) == ["b"] and page(Is("tags", "contains", ("",))) == ["b", "A"]
    assert page(Is("first_tag", "equal", ("a",))) == ["A"] and page(Is("first_tag", "between", ("a", "B"))) == ["b", "A"]
    assert page(order="first_tag") == ["A", "b", "C"] and page(order="first_tag", after=reduction.GroupAfter("a", key_of("a", Policy.ASCII_IGNORE_CASE))) == ["b", "C"]
    for bad in (Is("n", "contains", ("1",)), Is("n", "like", (1,)), Is("tags", "in", ()), Is("nope", "equal", (1,)), Is("n", "between", (2, 1))):
        with pytest.raises(Declared):
            page(bad)


def test_unions_are_bounded_where_a_page_returns_them(spark):
    rows = [(1, "small", ["x"], 1), (2, "large", ["a", "b", "c"], 2)]
    groups = groups_of(spark, rows)
    assert [r["tags"] for r in reduction.group_page(groups, LOGS, BY_SERVICE, "n", take=1).collect()] == [["x"]]
    assert [r["group_value"] for r in reduction.group_page(groups, LOGS, BY_SERVICE, "n", where=Is("n", "between", (0, 1))).collect()] == ["small"]
    with pytest.raises(Exception, match="more than 2 values"):
        reduction.group_page(groups, LOGS, BY_SERVICE, "n").collect()
    with pytest.raises(Exception, match="more than 2 values"):
        groups_of(spark, rows, bounded=True).collect()


def test_trims_are_idempotent(spark, tmp_path):
    now = [T0]
    store = RecordStore(spark, str(tmp_path), LOGS, clock=lambda: now[0])
    records = lambda ids: spark.createDataFrame([(i, T0, "{}", i, int(i)) for i in ids], "record_id string, occurred_at timestamp, payload string, service string, sequence long")
    store.append("t", "s", records("123"), T0, "a1")
    assert store.trim("t", "s", 1, T0, "t1") == store.trim("t", "s", 1, T0, "t1").__class__(2, 3)
    store.append("t", "s", records("45"), T0, "a2")
    again = store.trim("t", "s", 1, T0, "t1")
    assert (again.rows, again.last_cursor, again.replayed) == (2, 3, True) and store.read("t", "s").count() == 3
    with pytest.raises(Rejected):
        store.trim("t", "s", 2, T0, "t1")
    with pytest.raises(Rejected):
        store.trim("t", "s", 1, T0 - dt.timedelta(days=2), "t2")
    assert tuple(store.statistics("t", "s").first()) == (3, 5, 5, 5)
    assert store.trim("t", "s", 0, T0, "t3").rows == 3 and tuple(store.statistics("t", "s").first()) == (0, None, 5, 5)
    now[0] = T0 + dt.timedelta(days=5)
    with pytest.raises(Rejected):  # the ledger is gone by then, and so is the admission
        store.trim("t", "s", 1, T0, "t1")


def test_tenants_and_scopes_are_kept_apart(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path), LOGS, clock=lambda: T0)
    one = spark.createDataFrame([("1", T0, "{}")], "record_id string, occurred_at timestamp, payload string")
    store.append("a/scope=b", "c", one, T0, "n")
    assert store.read("a", "b/scope=c").count() == 0 and store.read("a/scope=b", "c").count() == 1


def test_commits_are_whole(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.commit(-1, {"x": 1}) == 0
    (tmp_path / "_log" / "abc.draft").write_text("{")  # of a writer that died
    assert log.latest() == (0, {"x": 1}) and log.commit(0, {"x": 2}) == 1
    with pytest.raises(Conflict):
        log.commit(0, {"x": 3})
    claim = tmp_path / "_log" / f"{2:020d}.claim"
    claim.write_text("")
    with pytest.raises(Conflict):
        log.commit(1, {"x": 3})
    import os

    os.utime(claim, (1, 1))
    assert log.commit(1, {"x": 3}) == 2 and log.latest() == (2, {"x": 3})
    assert sorted(p.name for p in (tmp_path / "_log").iterdir() if not p.name.startswith(".")) == ["00000000000000000000.json", "00000000000000000001.json", "00000000000000000002.json", "abc.draft"]


def test_wide_decimals_and_instants(spark):
    df = spark.createDataFrame([("1234567890123456789012345",), ("1.50",), ("1e2",), ("1.05",), ("x",)], "t string")
    assert [r[0] for r in df.select(values.exact_decimal(F.col("t"), 38, 1)).collect()] == [decimal.Decimal("1234567890123456789012345.0"), decimal.Decimal("1.5"), decimal.Decimal("100.0"), None, None]
    deep = spark.createDataFrame([("0.12345678901234567891",)], "t string")
    assert deep.select(values.exact_decimal(F.col("t"), 38, 20)).first()[0] == decimal.Decimal("0.12345678901234567891")
    at = spark.createDataFrame([('{"at":"2026-01-02T03:04:05.1234567+02:00"}',), ('{"at":"2026-01-02T03:04:05"}',), ('{"at":"2026-01-02"}',)], "document string")
    got = [r[0] for r in project(at, Field("at", Type.DATETIME)).select(F.unix_micros("at")).collect()]
    assert got == [int(dt.datetime(2026, 1, 2, 1, 4, 5, 123456, dt.UTC).timestamp() * 10**6 + 0.5), None, None]


def test_members_of_collections_are_typed(spark):
    unit = Unit("u", (Field("xs", Type.DECIMAL, collection=True, precision=10, scale=2),), (Query("q", {"xs": frozenset({Op.HAS, Op.HAS_ALL})}),))
    df = spark.createDataFrame([("a", [decimal.Decimal("1.00"), decimal.Decimal("2.50")]), ("b", [decimal.Decimal("3.00")])], "id string, xs array<decimal(10,2)>")
    asked = lambda op, v: [r["id"] for r in documents.page_rows(df, unit, Request("q", ((Compare("xs", op, v),),))).collect()]
    assert asked(Op.HAS, 1) == ["a"] and asked(Op.HAS_ALL, [1, 2.5, 1.0]) == ["a"] and asked(Op.HAS, 7) == []
