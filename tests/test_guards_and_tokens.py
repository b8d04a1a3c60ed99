"""Guarded deletions, and continuation tokens of stream and group pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.functions.text import Policy
from quern.operators import documents, joins, mutations, reduction, streams
from quern.operators.streams import Is
from quern.plans.declarations import OCCURRED, Declared, Field, Mutation, NoReferences, Op, Paging, Profile, Query, Reducer, RelatedNotEqual, Stream, StreamField, Type, Unit, compose
from quern.plans.requests import Compare, Request
from quern.sources.documents import DocumentStore, Save

T0 = dt.datetime(2026, 7, 12, 12, 0, 1, tzinfo=dt.UTC)
EQ = frozenset({Op.EQUAL})


def unit(name, fields, guards, **more):
    return Unit(name, tuple(Field(f, Type.STRING) for f in fields), (Query("find", {"state": EQ}),), (Mutation("drop", "find", "delete", guards=guards),), **more)


BOX = unit("box", ("state",), (NoReferences("item", "box"),), id_policy=Policy.ASCII_IGNORE_CASE, scoped=True)
ITEM = unit("item", ("state", "box"), (RelatedNotEqual("box", "box", "state", "kept"),), scoped=True)
OLD = Request("find", ((Compare("state", Op.EQUAL, "old"),),))


def test_guarded_deletions(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path), [BOX, ITEM], clock=lambda: T0)
    box = lambda i, state, scope="s": Save(i, "{}", {"state": state}, scope=scope)
    item = lambda i, state, at, scope="s": Save(i, "{}", {"state": state, "box": at}, scope=scope)
    store.write({
        "box": [box("A", "old"), box("b", "old"), box("c", "kept"), box("d", "new"), box("e", None), box("b", "old", "other")],
        "item": [item("1", "new", "a"), item("2", "new", "a"), item("3", "old", "c"), item("4", "old", "D"), item("5", "old", None), item("6", "old", "zz"), item("7", "old", "e"), item("8", "new", "b", "other"), item("9", "new", None)],
    })
    left = lambda u, scope: sorted(r["id"] for r in store.read(u).filter(F.col("storage_scope") == scope).collect())
    assert store.mutate("box", "drop", OLD, "op-1", "s") == (1, False)  # b alone: A is referred to in another spelling, the reference to b is of another scope
    assert left("box", "s") == ["A", "c", "d", "e"] and left("box", "other") == ["b"]
    assert store.mutate("item", "drop", OLD, "op-2", "s") == (2, False)  # 4 and 7: 3 is in a kept box, 5 and 6 in none
    assert left("item", "s") == ["1", "2", "3", "5", "6", "9"] and left("item", "other") == ["8"]
    assert store.mutate("item", "drop", OLD, "op-2", "s") == (2, True)
    assert store.read("box").columns == DocumentStore(spark, str(tmp_path), [BOX, ITEM]).read("box").columns
    with pytest.raises(Declared):
        mutations.mutate(store.read("box"), BOX, "drop", OLD, "s")  # without the rows of items


def test_a_unit_can_guard_itself(spark):
    node = unit("node", ("state", "parent"), (NoReferences("node", "parent"),))
    df = spark.createDataFrame([("1", "old", None), ("2", "old", "1"), ("3", "new", "2"), ("4", "old", "4")], "id string, state string, parent string")
    out = mutations.mutate(df, node, "drop", OLD, related={"node": (node, df)})
    assert out.columns == df.columns and sorted(r["id"] for r in out.collect()) == ["1", "2", "3", "4"]
    assert mutations.affected(df, node, "drop", OLD, related={"node": (node, df.filter("id <> '2'"))}) == 1
    assert "Join" in mutations.explain_mutation(df, node, "drop", OLD, related={"node": (node, df)})


def test_guards_are_checked():
    for bad in (
        (BOX,),
        (BOX, Unit("item", (Field("box", Type.INT64),), scoped=True)),
        (unit("box", ("state",), (NoReferences("item", "box"),)), unit("item", ("state", "box"), (), scoped=True)),
        (Unit("x", (Field("state", Type.STRING),), (Query("find", {"state": EQ}),), (Mutation("m", "find", "assign", "state", "z", guards=(NoReferences("x", "state"),)),)),),
        (unit("x", ("state",), (RelatedNotEqual("nope", "x", "state", "z"),)),),
    ):
        with pytest.raises(Declared):
            compose(bad)


LOGS = Stream("logs", (StreamField("service", Type.STRING, policy=Policy.ASCII_IGNORE_CASE, orderable=True), StreamField("n", Type.INT64, orderable=True), StreamField("tags", Type.STRING, multiple=True)))
BY = Profile("by service", "service", (Reducer("total", "sum", "n"), Reducer("last", "max_instant", "occurred_at"), Reducer("tags", "union", "tags")), frozenset({"total", "last"}), max_take=5, max_union=2)


def logs(spark, n):
    i = F.col("id")
    return spark.range(1, n + 1).select(i.alias("cursor"), F.timestamp_seconds(1_700_000_000 + i % 7).alias("occurred_at"), F.concat(F.lit("s"), (i % 6).cast("string")).alias("service"), F.when(i % 5 != 0, i % 4).alias("n"), F.array(F.concat(F.lit("t"), (i % 2).cast("string"))).alias("tags"))


@pytest.mark.parametrize("asked", [{}, {"descending": True}, {"order": "n"}, {"order": "service", "descending": True}, {"order": OCCURRED}, {"latest": None, "where": Is("n", "in", (1, 2)), "order": "n", "descending": True}])
def test_stream_tokens(spark, asked):
    first, grown = logs(spark, 40), logs(spark, 60)
    want = [r["cursor"] for r in streams.stream_page(first, LOGS, **asked, limit=100).collect()]
    page, got = streams.query_stream(first, LOGS, **asked, limit=9), []
    while True:
        got += [r["cursor"] for r in page.rows.collect()]
        assert page.snapshot == 40
        if page.next is None:
            break
        page = streams.query_stream(grown, LOGS, **asked, limit=9, after=page.next)  # later records stay out
    assert got == want


def test_stream_tokens_belong_to_their_query(spark):
    df = logs(spark, 30)
    token = streams.query_stream(df, LOGS, order="n", limit=5).next
    for other in ({"order": "n", "descending": True}, {"order": "service"}, {"order": "n", "where": Is("n", "equal", (1,))}, {}):
        with pytest.raises(Declared):
            streams.query_stream(df, LOGS, **other, limit=5, after=token)
    with pytest.raises(Declared):
        streams.query_stream(df, LOGS, order="n", limit=5, after=token[:-2])
    assert streams.query_stream(df.limit(0), LOGS, limit=5).next is None and streams.query_stream(df, LOGS, limit=30).next is None
    assert streams.query_stream(df, LOGS, limit=1000).next is None  # the largest limit has a probe beyond it
    with pytest.raises(Declared):
        streams.query_stream(df, LOGS, limit=1001)


@pytest.mark.parametrize(("order", "descending"), [("total", False), ("total", True), ("last", True)])
def test_group_tokens(spark, order, descending):
    first, grown = logs(spark, 40), logs(spark, 60)
    everything = reduction.group_page(reduction.reduce_groups(first.filter("cursor > 10 AND n > 0"), LOGS, BY), LOGS, BY, order, descending, take=5).collect()
    asked = {"order": order, "descending": descending, "take": 2, "matching": Is("n", "in", (1, 2, 3)), "input_limit": 30}
    page, got = reduction.query_groups(first, LOGS, BY, **asked), []
    while True:
        got += page.rows.collect()
        assert page.snapshot == 40
        if page.next is None:
            break
        page = reduction.query_groups(grown, LOGS, BY, **asked, after=page.next)
    assert got[:5] == everything and len(got) == 6


def test_group_tokens_belong_to_their_query(spark):
    df, asked = logs(spark, 40), {"order": "total", "take": 2, "input_limit": 30}
    token = reduction.query_groups(df, LOGS, BY, **asked).next
    for other in ({"order": "last"}, {"descending": True}, {"where": Is("total", "between", (0, 99))}, {"matching": Is("n", "equal", (1,))}):
        with pytest.raises(Declared, match="another query"):
            reduction.query_groups(df, LOGS, BY, **(asked | other), after=token)
    with pytest.raises(Declared, match="input limit"):
        reduction.query_groups(df, LOGS, BY, **(asked | {"input_limit": 20}), after=token)
    with pytest.raises(Declared):
        reduction.query_groups(df, LOGS, BY, order="total", take=6)
    assert reduction.query_groups(df.limit(0), LOGS, BY, **asked).rows.count() == 0


def test_only_groups_of_a_page_are_held_to_the_bound(spark):
    df = spark.createDataFrame([(1, "a", 1, ["x"]), (2, "b", 2, ["x", "y", "z"]), (3, "c", 3, None)], "cursor long, service string, n long, tags array<string>").withColumn("occurred_at", F.current_timestamp())
    page = reduction.query_groups(df, LOGS, BY, "total", take=1)
    assert [r["tags"] for r in page.rows.collect()] == [["x"]] and page.next is not None
    with pytest.raises(Exception, match="more than 2 values"):
        reduction.query_groups(df, LOGS, BY, "total", take=1, after=page.next)
    with pytest.raises(Exception, match="more than 2 values"):
        reduction.query_groups(df, LOGS, BY, "total", take=5)


PAGED = Unit("paged", (Field("rank", Type.INT32), Field("state", Type.STRING)), (Query("by rank", {"state": EQ}, (("rank", True),), Paging.CURSOR, max_take=4),))


def test_pages_by_cursor_end(spark):
    df = spark.createDataFrame([(str(i), None if i % 4 == 0 else i % 3, "new" if i < 9 else "old") for i in range(12)], "id string, rank int, state string")
    where, got, token = ((Compare("state", Op.EQUAL, "new"),),), [], None
    for size in (4, 4, 1):
        page = documents.query_page(df, PAGED, Request("by rank", where, take=4, after=token))
        got, token = got + [r["id"] for r in page.rows.collect()], page.next
        assert len(got) % 4 == size % 4 and (token is None) == (size == 1)
    assert got == [r["id"] for r in df.filter("state = 'new'").orderBy(F.col("rank").desc_nulls_last(), "id").collect()]
    moved = Unit("paged", PAGED.fields, (Query("by rank", {"state": EQ}, (("rank", False),), Paging.CURSOR, max_take=4),))
    token = documents.query_page(df, PAGED, Request("by rank", where, take=4)).next
    with pytest.raises(Declared):  # the token's boundary is one of another order
        documents.page_rows(df, moved, Request("by rank", where, take=4, after=token))


def test_hydrated_pages_keep_their_order(spark):
    df = spark.createDataFrame([(str(i), i % 5, "new") for i in range(20)], "id string, rank int, state string")
    request = Request("by rank", ((Compare("state", Op.EQUAL, "new"),),), take=4)
    page = documents.page_rows(df.select("id", "rank", "state"), PAGED, request)
    assert [r["id"] for r in joins.hydrate(page.select("id"), df, order=documents.page_order(PAGED, request)).collect()] == [r["id"] for r in page.collect()]
