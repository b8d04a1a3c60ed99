import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.text import Policy
from quern.operators import documents
from quern.operators.predicates import comparison, filter_column, identity_comparison, keyset_column, order_columns
from quern.plans.declarations import Declared, Field, Op, Paging, Query, Type, Unit, admitted, problems
from quern.plans.requests import Compare, Request, check, decode_token, encode_token

EVERY = frozenset({Op.EQUAL, Op.NOT_EQUAL, Op.IN, Op.CONTAINS, Op.NOT_CONTAINS, Op.STARTS_WITH})
NUMBER = frozenset({Op.EQUAL, Op.IN, Op.GREATER, Op.GREATER_EQUAL, Op.LESS, Op.LESS_EQUAL})
UNIT = admitted(
    Unit(
        "note",
        (Field("category", Type.STRING), Field("priority", Type.INT32), Field("visible", Type.BOOLEAN), Field("tags", Type.STRING, collection=True)),
        (
            Query("find", {"category": EVERY, "priority": NUMBER, "visible": frozenset({Op.EQUAL}), "tags": frozenset({Op.HAS, Op.HAS_ALL})}, (), disjunction=True),
            Query("latest", {"visible": frozenset({Op.EQUAL})}, (("category", False), ("priority", False)), latest_key="category"),
            Query("cursor", {"category": EVERY}, (("priority", True), ("category", False)), Paging.CURSOR),
            Query("needs", {"category": EVERY}, required=frozenset({"category"})),
        ),
    )
)
ROWS = [
    ("alpha-low", "alpha", 1, True, ["a", "b", "b"]),
    ("alpha-high", "alpha", 3, True, ["a"]),
    ("beta-tie-b", "beta", 2, True, ["b", "c"]),
    ("beta-tie-a", "beta", 2, True, None),
    ("gamma-low", "gamma", 1, False, []),
    ("none", None, None, None, None),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(ROWS, "id string, category string, priority int, visible boolean, tags array<string>").cache()


def found(df, *where, query="find"):
    return {r["id"] for r in documents.selection(df, UNIT, Request(query, where)).collect()}


def test_null_complements(spark):
    df = spark.createDataFrame([("absent", None), ("active", "active"), ("revoked", "revoked")], "id string, status string")
    ids = lambda op, v: {r["id"] for r in df.filter(comparison(Compare("status", op, v), F.col("status"))).collect()}
    assert ids(Op.EQUAL, "active") == {"active"}
    assert ids(Op.NOT_EQUAL, "active") == {"absent", "revoked"}
    assert ids(Op.EQUAL, None) == {"absent"}
    assert ids(Op.NOT_EQUAL, None) == {"active", "revoked"}
    assert ids(Op.IN, []) == set()
    assert ids(Op.IN, ["active", None]) == {"active", "absent"}
    for op, other, v in [(Op.EQUAL, Op.NOT_EQUAL, "active"), (Op.CONTAINS, Op.NOT_CONTAINS, "CT")]:
        assert ids(op, v) | ids(other, v) == {"absent", "active", "revoked"} and not ids(op, v) & ids(other, v)


def test_text_is_literal_and_ignores_case(spark):
    df = spark.createDataFrame([("100%",), ("a_b",), ("Straße",), (None,)], "t string")
    hit = lambda op, v: [r["t"] for r in df.filter(comparison(Compare("t", op, v), F.col("t"))).collect()]
    assert hit(Op.CONTAINS, "%") == ["100%"]
    assert hit(Op.CONTAINS, "_") == ["a_b"]
    assert hit(Op.STARTS_WITH, "STRAß") == ["Straße"]
    assert hit(Op.CONTAINS, "strasse") == []


def test_membership(notes):
    assert found(notes, (Compare("tags", Op.HAS, "b"),)) == {"alpha-low", "beta-tie-b"}
    assert found(notes, (Compare("tags", Op.HAS_ALL, ["b", "a", "b"]),)) == {"alpha-low"}
    with pytest.raises(Declared):
        found(notes, (Compare("tags", Op.HAS_ALL, []),))


def test_typed_members(spark):
    df = spark.createDataFrame([(1, ["1.00"]), (2, ["2.50"])], "id int, v array<string>").withColumn("v", F.col("v").cast("array<decimal(9,2)>"))
    c = comparison(Compare("v", Op.HAS_ALL, ["1", "1.0", "1e0"]), F.col("v"), "decimal(9,2)")
    assert [r["id"] for r in df.filter(c).collect()] == [1]


def test_clauses(notes):
    assert found(notes) == {r[0] for r in ROWS}
    assert found(notes, ()) == set()
    assert found(notes, (Compare("category", Op.EQUAL, "alpha"), Compare("priority", Op.EQUAL, 2)), (Compare("visible", Op.EQUAL, True),)) == {"alpha-low", "alpha-high", "beta-tie-a", "beta-tie-b"}


def test_latest_per_key(notes):
    request = Request("latest", ((Compare("visible", Op.EQUAL, True),),))
    assert [r["id"] for r in documents.page_rows(notes, UNIT, request).collect()] == ["alpha-low", "beta-tie-a"]
    assert documents.count(notes, UNIT, request) == 2
    assert [r["id"] for r in documents.page_rows(notes, UNIT, Request("latest", request.where, skip=1, take=1)).collect()] == ["beta-tie-a"]
    assert documents.count(notes, UNIT, Request("latest")) == 4  # null is a key


def test_cursor_walk_meets_every_row_once(notes):
    seen, after = [], None
    while True:
        page = documents.query_page(notes, UNIT, Request("cursor", take=2, after=after))
        seen += [r["id"] for r in page.rows.collect()]
        after = page.next
        if after is None:
            break
    assert seen == ["alpha-high", "beta-tie-a", "beta-tie-b", "alpha-low", "gamma-low", "none"]
    with pytest.raises(Declared):
        documents.query_page(notes, UNIT, Request("cursor", ((Compare("category", Op.EQUAL, "beta"),),), take=2, after=documents.query_page(notes, UNIT, Request("cursor", take=2)).next))


@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("abc"))), min_size=1, max_size=8), st.booleans(), st.booleans())
@settings(max_examples=8, deadline=None)
def test_keyset_equals_position(spark, rows, d1, d2):
    df = spark.createDataFrame([(*r, f"{i:02d}") for i, r in enumerate(rows)], "x int, y string, id string")
    order = [("x", d1), ("y", d2), ("id", False)]
    ordered = [tuple(r) for r in df.orderBy(*order_columns(order)).collect()]
    k = len(ordered) // 2
    after = df.filter(keyset_column(order, list(ordered[k]))).orderBy(*order_columns(order)).collect()
    assert [tuple(r) for r in after] == ordered[k + 1 :]


def test_take_zero_total_first_any(notes):
    page = documents.query_page(notes, UNIT, Request("find", take=0), total=True)
    assert page.total == 6 and page.rows.count() == 0
    assert documents.first_rows(notes, UNIT, Request("find", skip=2)).first()["id"] == "beta-tie-a"
    assert not documents.any_row(notes, UNIT, Request("find", ((Compare("priority", Op.GREATER, 9),),)))


def test_requests_outside_declarations():
    for bad in [Request("find", ((Compare("priority", Op.CONTAINS, "1"),),)), Request("needs"), Request("latest", (), (("priority", False),)), Request("find", after="qk1.x"), Request("find", take=10_000)]:
        with pytest.raises(Declared):
            check(UNIT, bad)
    wrong = Unit("w", (Field("a", Type.BOOLEAN), Field("j", Type.JSON, collection=True)), (Query("q", {"a": frozenset({Op.LESS}), "id": frozenset({Op.CONTAINS})}, latest_key="a", paging=Paging.CURSOR),))
    assert len(problems(wrong)) == 5
    with pytest.raises(Declared):
        admitted(wrong)


def test_tokens_are_bound_and_checked():
    t = encode_token("f", [1, None, "x"])
    assert decode_token(t, "f") == [1, None, "x"]
    for bad, f in [(t, "g"), (t[:-3] + "AAA", "f"), ("x", "f")]:
        with pytest.raises(Declared):
            decode_token(bad, f)


def test_utf16_order(spark):
    df = spark.createDataFrame([("�",), ("\U0001f600",), ("a",)], "t string")
    assert [r["t"] for r in df.orderBy(text.ordinal_key(F.col("t"))).collect()] == ["a", "\U0001f600", "�"]


@pytest.mark.parametrize("policy", list(Policy))
def test_keys_agree_with_columns(spark, policy):
    words = ["", "Abc", "zZ", "x y~"] + ([] if policy is Policy.ASCII_IGNORE_CASE else ["straße", "ÉÀ", "ǆ", "\U0001f600", "ŉ"])
    df = spark.createDataFrame([(w,) for w in words], "t string")
    rows = df.select("t", text.comparison_key(F.col("t"), policy).alias("k")).collect()
    assert all(r["k"] == text.key_of(r["t"], policy) for r in rows)
    assert text.key_of("straße", Policy.UNICODE_IGNORE_CASE) == text.key_of("STRAßE", Policy.UNICODE_IGNORE_CASE)


def test_ascii_policy_refuses_others(spark):
    with pytest.raises(Exception, match="not printable ASCII"):
        spark.createDataFrame([("é",)], "t string").select(text.comparison_key(F.col("t"), Policy.ASCII_IGNORE_CASE)).collect()


def test_identity(spark):
    df = spark.createDataFrame([("Ab",), ("aB",), ("b",)], "id string")
    ask = lambda op, v, p: sorted(r["id"] for r in df.filter(identity_comparison(Compare("id", op, v), F.col("id"), p)).collect())
    assert ask(Op.EQUAL, "ab", Policy.UNICODE_IGNORE_CASE) == ["Ab", "aB"]
    assert ask(Op.EQUAL, "Ab", Policy.ORDINAL) == ["Ab"]
    assert ask(Op.STARTS_WITH, "", Policy.ORDINAL) == ["Ab", "aB", "b"]
    with pytest.raises(Declared):
        ask(Op.CONTAINS, "a", Policy.ORDINAL)


def test_scopes(spark):
    unit = admitted(Unit("s", (Field("v", Type.INT32),), (Query("all", {"v": NUMBER}),), scoped=True))
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2)], "id string, storage_scope string, v int")
    assert documents.count(df, unit, Request("all"), scope="a") == 1
    assert documents.count(df, unit, Request("all"), across=True) == 2
    with pytest.raises(PermissionError):
        documents.count(df, unit, Request("all"))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id string, category string, priority int, visible boolean, tags array<string>").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = documents.explain(df.filter(filter_column(UNIT, ((Compare("priority", Op.GREATER, 1),),))).select("id"))
    assert "GreaterThan(priority,1)" in plan and "category" not in plan.split("ReadSchema")[1]
