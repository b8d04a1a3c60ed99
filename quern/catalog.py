"""The registered queries of the engine over the driver's tables, and the SQL that DuckDB checks them by.

orders, part, customer, documents with labels, and daily event types of users act as document units; events is the
record stream: event_id is its cursor and record id, ts the instant, value in hundredths its 64-bit field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text, values
from quern.functions.text import Policy
from quern.operators import documents, joins, mutations, predicates, reduction, streams
from quern.operators.streams import After, All, Any, Is
from quern.plans.declarations import Field, Mutation, NoReferences, Op, Paging, Profile, Query, Reducer, RelatedNotEqual, Stream, StreamField, Type, Unit, admitted, compose
from quern.plans.requests import Compare, Request, encode_token, request_fingerprint
from quern.sources import evolution

RANGES = frozenset({Op.EQUAL, Op.NOT_EQUAL, Op.IN, Op.GREATER, Op.GREATER_EQUAL, Op.LESS, Op.LESS_EQUAL})
TEXTS = frozenset({Op.EQUAL, Op.NOT_EQUAL, Op.IN, Op.CONTAINS, Op.NOT_CONTAINS, Op.STARTS_WITH})

ORDER = admitted(
    Unit(
        "order",
        (Field("status", Type.STRING), Field("priority", Type.STRING), Field("customer", Type.INT64), Field("total", Type.DECIMAL, precision=18, scale=2), Field("placed", Type.DATETIME)),
        (
            Query("by total", {"status": TEXTS, "priority": TEXTS, "total": RANGES, "customer": RANGES}, (("total", True),), disjunction=True, max_take=100_000),
            Query("all", {"status": TEXTS, "priority": TEXTS, "total": RANGES, "customer": RANGES}, (), disjunction=True, max_take=1_000_000),
            Query("mixed", {"status": TEXTS}, (("status", False), ("total", True)), max_take=1000),
            Query("cursor", {"status": TEXTS}, (("total", True),), Paging.CURSOR),
            Query("residual", {"status": TEXTS, "priority": TEXTS}, (("total", True),), required=frozenset({"priority"})),
            Query("latest", {"status": TEXTS}, (("customer", False), ("placed", True)), latest_key="customer", max_take=1_000_000),
        ),
        (
            Mutation("drop", "all", "delete"),
            Mutation("assign", "all", "assign", "priority", "9-NONE"),
            Mutation("close", "all", "transition", "status", "F", ("O", "P")),
        ),
    )
)
PART = admitted(Unit("part", (Field("name", Type.STRING), Field("kind", Type.STRING), Field("brand", Type.STRING), Field("size", Type.INT32)), (Query("find", {"name": TEXTS, "kind": TEXTS, "brand": TEXTS, "size": RANGES}, max_take=1_000_000),)))
CUSTOMER = admitted(Unit("customer", (Field("segment", Type.STRING),), (Query("by id", {"id": frozenset({Op.EQUAL, Op.IN, Op.NOT_EQUAL, Op.STARTS_WITH, Op.GREATER_EQUAL, Op.LESS}), "segment": TEXTS}, max_take=1_000_000),), id_policy=Policy.ASCII_IGNORE_CASE))
LABELLED = admitted(
    Unit(
        "labelled",
        (Field("quality", Type.INT32), Field("toxic", Type.INT32), Field("lang", Type.STRING), Field("text", Type.STRING)),
        (Query("find", {"quality": RANGES, "toxic": RANGES, "lang": TEXTS, "text": TEXTS}, max_take=1_000_000), Query("by quality", {"quality": RANGES}, (("quality", False),), Paging.CURSOR, max_take=1_000_000)),
    )
)
BUYER, PURCHASE = compose(
    (
        Unit("buyer", (Field("segment", Type.STRING),), (Query("find", {"segment": TEXTS}),), (Mutation("drop", "find", "delete", guards=(NoReferences("purchase", "buyer"),)),)),
        Unit("purchase", (Field("buyer", Type.STRING), Field("status", Type.STRING)), (Query("find", {"status": TEXTS}),), (Mutation("drop", "find", "delete", guards=(RelatedNotEqual("buyer", "buyer", "segment", "BUILDING"),)),)),
    )
)
DAILY = admitted(Unit("daily", (Field("types", Type.STRING, collection=True),), (Query("find", {"types": frozenset({Op.HAS, Op.HAS_ALL})}, max_take=1_000_000),)))
LINE = admitted(Unit("line", (Field("quantity", Type.INT64), Field("price", Type.INT64)), (Query("scan", {"quantity": RANGES}, max_take=100_000_000), Query("rank", {"quantity": RANGES}, (("price", True),)))))

EVENTS = Stream(
    "events",
    (StreamField("user", Type.STRING, latest=True, orderable=True), StreamField("kind", Type.STRING, policy=Policy.ASCII_IGNORE_CASE, latest=True, orderable=True), StreamField("sequence", Type.INT64, orderable=True), StreamField("tags", Type.STRING, multiple=True, policy=Policy.ASCII_IGNORE_CASE), StreamField("some_kind", Type.STRING, policy=Policy.ASCII_IGNORE_CASE)),
    max_limit=100_000,
    high_water="sequence",
)
_REDUCERS = {
    "started": Reducer("started", "min_instant", "occurred_at"),
    "ended": Reducer("ended", "max_instant", "occurred_at"),
    "total": Reducer("total", "sum", "sequence"),
    "largest": Reducer("largest", "max", "sequence"),
    "kinds": Reducer("kinds", "union", "kind"),
    "first_kind": Reducer("first_kind", "first", "some_kind", ("sequence", False)),
    "last_kind": Reducer("last_kind", "first", "some_kind", ("sequence", True)),
}


def profile(*aliases: str) -> Profile:
    chosen = aliases or tuple(_REDUCERS)
    return Profile("by user", "user", tuple(_REDUCERS[a] for a in chosen), frozenset(chosen) - {"kinds"}, max_take=1000)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    total = F.round(F.col("o_totalprice"), 2).cast("decimal(18,2)")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), total.alias("total"), F.col("o_orderdate").alias("placed"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("segment"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return d.select("doc_id", "lang", "text").join(lab.select("doc_id", "quality", "toxic"), "doc_id", "left").withColumn("id", F.col("doc_id").cast("string"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    per = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return per.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("id"), "types")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("cursor"), F.col("event_id").cast("string").alias("record_id"), F.col("ts").alias("occurred_at"), F.col("user_id").cast("string").alias("user"), kind.alias("kind"),
        F.nullif(kind, F.lit("view")).alias("some_kind"), F.round(F.col("value") * 100).cast("long").alias("sequence"), F.array(kind, F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))).alias("tags"), F.col("props").alias("payload"),
    )


def _c(path: str, op: Op, value: object = None) -> tuple[Compare, ...]:
    return (Compare(path, op, value),)


def _doc(unit: Unit, source: Callable, query: str, *where: tuple[Compare, ...], columns: tuple[str, ...], skip: int = 0, take: int | None = None, all_rows: bool = False):
    """A document query that returns a page, or all selected rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        request, df = Request(query, where, None, skip, take), source(spark, sf_dir)
        rows = documents.selection(df, unit, request) if all_rows else documents.page_rows(df, unit, request)
        return rows.select(*columns)

    return run


def _all(unit: Unit, source: Callable, query: str, *where: tuple[Compare, ...], columns: tuple[str, ...] = ("id",)):
    return _doc(unit, source, query, *where, columns=columns, all_rows=True)


def _stream(columns: tuple[str, ...] = ("cursor",), **asked: object):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return streams.stream_page(events(spark, sf_dir), EVENTS, **asked).select(*columns)

    return run


def _matching(columns: tuple[str, ...] = ("cursor",), **asked: object):
    """A stream query of all matching records, however many."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return streams.matching(events(spark, sf_dir), EVENTS, **asked).select(*columns)

    return run


def _groups(*aliases: str, **page: object):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = profile(*aliases)
        out = reduction.reduce_groups(events(spark, sf_dir), EVENTS, p, bounded=not page)
        return _shown(reduction.group_page(out, EVENTS, p, **page) if page else out)

    return run


def _shown(groups: DataFrame) -> DataFrame:
    if "kinds" in groups.columns:
        groups = groups.withColumn("kinds", F.array_join("kinds", "|"))
    return groups.drop("group_key")


def count_orders(spark, sf_dir):
    return documents.count_rows(orders(spark, sf_dir), ORDER, Request("all", (_c("status", Op.EQUAL, "F"),)))


def any_order(spark, sf_dir):
    def found(op: Op) -> DataFrame:
        rows = documents.selection(orders(spark, sf_dir), ORDER, Request("all", (_c("total", op, 0),))).limit(1)
        return rows.agg((F.count(F.lit(1)) > 0).alias("found")).withColumn("asked", F.lit(op.value))

    return found(Op.LESS).unionByName(found(Op.GREATER))


def first_order(spark, sf_dir):
    return documents.first_rows(orders(spark, sf_dir), ORDER, Request("by total", (_c("status", Op.EQUAL, "O"),), skip=3)).select("id", "total")


def page_with_total(spark, sf_dir):
    page = documents.query_page(orders(spark, sf_dir), ORDER, Request("by total", (_c("status", Op.EQUAL, "P"),), take=20), total=True)
    return page.rows.select("id", "total", F.lit(page.total).cast("long").alias("n"))


def cursor_page(spark, sf_dir):
    where = (_c("status", Op.EQUAL, "F"),)
    df = orders(spark, sf_dir)
    last = df.filter("id = '7'").select("total").first()[0]
    token = encode_token(request_fingerprint(ORDER, Request("cursor", where), None), [last, "7"])
    return documents.page_rows(df, ORDER, Request("cursor", where, take=50, after=token)).select("id", "total")


def cursor_null_boundary(spark, sf_dir):
    token = encode_token(request_fingerprint(LABELLED, Request("by quality"), None), [None, "500"])
    return documents.page_rows(labelled(spark, sf_dir), LABELLED, Request("by quality", take=400, after=token)).select("id", "quality")


def latest_count(spark, sf_dir):
    return documents.count_rows(orders(spark, sf_dir), ORDER, Request("latest", (_c("status", Op.EQUAL, "F"),)))


def linked_join(spark, sf_dir):
    df = orders(spark, sf_dir)
    request = Request("by total", (_c("status", Op.EQUAL, "F"),), take=30)
    page = documents.page_rows(df.select("id", "status", "total"), ORDER, request).select("id")
    return joins.hydrate(page, df, order=documents.page_order(ORDER, request)).select("id", "customer", "priority")


def json_path(spark, sf_dir):
    f = Field("k", Type.INT64)
    return evolution.project(events(spark, sf_dir), f, "payload").filter(F.col("k") > 50).select("cursor", "k")


def backfill(spark, sf_dir):
    filled = evolution.project(events(spark, sf_dir), Field("k", Type.INT64), "payload")
    return filled.groupBy("kind").agg(F.count("k").alias("filled"), values.checked_sum(F.col("k")).alias("total"))


def exact_count(spark, sf_dir):
    return streams.exact_count(events(spark, sf_dir), EVENTS, where=Is("kind", "equal", ("click",)), latest="user")


def keep_newest(spark, sf_dir):
    return streams.keep_newest(events(spark, sf_dir), 700).select("cursor", "user")


def statistics(spark, sf_dir):
    return streams.statistics(events(spark, sf_dir), EVENTS)


def full_profile(spark, sf_dir):
    p = profile()
    groups = reduction.reduce_groups(events(spark, sf_dir), EVENTS, p, snapshot=900_000, input_limit=5000, bounded=False)
    page = reduction.group_page(groups, EVENTS, p, "total", True, 50, All((Is("largest", "between", (100, 10**9)), Any((Is("kinds", "in", ("click", "purchase")), Is("first_kind", "contains", ("i",)))))))
    return _shown(page)


def group_page2(spark, sf_dir):
    p = profile("total", "largest")
    groups = reduction.reduce_groups(events(spark, sf_dir), EVENTS, p)
    after = reduction.GroupAfter(500_000, text.key_of("5"))
    return _shown(reduction.group_page(groups, EVENTS, p, "total", False, 40, after=after))


def _mutated(name: str, *where):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mutations.mutate(orders(spark, sf_dir), ORDER, name, Request("all", where)).select("id", "status", "priority")

    return run


def mutated_documents(spark, sf_dir):
    """An assignment over a unit of JSON documents: column, document and version change together."""
    o = orders(spark, sf_dir)
    documents_ = o.withColumn("document", F.to_json(F.struct("status", F.struct("priority").alias("ship")))).withColumn("version", F.lit(1).cast("long"))
    out = mutations.mutate(documents_, ORDER, "assign", Request("all", (_c("total", Op.GREATER, 250000),)))
    member = lambda path: F.get_json_object("document", path)
    return out.select("id", "priority", "version", member("$.priority").alias("set"), member("$.status").alias("status"), member("$.ship.priority").alias("kept"))


def group_having_ci(spark, sf_dir):
    """Predicates over reducers in other spellings than the records', and an order of texts by their keys."""
    p = Profile("by user", "user", (_REDUCERS["kinds"], _REDUCERS["first_kind"], _REDUCERS["largest"]), frozenset({"first_kind"}), max_take=1000)
    where = All((Is("kinds", "in", ("PURCHASE",)), Is("kinds", "contains", ("ICK",)), Any((Is("first_kind", "equal", ("Click",)), Is("first_kind", "contains", ("SIGN",))))))
    return _shown(reduction.group_page(reduction.reduce_groups(events(spark, sf_dir), EVENTS, p, bounded=False), EVENTS, p, "first_kind", True, 40, where))


def group_union_bound_page(spark, sf_dir):
    """A page of groups within the bound of unions, of a profile that other groups exceed."""
    p = Profile("by kind", "kind", (Reducer("users", "union", "user"), Reducer("records", "max", "sequence")), frozenset({"records"}), max_take=1000, max_union=3)
    few = events(spark, sf_dir).withColumn("kind", F.when(F.col("cursor") % 50 == 0, F.concat(F.lit("rare"), F.col("cursor").cast("string"))).otherwise(F.col("kind")))
    page = reduction.group_page(reduction.reduce_groups(few, EVENTS, p, bounded=False), EVENTS, p, "records", False, 30, Is("records", "between", (0, 5000)))
    return page.withColumn("users", F.array_join("users", "|")).drop("group_key")


def guard_no_references(spark, sf_dir):
    """Customers that no order of the lowest priority refers to."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.without_references(c, _read(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'"), "c_custkey", "o_custkey")


def guard_related(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.related_not_equal(o, "o_custkey", _read(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "BUILDING").select("o_orderkey")


def _bought(spark: SparkSession, sf_dir: str) -> mutations.Related:
    """Buyers, and their orders of the lowest priority."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'")
    buyers = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"))
    return {"buyer": (BUYER, buyers), "purchase": (PURCHASE, o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("buyer"), F.col("o_orderstatus").alias("status")))}


def guarded_delete(spark, sf_dir):
    """Of the buyers of a segment those go that no purchase refers to."""
    related = _bought(spark, sf_dir)
    return mutations.mutate(related["buyer"][1], BUYER, "drop", Request("find", (_c("segment", Op.EQUAL, "BUILDING"),)), related=related).select("id", "segment")


def related_delete(spark, sf_dir):
    """Of the purchases of a status those go whose buyer is of another segment."""
    related = _bought(spark, sf_dir)
    return mutations.mutate(related["purchase"][1], PURCHASE, "drop", Request("find", (_c("status", Op.EQUAL, "F"),)), related=related).select("id", "buyer", "status")


def stream_token_page(spark, sf_dir):
    """The second page of a stream query, by the first one's token."""
    df, asked = events(spark, sf_dir), {"where": Is("kind", "equal", ("click",)), "order": "sequence", "descending": True, "limit": 100}
    return streams.query_stream(df, EVENTS, **asked, after=streams.query_stream(df, EVENTS, **asked).next).rows.select("cursor", "sequence")


def group_token_page(spark, sf_dir):
    """The second page of groups, by the first one's token."""
    df, p = events(spark, sf_dir), profile("total", "kinds", "ended")
    asked = {"order": "ended", "descending": True, "take": 25, "where": Is("total", "between", (1, 10**12)), "matching": Is("kind", "in", ("click", "view"))}
    return _shown(reduction.query_groups(df, EVENTS, p, **asked, after=reduction.query_groups(df, EVENTS, p, **asked).next).rows)


def elements_all(spark, sf_dir):
    owners = daily(spark, sf_dir)
    elements = owners.select("id", F.explode("types").alias("element"))
    return joins.owners_with_all_elements(owners, elements, ["click", "purchase", "click"]).select("id")


def elements_one(spark, sf_dir):
    owners = daily(spark, sf_dir)
    return joins.owners_with_element(owners, owners.select("id", F.explode("types").alias("element")), "signup").select("id")


def comparison_keys(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    key = text.comparison_key(F.col("lang"), Policy.ASCII_IGNORE_CASE)
    return d.select("doc_id", key.alias("key"), text.lookup_hash(key).alias("hash"))


def clock_ticks(spark, sf_dir):
    return events(spark, sf_dir).select("cursor", values.ticks(F.col("occurred_at").cast("timestamp")).alias("ticks"))


def keyset_complement(spark, sf_dir):
    """How many rows come before, at and after a boundary of a nullable order."""
    order, at = [("quality", False), ("id", False)], [1, "300"]
    df = labelled(spark, sf_dir)
    after = predicates.keyset_column(order, at)
    return df.agg(F.count_if(after).alias("after"), F.count_if(~after).alias("others"))


O, P, L, D, C = orders, parts, labelled, daily, customers
FLAGSHIP = "group_profile_full"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "doc_equal": _doc(ORDER, O, "by total", _c("status", Op.EQUAL, "F"), columns=("id", "total"), skip=10, take=25),
    "doc_equal_null": _all(LABELLED, L, "find", _c("quality", Op.EQUAL), columns=("doc_id",)),
    "doc_not_equal": _all(LABELLED, L, "find", _c("quality", Op.NOT_EQUAL, 1), columns=("doc_id",)),
    "doc_not_equal_null": _all(LABELLED, L, "find", _c("quality", Op.NOT_EQUAL), columns=("doc_id",)),
    "doc_in": _all(ORDER, O, "all", _c("priority", Op.IN, ["1-URGENT", "5-LOW"])),
    "doc_in_with_null": _all(LABELLED, L, "find", _c("toxic", Op.IN, [1, None]), columns=("doc_id",)),
    "doc_in_empty": _all(ORDER, O, "all", _c("priority", Op.IN, [])),
    "doc_contains": _all(PART, P, "find", _c("name", Op.CONTAINS, "A"), columns=("id", "name")),
    "doc_not_contains": _all(PART, P, "find", _c("name", Op.NOT_CONTAINS, "E"), columns=("id", "name")),
    "doc_contains_literal_wildcards": _all(LABELLED, L, "find", _c("text", Op.CONTAINS, "%"), columns=("doc_id",)),
    "doc_starts_with": _all(PART, P, "find", _c("kind", Op.STARTS_WITH, "s"), columns=("id", "kind")),
    "doc_gt": _all(ORDER, O, "all", _c("total", Op.GREATER, 300000)),
    "doc_gte": _all(ORDER, O, "all", _c("customer", Op.GREATER_EQUAL, 1000)),
    "doc_lt": _all(ORDER, O, "all", _c("total", Op.LESS, 20000)),
    "doc_lte": _all(ORDER, O, "all", _c("customer", Op.LESS_EQUAL, 10)),
    "doc_collection_contains": _all(DAILY, D, "find", _c("types", Op.HAS, "purchase")),
    "doc_collection_contains_all": _all(DAILY, D, "find", _c("types", Op.HAS_ALL, ["click", "purchase", "click"])),
    "doc_element_join": elements_one,
    "doc_element_join_all": elements_all,
    "doc_cnf": _all(ORDER, O, "all", (Compare("status", Op.EQUAL, "F"), Compare("priority", Op.STARTS_WITH, "1-")), _c("total", Op.GREATER_EQUAL, 100000), columns=("id", "status", "priority")),
    "doc_empty_clause": _all(ORDER, O, "all", ()),
    "doc_residual": _doc(ORDER, O, "residual", _c("status", Op.EQUAL, "O"), _c("priority", Op.CONTAINS, "high"), columns=("id", "total"), take=40),
    "doc_identity_equal_ci": _all(CUSTOMER, C, "by id", _c("id", Op.EQUAL, "CUSTOMER#000000007")),
    "doc_identity_in": _all(CUSTOMER, C, "by id", _c("id", Op.IN, ["customer#000000003", "CUSTOMER#000000009"])),
    "doc_identity_not_equal": _all(CUSTOMER, C, "by id", _c("id", Op.NOT_EQUAL, "CUSTOMER#000000007")),
    "doc_identity_prefix": _all(CUSTOMER, C, "by id", _c("id", Op.STARTS_WITH, "CUSTOMER#00000001")),
    "doc_identity_range": _all(CUSTOMER, C, "by id", _c("id", Op.GREATER_EQUAL, "CUSTOMER#00000002"), _c("id", Op.LESS, "CUSTOMER#00000004")),
    "doc_count": count_orders,
    "doc_any": any_order,
    "doc_first": first_order,
    "doc_take_zero": _doc(ORDER, O, "by total", columns=("id",), take=0),
    "doc_page_with_total": page_with_total,
    "doc_offset_page": _doc(ORDER, O, "by total", columns=("id", "total"), skip=1000, take=50),
    "doc_mixed_order": _doc(ORDER, O, "mixed", columns=("id", "status", "total"), take=100),
    "doc_keyset_page2": cursor_page,
    "doc_keyset_null_boundary": cursor_null_boundary,
    "doc_keyset_complement": keyset_complement,
    "doc_latest_per_key": _all(ORDER, O, "latest", _c("status", Op.EQUAL, "F"), columns=("id", "customer")),
    "doc_latest_per_key_count": latest_count,
    "doc_linked_join": linked_join,
    "doc_json_path": json_path,
    "doc_selectivity_10pct": _all(LINE, lines, "scan", _c("quantity", Op.LESS_EQUAL, 5), columns=("id", "price")),
    "doc_selectivity_50pct": _all(LINE, lines, "scan", _c("quantity", Op.LESS_EQUAL, 25), columns=("id", "price")),
    "doc_selectivity_10pct_ordered": _doc(LINE, lines, "rank", _c("quantity", Op.LESS_EQUAL, 5), columns=("id", "price"), take=100),
    "stream_equal": _matching(("cursor", "user"), where=Is("kind", "equal", ("CLICK",))),
    "stream_in": _matching(("cursor", "user"), where=Is("user", "in", ("3", "5", "8"))),
    "stream_range": _matching(("cursor", "sequence"), where=Is("sequence", "between", (1000, 5000))),
    "stream_contains": _matching(("cursor", "kind"), where=Is("kind", "contains", ("UR",))),
    "stream_contains_empty": _stream(("cursor",), where=Is("kind", "contains", ("",)), limit=500),
    "stream_multiple": _matching(("cursor",), where=All((Is("tags", "in", ("T1", "t2")), Is("tags", "contains", ("LICK",))))),
    "stream_tree": _matching(("cursor",), where=All((Any((Is("kind", "equal", ("click",)), Is("kind", "equal", ("purchase",)))), Is("sequence", "between", (500, 9000))))),
    "stream_field_order": _stream(("cursor", "sequence"), order="sequence", descending=True, limit=200),
    "stream_cursor_desc": _stream(("cursor",), where=Is("user", "equal", ("4",)), descending=True, limit=30),
    "stream_snapshot_page2": _stream(("cursor", "sequence"), order="sequence", limit=100, after=After(5000, 700, 900)),
    "stream_latest_per_key": _matching(("cursor", "user"), where=Is("kind", "in", ("click", "view")), latest="user"),
    "stream_exact_count": exact_count,
    "stream_statistics": statistics,
    "stream_keep_newest": keep_newest,
    "group_min_max_instant": _groups("started", "ended"),
    "group_sum": _groups("total"),
    "group_max": _groups("largest"),
    "group_set_union": _groups("kinds"),
    "group_first_by_asc": _groups("first_kind"),
    "group_first_by_desc": _groups("last_kind"),
    "group_having": _groups("total", "largest", order="largest", descending=True, take=60, where=Is("total", "between", (0, 10**9))),
    "group_page2": group_page2,
    "group_profile_full": full_profile,
    "group_having_ci": group_having_ci,
    "group_union_bound_page": group_union_bound_page,
    "mutation_documents": mutated_documents,
    "mutation_delete": _mutated("drop", _c("status", Op.EQUAL, "P")),
    "mutation_assign": _mutated("assign", _c("total", Op.GREATER, 250000)),
    "mutation_transition": _mutated("close", _c("priority", Op.EQUAL, "1-URGENT")),
    "mutation_delete_unreferenced": guarded_delete,
    "mutation_delete_related": related_delete,
    "stream_token_page2": stream_token_page,
    "group_token_page2": group_token_page,
    "guard_no_references": guard_no_references,
    "guard_related_not_equal": guard_related,
    "backfill_projection": backfill,
    "text_comparison_keys": comparison_keys,
    "value_ticks": clock_ticks,
}

_TOTAL = "CAST(round(o_totalprice, 2) AS DECIMAL(18,2))"
_ID = "CAST(o_orderkey AS VARCHAR)"
_LAB = "documents d LEFT JOIN labels l USING (doc_id)"
_DAILY = "(SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS id, list_distinct(list(event_type)) AS types FROM events GROUP BY user_id, CAST(ts AS DATE))"
_LINES = "(SELECT l_orderkey || '/' || l_linenumber AS id, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)"
_EV = "(SELECT event_id AS cursor, ts AS occurred_at, CAST(user_id AS VARCHAR) AS \"user\", event_type AS kind, nullif(event_type, 'view') AS some_kind, CAST(round(value * 100) AS BIGINT) AS sequence, props FROM events)"


def _orders(where: str, columns: str = f"{_ID} AS id") -> str:
    return f"SELECT {columns} FROM orders WHERE {where}"


def _by_total(where: str, tail: str, columns: str = f"{_ID} AS id, {_TOTAL} AS total") -> str:
    return f"SELECT {columns} FROM orders WHERE {where} ORDER BY {_TOTAL} DESC NULLS LAST, {_ID} {tail}"


def _grouped(columns: str, tail: str = "", source: str = _EV) -> str:
    return f'SELECT "user" AS group_value, {columns} FROM {source} e WHERE "user" IS NOT NULL GROUP BY "user" {tail}'


_UNION = "array_to_string(list_sort(list_distinct(list(kind))), '|') AS kinds"
_FIRST = "(arg_min_null(some_kind, (sequence::HUGEINT * 1000000000 + cursor))) AS first_kind"
_LAST = "(arg_max_null(some_kind, (sequence::HUGEINT * 1000000000 - cursor))) AS last_kind"
ORACLE_SQL: dict[str, str] = {
    "doc_equal": _by_total("o_orderstatus = 'F'", "LIMIT 25 OFFSET 10"),
    "doc_equal_null": f"SELECT d.doc_id FROM {_LAB} WHERE quality IS NULL",
    "doc_not_equal": f"SELECT d.doc_id FROM {_LAB} WHERE quality IS DISTINCT FROM 1",
    "doc_not_equal_null": f"SELECT d.doc_id FROM {_LAB} WHERE quality IS NOT NULL",
    "doc_in": _orders("o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "doc_in_with_null": f"SELECT d.doc_id FROM {_LAB} WHERE toxic = 1 OR toxic IS NULL",
    "doc_in_empty": _orders("false"),
    "doc_contains": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a')",
    "doc_not_contains": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_name IS NULL OR NOT contains(lower(p_name), 'e')",
    "doc_contains_literal_wildcards": "SELECT doc_id FROM documents WHERE contains(lower(text), '%')",
    "doc_starts_with": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS kind FROM part WHERE starts_with(lower(p_type), 's')",
    "doc_gt": _orders(f"{_TOTAL} > 300000"),
    "doc_gte": _orders("o_custkey >= 1000"),
    "doc_lt": _orders(f"{_TOTAL} < 20000"),
    "doc_lte": _orders("o_custkey <= 10"),
    "doc_collection_contains": f"SELECT id FROM {_DAILY} WHERE list_contains(types, 'purchase')",
    "doc_collection_contains_all": f"SELECT id FROM {_DAILY} WHERE list_has_all(types, ['click', 'purchase'])",
    "doc_element_join": f"SELECT id FROM {_DAILY} WHERE list_contains(types, 'signup')",
    "doc_element_join_all": f"SELECT id FROM {_DAILY} WHERE list_has_all(types, ['click', 'purchase'])",
    "doc_cnf": _orders(f"(o_orderstatus = 'F' OR starts_with(o_orderpriority, '1-')) AND {_TOTAL} >= 100000", f"{_ID} AS id, o_orderstatus AS status, o_orderpriority AS priority"),
    "doc_empty_clause": _orders("false"),
    "doc_residual": _by_total("o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'high')", "LIMIT 40"),
    "doc_identity_equal_ci": "SELECT c_name AS id FROM customer WHERE lower(c_name) = 'customer#000000007'",
    "doc_identity_in": "SELECT c_name AS id FROM customer WHERE lower(c_name) IN ('customer#000000003', 'customer#000000009')",
    "doc_identity_not_equal": "SELECT c_name AS id FROM customer WHERE lower(c_name) IS DISTINCT FROM 'customer#000000007'",
    "doc_identity_prefix": "SELECT c_name AS id FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')",
    "doc_identity_range": "SELECT c_name AS id FROM customer WHERE lower(c_name) >= 'customer#00000002' AND lower(c_name) < 'customer#00000004'",
    "doc_count": _orders("o_orderstatus = 'F'", "count(*) AS n"),
    "doc_any": f"{_orders(f'{_TOTAL} < 0', "count(*) > 0 AS found, 'less' AS asked")} UNION ALL {_orders(f'{_TOTAL} > 0', "count(*) > 0 AS found, 'greater' AS asked")}",
    "doc_first": _by_total("o_orderstatus = 'O'", "LIMIT 1 OFFSET 3"),
    "doc_take_zero": _orders("false"),
    "doc_page_with_total": _by_total("o_orderstatus = 'P'", "LIMIT 20", f"{_ID} AS id, {_TOTAL} AS total, count(*) OVER () AS n"),
    "doc_offset_page": _by_total("true", "LIMIT 50 OFFSET 1000"),
    "doc_mixed_order": f"SELECT {_ID} AS id, o_orderstatus AS status, {_TOTAL} AS total FROM orders ORDER BY o_orderstatus NULLS FIRST, {_TOTAL} DESC NULLS LAST, {_ID} LIMIT 100",
    "doc_keyset_page2": _by_total(f"o_orderstatus = 'F' AND ({_TOTAL} < (SELECT {_TOTAL} FROM orders WHERE o_orderkey = 7) OR ({_TOTAL} = (SELECT {_TOTAL} FROM orders WHERE o_orderkey = 7) AND {_ID} > '7'))", "LIMIT 50"),
    "doc_keyset_null_boundary": f"SELECT CAST(d.doc_id AS VARCHAR) AS id, quality FROM {_LAB} WHERE quality IS NOT NULL OR CAST(d.doc_id AS VARCHAR) > '500' ORDER BY quality NULLS FIRST, CAST(d.doc_id AS VARCHAR) LIMIT 400",
    "doc_keyset_complement": f"SELECT count(*) FILTER (WHERE coalesce(quality > 1 OR (quality = 1 AND CAST(d.doc_id AS VARCHAR) > '300'), false)) AS after, count(*) FILTER (WHERE NOT coalesce(quality > 1 OR (quality = 1 AND CAST(d.doc_id AS VARCHAR) > '300'), false)) AS others FROM {_LAB}",
    "doc_latest_per_key": f"SELECT id, customer FROM (SELECT {_ID} AS id, o_custkey AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, {_ID}) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1",
    "doc_latest_per_key_count": "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "doc_linked_join": _by_total("o_orderstatus = 'F'", "LIMIT 30", f"{_ID} AS id, o_custkey AS customer, o_orderpriority AS priority"),
    "doc_json_path": f"SELECT cursor, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {_EV} WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50",
    "doc_selectivity_10pct": f"SELECT id, price FROM {_LINES} WHERE quantity <= 5",
    "doc_selectivity_50pct": f"SELECT id, price FROM {_LINES} WHERE quantity <= 25",
    "doc_selectivity_10pct_ordered": f"SELECT id, price FROM {_LINES} WHERE quantity <= 5 ORDER BY price DESC NULLS LAST, id LIMIT 100",
    "stream_equal": f'SELECT cursor, "user" FROM {_EV} WHERE lower(kind) = \'click\'',
    "stream_in": f'SELECT cursor, "user" FROM {_EV} WHERE "user" IN (\'3\', \'5\', \'8\')',
    "stream_range": f"SELECT cursor, sequence FROM {_EV} WHERE sequence BETWEEN 1000 AND 5000",
    "stream_contains": f"SELECT cursor, kind FROM {_EV} WHERE contains(lower(kind), 'ur')",
    "stream_contains_empty": f"SELECT cursor FROM {_EV} WHERE kind IS NOT NULL ORDER BY cursor LIMIT 500",
    "stream_multiple": f"SELECT cursor FROM {_EV} WHERE (cursor % 3 IN (1, 2)) AND contains(kind, 'lick')",
    "stream_tree": f"SELECT cursor FROM {_EV} WHERE kind IN ('click', 'purchase') AND sequence BETWEEN 500 AND 9000",
    "stream_field_order": f"SELECT cursor, sequence FROM {_EV} WHERE sequence IS NOT NULL ORDER BY sequence DESC, cursor DESC LIMIT 200",
    "stream_cursor_desc": f"SELECT cursor FROM {_EV} WHERE \"user\" = '4' ORDER BY cursor DESC LIMIT 30",
    "stream_snapshot_page2": f"SELECT cursor, sequence FROM {_EV} WHERE cursor <= 5000 AND (sequence > 900 OR (sequence = 900 AND cursor > 700)) ORDER BY sequence, cursor LIMIT 100",
    "stream_latest_per_key": f'SELECT max(cursor) AS cursor, "user" FROM {_EV} WHERE kind IN (\'click\', \'view\') GROUP BY "user"',
    "stream_exact_count": f'SELECT count(DISTINCT "user") AS n FROM {_EV} WHERE kind = \'click\'',
    "stream_statistics": f"SELECT count(*) AS retained, max(cursor) AS newest_cursor, max(sequence) AS high_water FROM {_EV}",
    "stream_keep_newest": f'SELECT cursor, "user" FROM {_EV} ORDER BY cursor DESC LIMIT 700',
    "group_min_max_instant": _grouped("min(occurred_at) AS started, max(occurred_at) AS ended"),
    "group_sum": _grouped("CAST(sum(sequence) AS BIGINT) AS total"),
    "group_max": _grouped("max(sequence) AS largest"),
    "group_set_union": _grouped(_UNION),
    "group_first_by_asc": _grouped(_FIRST),
    "group_first_by_desc": _grouped(_LAST),
    "group_having": f"SELECT * FROM ({_grouped('CAST(sum(sequence) AS BIGINT) AS total, max(sequence) AS largest')}) WHERE total BETWEEN 0 AND 1000000000 ORDER BY largest DESC, group_value LIMIT 60",
    "group_page2": f"SELECT * FROM ({_grouped('CAST(sum(sequence) AS BIGINT) AS total, max(sequence) AS largest')}) WHERE total > 500000 OR (total = 500000 AND group_value > '5') ORDER BY total, group_value LIMIT 40",
    "group_profile_full": f"""SELECT * FROM ({_grouped(f'min(occurred_at) AS started, max(occurred_at) AS ended, CAST(sum(sequence) AS BIGINT) AS total, max(sequence) AS largest, {_UNION}, {_FIRST}, {_LAST}', source=f'(SELECT * FROM {_EV} WHERE cursor <= 900000 ORDER BY cursor DESC LIMIT 5000)')})
        WHERE largest BETWEEN 100 AND 1000000000 AND (list_has_any(string_split(kinds, '|'), ['click', 'purchase']) OR coalesce(contains(first_kind, 'i'), false)) ORDER BY total DESC, group_value LIMIT 50""",
    "group_having_ci": f"""SELECT * FROM ({_grouped(f'{_UNION}, {_FIRST}, max(sequence) AS largest')}) WHERE list_contains(string_split(kinds, '|'), 'purchase') AND contains(kinds, 'ick')
        AND (first_kind = 'click' OR contains(first_kind, 'sign')) ORDER BY first_kind DESC, group_value LIMIT 40""",
    "group_union_bound_page": f"""SELECT kind AS group_value, array_to_string(list_sort(list_distinct(list("user"))), '|') AS users, max(sequence) AS records
        FROM (SELECT cursor, "user", sequence, CASE WHEN cursor % 50 = 0 THEN 'rare' || cursor ELSE kind END AS kind FROM {_EV}) GROUP BY kind
        HAVING max(sequence) BETWEEN 0 AND 5000 ORDER BY records, group_value LIMIT 30""",
    "mutation_documents": f"SELECT {_ID} AS id, CASE WHEN {_TOTAL} > 250000 THEN '9-NONE' ELSE o_orderpriority END AS priority, CASE WHEN {_TOTAL} > 250000 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN {_TOTAL} > 250000 THEN '9-NONE' END AS set, o_orderstatus AS status, o_orderpriority AS kept FROM orders",
    "mutation_delete": _orders("o_orderstatus IS DISTINCT FROM 'P'", f"{_ID} AS id, o_orderstatus AS status, o_orderpriority AS priority"),
    "mutation_delete_unreferenced": "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment FROM customer c WHERE c_mktsegment IS DISTINCT FROM 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')",
    "mutation_delete_related": f"""SELECT {_ID} AS id, CAST(o_custkey AS VARCHAR) AS buyer, o_orderstatus AS status FROM orders
        WHERE o_orderpriority = '5-LOW' AND (o_orderstatus IS DISTINCT FROM 'F' OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IS DISTINCT FROM 'BUILDING'))""",
    "stream_token_page2": f"SELECT cursor, sequence FROM {_EV} WHERE kind = 'click' AND sequence IS NOT NULL ORDER BY sequence DESC, cursor DESC LIMIT 100 OFFSET 100",
    "group_token_page2": f"""SELECT * FROM ({_grouped(f'CAST(sum(sequence) AS BIGINT) AS total, {_UNION}, max(occurred_at) AS ended', source=f"(SELECT * FROM {_EV} WHERE kind IN ('click', 'view'))")})
        WHERE total BETWEEN 1 AND 1000000000000 ORDER BY ended DESC, group_value LIMIT 25 OFFSET 25""",
    "mutation_assign": f"SELECT {_ID} AS id, o_orderstatus AS status, CASE WHEN {_TOTAL} > 250000 THEN '9-NONE' ELSE o_orderpriority END AS priority FROM orders",
    "mutation_transition": f"SELECT {_ID} AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P') THEN 'F' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders",
    "guard_no_references": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')",
    "guard_related_not_equal": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IS DISTINCT FROM 'BUILDING')",
    "backfill_projection": f"SELECT kind, count(CAST(json_extract(props, '$.k') AS BIGINT)) AS filled, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM {_EV} GROUP BY kind",
    "text_comparison_keys": "SELECT doc_id, '00' || array_to_string(list_transform(string_split(lower(lang), ''), lambda c: hex(c)), '00') AS key, sha256('00' || array_to_string(list_transform(string_split(lower(lang), ''), lambda c: hex(c)), '00')) AS hash FROM documents",
    "value_ticks": f"SELECT cursor, epoch_us(occurred_at) * 10 + 621355968000000000 AS ticks FROM {_EV}",
}
