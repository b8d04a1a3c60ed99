"""Queries over record streams: predicate trees, snapshots, order, latest per key, counts, retention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.text import Policy
from quern.operators.bounds import newest_bound
from quern.plans.declarations import Declared, Stream, StreamField, Type
from quern.plans.requests import decode_token, encode_token, fingerprint


@dataclass(frozen=True)
class Is:
    """A comparison with a field: equal, in, between (inclusive) or contains."""

    field: str
    op: str
    values: tuple


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


Predicate = Is | All | Any


@dataclass(frozen=True)
class After:
    """Where a page ended: the snapshot it belongs to, the last cursor, and the last value of the order's field."""

    snapshot: int
    cursor: int
    value: object = None


def check_tree(stream: Stream, p: Predicate, field: Callable[[str], StreamField] | None = None) -> None:
    """An error if the tree is no valid one over the stream's fields, or over those that field gives."""
    field = field or stream.field
    nodes = values = 0
    todo = [p]
    while todo:
        x = todo.pop()
        nodes += 1
        if isinstance(x, Is):
            f = field(x.field)
            values += len(x.values)
            ends = [text.key_of(v, f.policy) for v in x.values] if x.op == "between" and f.type is Type.STRING else x.values
            if x.op == "between" and (len(ends) != 2 or ends[0] > ends[1] or f.multiple):
                raise Declared(f"{x.field}: between needs two ordered values of a scalar field")
            if x.op == "contains" and (f.type is not Type.STRING or len(x.values) != 1):
                raise Declared(f"{x.field}: contains needs one text")
            if x.op == "in" and not x.values:
                raise Declared(f"{x.field}: in needs values")
            if x.op not in ("equal", "in", "between", "contains") or (x.op == "equal" and len(x.values) != 1):
                raise Declared(f"{x.field}: no such comparison")
        else:
            if not x.parts:
                raise Declared("a group of no predicates")
            todo += x.parts
    if nodes > stream.max_nodes or values > stream.max_values:
        raise Declared("the predicate is too large")


def compare_one(f: StreamField, x: Is, value: Column) -> Column:
    """A comparison of one value. Where keys and texts are equal alike, the column itself is compared, so that scans can be asked."""
    if f.type is Type.STRING and not (f.policy is Policy.ORDINAL and x.op != "between"):
        key, keys = text.comparison_key(value, f.policy), [text.key_of(v, f.policy) for v in x.values]
        if x.op == "contains":
            return text.key_contains(key, keys[0], text.key_unit(f.policy))
    else:
        key, keys = value, list(x.values)
        if x.op == "contains":
            return F.contains(key, F.lit(keys[0]))
    if x.op == "between":
        return key.between(F.lit(keys[0]), F.lit(keys[1]))
    return key.isin(keys)


def predicate_column(stream: Stream, p: Predicate) -> Column:
    """True or false, never null: a record without the field doesn't match."""
    if isinstance(p, Is):
        f = stream.field(p.field)
        c = F.col(f.name)
        found = F.exists(c, lambda v: v.isNotNull() & compare_one(f, p, v)) if f.multiple else compare_one(f, p, c)
        return c.isNotNull() & found
    parts = [predicate_column(stream, x) for x in p.parts]
    return reduce(and_ if isinstance(p, All) else or_, parts)


def snapshot_rows(df: DataFrame, snapshot: int | None) -> DataFrame:
    """Records up to the snapshot's cursor."""
    return df if snapshot is None else df.filter(F.col("cursor") <= snapshot)


def matching(df: DataFrame, stream: Stream, where: Predicate | None = None, snapshot: int | None = None, latest: str | None = None, order: str | None = None) -> DataFrame:
    """The records a query is about: of the snapshot, matching, the newest of each key, having the order's field; in that order."""
    rows = snapshot_rows(df, snapshot)
    if where is not None:
        check_tree(stream, where)
        rows = rows.filter(predicate_column(stream, where))
    if latest is not None:
        f = stream.field(latest)
        if not f.latest or f.multiple:
            raise Declared(f"{latest} is no key of latest records")
        rows = rows.filter(F.col(latest).isNotNull()).withColumn("_k", text.comparison_key(F.col(latest), f.policy) if f.type is Type.STRING else F.col(latest))
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("cursor")))).filter("_n = 1").drop("_n", "_k")
    if order is not None:
        if not stream.field(order).orderable:
            raise Declared(f"{order} is no order")
        rows = rows.filter(F.col(order).isNotNull())
    return rows


def stream_page(df: DataFrame, stream: Stream, where: Predicate | None = None, snapshot: int | None = None, latest: str | None = None, order: str | None = None, descending: bool = False, limit: int = 100, after: After | None = None) -> DataFrame:
    """A page in the order of a field and the cursor, both in one direction, or of the cursor alone."""
    if not 1 <= limit <= stream.max_limit:
        raise Declared(f"the limit must be from 1 to {stream.max_limit}")
    return _stream_rows(df, stream, where, snapshot, latest, order, descending, limit, after)


def _stream_rows(df: DataFrame, stream: Stream, where: Predicate | None, snapshot: int | None, latest: str | None, order: str | None, descending: bool, limit: int, after: After | None) -> DataFrame:
    rows = matching(df, stream, where, after.snapshot if after else snapshot, latest, order)
    by: list[Column] = [F.col("cursor")]
    if order is not None:
        f = stream.field(order)
        by.insert(0, text.comparison_key(F.col(order), f.policy) if f.type is Type.STRING else F.col(order))
    if after is not None:
        last = F.col("cursor") < after.cursor if descending else F.col("cursor") > after.cursor
        if order is not None:
            f = stream.field(order)
            bound = F.lit(text.key_of(after.value, f.policy) if f.type is Type.STRING else after.value)
            last = (by[0] < bound if descending else by[0] > bound) | ((by[0] == bound) & last)
        rows = rows.filter(last)
    return rows.orderBy(*[c.desc() if descending else c.asc() for c in by]).limit(limit)


@dataclass(frozen=True)
class StreamPage:
    """rows in order; the snapshot that they belong to; the token of the next page if there is one."""

    rows: DataFrame
    snapshot: int
    next: str | None = None


def newest_cursor(df: DataFrame) -> int:
    """The newest cursor, 0 where there is no record: the snapshot that a first page takes."""
    return df.agg(F.max("cursor")).first()[0] or 0


def query_stream(df: DataFrame, stream: Stream, where: Predicate | None = None, latest: str | None = None, order: str | None = None, descending: bool = False, limit: int = 100, after: str | None = None) -> StreamPage:
    """A page of what is there when the first page is asked for; its tokens carry that snapshot, so later records stay out.

    A token belongs to one declared stream, filter, key and order; the limit may change from page to page. The end of a
    page is found by the order's columns alone, at most max_limit + 1 narrow rows.
    """
    bound_to = fingerprint("stream", stream.name, [repr(f) for f in stream.fields], repr(where), latest, order, descending)
    at = None if after is None else After(*decode_token(after, bound_to))
    snapshot = at.snapshot if at else newest_cursor(df)
    rows = stream_page(df, stream, where, snapshot, latest, order, descending, limit, at)
    ends = _stream_rows(df, stream, where, snapshot, latest, order, descending, limit + 1, at)
    held = ends.select("cursor", *([F.col(order).alias("_value")] if order is not None else [])).collect()
    if len(held) <= limit:
        return StreamPage(rows, snapshot)
    last = held[limit - 1]
    return StreamPage(rows, snapshot, encode_token(bound_to, [snapshot, last["cursor"], last["_value"] if order is not None else None]))


def exact_count(df: DataFrame, stream: Stream, **asked: object) -> DataFrame:
    """One row: n, of all pages together."""
    return matching(df, stream, **asked).agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame, stream: Stream) -> DataFrame:
    """One row: retained records, their newest cursor, and the largest value of the stream's logical clock among them."""
    high = F.max(stream.high_water) if stream.high_water else F.lit(None).cast("long")
    return df.agg(F.count(F.lit(1)).alias("retained"), F.max("cursor").alias("newest_cursor"), high.alias("high_water"))


def keep_newest(df: DataFrame, n: int) -> DataFrame:
    """The n newest records."""
    if n == 0:
        return df.limit(0)
    low = newest_bound(df, n)
    return df if low is None else df.filter(F.col("cursor") >= low)
