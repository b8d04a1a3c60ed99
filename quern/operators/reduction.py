"""Grouped reduction of a stream's records, or its newest ones, by a declared profile, in one aggregation per kind of reducer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text, values
from quern.operators.streams import Any, Is, Predicate, check_tree, compare_one, keep_newest, newest_cursor, predicate_column, snapshot_rows
from quern.plans.declarations import Declared, Profile, Stream, StreamField, Type
from quern.plans.requests import decode_token, encode_token, fingerprint


@dataclass(frozen=True)
class GroupAfter:
    """Where a page of groups ended."""

    value: object
    key: str


def reduce_groups(df: DataFrame, stream: Stream, profile: Profile, snapshot: int | None = None, where: Predicate | None = None, input_limit: int | None = None, bounded: bool = True) -> DataFrame:
    """One row per group: group_key, group_value (as its earliest record spells it), and a column per reducer.

    Records without the group's field belong to no group. Unions are arrays of distinct values in the order of their
    keys, each as its earliest record spells it; a union beyond the profile's bound is an error where the group is read.
    With bounded false that is left to group_page, which holds only the groups of its page to the bound.
    """
    group = stream.field(profile.group)
    if group.multiple or group.type is not Type.STRING:
        raise Declared(f"{profile.group} can't group")
    limit = profile.input_limit if input_limit is None else input_limit
    if limit is not None and (limit < 1 or profile.input_limit is not None and limit > profile.input_limit):
        raise Declared(f"the input must be at least 1 record and at most {profile.input_limit or 'all'}")
    rows = snapshot_rows(df, snapshot)
    if limit is not None:
        rows = keep_newest(rows, limit)
    if where is not None:
        check_tree(stream, where)
        rows = rows.filter(predicate_column(stream, where))
    rows = rows.filter(F.col(profile.group).isNotNull()).withColumn("group_key", text.comparison_key(F.col(profile.group), group.policy))
    simple = {"min_instant": F.min, "max_instant": F.max, "max": F.max, "sum": lambda c: values.checked_sum(F.col(c))}
    out: list[Column] = [F.min_by(profile.group, "cursor").alias("group_value")]
    unions = [r for r in profile.reducers if r.kind == "union"]
    for r in profile.reducers:
        if r.kind in simple:
            out.append(simple[r.kind](r.source).alias(r.alias))
        elif r.kind == "first":
            by, down = r.order
            held = F.struct(F.col(r.source).alias("v"))  # a null output still wins
            rank = F.when(F.col(by).isNotNull(), F.struct(F.col(by).alias("o"), (-F.col("cursor") if down else F.col("cursor")).alias("c")))
            out.append((F.max_by if down else F.min_by)(held, rank)["v"].alias(r.alias))
        elif r.kind != "union":
            raise Declared(f"{r.alias}: no such reducer")
    reduced = rows.groupBy("group_key").agg(*out)
    for r in unions:
        f = stream.field(r.source)
        each = F.posexplode(r.source) if f.multiple else F.posexplode(F.array(r.source))
        flat = rows.select("group_key", "cursor", each.alias("at", "value")).filter(F.col("value").isNotNull())
        flat = flat.withColumn("key", text.comparison_key(F.col("value"), f.policy))
        spelled = flat.groupBy("group_key", "key").agg(F.min_by("value", F.struct("cursor", "at")).alias("value"))
        sets = spelled.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("s"))
        reduced = reduced.join(sets.select("group_key", F.col("s.value").alias(r.alias)), "group_key", "left")
        reduced = reduced.withColumn(r.alias, F.coalesce(r.alias, F.array().cast("array<string>")))
    out = reduced.select("group_key", "group_value", *[r.alias for r in profile.reducers])
    return bounded_unions(out, profile) if bounded else out


def bounded_unions(groups: DataFrame, profile: Profile) -> DataFrame:
    """The groups, of which reading one is an error if a union of it has more values than the profile allows."""
    for r in profile.reducers:
        if r.kind == "union":
            too_many = F.raise_error(F.lit(f"{r.alias}: more than {profile.max_union} values")).cast("array<string>")
            groups = groups.withColumn(r.alias, F.when(F.size(r.alias) > profile.max_union, too_many).otherwise(F.col(r.alias)))
    return groups


def _result_field(stream: Stream, profile: Profile, alias: str) -> StreamField:
    """What a reducer gives, as a field: comparisons and orders go by its source's policy."""
    r = next((r for r in profile.reducers if r.alias == alias), None)
    if r is None:
        raise Declared(f"{profile.name} has no reducer {alias}")
    source = stream.field(r.source)
    return StreamField(alias, source.type, r.kind == "union", source.policy)


def having(stream: Stream, profile: Profile, p: Predicate) -> Column:
    """A predicate tree over reducers' aliases, checked as one over fields is. Texts compare by the keys of their source's policy."""
    check_tree(stream, p, lambda alias: _result_field(stream, profile, alias))

    def made(x: Predicate) -> Column:
        if not isinstance(x, Is):
            return reduce(lambda a, b: a | b if isinstance(x, Any) else a & b, map(made, x.parts))
        f, c = _result_field(stream, profile, x.field), F.col(x.field)
        if x.op == "contains" and x.values[0] == "" and not f.multiple:
            return F.lit(True)
        return F.coalesce(F.exists(c, lambda v: compare_one(f, x, v)) if f.multiple else compare_one(f, x, c), F.lit(False))

    return made(p)


def group_page(groups: DataFrame, stream: Stream, profile: Profile, order: str, descending: bool = False, take: int = 100, where: Predicate | None = None, after: GroupAfter | None = None) -> DataFrame:
    """A page of reduced groups in the order of a reducer, ties by the group's key ascending. Groups without its value are left out.

    Texts order by the keys of their policy. Only the page's own groups are held to the bound of unions.
    """
    if order not in profile.orderable:
        raise Declared(f"{order} is no order of {profile.name}")
    if not 1 <= take <= profile.max_take:
        raise Declared(f"take must be from 1 to {profile.max_take}")
    rows, by = _ordered_groups(groups, stream, profile, order, descending, where, after)
    return bounded_unions(rows.orderBy(*by).limit(take), profile)


def _ordered_groups(groups: DataFrame, stream: Stream, profile: Profile, order: str, descending: bool, where: Predicate | None, after: GroupAfter | None) -> tuple[DataFrame, list[Column]]:
    """The groups after a page's end that match, and their total order."""
    rows, f = groups.filter(F.col(order).isNotNull()), _result_field(stream, profile, order)
    if where is not None:
        rows = rows.filter(having(stream, profile, where))
    keyed = f.type is Type.STRING
    o = text.comparison_key(F.col(order), f.policy) if keyed else F.col(order)
    if after is not None:
        v = F.lit(text.key_of(after.value, f.policy) if keyed else after.value)
        rows = rows.filter((o < v if descending else o > v) | ((o == v) & (F.col("group_key") > after.key)))
    return rows, [o.desc() if descending else o.asc(), F.col("group_key").asc()]


@dataclass(frozen=True)
class GroupPage:
    """rows in order; the snapshot that they are reduced from; the token of the next page if there is one."""

    rows: DataFrame
    snapshot: int
    next: str | None = None


def query_groups(df: DataFrame, stream: Stream, profile: Profile, order: str, descending: bool = False, take: int = 100, where: Predicate | None = None, matching: Predicate | None = None, input_limit: int | None = None, after: str | None = None) -> GroupPage:
    """A page of groups of what is there when the first page is asked for. matching selects records, where groups.

    Tokens carry the snapshot and the input limit, and belong to one stream, profile, selection and order; a token with
    another input limit is refused, as the groups would be others. The groups are reduced once for a page and its token:
    the page comes to the driver, at most max_take groups with bounded unions, and the next group without its unions.
    """
    shape = [stream.name, [repr(f) for f in stream.fields], profile.name, profile.group, [repr(r) for r in profile.reducers], profile.max_union]
    bound_to = fingerprint("groups", shape, repr(where), repr(matching), order, descending)
    limit = profile.input_limit if input_limit is None else input_limit
    snapshot, at = None, None
    if after is not None:
        snapshot, held_limit, value, key = decode_token(after, bound_to)
        if held_limit != limit:
            raise Declared("the continuation token belongs to another input limit")
        at = GroupAfter(value, key)
    if order not in profile.orderable:
        raise Declared(f"{order} is no order of {profile.name}")
    if not 1 <= take <= profile.max_take:
        raise Declared(f"take must be from 1 to {profile.max_take}")
    snapshot = newest_cursor(df) if snapshot is None else snapshot
    groups = reduce_groups(df, stream, profile, snapshot, matching, input_limit, bounded=False)
    rows, by = _ordered_groups(groups, stream, profile, order, descending, where, at)
    rows = rows.orderBy(*by).limit(take + 1).withColumn("_n", F.row_number().over(Window.orderBy(*by)))  # take + 1 rows
    unions = [r.alias for r in profile.reducers if r.kind == "union"]
    rows = bounded_unions(rows.withColumns({u: F.when(F.col("_n") <= take, F.col(u)) for u in unions}), profile)
    held = rows.orderBy("_n").drop("_n").collect()
    page = df.sparkSession.createDataFrame(held[:take], groups.schema)
    if len(held) <= take:
        return GroupPage(page, snapshot)
    last = held[take - 1]
    return GroupPage(page, snapshot, encode_token(bound_to, [snapshot, limit, last[order], last["group_key"]]))
