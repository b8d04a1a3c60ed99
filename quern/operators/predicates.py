"""Comparisons as Columns: exact null complements, literal text matching, membership, keyset bounds."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.text import Policy
from quern.plans.declarations import Declared, Op, Unit, sql_type
from quern.plans.requests import Compare, Filter


def comparison(c: Compare, column: Column, kind: str | None = None) -> Column:
    """One comparison. Every result is true or false, never null, so that complements are exact.

    The test for null is a conjunct of its own, so that scans can be asked both.

    kind: the column's SQL type, to which members of a collection are cast, so that 1, 1.0 and 1e0 are one value.
    """
    v = c.value
    if c.op is Op.EQUAL:
        return column.isNull() if v is None else column.eqNullSafe(F.lit(v))
    if c.op is Op.NOT_EQUAL:
        return column.isNotNull() if v is None else ~column.eqNullSafe(F.lit(v))
    if c.op is Op.IN:
        known = [x for x in v if x is not None]
        found = column.isNotNull() & column.isin(known) if known else F.lit(False)
        return found | column.isNull() if len(known) < len(v) else found
    if c.op is Op.CONTAINS:
        return column.isNotNull() & text.contains_ignore_case(column, v)
    if c.op is Op.NOT_CONTAINS:
        return column.isNull() | ~text.contains_ignore_case(column, v)
    if c.op is Op.STARTS_WITH:
        return column.isNotNull() & text.starts_ignore_case(column, v)
    if c.op is Op.HAS:
        return column.isNotNull() & F.coalesce(F.array_contains(column, _member(v, kind)), F.lit(False))
    if c.op is Op.HAS_ALL:
        if not v:
            raise Declared("has all needs values")
        wanted = F.array_distinct(F.array(*[_member(x, kind) for x in v]))
        return column.isNotNull() & (F.size(F.array_except(wanted, column)) == 0)
    bound = F.lit(v)
    ranges = {Op.GREATER: column > bound, Op.GREATER_EQUAL: column >= bound, Op.LESS: column < bound, Op.LESS_EQUAL: column <= bound}
    return column.isNotNull() & ranges[c.op]


def _member(v: object, kind: str | None) -> Column:
    return F.lit(v).cast(kind) if kind else F.lit(v)


def identity_comparison(c: Compare, column: Column, policy: Policy) -> Column:
    """A comparison of document ids by their keys under the unit's policy. Substrings are refused."""
    key = text.comparison_key(column, policy)
    k = lambda v: text.key_of(v, policy)
    if c.op in (Op.EQUAL, Op.NOT_EQUAL, Op.IN):
        value = [k(x) for x in c.value] if c.op is Op.IN else k(c.value)
        return comparison(Compare(c.path, c.op, value), key)
    if c.op is Op.STARTS_WITH:
        return F.startswith(key, F.lit(k(c.value)))
    if c.op in (Op.GREATER, Op.GREATER_EQUAL, Op.LESS, Op.LESS_EQUAL):
        return comparison(Compare(c.path, c.op, k(c.value)), key)
    raise Declared(f"ids can't be asked {c.op.value}")


def filter_column(unit: Unit, where: Filter) -> Column:
    """All clauses, of each any comparison; an empty clause matches nothing."""
    clauses = []
    for clause in where:
        parts = []
        for c in clause:
            if c.path == "id":
                parts.append(identity_comparison(c, F.col("id"), unit.id_policy))
            else:
                f = unit.field(c.path)
                parts.append(comparison(c, F.col(c.path), sql_type(f) if f.collection else None))
        clauses.append(reduce(or_, parts, F.lit(False)) if not parts else reduce(or_, parts))
    return reduce(and_, clauses) if clauses else F.lit(True)


def order_columns(order: list[tuple[str, bool]]) -> list[Column]:
    """Nulls first ascending, last descending; ids by their UTF-16 order."""
    by = lambda p: text.ordinal_key(F.col(p)) if p == "id" else F.col(p)
    return [by(p).desc_nulls_last() if down else by(p).asc_nulls_first() for p, down in order]


def keyset_column(order: list[tuple[str, bool]], boundary: list[object]) -> Column:
    """Rows strictly after the boundary in the order, nulls placed as order_columns does."""
    out, same = F.lit(False), F.lit(True)
    for (path, down), v in zip(order, boundary, strict=True):
        column, bound = (text.ordinal_key(F.col(path)), F.lit(text.key_of(v))) if path == "id" else (F.col(path), F.lit(v))
        if v is None:
            later = F.lit(False) if down else column.isNotNull()
        else:
            later = column.isNull() | (column < bound) if down else column.isNotNull() & (column > bound)
        out = out | (same & later)
        same = same & (column.isNull() if v is None else column.eqNullSafe(bound))
    return out
