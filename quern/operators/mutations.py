"""Declared bulk mutations: new rows, and how many the selection held."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.documents import set_member
from quern.operators.documents import explain, in_scope
from quern.operators.predicates import filter_column
from quern.plans.declarations import Declared, Guard, Mutation, NoReferences, Op, Unit
from quern.plans.requests import Compare, Request, check


#: The units that guards name, each with its rows.
Related = dict[str, tuple[Unit, DataFrame]]


def _selected(unit: Unit, name: str, request: Request, scope: str | None) -> tuple[Mutation, Column]:
    m = unit.mutation(name)
    if request.query != m.query:
        raise Declared(f"{name} selects by {m.query}")
    check(unit, request)
    if not request.where:
        raise Declared(f"{name} must select by a predicate")
    where = request.where
    if m.action == "transition":
        where = (*where, (Compare(m.path, Op.IN, list(m.sources)),))
    chosen = filter_column(unit, where)
    if unit.scoped:
        if scope is None:
            raise PermissionError(f"{unit.name} needs a scope")
        chosen = chosen & (F.col("storage_scope") == scope)
    return m, chosen


def _guard(df: DataFrame, unit: Unit, guard: Guard, related: Related, flag: str) -> DataFrame:
    """df with a flag: whether the guard holds for the row. References and ids meet by the key of the id's policy, and by scope where both units have one."""
    if guard.unit not in related:
        raise Declared(f"{unit.name}: the rows of {guard.unit} are needed for a guard")
    other, rows = related[guard.unit]
    backwards = isinstance(guard, NoReferences)
    policy = unit.id_policy if backwards else other.id_policy
    if not backwards:
        rows = rows.filter(~F.col(guard.path).eqNullSafe(F.lit(guard.value)))
    both = unit.scoped and other.scoped
    there = rows.select(text.comparison_key(F.col(guard.reference if backwards else "id"), policy).alias(f"{flag}_key"), *([F.col("storage_scope").alias(f"{flag}_scope")] if both else []))
    there = there.filter(F.col(f"{flag}_key").isNotNull()).distinct().withColumn(flag, F.lit(True))
    met = text.comparison_key(df["id" if backwards else guard.reference], policy) == there[f"{flag}_key"]
    if both:
        met = met & (df["storage_scope"] == there[f"{flag}_scope"])
    found = F.col(flag).isNull() if backwards else F.col(flag).isNotNull()
    return df.join(there, met, "left").withColumn(flag, found).drop(f"{flag}_key", f"{flag}_scope")


def _guarded(df: DataFrame, unit: Unit, m: Mutation, chosen: Column, related: Related | None) -> tuple[DataFrame, Column, list[str]]:
    """df with a flag for each of the mutation's guards, the selection by them, and the flags' names."""
    flags = []
    for i, guard in enumerate(m.guards):
        flags.append(f"_guard{i}")
        df = _guard(df, unit, guard, related or {}, flags[-1])
        chosen = chosen & F.col(flags[-1])
    return df, chosen, flags


def mutate(df: DataFrame, unit: Unit, name: str, request: Request, scope: str | None = None, now: dt.datetime | None = None, related: Related | None = None) -> DataFrame:
    """All rows of the unit after the mutation. A row that already has the value counts as changed.

    Changed rows get the value in the column and at its path in the document, the next version, and the time, where
    there are such columns. related: the rows of the units that guards name.
    """
    m, chosen = _selected(unit, name, request, scope)
    if m.action == "delete":
        rows, chosen, flags = _guarded(df, unit, m, chosen, related)
        return rows.filter(~chosen).drop(*flags)
    changed = {m.path: F.lit(m.value).cast(dict(df.dtypes)[m.path])}
    if "document" in df.columns:
        changed["document"] = set_member(F.when(chosen, F.col("document")), m.path, m.value)
    if "version" in df.columns:
        changed["version"] = F.col("version") + 1
    if "updated_utc" in df.columns and now is not None:
        changed["updated_utc"] = F.lit(now).cast("timestamp")
    return df.withColumns({c: F.when(chosen, new).otherwise(F.col(c)) for c, new in changed.items()})


def affected(df: DataFrame, unit: Unit, name: str, request: Request, scope: str | None = None, related: Related | None = None) -> int:
    """Rows that the mutation selects and its guards let go."""
    m, chosen = _selected(unit, name, request, scope)
    rows, chosen, _ = _guarded(in_scope(df, unit, scope).filter(chosen), unit, m, chosen, related)
    return rows.filter(chosen).count()


def explain_mutation(df: DataFrame, unit: Unit, name: str, request: Request, scope: str | None = None, related: Related | None = None) -> str:
    """Spark's formatted plan of the selection that a mutation would change; nothing runs."""
    m, chosen = _selected(unit, name, request, scope)
    rows, chosen, flags = _guarded(in_scope(df, unit, scope).filter(chosen), unit, m, chosen, related)
    return explain(rows.filter(chosen).drop(*flags))
