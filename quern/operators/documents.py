"""Document queries: pages by offset or cursor, count, any, first, latest per key.

A unit's rows are a DataFrame with a string column id, the unit's fields, and storage_scope if it is scoped. Only the
boundary of a page comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.predicates import filter_column, keyset_column, order_columns
from quern.plans.declarations import Paging, Query, Unit
from quern.plans.requests import Request, check, decode_token, encode_token, request_fingerprint, resolve_order


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int | None = None
    next: str | None = None


def in_scope(df: DataFrame, unit: Unit, scope: str | None, across: bool = False) -> DataFrame:
    """The rows a session may see. Reading across scopes must be asked for."""
    if not unit.scoped or across:
        return df
    if scope is None:
        raise PermissionError(f"{unit.name} needs a scope")
    return df.filter(F.col("storage_scope") == scope)


def _total_order(unit: Unit, query: Query, request: Request) -> list[tuple[str, bool]]:
    """The declared order, then the scope and the id, so that no two rows tie."""
    return [*resolve_order(query, request.order), *([("storage_scope", False)] if unit.scoped else []), ("id", False)]


def page_order(unit: Unit, request: Request) -> list[Column]:
    """The total order of a request's pages, to sort by again where rows were joined."""
    return order_columns(_total_order(unit, check(unit, request), request))


def selection(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False) -> DataFrame:
    """All rows that the request's filter selects; of each key the first in order, where latest-per-key is declared."""
    query = check(unit, request)
    rows = in_scope(df, unit, scope, across).filter(filter_column(unit, request.where))
    if query.latest_key:
        over = Window.partitionBy(query.latest_key).orderBy(*order_columns(_total_order(unit, query, request)))
        rows = rows.withColumn("_n", F.row_number().over(over)).filter("_n = 1").drop("_n")
    return rows


def page_rows(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False) -> DataFrame:
    """The rows of one page in order; lazy."""
    return _page(df, unit, request, scope, across)


def _page(df: DataFrame, unit: Unit, request: Request, scope: str | None, across: bool, probe: int = 0) -> DataFrame:
    """page_rows and as many rows more as probe."""
    query = check(unit, request)
    order = _total_order(unit, query, request)
    rows = selection(df, unit, request, scope, across)
    if request.after is not None:
        rows = rows.filter(keyset_column(order, decode_token(request.after, request_fingerprint(unit, request, scope))))
    rows = rows.orderBy(*order_columns(order))
    if request.skip:
        rows = rows.offset(request.skip)
    return rows.limit((query.max_take if request.take is None else request.take) + probe)


def query_page(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False, total: bool = False) -> Page:
    """A page, its total if asked for, and the token of the next page if there is one.

    The boundary is found by the page's order alone, with one row more than the page: at most max_take + 1 narrow rows.
    """
    query = check(unit, request)
    take = query.max_take if request.take is None else request.take
    n = count(df, unit, request, scope, across) if total else None
    if n == 0 or take == 0:
        return Page(df.limit(0), n)
    rows = page_rows(df, unit, request, scope, across)
    if query.paging is not Paging.CURSOR:
        return Page(rows, n)
    order = _total_order(unit, query, request)
    held = _page(df, unit, request, scope, across, probe=1).select(*[p for p, _ in order]).collect()
    return Page(rows, n, encode_token(request_fingerprint(unit, request, scope), list(held[take - 1])) if len(held) > take else None)


def count_rows(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False) -> DataFrame:
    """One row: n, the rows selected, or the keys where latest-per-key is declared (null is a key)."""
    query = check(unit, request)
    rows = in_scope(df, unit, scope, across).filter(filter_column(unit, request.where))
    if query.latest_key:
        rows = rows.select(query.latest_key).distinct()
    return rows.agg(F.count(F.lit(1)).alias("n"))


def count(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False) -> int:
    return count_rows(df, unit, request, scope, across).first()["n"]


def any_row(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False) -> bool:
    check(unit, request)
    return not in_scope(df, unit, scope, across).filter(filter_column(unit, request.where)).isEmpty()


def first_rows(df: DataFrame, unit: Unit, request: Request, scope: str | None = None, across: bool = False) -> DataFrame:
    """The first row in order after request.skip rows; no row if there is none."""
    return page_rows(df, unit, Request(request.query, request.where, request.order, request.skip, 1, request.after), scope, across)


def load(df: DataFrame, unit: Unit, document_id: str, scope: str | None = None) -> Row | None:
    """A document by its id, under the unit's policy."""
    key = text.key_of(document_id, unit.id_policy)
    return in_scope(df, unit, scope).filter(text.comparison_key(F.col("id"), unit.id_policy) == key).limit(1).first()


def explain(df: DataFrame) -> str:
    """Spark's formatted plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
