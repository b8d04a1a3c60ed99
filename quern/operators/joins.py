"""Joins that declarations imply: covering rows to documents, elements to owners, and guards between units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hydrate(page: DataFrame, documents: DataFrame, keys: tuple[str, ...] = ("id",), order: list[Column] | None = None) -> DataFrame:
    """The documents of a page of covering rows, in an order if one is given, as joins keep none.

    A page is limited, so Spark broadcasts it by its size.
    """
    rows = page.select(*keys).join(documents, list(keys))
    return rows.orderBy(*order) if order else rows


def owners_with_element(owners: DataFrame, elements: DataFrame, value: object, key: str = "id") -> DataFrame:
    """Owners of which the element table (key, element) holds the value."""
    return owners.join(elements.filter(F.col("element") == F.lit(value)), key, "left_semi")


def owners_with_all_elements(owners: DataFrame, elements: DataFrame, values: list, key: str = "id") -> DataFrame:
    """Owners of which the element table holds every one of the values; counted before the join."""
    wanted = list(dict.fromkeys(values))
    held = elements.filter(F.col("element").isin(wanted)).groupBy(key).agg(F.count_distinct("element").alias("n"))
    return owners.join(held.filter(F.col("n") == len(wanted)), key, "left_semi")


def without_references(targets: DataFrame, references: DataFrame, key: str, reference: str) -> DataFrame:
    """Targets that no row refers to; null references refer to nothing."""
    return targets.join(references.select(F.col(reference).alias(key)).filter(F.col(key).isNotNull()), key, "left_anti")


def related_not_equal(rows: DataFrame, reference: str, targets: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """Rows whose target exists and whose target's column differs from the value (null differs from any value)."""
    ok = targets.filter(~F.col(column).eqNullSafe(F.lit(value))).select(F.col(key).alias(reference))
    return rows.join(ok, reference, "left_semi")
