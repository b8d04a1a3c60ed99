"""Additive schema evolution, backfill of projections, and upgrades of documents by version."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import values
from quern.plans.declarations import Declared, Field, Type, Unit


@dataclass(frozen=True)
class Change:
    kind: str  # create, add field, add index
    unit: str
    path: str | None = None


def additive_changes(recorded: list[Unit], declared: list[Unit]) -> list[Change]:
    """What is new in the declared units. Anything changed or removed is an error."""
    old = {u.name: u for u in recorded}
    out: list[Change] = []
    gone = set(old) - {u.name for u in declared}
    if gone:
        raise Declared(f"removed: {', '.join(sorted(gone))}")
    for u in declared:
        if u.name not in old:
            out.append(Change("create", u.name))
            continue
        was = {f.path: f for f in old[u.name].fields}
        if old[u.name].id_policy is not u.id_policy or old[u.name].scoped != u.scoped:
            raise Declared(f"{u.name}: identity and scoping can't change")
        lost = set(was) - {f.path for f in u.fields}
        if lost:
            raise Declared(f"{u.name}: removed {', '.join(sorted(lost))}")
        for f in u.fields:
            if f.path not in was:
                out.append(Change("add field", u.name, f.path))
            elif was[f.path] != f:
                raise Declared(f"{u.name}.{f.path}: changed")
    return out


def project(df: DataFrame, f: Field, document: str = "document") -> DataFrame:
    """df with the field filled from the canonical JSON. Numbers are read by their digits; those that don't fit are null.

    Members are found by a JSON parser that keeps numbers as written; Spark's own JSON functions would go by way of doubles.
    """
    path = f.path.split(".")

    @F.pandas_udf("array<string>" if f.collection else "string")
    def lexeme(docs: pd.Series) -> pd.Series:
        def one(text: str | None):
            at = json.loads(text, parse_int=str, parse_float=str) if text else None
            for key in path:
                at = at.get(key) if isinstance(at, dict) else None
            if f.collection:
                return None if not isinstance(at, list) else [_lexeme(x) for x in at]
            return _lexeme(at)

        return docs.map(one)

    c = lexeme(F.col(document))
    return df.withColumn(f.path, F.transform(c, lambda x: _typed(x, f)) if f.collection else _typed(c, f))


def _lexeme(x: object) -> str | None:
    return None if x is None or isinstance(x, (dict, list)) else str(x).lower() if isinstance(x, bool) else x


def _typed(c, f: Field):
    if f.type is Type.INT32:
        return values.exact_integer(c, "int")
    if f.type is Type.INT64:
        return values.exact_integer(c)
    if f.type is Type.DECIMAL:
        return values.exact_decimal(c, f.precision, f.scale)
    if f.type is Type.BOOLEAN:
        return F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False)
    if f.type is Type.DATETIME:
        return values.instant(c)
    return c


class Upgrades:
    """Steps from one document version to the next, applied when documents are read."""

    def __init__(self, current: str, steps: dict[str, tuple[str, Callable[[dict], dict]]]):
        self.current, self._steps = current, steps
        for start in steps:
            seen, at = set(), start
            while at != current:
                if at in seen or at not in steps:
                    raise Declared(f"no way from version {start} to {current}")
                seen.add(at)
                at = steps[at][0]

    def apply(self, version: str, document: str) -> str:
        held = json.loads(document)
        while version != self.current:
            if version not in self._steps:
                raise Declared(f"unknown version {version}")
            version, step = self._steps[version]
            held = step(held)
        return json.dumps(held, separators=(",", ":"))

    def read(self, df: DataFrame) -> DataFrame:
        """df with all documents at the current version; those that are there already don't go to Python."""
        steps, current = self, self.current

        def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["document"] = [steps.apply(v, d) for v, d in zip(b["schema_version"], b["document"], strict=True)]
                b["schema_version"] = current
                yield b

        old = df.filter(F.col("schema_version") != current)
        return df.filter(F.col("schema_version") == current).unionByName(old.mapInPandas(up, df.schema))
