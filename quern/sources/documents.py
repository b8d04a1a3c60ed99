"""Documents as Parquet snapshots: save, load, delete, units of work, bulk mutations; all by optimistic concurrency.

A batch of writes is one Spark job that rewrites the unit, and one commit. It is meant for batches, not single rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text
from quern.operators import documents, mutations
from quern.plans.declarations import Field, Type, Unit, compose
from quern.plans.requests import Request, request_fingerprint
from quern.sources.commits import CommitLog, Conflict

ENVELOPE = "id string, storage_scope string, version long, schema_version string, document string, created_utc timestamp, updated_utc timestamp"
_ATTEMPTS = 5


def field_type(f: Field) -> T.DataType:
    one = {Type.INT32: T.IntegerType(), Type.INT64: T.LongType(), Type.DECIMAL: T.DecimalType(f.precision, f.scale), Type.BOOLEAN: T.BooleanType(), Type.DATETIME: T.TimestampType(), Type.BINARY: T.BinaryType()}.get(f.type, T.StringType())
    return T.ArrayType(one) if f.collection else one


def member(value: object, path: str) -> object:
    """A member of nested objects by its dotted path; None where there is none."""
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def unit_schema(unit: Unit) -> T.StructType:
    out = T._parse_datatype_string(ENVELOPE)
    for f in unit.fields:
        out = out.add(f.path, field_type(f))
    return out


@dataclass(frozen=True)
class Save:
    """expected: None writes whatever is there, 0 only creates, n replaces version n."""

    id: str
    document: str
    fields: dict
    expected: int | None = None
    scope: str | None = None
    schema_version: str = "1"


@dataclass(frozen=True)
class Delete:
    id: str
    expected: int | None = None
    scope: str | None = None


class Refused(RuntimeError):
    """A batch that can't be committed, as a whole: a version, a unique value or a scope is against it."""


class DocumentStore:
    def __init__(self, spark: SparkSession, folder: str, units: list[Unit], clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self._spark, self._log, self._clock = spark, CommitLog(spark, folder), clock
        self._units = {u.name: u for u in compose(tuple(units))}

    def read(self, unit: str, commit: int | None = None) -> DataFrame:
        """The unit's rows at a commit, or now."""
        state = self._log.latest()[1] if commit is None else self._log.read(commit) if commit >= 0 else {}
        return self._rows(unit, state)

    def version(self) -> int:
        return self._log.latest()[0]

    def _rows(self, unit: str, state: dict) -> DataFrame:
        at, schema = state.get("tables", {}).get(unit), unit_schema(self._units[unit])
        return self._spark.read.schema(schema).parquet(at) if at else self._spark.createDataFrame([], schema)

    def load(self, unit: str, document_id: str, scope: str | None = None, commit: int | None = None) -> Row | None:
        return documents.load(self.read(unit, commit), self._units[unit], document_id, scope)

    def write(self, batch: dict[str, list[Save | Delete]]) -> int:
        """Writes all units of a batch in one commit, or nothing. The commit's number."""
        for _ in range(_ATTEMPTS):
            n, state = self._log.latest()
            tables = dict(state.get("tables", {}))
            for unit, ops in batch.items():
                tables[unit] = self._publish(unit, self._applied(self._units[unit], self._rows(unit, state), ops))
            try:
                return self._log.commit(n, {**state, "tables": tables})
            except Conflict:
                continue  # versions are checked anew against what was committed
        raise Conflict("other writers were always faster")

    def save_json(self, unit: str, values: dict[str, dict], scope: str | None = None, expected: int | None = None) -> int:
        """Writes JSON objects by id; the unit's fields are taken from them by their paths."""
        u = self._units[unit]
        return self.write({unit: [Save(i, json.dumps(v, separators=(",", ":")), {f.path: member(v, f.path) for f in u.fields}, expected, scope) for i, v in values.items()]})

    def load_json(self, unit: str, document_id: str, scope: str | None = None) -> dict | None:
        row = self.load(unit, document_id, scope)
        return None if row is None else json.loads(row["document"])

    def first_json(self, unit: str, request: Request, scope: str | None = None) -> dict | None:
        """The first document in the request's order, or None."""
        row = documents.first_rows(self.read(unit), self._units[unit], request, scope).select("document").first()
        return None if row is None else json.loads(row["document"])

    def query_json(self, unit: str, request: Request, schema: str, scope: str | None = None) -> DataFrame:
        """A page's documents as rows of a schema, with their ids."""
        page = documents.page_rows(self.read(unit), self._units[unit], request, scope)
        return page.select("id", F.from_json("document", schema).alias("j")).select("id", "j.*")

    def _publish(self, unit: str, rows: DataFrame) -> str:
        path = f"{self._log.folder}/{unit}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _key(self, unit: Unit) -> list:
        return [text.comparison_key(F.col("id"), unit.id_policy).alias("_key"), F.coalesce("storage_scope", F.lit("")).alias("_scope")]

    def _applied(self, unit: Unit, rows: DataFrame, ops: list[Save | Delete]) -> DataFrame:
        now = self._clock()
        keys = [(text.key_of(o.id, unit.id_policy), o.scope or "") for o in ops]
        if len(set(keys)) < len(keys):
            raise Refused("a batch writes a document twice")
        if any(unit.scoped != (o.scope is not None) for o in ops):
            raise Refused(f"{unit.name} is {'scoped' if unit.scoped else 'global'}")
        wanted = self._spark.createDataFrame([(*k, o.expected, isinstance(o, Save)) for k, o in zip(keys, ops, strict=True)], "_key string, _scope string, _expected long, _save boolean")
        keyed = rows.select("*", *self._key(unit))
        there = wanted.join(keyed.select("_key", "_scope", "version", "created_utc"), ["_key", "_scope"], "left").collect()  # a row for each operation of the batch
        held = {(r["_key"], r["_scope"]): r for r in there}
        new = []
        for k, o in zip(keys, ops, strict=True):
            r = held[k]
            at = r["version"]
            if (o.expected is not None and o.expected != (at or 0)) or (isinstance(o, Delete) and at is None):
                raise Refused(f"{o.id}: expected version {o.expected}, found {at}")
            if unit.append_only and at is not None:
                raise Refused(f"{o.id}: {unit.name} is append-only")
            if isinstance(o, Save):
                new.append((o.id, o.scope, (at or 0) + 1, o.schema_version, o.document, r["created_utc"] or now, now, *[o.fields.get(f.path) for f in unit.fields]))
        left = keyed.join(wanted.select("_key", "_scope"), ["_key", "_scope"], "left_anti").drop("_key", "_scope")
        out = left.unionByName(self._spark.createDataFrame(new, unit_schema(unit)))
        for f in unit.fields:
            if f.unique and not out.filter(F.col(f.path).isNotNull()).groupBy("storage_scope", f.path).count().filter("count > 1").isEmpty():
                raise Refused(f"{f.path} must be unique")
        return out

    def mutate(self, unit: str, name: str, request: Request, operation: str, scope: str | None = None) -> tuple[int, bool]:
        """(rows, replayed) of a declared mutation. The same operation again gives the first result; with another request it is refused."""
        u = self._units[unit]
        print_ = request_fingerprint(u, request, scope)
        for _ in range(_ATTEMPTS):
            n, state = self._log.latest()
            ledger = dict(state.get("mutations", {}))
            if operation in ledger:
                if ledger[operation]["print"] != f"{name}:{print_}":
                    raise Refused(f"operation {operation} was another one")
                return ledger[operation]["rows"], True
            rows = self._rows(unit, state)
            related = {g.unit: (self._units[g.unit], self._rows(g.unit, state)) for g in u.mutation(name).guards}
            changed = mutations.affected(rows, u, name, request, scope, related)
            tables = dict(state.get("tables", {}))
            if changed:
                tables[unit] = self._publish(unit, mutations.mutate(rows, u, name, request, scope, self._clock(), related))
            ledger[operation] = {"print": f"{name}:{print_}", "rows": changed}
            try:
                self._log.commit(n, {**state, "tables": tables, "mutations": ledger})
            except Conflict:
                continue
            return changed, False
        raise Conflict("other writers were always faster")


class UnitOfWork:
    """Collects writes and commits them together. After a refusal it can only be rolled back."""

    def __init__(self, store: DocumentStore):
        self._store, self._batch, self._state, self._seen = store, {}, "open", None

    def _add(self, unit: str, op: Save | Delete) -> None:
        if self._state != "open":
            raise Refused(f"the unit of work is {self._state}")
        self._batch.setdefault(unit, []).append(op)

    def save(self, unit: str, op: Save) -> None:
        self._add(unit, op)

    def delete(self, unit: str, op: Delete) -> None:
        self._add(unit, op)

    def load(self, unit: str, document_id: str, scope: str | None = None) -> Row | None:
        """A document as it was when the unit of work first looked, whatever others committed since."""
        if self._state != "open":
            raise Refused(f"the unit of work is {self._state}")
        if self._seen is None:
            self._seen = self._store.version()
        return self._store.load(unit, document_id, scope, self._seen)

    def commit(self) -> int:
        if self._state != "open":
            raise Refused(f"the unit of work is {self._state}")
        self._state = "poisoned"
        n = self._store.write(self._batch)
        self._state = "committed"
        return n

    def rollback(self) -> None:
        self._batch, self._state = {}, "rolled back"
