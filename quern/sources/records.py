"""Record streams: idempotent append of batches, and trimming to the newest records."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.streams import keep_newest, statistics
from quern.plans.declarations import Declared, Stream, Type
from quern.sources.commits import CommitLog, Conflict

RECORD = "cursor long, record_id string, occurred_at timestamp, payload string"
_TYPES = {Type.INT32: T.IntegerType(), Type.INT64: T.LongType(), Type.DECIMAL: T.DecimalType(38, 10), Type.BOOLEAN: T.BooleanType(), Type.DATETIME: T.TimestampType()}


def stream_schema(stream: Stream) -> T.StructType:
    out = T._parse_datatype_string(RECORD)
    for f in stream.fields:
        one = _TYPES.get(f.type, T.StringType())
        out = out.add(f.name, T.ArrayType(one) if f.multiple else one)
    return out


class Rejected(RuntimeError):
    """A batch that is not appended, as a whole."""


@dataclass(frozen=True)
class Outcome:
    rows: int
    last_cursor: int
    replayed: bool = False


class RecordStore:
    """Streams by (tenant, scope). Cursors rise by one from record to record and are never used again."""

    def __init__(self, spark: SparkSession, folder: str, stream: Stream, window: dt.timedelta = dt.timedelta(days=1), skew: dt.timedelta = dt.timedelta(minutes=5), clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self._spark, self._stream, self._folder, self._window, self._skew, self._clock = spark, stream, folder, window, skew, clock
        self._logs: dict[tuple[str, str], CommitLog] = {}

    def _log(self, tenant: str, scope: str) -> CommitLog:
        at = (tenant, scope)
        if at not in self._logs:
            self._logs[at] = CommitLog(self._spark, f"{self._folder}/{self._stream.name}/tenant={quote(tenant, safe='')}/scope={quote(scope, safe='')}")
        return self._logs[at]

    def read(self, tenant: str, scope: str) -> DataFrame:
        """All retained records."""
        return self._rows(self._log(tenant, scope).latest()[1])

    def _rows(self, state: dict) -> DataFrame:
        schema, parts = stream_schema(self._stream), state.get("parts", [])
        rows = self._spark.read.schema(schema).parquet(*parts) if parts else self._spark.createDataFrame([], schema)
        return rows.filter(F.col("cursor") >= state["low"]) if state.get("low") is not None else rows

    def state(self, tenant: str, scope: str) -> dict:
        """last_cursor and high_water over the stream's whole life, which trims don't lower."""
        held = self._log(tenant, scope).latest()[1]
        return {"last_cursor": held.get("last_cursor", 0), "high_water": held.get("high_water")}

    def _admit(self, issued_at: dt.datetime, clock: float) -> None:
        at = issued_at.timestamp()
        if at > clock + self._skew.total_seconds():
            raise Rejected("issued in the future")
        if at < clock - (self._window + self._skew).total_seconds():
            raise Rejected("issued too long ago")

    def append(self, tenant: str, scope: str, records: DataFrame, issued_at: dt.datetime, nonce: str) -> Outcome:
        """Appends records (record_id, occurred_at, payload and fields) in the order of occurred_at and record_id.

        The same operation (issued_at, nonce) with the same records again gives the first outcome; with others it is
        rejected, as is a record id that the stream holds or the batch repeats.
        """
        log, operation = self._log(tenant, scope), f"{issued_at.isoformat()}|{nonce}"
        rows = self._typed(records)
        n, mark = self._seen(rows)
        if n > self._stream.max_batch:
            raise Declared(f"a batch has at most {self._stream.max_batch} records")
        for _ in range(5):
            at, state = log.latest()
            ledger = dict(state.get("appends", {}))
            if operation in ledger:
                if ledger[operation]["mark"] != f"{n}:{mark}":
                    raise Rejected("the operation was another one")
                return Outcome(ledger[operation]["rows"], ledger[operation]["last"], True)
            clock = max(self._clock().timestamp(), state.get("clock", 0.0))
            self._admit(issued_at, clock)
            last = state.get("last_cursor", 0)
            placed = rows.withColumn("cursor", F.row_number().over(Window.orderBy("occurred_at", "record_id")) + F.lit(last))  # max_batch rows at most
            added = self._added(log, state, rows, placed, n)
            ledger[operation] = {"mark": f"{n}:{mark}", "rows": n, "last": last + n, "until": clock + 2 * (self._window + self._skew).total_seconds()}
            ledger = {k: v for k, v in ledger.items() if v["until"] >= clock}  # by then the operation is too old to be admitted
            try:
                log.commit(at, {**state, **added, "clock": clock, "appends": ledger})
            except Conflict:
                continue
            return Outcome(n, last + n)
        raise Conflict("other writers were always faster")

    def append_numbered(self, tenant: str, scope: str, records: DataFrame, source: str, number: int) -> Outcome:
        """Appends a batch of any size, whenever it comes, as number of its source; numbers of a source rise.

        The source's last number with the same records again gives its first outcome; other records or a smaller number
        are rejected, as is a record id that the stream holds or the batch repeats.
        """
        log, rows = self._log(tenant, scope), self._typed(records)
        n, mark = self._seen(rows)
        scratch, ranged = f"{log.folder}/{uuid.uuid4().hex}", None
        for _ in range(5):
            at, state = log.latest()
            held = state.get("sources", {}).get(source)
            if held and number <= held["number"]:
                if number < held["number"] or held["mark"] != f"{n}:{mark}":
                    raise Rejected("the operation was another one")
                return Outcome(held["rows"], held["last"], True)
            last = state.get("last_cursor", 0)
            ranged = ranged or self._ranged(scratch, rows)
            added = self._added(log, state, rows, ranged.withColumn("cursor", F.col("cursor") + F.lit(last)), n)
            sources = {**state.get("sources", {}), source: {"number": number, "mark": f"{n}:{mark}", "rows": n, "last": last + n}}
            try:
                log.commit(at, {**state, **added, "sources": sources})
            except Conflict:
                continue
            log.drop(scratch)
            return Outcome(n, last + n)
        raise Conflict("other writers were always faster")

    def _typed(self, records: DataFrame) -> DataFrame:
        return records.select([F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in stream_schema(self._stream) if f.name != "cursor"])

    def _seen(self, rows: DataFrame) -> tuple[int, object]:
        """How many records a batch has, and a checksum of them."""
        n, ids, mark = rows.agg(F.count(F.lit(1)), F.count_distinct("record_id"), F.sum(F.xxhash64(*[F.col(c).cast("string") for c in rows.columns]).cast("decimal(38,0)"))).first()
        if ids < n:
            raise Rejected("the batch repeats a record id, or lacks one")
        return n, mark

    def _ranged(self, path: str, rows: DataFrame) -> DataFrame:
        """rows with cursor, from 1 on in the order of occurred_at and record_id: ranges are sorted in tasks of their own, their sizes are added up."""
        placed = rows.repartitionByRange("occurred_at", "record_id").sortWithinPartitions("occurred_at", "record_id").withColumn("_place", F.monotonically_increasing_id())
        placed.write.parquet(path)
        placed = self._spark.read.schema(placed.schema).parquet(path).withColumn("_range", F.shiftright("_place", 33))
        before, at = {}, 0
        for r in sorted(placed.groupBy("_range").count().collect()):  # a row for each partition of the shuffle
            before[r["_range"]], at = at, at + r["count"]
        if not before:
            return placed.withColumn("cursor", F.col("_place")).drop("_place", "_range")
        first = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[F.col("_range")]
        return placed.withColumn("cursor", first + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1)).drop("_place", "_range")

    def _added(self, log: CommitLog, state: dict, rows: DataFrame, placed: DataFrame, n: int) -> dict:
        """Writes the n rows as placed; what that changes of the state."""
        if not self._rows(state).select("record_id").join(rows.select("record_id"), "record_id", "left_semi").isEmpty():
            raise Rejected("the stream holds a record id of the batch")
        path = f"{log.folder}/{uuid.uuid4().hex}"
        placed.select(stream_schema(self._stream).names).write.parquet(path)
        high = state.get("high_water")
        if self._stream.high_water and n:
            seen = rows.agg(F.max(self._stream.high_water)).first()[0]
            high = seen if high is None else high if seen is None else max(high, seen)
        return {"parts": [*state.get("parts", []), path], "last_cursor": state.get("last_cursor", 0) + n, "high_water": high}

    def trim(self, tenant: str, scope: str, keep: int, issued_at: dt.datetime | None = None, nonce: str | None = None) -> Outcome:
        """Keeps the newest records; how many went. Cursors and high water stay.

        A trim with an operation (issued_at, nonce) is done once: again, it gives its first outcome, however many
        records came since; with another keep it is rejected, as is one issued outside the admission window.
        """
        log, operation = self._log(tenant, scope), None if nonce is None else f"{issued_at.isoformat()}|{nonce}"
        for _ in range(5):
            at, state = log.latest()
            ledger, extra = dict(state.get("trims", {})), {}
            if operation is not None:
                clock = max(self._clock().timestamp(), state.get("clock", 0.0))
                ledger = {k: v for k, v in ledger.items() if v["until"] >= clock}
                if operation in ledger:
                    if ledger[operation]["keep"] != keep:
                        raise Rejected("the operation was another one")
                    return Outcome(ledger[operation]["rows"], ledger[operation]["last"], True)
                self._admit(issued_at, clock)
            rows, last = self._rows(state), state.get("last_cursor", 0)
            before, kept = rows.count(), keep_newest(rows, keep)
            low = last + 1 if keep == 0 else kept.agg(F.min("cursor")).first()[0]
            gone = before - min(before, keep)
            if operation is not None:
                ledger[operation] = {"keep": keep, "rows": gone, "last": last, "until": clock + 2 * (self._window + self._skew).total_seconds()}
                extra = {"clock": clock, "trims": ledger}
            if not gone and not extra:
                return Outcome(0, last)
            try:
                log.commit(at, {**state, **extra, **({"low": low} if gone else {})})
            except Conflict:
                continue
            return Outcome(gone, last)
        raise Conflict("other writers were always faster")

    def statistics(self, tenant: str, scope: str) -> DataFrame:
        """One row: retained, newest_cursor, and last_cursor and high_water over the stream's whole life, which trims don't lower."""
        life = self.state(tenant, scope)
        return statistics(self.read(tenant, scope), self._stream).select("retained", "newest_cursor", F.lit(life["last_cursor"]).cast("long").alias("last_cursor"), F.lit(life["high_water"]).alias("high_water"))

    def compact(self, tenant: str, scope: str) -> None:
        """Rewrites the retained records as one part, sorted by cursor in ranges."""
        log = self._log(tenant, scope)
        at, state = log.latest()
        path = f"{log.folder}/{uuid.uuid4().hex}"
        self._rows(state).repartitionByRange("cursor").sortWithinPartitions("cursor").write.parquet(path)
        log.commit(at, {**state, "parts": [path], "low": None})
