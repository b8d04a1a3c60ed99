import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.plans.declarations import Stream, StreamField, Type
from quern.sources.records import RecordStore, Rejected
from quern.streaming.ingest import append_stream

NOW = dt.datetime(2026, 7, 12, 12, 0, tzinfo=dt.UTC)
STREAM = Stream("logs", (StreamField("sequence", Type.INT64, orderable=True),), high_water="sequence", max_batch=100)
SCHEMA = "record_id string, occurred_at timestamp, payload string, sequence long"


def test_large_and_late_batches_arrive_whole(spark, tmp_path):
    source, now = tmp_path / "in", [NOW]
    store = RecordStore(spark, f"file://{tmp_path}/rec", STREAM, clock=lambda: now[0])

    def more(low, high):  # later records come first in the files
        i = F.col("id")
        rows = spark.range(low, high, 1, 3).select(F.lpad(i.cast("string"), 6, "0").alias("record_id"), F.timestamp_seconds(1_000_000 - (i / 7).cast("long")).alias("occurred_at"), F.lit("x").alias("payload"), i.alias("sequence"))
        rows.write.mode("append").json(str(source))
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        query = append_stream(stream, store, "t", "s", str(tmp_path / "checkpoint"), NOW, once=True)
        assert query.awaitTermination(100) and query.exception() is None

    more(0, 250)
    now[0] = NOW + dt.timedelta(days=9)
    more(250, 500)
    rows = sorted(store.read("t", "s").collect())
    assert [r["cursor"] for r in rows] == list(range(1, 501))
    assert [r["record_id"] for r in rows] == [f"{i:06}" for low in (0, 250) for i in sorted(range(low, low + 250), key=lambda i: (-(i // 7), i))]
    assert store.state("t", "s") == {"last_cursor": 500, "high_water": 499}


def test_numbered_batches_replay(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/rec", STREAM, clock=lambda: NOW)
    one, two = (spark.createDataFrame([(x, NOW, "", 1) for x in ids], SCHEMA) for ids in (("a", "b"), ("c",)))
    assert store.append_numbered("t", "s", one, "src", 0).last_cursor == 2
    again = store.append_numbered("t", "s", one, "src", 0)
    assert (again.rows, again.last_cursor, again.replayed) == (2, 2, True)
    assert store.append_numbered("t", "s", two, "src", 1).last_cursor == 3
    for rows, number in ((one, 0), (one, 1), (one, 2)):
        with pytest.raises(Rejected):
            store.append_numbered("t", "s", rows, "src", number)
    assert store.read("t", "s").count() == 3
