import duckdb
import pytest
from pyspark.sql import functions as F

from quern import catalog

STREAMS = ("stream_equal", "stream_in", "stream_range", "stream_contains", "stream_multiple", "stream_tree", "stream_latest_per_key")
GROUPS = ("group_min_max_instant", "group_sum", "group_max", "group_set_union", "group_first_by_asc", "group_first_by_desc", "group_having", "group_page2", "group_profile_full")


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """More events than a page or a window of newest records holds; the oldest ones differ from all others."""
    folder, i = str(tmp_path_factory.mktemp("many")), F.col("id")
    old = i < 50
    kind = F.when(old, "signup").when(i % 3 == 0, "view").when(i % 3 == 1, "click").otherwise("purchase")
    user = F.when(old, i % 5).when(i % 4 == 0, 3).when(i % 4 == 1, 7).otherwise(i % 300_007)
    events = spark.range(1_050_000).select(i.alias("event_id"), F.timestamp_seconds(i).cast("timestamp_ntz").alias("ts"), user.cast("long").alias("user_id"), kind.alias("event_type"), F.when(old, 5000.0).otherwise(20.0 + i % 20).alias("value"), F.lit('{"k": 1}').alias("props"))
    events.repartition(4).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS + GROUPS)
def test_all_events_count(spark, many, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    got = catalog.QUERIES[name](spark, many).collect()
    assert name not in STREAMS or len(want) > 100_000
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
