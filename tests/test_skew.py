"""Hot keys: the spread forms give the same rows as the plain ones."""

import datetime

import pytest
from pyspark.sql import Window, functions as F

from postmill.operators import outbox, schedule, spread

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """6000 rows; one key holds two thirds, many times repeat."""
    i = F.col("id")
    return spark.range(6000).select(
        i.alias("event_id"), F.when(i % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (i % 40).cast("string"))).alias("k"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=((i * 7919) % 500).cast("int"))).alias("ts"),
        ((i * 31) % 17).alias("v")).repartition(7).cache()


def test_attach_spread_equals_broadcast(spark, hot):
    one = hot.select("k").distinct().where("k != 'k3'").withColumn("size", F.length("k"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        wide = spread.attach(hot, one, ["k"], how)
        salted = spread.attach(hot, one, ["k"], how, rows=1, spread=8)
        assert wide.count() == salted.count()
        assert wide.exceptAll(salted).count() == 0


def test_attach_spreads_the_hot_key(spark, hot):
    """With the spread form no task gets the whole hot key."""
    one = hot.select("k").distinct().withColumn("size", F.length("k"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = spread.attach(hot, one, ["k"], rows=1, spread=64)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1500 and sum(sizes) == 6000
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)


def test_equal_rows_of_a_hot_key_go_to_many_tasks(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
                                      F.lit("same").alias("x"))
    one = many.select("k").distinct().withColumn("size", F.length("k"))
    assert len(spread.frequent(many, ["k"])) == 1
    assert spread.frequent(spark.range(5000).select(F.col("id").alias("k")), ["k"]) == []
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = spread.attach(many, one, ["k"], rows=1)
        tasks = out.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 4 and sum(r["count"] for r in tasks) == 10_000 and out.count() == 20_000
        assert out.where("size IS NULL").count() == 0
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)


def test_attach_keeps_rows_without_a_key(spark):
    many = spark.createDataFrame([(None, 1)] * 50 + [("a", 2), ("b", 3)], "k string, v int")
    one = spark.createDataFrame([("a", 1.0), ("c", 2.0), ("d", 2.0)], "k string, w double")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = (spread.attach(many, one, ["k"], how, rows=n) for n in (1, 100))
        assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_fits_is_exact(spark, hot):
    assert spread.fits(hot, rows=6000) and not spread.fits(hot, rows=5999)
    assert not spread.fits(hot, rows=6000, size=1000)


def test_global_index(spark, hot):
    got = spread.global_index(hot, ["ts", "event_id"], "n")
    want = hot.withColumn("n", F.row_number().over(Window.orderBy("ts", "event_id")).cast("bigint") - 1)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 6000


@pytest.mark.parametrize("limit", [1, 100, 1000, 10_000])
def test_running(spark, hot, limit):
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    flag = F.when(F.col("v") % 2 == 0, F.col("v"))
    want = hot.withColumns({
        "n": F.row_number().over(w).cast("bigint"),
        "total": F.sum(flag).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("ts").over(w)})
    got = spread.running(hot, ["k"], ["ts", "event_id"], number="n", total={"total": flag}, previous={"before": "ts"},
                         group_rows=limit)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == 6000


def test_running_cuts_the_hot_key(spark, hot):
    placed = spread._blockwise(hot, ["k"], ["ts", "event_id"], "n", {}, {})
    sizes = [r["count"] for r in placed.where("k = 'hot'").groupBy("_block").count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 3000


def test_first_and_last_per_key(spark, hot, rows):
    first = spread.first_per_key(hot, ["k"], ["ts", "event_id"])
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    want = hot.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    assert rows(first) == rows(want.select(*first.columns))
    last = spread.last_per_key(hot, ["k"], ["ts", "event_id"], F.count("*").alias("n"))
    assert last.where("k = 'hot'").first()["n"] == 4000


def test_lane_plan_and_gaps_with_a_hot_lane(spark, hot):
    lanes = hot.select(F.col("event_id").alias("id"), "k", F.col("ts").alias("created_at"))
    a, b = (schedule.lane_plan(lanes, "k", START, 6, group_rows=n) for n in (500, 10**6))
    assert a.select(*b.columns).exceptAll(b).count() == 0
    assert b.groupBy("k", "planned_at").count().where("count > 1").count() == 0
    gaps = hot.select("event_id", "k", "ts")
    a, b = (schedule.start_gaps(gaps, "k", group_rows=n) for n in (500, 10**6))
    assert a.select(*b.columns).exceptAll(b).count() == 0 and b.where("too_fast").count() > 0


def test_pace():
    assert (schedule.pace_ms(6), schedule.pace_ms(60), schedule.pace_ms(600), schedule.pace_ms(7)) == (
        11000, 2000, 1100, 9572)


def test_trail_with_a_hot_mailing(spark, hot):
    lines = hot.select(F.col("k").alias("mailing_id"), F.col("event_id").alias("line_no"),
                       (F.col("v") % 2 == 0).alias("is_valid"))
    a, b = (schedule.progress_trail(lines, 50, group_rows=n) for n in (500, 10**6))
    assert a.select(*b.columns).exceptAll(b).count() == 0
    assert b.where("mailing_id = 'hot'").count() == 80


def test_nested_pages_hold_every_message_of_a_hot_mailing(spark):
    mailings = spark.createDataFrame(
        [("a", "fa", "PENDING", START), ("b", "fb", "QUEUED", START), ("c", "fc", "FAILED", START)],
        "id string, filename string, status string, created_at timestamp_ntz")
    messages = spark.range(2500).select(
        F.col("id"), F.when(F.col("id") < 2400, "a").otherwise("c").alias("mailing_id"), F.lit("q").alias("target_queue"),
        (F.col("id") % 2 == 0).alias("published"), F.lit(START).cast("timestamp_ntz").alias("created_at"))
    out = outbox.nested_messages(mailings, messages, page_rows=100, group_rows=300)
    sizes = {(r.mailing_id, r.page_no): r.message_count for r in out.collect()}
    assert sizes == {**{("a", i): 100 for i in range(24)}, ("b", 0): 0}
    items = out.select(F.explode("messages").alias("m"))
    assert items.select("m.outbox_id").distinct().count() == 2400
