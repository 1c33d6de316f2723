"""Fixtures of the library's input tables, built from the generic tables of a folder by plain arithmetic.

Each user of `events` is a tracked object, fifteen a video; its rows are detections 0.2 s apart, and what it does on the
road follows from its id, so that every rule has something to find. See SCHEMAS for the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.sources.scene import ACROSS, ALONG, ORIGIN

TRACKS = "video_id long, frame long, t double, id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
SIGNALS = "video_id long, frame long, t double, state string, red long, amber long, green long"
EVENTS = "video_id long, start double, end double, label string"
#: Tracks are in source pixels of this size.
SOURCE_SIZE = (3840, 2160)
# The event labels.
LABELS = (
    "accident", "near_miss", "red_light", "wrong_way", "illegal_u_turn", "stopped_vehicle", "jaywalking", "failure_to_yield",
    "illegal_turn", "solid_line_crossing", "stop_line", "congestion", "road_obstacle", "fire_smoke",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    e = e.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    # A few persons ride what has the next id.
    e = e.withColumn("as_id", F.expr("CASE WHEN user_id % 8 = 4 AND user_id % 3 = 1 THEN user_id + 1 ELSE user_id END"))
    e = e.withColumn("k", F.expr("as_id % 15")).withColumn("cls", F.expr("CAST(element_at(array(2, 2, 0, 7, 0, 3, 5, 1), CAST(user_id % 8 AS INT) + 1) AS INT)"))
    e = e.withColumn("walks", F.expr("cls = 0 AND as_id = user_id"))
    u = F.expr("""CASE
      WHEN walks AND user_id % 8 = 4 THEN 670.0 WHEN walks THEN 450.0 + n * 0.5
      WHEN k < 9 THEN 330.0 + 70.0 * (CASE WHEN k = 8 THEN 0 ELSE k div 5 END) + 5.0 * least(n, 15) + 6.0 * greatest(n - 55, 0) + (event_id % 7) * 0.1
      WHEN k = 10 THEN 540.0 + 6.0 * least(n, 10) + 8.0 * greatest(n - 45, 0) + (event_id % 7) * 0.1
      WHEN k = 12 THEN 800.0 + 4.0 * least(n, 3) + (event_id % 7) * 0.05
      WHEN k = 13 THEN 580.0 - 6.0 * n
      WHEN k = 14 THEN 470.0 + 3.0 * n
      ELSE 480.0 + 8.0 * n + (event_id % 7) * 0.1 END""")
    w = F.expr("""CASE
      WHEN walks THEN -30.0 + 4.0 * n
      WHEN k = 11 THEN -20.0 - 40.0 * (as_id % 4)
      WHEN k = 14 THEN 121.0 + 2.0 * n
      WHEN k = 8 THEN 20.0 + 40.0 * 3
      ELSE 20.0 + 40.0 * (as_id % 5) END""")
    e = e.withColumns({"u": u, "w": w})
    e = e.withColumns({
        "fx": F.lit(2.0) * (F.lit(ORIGIN[0]) + F.lit(ALONG[0]) * F.col("u") + F.lit(ACROSS[0]) * F.col("w")),
        "fy": F.lit(2.0) * (F.lit(ORIGIN[1]) + F.lit(ALONG[1]) * F.col("u") + F.lit(ACROSS[1]) * F.col("w")),
        "bw": F.expr("CASE cls WHEN 0 THEN 24.0D WHEN 5 THEN 150.0D WHEN 7 THEN 110.0D WHEN 2 THEN 84.0D ELSE 44.0D END"),
        "bh": F.expr("CASE cls WHEN 0 THEN 60.0D WHEN 5 THEN 96.0D WHEN 7 THEN 80.0D WHEN 2 THEN 56.0D ELSE 50.0D END"),
    })
    frame = F.expr("6L * n + 18L * (user_id % 7)")
    return e.select(
        F.expr("user_id div 15").alias("video_id"), frame.alias("frame"), (frame / F.lit(30.0)).alias("t"), F.col("user_id").alias("id"), "cls",
        (F.lit(0.2) + F.expr("(event_id % 80) / 100.0D")).alias("conf"),
        (F.col("fx") - F.col("bw") / 2).alias("x1"), (F.col("fy") - F.col("bh")).alias("y1"), (F.col("fx") + F.col("bw") / 2).alias("x2"), F.col("fy").alias("y2"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample every three frames of a video: red, amber, green by turns of ten seconds, some unknown."""
    last = tracks(spark, sf_dir).groupBy("video_id").agg(F.max("frame").alias("last"))
    s = last.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(3).cast("long"))).alias("frame"))
    state = F.expr("CASE WHEN frame % 31 = 0 THEN '?' WHEN frame % 300 < 150 THEN 'R' WHEN frame % 300 < 180 THEN 'Y' ELSE 'G' END")
    s = s.withColumn("state", state)
    return s.select("video_id", "frame", (F.col("frame") / F.lit(30.0)).alias("t"), "state", *(F.expr(f"IF(state = '{x}', 30L, frame % 4)").alias(c) for x, c in (("R", "red"), ("Y", "amber"), ("G", "green"))))


def _labelled(orders: DataFrame, shift: str, numbered: tuple = ()) -> DataFrame:
    names = F.array(*(F.lit(x) for x in LABELS))
    base = orders.select(F.expr("o_custkey div 4").alias("video_id"), F.col("o_orderkey").alias("k"))
    # k numbers the events of all videos in the order of their input.
    start = F.greatest(F.lit(0.0), F.expr("((k * 37) % 3000) / 10.0D") + F.expr(shift))
    label = F.element_at(names, F.expr("CAST((k % 5 + video_id) % 14 AS INT) + 1"))
    return base.select("video_id", start.alias("start"), (start + F.expr("1.0D + (k % 40) / 10.0D")).alias("end"), label.alias("label"), *(F.col(c).alias("idx") for c in numbered))


def labels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(read(spark, sf_dir, "orders"), "0.0D")


def labels_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels_raw with idx, the place of each event in the input, some of them with bad times."""
    rows = _labelled(read(spark, sf_dir, "orders"), "0.0D", ("k",))
    return rows.withColumns({"start": F.expr("IF(idx % 31 = 0, -0.5D, start)"), "end": F.expr("IF(idx % 23 = 0, start - 1.0D, end)")})


def video_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id and duration of the labelled videos."""
    return labels_raw(spark, sf_dir).select("video_id").distinct().withColumn("duration", F.expr("240.0D + video_id % 61"))


def labels_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.functions.intervals import merge_intervals

    return merge_intervals(labels_raw(spark, sf_dir), ["video_id", "label"], max_gap=0.0, min_duration=0.0)


def labels_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.functions.intervals import merge_intervals

    """Most of the true events, moved a little, and others far off; some videos are missing, and some are not in the truth."""
    o = read(spark, sf_dir, "orders").filter("o_custkey div 4 % 9 <> 4")
    found = _labelled(o.filter("o_orderkey % 11 <> 0"), "(k % 9 - 4) / 10.0D").unionByName(_labelled(o.filter("o_orderkey % 13 = 0"), "50.0D"))
    foreign = _labelled(o.filter("o_orderkey % 29 = 0"), "0.0D").withColumn("video_id", F.expr("video_id + 100000"))
    found = found.unionByName(foreign)
    return merge_intervals(found, ["video_id", "label"], max_gap=0.0, min_duration=0.0)


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    e = e.withColumn("idx", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1)
    return e.select(F.col("user_id").alias("video_id"), "idx", (F.col("idx") * F.lit(0.5)).alias("t"), F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("score"))


def risk_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """risk with scores beyond 1 and times that go back."""
    rows = risk(spark, sf_dir)
    back = F.expr("IF(video_id % 4 = 1 AND idx = 20 + video_id % 7, t - 2.0D, t)")
    return rows.withColumns({"t": back, "score": F.expr("IF(video_id % 3 = 0 AND idx % 37 = 36, score + 1.0D, score)")})


def labels_accident(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    """An accident in each video, two that lie close together in every other one, and some near misses."""
    late = v.select("video_id", F.explode(F.expr("IF(video_id % 2 = 0, array(0.0D, 5.0D), array(0.0D))")).alias("late"))
    hit = late.select("video_id", F.expr("8.0D + video_id % 20 + late").alias("start"), F.expr("10.0D + video_id % 20 + late").alias("end"), F.lit("accident").alias("label"))
    miss = v.filter("video_id % 3 = 0").select("video_id", F.expr("3.0D + video_id % 5").alias("start"), F.expr("4.5D + video_id % 5").alias("end"), F.lit("near_miss").alias("label"))
    return hit.unionByName(miss)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.expr("(l_orderkey div 4) % 3").alias("video_id"), F.expr("l_orderkey div 12").alias("frame"), F.expr("CAST((l_orderkey % 4) * 8 + l_linenumber - 1 AS INT)").alias("row"),
        F.expr("CAST(l_partkey % 180 AS INT)").alias("h"), F.expr("CAST((l_suppkey * 13 + l_linenumber * 37) % 256 AS INT)").alias("s"), F.expr("CAST(l_quantity * 5 AS INT)").alias("v"),
    )
