"""Lookups of events, rows and curves at given times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions.intervals import point_join
from trajlake.sources.files import materialize


def active_at(points: DataFrame, events: DataFrame, width: float = 8.0) -> DataFrame:
    """video_id, t and labels of the points at which events last (ends included): each label once, by its earliest event.

    width is about the length of most events.
    """
    hits = point_join(points.select("video_id", "t").distinct(), materialize(events, "events"), ["video_id"], width)
    first = hits.groupBy("video_id", "t", "label").agg(F.min(F.struct("start", "end")).alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"])
    return first.groupBy("video_id", "t").agg(F.array_join(names, ",").alias("labels"))


def nearest_rows(points: DataFrame, rows: DataFrame, keys: list[str], reach: float, value: str) -> DataFrame:
    """points (keys and t) with the value of the row of their keys that is nearest in time, of equals the earlier one.

    Points without a row at most reach seconds away go. Both meet in time buckets.
    """
    width = 2 * reach
    near = F.array_distinct(F.array(F.floor((F.col("t") - reach) / width), F.floor((F.col("t") + reach) / width)))
    p = points.select(*keys, "t").withColumn("bucket", F.explode(near))
    r = rows.select(*keys, F.floor(F.col("t") / width).alias("bucket"), F.col("t").alias("r_t"), F.col(value).alias("r_value"))
    both = p.join(r, [*keys, "bucket"]).filter((F.col("r_t") >= F.col("t") - reach) & (F.col("r_t") <= F.col("t") + reach))
    return both.groupBy(*keys, "t").agg(F.min_by("r_value", F.struct(F.abs(F.col("r_t") - F.col("t")), "r_t")).alias(value))


def curve_at(points: DataFrame, curve: DataFrame, fps: float) -> DataFrame:
    """points with idx and score of their video's curve at t * fps (half to even), kept within the curve."""
    last = curve.groupBy("video_id").agg(F.max("idx").alias("last"))
    idx = F.least("last", F.greatest(F.lit(0).cast("long"), F.bround(F.col("t") * fps, 0).cast("long")))
    return points.join(last, "video_id").withColumn("idx", idx).drop("last").join(curve.select("video_id", "idx", "score"), ["video_id", "idx"])


def not_near_duplicates(new: DataFrame, known: DataFrame, within: float = 0.05) -> DataFrame:
    """The new events (video_id, label, start, end, idx) that aren't near one known, nor near one of them kept before.

    Near: of the same video and label, with both ends less than within apart. The new events of a video and label are looked
    at in the order of idx. The known ones meet them in buckets of that width.
    """
    cell = lambda c: F.floor(F.col(c) / within)
    old = known.select("video_id", "label", F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    old = old.withColumn("cell", F.explode(F.array(*(cell("k_start") + i for i in (-1, 0, 1)))))
    near = (F.abs(F.col("start") - F.col("k_start")) < within) & (F.abs(F.col("end") - F.col("k_end")) < within)
    fresh = new.withColumn("cell", cell("start")).alias("n")
    same = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in ("video_id", "label", "cell")]
    fresh = fresh.join(old.alias("o"), [*same, near], "left_anti").drop("cell")
    fresh = materialize(fresh.select("video_id", "label", "idx", "start", "end"), "fresh_events")
    keys = ["video_id", "label"]
    a = fresh.select(*keys, F.col("idx").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.explode(F.array(*(cell("start") + i for i in (-1, 0, 1)))).alias("cell"))
    b = fresh.select(*keys, F.col("idx").alias("b"), "start", "end", cell("start").alias("cell"))
    close = (F.abs(F.col("start") - F.col("a_start")) < within) & (F.abs(F.col("end") - F.col("a_end")) < within)
    near_pairs = a.join(b, [*keys, "cell"]).filter((F.col("a") < F.col("b")) & close).select(*keys, "a", "b")
    gone = _after_kept(materialize(near_pairs, "near_pairs"), keys)
    return fresh.join(gone, [*keys, "idx"], "left_anti").select("video_id", "label", "idx", "start", "end")


def _after_kept(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and idx of what goes when, in the order of idx, each row stays unless it is near one that stayed before (a before b).

    In rounds: what nothing open stands before stays, so what is near it goes, and neither is open any more.
    """
    gone = pairs.select(*keys, F.col("b").alias("idx")).limit(0)
    while not pairs.isEmpty():
        stays = pairs.select(*keys, "a").distinct().join(pairs.select(*keys, F.col("b").alias("a")), [*keys, "a"], "left_anti")
        goes = materialize(pairs.join(stays, [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("idx")).distinct(), "near_gone")
        gone = gone.unionByName(goes)
        left = pairs.join(stays, [*keys, "a"], "left_anti")
        for side in "ab":
            left = left.join(goes.withColumnRenamed("idx", side), [*keys, side], "left_anti")
        pairs = materialize(left, "near_pairs")
    return gone
