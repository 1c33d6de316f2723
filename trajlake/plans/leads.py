"""Loose candidates (leads) of tracks, for review: video_id, kind, start, end, track, cls, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.functions.intervals import hit_segments
from trajlake.operators.motion import lagged_speed, projected_velocity
from trajlake.plans.features import VEHICLES
from trajlake.sources.files import materialize
from trajlake.sources.scene import Scene

TRACK = ["video_id", "id"]


def _leads(rows: DataFrame, kind: str, mask, gap: float, least: float, detail: str) -> DataFrame:
    found = hit_segments(rows, [*TRACK, "mode"], mask, gap, least)
    return found.select("video_id", F.lit(kind).alias("kind"), "start", "end", F.col("id").alias("track"), F.col("mode").alias("cls"), F.lit(detail).alias("detail"))


def leads(rows: DataFrame, scene: Scene) -> DataFrame:
    """Leads of tracks of three rows or more, from scene positions; a track's class is its most frequent one."""
    x, y = F.col("cx"), F.col("foot_y")
    known = rows.groupBy(*TRACK).agg(F.count("*").alias("rows"), F.mode("cls", True).alias("mode")).filter("rows >= 3")
    on = {f"on_{k}": geo.inside(x, y, p) for k, p in scene.crosswalks.items()} | {f"road_{k}": geo.inside(x, y, p) for k, p in scene.carriageways.items()}
    rows = materialize(rows.join(known, TRACK).withColumns(on), "lead_rows")
    persons, vehicles = rows.filter("mode = 0"), rows.filter(F.col("mode").isin(*VEHICLES))
    either = lambda names: reduce(lambda a, b: a | b, (F.col(n) for n in names))
    out = [_leads(persons, "crosswalk_person", F.col(f"on_{k}"), 0.5, 0.3, k) for k in scene.crosswalks]
    off = either(f"road_{k}" for k in scene.carriageways) & ~either(f"on_{k}" for k in scene.crosswalks)
    out.append(_leads(persons, "jaywalking", off, 0.6, 1.0, "road outside crossing"))
    out += [_leads(vehicles, "crosswalk_vehicle", F.col(f"on_{k}"), 0.5, 0.25, k) for k in scene.crosswalks]
    out.append(stop_crossings(vehicles, scene))
    out.append(_leads(lagged_speed(vehicles), "stopped_or_queue", F.col("v") < 5, 0.5, 8.0, "stands"))
    for k in scene.carriageways:
        out.append(_leads(projected_velocity(vehicles, scene.directions[k]), "wrong_way", (F.col("v") < -12) & F.col(f"road_{k}"), 0.5, 1.0, k))
    out.append(_leads(turning(vehicles.filter("rows >= 30")), "turn_or_swerve", F.col("turn") > 0.65, 0.6, 0.3, "turns"))
    return reduce(DataFrame.unionByName, out)


def stop_crossings(vehicles: DataFrame, scene: Scene) -> DataFrame:
    """Where a box's far lower corner passes the stop line, within 80 px of it and 50 px of its ends."""
    by = W.partitionBy(*TRACK).orderBy("t", "frame")
    fx, fy = F.col("x2") * F.col("scale_x"), F.col("y2") * F.col("scale_y")
    at = vehicles.select(*TRACK, "t", "frame", "mode", fx.alias("fx"), geo.side_and_distance(fx, fy, scene.stop_line).alias("q"))
    at = at.withColumn("before", F.lag("q.side").over(by))
    xs = [p[0] for p in scene.stop_line]
    hit = at.filter((F.col("before") < 0) & (F.col("q.side") >= 0) & (F.col("q.distance") <= 80) & F.col("fx").between(min(xs) - 50, max(xs) + 50))
    t = F.round("t", 2)
    return hit.select("video_id", F.lit("stop_crossing").alias("kind"), t.alias("start"), t.alias("end"), F.col("id").alias("track"), F.col("mode").alias("cls"), F.lit("near").alias("detail"))


def turning(rows: DataFrame, n: int = 10) -> DataFrame:
    """Adds turn: by how much the heading of the last n steps has changed over n rows, turns past half a circle unwound."""
    by = W.partitionBy(*TRACK).orderBy("t", "frame")
    since = lambda c: F.col(c) - F.lag(c, n).over(by)
    a = rows.withColumn("heading", F.atan2(since("foot_y"), since("cx")))
    pi = 3.141592653589793
    step = F.col("heading") - F.lag("heading").over(by)
    a = a.withColumn("step", step - F.floor(F.round((step + pi) / (2 * pi), 9)) * (2 * pi))  # half a circle counts as backwards
    full = F.count("step").over(by.rowsBetween(1 - n, 0)) == n
    return a.withColumn("turn", F.when(full, F.abs(F.sum("step").over(by.rowsBetween(1 - n, 0)))))


def lead_summary(found: DataFrame) -> DataFrame:
    """Leads by video and kind, and by video over all kinds (kind null)."""
    return found.rollup("video_id", "kind").agg(F.count("*").alias("n")).filter("video_id IS NOT NULL")


def longest(found: DataFrame, k: int = 20) -> DataFrame:
    """The k longest leads of each kind; of equals the earliest, by video and track."""
    by = W.partitionBy("kind").orderBy(F.round(F.col("end") - F.col("start"), 2).desc(), "start", "video_id", "track", "detail")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def yield_shortlist(found: DataFrame) -> DataFrame:
    """Vehicles' stays on a crossing with the persons on it at the time."""
    from trajlake.functions.intervals import overlap_join

    cars = found.filter("kind = 'crosswalk_vehicle'").select("video_id", "detail", "track", "start", "end")
    people = found.filter("kind = 'crosswalk_person'").select("video_id", "detail", "track", "start", "end")
    both = overlap_join(cars, people, ["video_id", "detail"], 4.0, closed=True)
    return both.groupBy("video_id", "detail", "track", "start", "end").agg(F.array_join(F.array_sort(F.collect_set("r_track")), ",").alias("persons"))
