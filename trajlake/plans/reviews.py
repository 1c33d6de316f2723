"""Shortlists and summaries for people who review events: which leads, crossings and movements to look at first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.operators.asof import backward, forward
from trajlake.operators.motion import quantile_rows

TRACK = ["video_id", "id"]
# The classes of the detector that are motor vehicles.
MOTOR = (2, 3, 5, 7)


def _rows_of(found: DataFrame, rows: DataFrame, inset: float) -> DataFrame:
    """Rows (t, x, y, frame) of each lead's track within its times, which are drawn in by inset seconds at either end."""
    spans = found.select("video_id", F.col("track").alias("id"), "start", "end")
    return rows.join(spans, TRACK).filter((F.col("t") >= F.col("start") + inset) & (F.col("t") <= F.col("end") - inset))


def jaywalking_shortlist(found: DataFrame, rows: DataFrame, least: float = 2.0, k: int = 50) -> DataFrame:
    """Of each video the k jaywalking leads that go farthest, with where they begin and end; whole pixels.

    Leads last least seconds and have three rows or more. Of equal distances, the earliest.
    """
    leads = found.filter((F.col("kind") == "jaywalking") & (F.col("end") - F.col("start") >= least))
    at = F.struct("t", "frame")
    ends = {"x0": F.min_by("x", at), "y0": F.min_by("y", at), "x1": F.max_by("x", at), "y1": F.max_by("y", at)}
    moved = _rows_of(leads, rows, -0.1).groupBy(*TRACK, "start", "end").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in ends.items())).filter("n >= 3")
    moved = moved.withColumn("distance", F.floor(F.round(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6)))
    by = W.partitionBy("video_id").orderBy(F.col("distance").desc(), "start", "end", "id")
    out = moved.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return out.select("video_id", "start", "end", F.col("id").alias("track"), "distance", *(F.floor(F.round(c, 6)).alias(c) for c in ends), "rank")


def stopped_shortlist(found: DataFrame, rows: DataFrame, beyond: tuple[float, float] = (920.0, 620.0), least: float = 9.0) -> DataFrame:
    """Leads of standing vehicles of least seconds whose median place lies beyond an x or a y; whole pixels."""
    leads = found.filter((F.col("kind") == "stopped_or_queue") & (F.col("end") - F.col("start") >= least))
    middle = _rows_of(leads, rows, 0.5).groupBy(*TRACK, "start", "end").agg(*(F.floor(F.round(F.expr(f"percentile({c}, 0.5)"), 6)).alias(c) for c in ("x", "y")))
    return middle.filter((F.col("x") > beyond[0]) | (F.col("y") > beyond[1])).select("video_id", "start", "end", F.col("id").alias("track"), "x", "y")


def confirmed_phases(changes: DataFrame, samples: DataFrame, slack: float = 0.3) -> DataFrame:
    """video_id, t and state of changes to red or green, at the first sample that shows it.

    Red is looked for from the change on, green from slack seconds before it. Changes that no sample shows go.
    """
    out = []
    for state, before in (("R", 0.0), ("G", slack)):
        points = changes.filter(F.col("state") == state).select("video_id", (F.col("t") - before).alias("t"))
        seen = samples.filter(F.col("state") == state).select("video_id", "t", F.col("t").alias("seen"))
        found = forward(points, seen, "seen").filter("seen IS NOT NULL")
        out.append(found.select("video_id", F.round("seen", 2).alias("t"), F.lit(state).alias("state")))
    return out[0].unionByName(out[1]).distinct()


def red_crossings(found: DataFrame, phases: DataFrame) -> DataFrame:
    """Stop line crossings (video_id, t, track) while the last confirmed phase is red."""
    stops = found.filter("kind = 'stop_crossing'").select("video_id", F.col("start").alias("t"), "track")
    return backward(stops, phases, "state", F.lit("?")).filter("state = 'R'").drop("state")


def side_crossings(rows: DataFrame, a: tuple[float, float], b: tuple[float, float]) -> DataFrame:
    """video_id, id and t at which a motor vehicle passes from the negative to the positive side of the line a to b, near it."""
    side = geo.line_side(F.col("x"), F.col("y"), a, b)
    before = F.lag("side").over(W.partitionBy(*TRACK).orderBy("t", "frame"))
    rows = rows.filter(F.col("cls").isin(*MOTOR)).withColumn("side", side).withColumn("before", before)
    near = (F.col("x") > a[0] - 20) & (F.col("x") < b[0] + 60)
    return rows.filter(near & (F.col("before") < 0) & (F.col("side") > 0)).select(*TRACK, "t")


def crossings_by_phase(crossings: DataFrame) -> DataFrame:
    """By video, crossings (is_green) in all, while green, and while not."""
    return crossings.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if("is_green").alias("green"), F.count_if(~F.col("is_green")).alias("red"))


def _tracks(rows: DataFrame) -> DataFrame:
    at = F.struct("t", "frame")
    ends = [F.min_by(c, at).alias(f"{c}0") for c in ("x", "y", "cls")] + [F.max_by(c, at).alias(f"{c}1") for c in ("x", "y")]
    return rows.filter(F.col("cls").isin(*MOTOR)).groupBy(*TRACK).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), *ends)


def movements(rows: DataFrame, most_x: float = 600.0, most_y: float = 650.0, down: float = 100.0, k: int = 8) -> DataFrame:
    """Of each video the first k motor vehicles that come from the upper left and go down, with five points of their way.

    They have twelve rows or more over two seconds or more.
    """
    kept = _tracks(rows).filter((F.col("n") >= 12) & (F.col("t1") - F.col("t0") >= 2) & (F.col("x0") <= most_x) & (F.col("y0") <= most_y) & (F.col("y1") - F.col("y0") >= down))
    first = kept.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy("t0", "id"))).filter(F.col("rank") <= k)
    points = quantile_rows(rows.join(first.select(*TRACK), TRACK, "left_semi"))
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    step = F.struct("t", "frame", F.concat(F.lit("("), whole("x"), F.lit(","), whole("y"), F.lit(")")).alias("at"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda p: p["at"]), " -> ").alias("path")
    return first.join(points.groupBy(*TRACK).agg(path), TRACK).select(*TRACK, "t0", "t1", F.col("cls0").alias("cls"), "path", "rank")


def exits(rows: DataFrame, a: tuple[float, float], b: tuple[float, float], most_x: float, most_y: float, named: dict[str, str]) -> DataFrame:
    """video_id, id, t, x, y and exit of motor vehicles at their first row past the line a to b, between its ends.

    They have fifteen rows or more and begin before the line and not beyond most_x, most_y. named gives exits by SQL
    conditions on the last point (x1, y1), of which the first that holds counts; else it is other.
    """
    line = a[1] + (F.col("x") - a[0]) * (b[1] - a[1]) / (b[0] - a[0])
    rows = rows.filter(F.col("cls").isin(*MOTOR)).withColumn("past", F.col("y") - line)
    at = F.struct("t", "frame")
    kept = _tracks(rows).join(rows.groupBy(*TRACK).agg(F.min_by("past", at).alias("past0")), TRACK)
    kept = kept.filter((F.col("n") >= 15) & (F.col("x0") <= most_x) & (F.col("y0") <= most_y) & (F.col("past0") <= 0))
    over = rows.filter((F.col("past") >= 0) & F.col("x").between(a[0], b[0])).groupBy(*TRACK).agg(F.min(F.struct("t", "frame", "x", "y")).alias("c"))
    exit_ = F.coalesce(*(F.when(F.expr(c), F.lit(k)) for k, c in named.items()), F.lit("other"))
    return kept.join(over, TRACK).select(*TRACK, F.col("c.t").alias("t"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), exit_.alias("exit"))


def reviewed(*sets: DataFrame) -> DataFrame:
    """video_id, n, start, end and label of all events of the sets, numbered in the order of start and label; 1 decimal."""
    events = sets[0].select("video_id", "start", "end", "label")
    for more in sets[1:]:
        events = events.unionByName(more.select("video_id", "start", "end", "label"))
    n = F.row_number().over(W.partitionBy("video_id").orderBy("start", "label", "end"))
    return events.select("video_id", n.alias("n"), F.bround("start", 1).alias("start"), F.bround("end", 1).alias("end"), "label")


def sampled_tracks(rows: DataFrame, size: tuple[int, int], each: int = 32, most: int = 72, points: int = 24) -> DataFrame:
    """video_id, id, n and path (points x, y, 1 decimal) of tracks for a map: about each a video, most in all, points a track.

    Only points within the frame count, and tracks with three of them or more.
    """
    ids = rows.select(*TRACK).distinct()
    ids = ids.withColumns({"nth": F.row_number().over(W.partitionBy("video_id").orderBy("id")) - 1, "all": F.count("*").over(W.partitionBy("video_id"))})
    step = F.greatest(F.lit(1), F.floor(F.col("all") / each))
    ids = ids.filter((F.col("nth") % step == 0) & (F.floor(F.col("nth") / step) < each))
    valid = ~F.isnan("x") & ~F.isnan("y") & F.col("x").between(0, size[0]) & F.col("y").between(0, size[1])
    inside = rows.join(ids.select(*TRACK), TRACK, "left_semi").filter(valid)
    chosen = inside.groupBy(*TRACK).agg(F.count("*").alias("n")).filter("n >= 3").orderBy(*TRACK).limit(most)
    kept = linspace_rows(inside.join(F.broadcast(chosen), TRACK), points)
    spot = F.struct("t", "frame", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
    path = F.transform(F.array_sort(F.collect_list(spot)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return kept.groupBy(*TRACK, "n").agg(path.alias("path"))


def linspace_rows(rows: DataFrame, k: int) -> DataFrame:
    """Of each track with more than k rows the k at equal steps from the first to the last, places rounded half to even."""
    by = W.partitionBy(*TRACK)
    numbered = rows.withColumns({"__i": F.row_number().over(by.orderBy("t", "frame")) - 1, "__n": F.count("*").over(by)})
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / (k - 1), 0).cast("long"))
    return numbered.filter((F.col("__n") <= k) | F.array_contains(steps, F.col("__i").cast("long"))).drop("__i", "__n")


def in_zone(rows: DataFrame, box: tuple[float, float, float, float], slope: float, offset: float) -> DataFrame:
    """Rows strictly within a box (x0, x1, y0, y1) and below the line y = offset + slope x (y grows downwards)."""
    x, y = F.col("x"), F.col("y")
    return rows.filter((x > box[0]) & (x < box[1]) & (y > box[2]) & (y < box[3]) & (y > F.lit(offset) + x * slope))
