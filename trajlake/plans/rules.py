"""Traffic rules over features and signals: each gives events (video_id, start, end, label)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.functions.intervals import mask_intervals, merge_events, merge_intervals, overlap_join, sample_step
from trajlake.operators.asof import forward, stable_state, sustained_green
from trajlake.plans.features import RIDDEN, VEHICLES
from trajlake.sources.files import materialize
from trajlake.sources.scene import Scene

TRACK = ["video_id", "id"]


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds, in scene pixels and seconds. The defaults."""

    slow_speed: float = 8.0
    stop_speed: float = 4.0
    jaywalk_seconds: float = 1.2
    jaywalk_distance: float = 14.0
    yield_speed: float = 12.0
    yield_margin: float = 12.0
    congested_lanes: int = 4
    congested_vehicles: int = 5
    merge_gap: float = 1.0
    event_seconds: float = 0.5
    unvalidated: bool = False


# The labels that are published, and those that the unvalidated rules add.
VALIDATED = ("congestion", "failure_to_yield", "red_light")
UNVALIDATED = ("stopped_vehicle", "wrong_way", "solid_line_crossing", "accident", "near_miss")


def _vehicles(features: DataFrame) -> DataFrame:
    return features.filter(F.col("cls").isin(*VEHICLES))


def _events(rows: DataFrame, label: str) -> DataFrame:
    return rows.select("video_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(label).alias("label"))


def without_riders(features: DataFrame) -> DataFrame:
    """Persons whose box isn't that of somebody on a bicycle or motorcycle in the same frame."""
    box = ["x1", "y1", "x2", "y2"]
    ridden = features.filter(F.col("cls").isin(*RIDDEN)).select("video_id", "frame", *(F.col(c).alias(f"r_{c}") for c in box))
    persons = features.filter("cls = 0").withColumns({f"p_{c}": F.col(c) for c in box})
    near = (persons["video_id"] == ridden["video_id"]) & (persons["frame"] == ridden["frame"]) & (geo.box_overlap("p_", "r_") >= 0.24)
    return persons.join(ridden, near, "left_anti").drop(*(f"p_{c}" for c in box))


def _spanned(rows: DataFrame, spans: DataFrame, before: float, after: float) -> DataFrame:
    """A track's rows in its spans, widened; both meet in buckets of time, so a long track's rows don't meet all its spans."""
    width = 8.0
    s = spans.select(*TRACK, *(F.col(c).alias(f"s_{c}") for c in spans.columns if c not in TRACK))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("s_start") - before) / width), F.floor((F.col("s_end") + after) / width))))
    both = rows.withColumn("bucket", F.floor(F.col("t") / width)).join(s, [*TRACK, "bucket"]).drop("bucket")
    return both.filter((F.col("t") >= F.col("s_start") - before) & (F.col("t") <= F.col("s_end") + after))


def _travel(x: str, y: str) -> Column:
    at = F.struct("t", "frame")
    dx, dy = (F.max_by(c, at) - F.min_by(c, at) for c in (x, y))
    return F.sqrt(dx * dx + dy * dy)


def congested_frames(features: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """video_id, t (2 decimals), lanes and vehicles of the slow ones queueing on near lanes."""
    slow = _vehicles(features).filter(F.col("in_queue") & (F.col("road_id") == "near") & F.col("lane_id").startswith("near_") & (F.col("speed") <= config.slow_speed))
    return slow.groupBy("video_id", F.bround("t", 2).alias("t")).agg(F.count_distinct("lane_id").alias("lanes"), F.count_distinct("id").alias("vehicles"))


def congestion(features: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    full = (F.col("lanes") >= config.congested_lanes) & (F.col("vehicles") >= config.congested_vehicles)
    runs = mask_intervals(congested_frames(features, config), ["video_id"], full, gap=0.45)
    return _events(merge_intervals(runs, ["video_id"], config.merge_gap, 3.0), "congestion")


def jaywalking(features: DataFrame, scene: Scene, config: RuleConfig = RuleConfig()) -> DataFrame:
    persons = features.filter("cls = 0")
    walkers = without_riders(features).select(*TRACK, "frame", F.lit(True).alias("walks"))
    rows = persons.join(walkers, [*TRACK, "frame"], "left")
    crossing = F.lit(False)
    for polygon in scene.crosswalks.values():
        crossing = crossing | geo.inside(F.col("foot_x"), F.col("foot_y"), polygon, 20.0)
    runs = mask_intervals(rows, TRACK, F.col("in_road") & ~crossing & F.coalesce("walks", F.lit(False)), gap=0.45).filter(F.col("end") - F.col("start") >= config.jaywalk_seconds)
    moved = _spanned(rows, runs, 0.2, 0.2).groupBy(*TRACK, "s_start", "s_end").agg(F.count("*").alias("n"), _travel("foot_x", "foot_y").alias("d"))
    found = moved.filter((F.col("n") >= 2) & (F.col("d") >= config.jaywalk_distance)).select("video_id", F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    return _events(merge_intervals(found, ["video_id"], config.merge_gap, config.jaywalk_seconds), "jaywalking")


def crosswalk_occupancy(rows: DataFrame, scene: Scene, persons: bool, margin: float = 12.0, steps: DataFrame | None = None) -> DataFrame:
    """video_id, id, crossing, start and end of a track's stays on each crossing; a vehicle's body counts with both ends."""
    points = ["foot"] if persons else ["foot", "front", "rear"]
    on = []
    for name, polygon in scene.crosswalks.items():
        inside = [geo.inside(F.col(f"{p}_x"), F.col(f"{p}_y"), polygon, margin if persons else 8.0) for p in points]
        on.append(F.when(reduce(lambda a, b: a | b, inside), F.lit(name)))
    stays = rows.select(*TRACK, "t", F.explode(F.array_compact(F.array(*on))).alias("crossing"))
    keys = [*TRACK, "crossing"]
    runs = mask_intervals(stays, keys, F.lit(True), gap=0.25, steps=sample_step(rows, TRACK) if steps is None else steps)
    return merge_intervals(runs, keys, 0.25, 0.15)


def _fast(cls: str, config: RuleConfig) -> Column:
    return F.when(F.col(cls) == 1, 3.0).otherwise(config.yield_speed)


def failure_to_yield(features: DataFrame, scene: Scene, config: RuleConfig = RuleConfig(), steps: DataFrame | None = None) -> DataFrame:
    """steps has the sampling step of each vehicle, where it is known; so too in the other rules."""
    at = F.struct("t", "frame")
    vehicles = _vehicles(features)
    moving = vehicles.groupBy(*TRACK).agg(F.count("*").alias("n"), F.expr("percentile(speed, 0.5)").alias("v"), _travel("cx", "cy").alias("d"), F.min_by("cls", at).alias("c0"))
    moving = moving.filter((F.col("n") >= 2) & (F.col("v") >= _fast("c0", config)) & (F.col("d") >= 8.0)).select(*TRACK)
    rows = materialize(vehicles.join(moving, TRACK).select(*TRACK, "frame", "t", "cls", "speed", *(f"{p}_{c}" for p in ("foot", "front", "rear") for c in "xy"), "cx", "cy"), "moving_vehicles")
    stays = crosswalk_occupancy(rows, scene, persons=False, steps=steps)
    local = _spanned(rows, stays, 0.12, 0.12).groupBy(*TRACK, "s_crossing", "s_start", "s_end").agg(F.count("*").alias("n"), F.expr("percentile(speed, 0.5)").alias("v"), _travel("cx", "cy").alias("d"), F.min_by("cls", at).alias("c0"))
    passing = local.filter((F.col("n") >= 2) & (F.col("v") >= _fast("c0", config)) & (F.col("d") >= 8.0))
    passing = passing.select("video_id", "id", F.col("s_crossing").alias("crossing"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    walkers = materialize(without_riders(features).select(*TRACK, "t", "foot_x", "foot_y"), "walkers")
    walking = crosswalk_occupancy(walkers, scene, persons=True, margin=config.yield_margin).drop("id")
    return _events(overlap_join(passing, walking, ["video_id", "crossing"], 4.0, "left_semi"), "failure_to_yield")


def approaching(features: DataFrame) -> DataFrame:
    """Vehicle rows of tracks of two rows or more that begin on the near road or off any, or queue at some time; a table."""
    vehicles = _vehicles(features).select(*TRACK, "frame", "t", "road_id", "in_queue", "speed", "front_stopline_signed")
    kept = vehicles.groupBy(*TRACK).agg(F.count("*").alias("n"), F.min_by(F.coalesce("road_id", F.lit("")), F.struct("t", "frame")).alias("road"), F.max("in_queue").alias("queued"), F.max("t").alias("last_t"))
    return materialize(vehicles.join(kept.filter("n >= 2 AND (road IN ('near', '') OR queued)").select(*TRACK, "last_t"), TRACK), "approaching")


def front_crossings(rows: DataFrame) -> DataFrame:
    """video_id, id, t at which the front passes 12 px beyond the stop line."""
    from pyspark.sql import Window as W

    by = W.partitionBy(*TRACK).orderBy("t", "frame")
    before = rows.withColumn("before", F.lag("front_stopline_signed").over(by))
    return before.filter("before < 12.0 AND front_stopline_signed >= 12.0").select(*TRACK, "t")


def line_stops(rows: DataFrame, signals: DataFrame, duration: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """video_id, id, start and end: the first stop of a track just beyond the line, on red, that lasts to the next green.

    rows come from approaching().
    """
    past = rows.filter((F.col("speed") <= config.stop_speed) & F.col("front_stopline_signed").between(10.0, 48.0))
    stops = mask_intervals(past, TRACK, F.lit(True), gap=0.35).filter("end - start >= 0.65")
    stops = stable_state(stops.select(*TRACK, F.col("start").alias("t")), signals).filter("state = 'R'").drop("state")
    last = rows.select(*TRACK, "last_t").distinct()
    stops = forward(stops, sustained_green(signals), "green_t").join(last, TRACK).join(duration, "video_id")
    stops = stops.select(*TRACK, F.col("t").alias("start"), F.coalesce("green_t", F.least("duration", F.col("last_t") + 0.1)).alias("end"))
    s = stops.select(*TRACK, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    went = rows.filter("front_stopline_signed > 48.0 AND speed > 5.0").join(s, TRACK).filter("t >= s_start AND t < s_end").select(*TRACK, F.col("s_start").alias("start")).distinct()
    kept = stops.join(went, [*TRACK, "start"], "left_anti")
    return kept.groupBy(*TRACK).agg(F.min("start").alias("start"), F.min_by("end", "start").alias("end"))


def stop_line(features: DataFrame, signals: DataFrame, duration: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    lamps = materialize(signals.select("video_id", "t", "state"), "lamps")
    return _events(line_stops(approaching(features), lamps, duration, config).filter(F.col("end") - F.col("start") >= config.event_seconds), "stop_line")


def red_light(features: DataFrame, signals: DataFrame, duration: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """A front that passes the line on red and goes on within 1.2 s; not for tracks that stop there, however short the stop."""
    rows, signals = approaching(features), materialize(signals.select("video_id", "t", "state"), "lamps")
    red = stable_state(front_crossings(rows), signals).filter("state = 'R'").drop("state")
    on = rows.filter("front_stopline_signed > 48.0 AND speed > 5.0").select(*TRACK, F.col("t").alias("u"))
    went = red.join(on, TRACK).filter("u >= t AND u <= t + 1.2").groupBy(*TRACK).agg(F.min("t").alias("start"))
    went = went.join(line_stops(rows, signals, duration, config), TRACK, "left_anti")
    went = went.join(rows.select(*TRACK, "last_t").distinct(), TRACK).join(duration, "video_id")
    return _events(went.withColumn("end", F.greatest(F.col("start") + 0.1, F.least("duration", F.col("last_t") + 0.1))), "red_light")


def stopped_vehicle(features: DataFrame, duration: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    rows = _vehicles(features)
    share = rows.groupBy(*TRACK).agg(F.avg(F.col("in_queue").cast("double")).alias("q"), F.avg(F.coalesce(F.col("road_id") == "far", F.lit(False)).cast("double")).alias("f"))
    rows = rows.join(share.filter("q <= 0.15 AND f <= 0.5").select(*TRACK), TRACK)
    runs = mask_intervals(rows, TRACK, F.col("in_road") & (F.col("speed") <= 2.5), gap=0.5, steps=steps).filter("end - start >= 10.0")
    return _events(runs.join(duration, "video_id").withColumn("end", F.least("duration", "end")), "stopped_vehicle")


def wrong_way(features: DataFrame, scene: Scene, steps: DataFrame | None = None) -> DataFrame:
    along = {k: F.cos("heading_rad") * F.lit(x) + F.sin("heading_rad") * F.lit(y) for k, (x, y) in scene.directions.items()}
    against = F.when(F.col("road_id") == "near", along["near"]).when(F.col("road_id") == "far", along["far"])
    mask = F.coalesce(F.col("lane_id").isNotNull() & (F.col("lane_id") != "near_curb") & ~F.col("in_junction") & (against < -0.55) & (F.col("speed") > 5.0), F.lit(False))
    return _events(mask_intervals(_vehicles(features), TRACK, mask, gap=0.35, steps=steps).filter("end - start >= 1.0"), "wrong_way")


def solid_line(features: DataFrame, scene: Scene) -> DataFrame:
    from pyspark.sql import Window as W

    by, out = W.partitionBy(*TRACK).orderBy("t", "frame"), None
    for line in scene.solid_lines.values():
        if len(line) < 2:
            continue
        rows = _vehicles(features).select(*TRACK, "t", "frame", "speed", geo.signed_side(F.col("cx"), F.col("foot_y"), line).alias("d"))
        rows = rows.withColumns({f"p_{c}": F.lag(c).over(by) for c in ("t", "speed", "d")})
        rows = rows.filter((F.col("p_d") * F.col("d") < 0) & (F.least(F.abs("p_d"), F.abs("d")) <= 28.0) & (F.greatest("p_speed", "speed") >= 5.0))
        rows = rows.select("video_id", F.col("p_t").alias("start"), F.col("t").alias("end"))
        out = rows if out is None else out.unionByName(rows)
    return _events(out, "solid_line_crossing")


def frame_pairs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of objects of a frame, the lower id first; columns of the two get a_ and b_."""
    side = lambda p: rows.select("video_id", "frame", *(F.col(c).alias(f"{p}_{c}") for c in ["id", *columns]))
    return side("a").join(side("b"), ["video_id", "frame"]).filter("a_id < b_id")


def contact(features: DataFrame) -> DataFrame:
    pairs = frame_pairs(_vehicles(features).withColumn("at", F.bround("t", 2)), ["at", "speed", "x1", "y1", "x2", "y2"])
    pairs = pairs.withColumn("o", geo.box_overlap("a_", "b_"))
    hit = (F.col("o") >= 0.35) & (F.col("a_speed") < 3.0) & (F.col("b_speed") < 3.0)
    near = (F.col("o") >= 0.12) & (F.least("a_speed", "b_speed") < 4.0)
    found = pairs.withColumn("label", F.when(hit, "accident").when(near, "near_miss")).filter("label IS NOT NULL")
    start = F.col("a_at") - F.when(F.col("label") == "accident", 0.2).otherwise(0.3)
    end = F.col("a_at") + F.when(F.col("label") == "accident", 0.5).otherwise(0.6)
    return found.select("video_id", start.alias("start"), end.alias("end"), "label")


def generate_events(features: DataFrame, signals: DataFrame, scene: Scene, duration: DataFrame, config: RuleConfig = RuleConfig(), more: tuple = ()) -> DataFrame:
    """The events of all rules that are validated (and of more, your own functions of features), cut, merged, of a least length."""
    # Rules keep whole tracks or none where they ask for steps, so the vehicles' serve all of them.
    duration, steps = materialize(duration, "durations"), materialize(sample_step(_vehicles(features), TRACK), "vehicle_steps")
    found = [congestion(features, config), failure_to_yield(features, scene, config, steps), red_light(features, signals, duration, config)]
    if config.unvalidated:
        found += [stopped_vehicle(features, duration, steps), wrong_way(features, scene, steps), solid_line(features, scene), contact(features)]
    found += [rule(features) for rule in more]
    events = found[0]
    for rule in found[1:]:
        events = events.unionByName(rule)
    return merge_events(events.join(duration, "video_id"), F.col("duration"), config.merge_gap, config.event_seconds)
