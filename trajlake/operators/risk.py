"""How likely an accident is soon, from what has been seen so far: by sample of a video, and as a curve over its frames.

Three signs count: two objects on a collision course, a track that brakes hard, and a vehicle that passes on red or comes
against the road's direction. A sample's score is the greatest of them. Between samples it fades.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.functions.intervals import point_join
from trajlake.operators.asof import backward
from trajlake.plans.features import VEHICLES, to_scene
from trajlake.sources.files import materialize
from trajlake.sources.scene import Scene

TRACK = ["video_id", "id"]


@dataclass(frozen=True)
class RiskConfig:
    """Seconds, scene pixels and scores. The defaults."""

    horizon: float = 5.0
    moving: float = 3.0
    clearance: float = 25.0
    collision_most: float = 0.9
    braking_from: float = 30.0
    braking_speed: float = 12.0
    braking_least: float = 0.52
    braking_most: float = 0.8
    on_red: float = 0.58
    wrong_way: float = 0.55
    fade: float = 1.5


def causal_motion(tracks: DataFrame, scene: Scene, source_size: tuple[int, int]) -> DataFrame:
    """video_id, frame, t, id, cls, x, y, radius, vx, vy and speed of persons and vehicles, from each one's last sample only."""
    by = W.partitionBy(*TRACK).orderBy("t", "frame")
    rows = to_scene(tracks.filter((F.col("cls") == 0) | F.col("cls").isin(*VEHICLES)), scene, source_size)
    wide, high = (F.col("x2") - F.col("x1")) * F.col("scale_x"), (F.col("y2") - F.col("y1")) * F.col("scale_y")
    rows = rows.select(*TRACK, "frame", "t", "cls", F.col("cx").alias("x"), F.col("foot_y").alias("y"), F.greatest(F.lit(6.0), F.hypot(wide, high) * 0.25).alias("radius"))
    dt = F.greatest(F.lit(1e-3), F.col("t") - F.lag("t").over(by))
    rows = rows.withColumns({f"v{c}": F.coalesce((F.col(c) - F.lag(c).over(by)) / dt, F.lit(0.0)) for c in ("x", "y")})
    return rows.withColumn("speed", F.hypot("vx", "vy"))


def collision(objects: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """video_id, frame and ttc, the highest risk of two objects of a frame, not both persons, that move towards each other."""
    columns = ["cls", "x", "y", "radius", "vx", "vy"]
    moving = objects.filter(F.col("speed") >= config.moving)
    side = lambda p: moving.select("video_id", "frame", *(F.col(c).alias(f"{p}_{c}") for c in ("id", *columns)))
    pairs = side("a").join(side("b"), ["video_id", "frame"]).filter("a_id < b_id AND NOT (a_cls = 0 AND b_cls = 0)")
    pairs = pairs.select("video_id", "frame", (F.col("a_radius") + F.col("b_radius")).alias("radii"), *((F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"d{c}") for c in ("x", "y", "vx", "vy")))
    pairs = pairs.withColumn("closing", F.col("dvx") * F.col("dvx") + F.col("dvy") * F.col("dvy")).filter("closing >= 1e-5")
    pairs = pairs.withColumn("after", -(F.col("dx") * F.col("dvx") + F.col("dy") * F.col("dvy")) / F.col("closing"))
    pairs = pairs.filter((F.col("after") > 0) & (F.col("after") <= config.horizon))
    miss = F.hypot(F.col("dx") + F.col("dvx") * F.col("after"), F.col("dy") + F.col("dvy") * F.col("after"))
    pairs = pairs.withColumn("gap", miss - F.col("radii")).filter(F.col("gap") <= config.clearance)
    close = 1 / (1 + F.exp(F.least(F.lit(40.0), F.greatest(F.lit(-40.0), (F.col("gap") - 4.0) / 5.0))))
    return pairs.groupBy("video_id", "frame").agg(F.max(close * F.exp(-F.col("after") / 4.0) * config.collision_most).alias("ttc"))


def braking(objects: DataFrame, samples: DataFrame, config: RiskConfig = RiskConfig(), width: float = 2.0) -> DataFrame:
    """video_id, t and braking, the highest of the risks by which a track's last three samples show that it brakes.

    A track's risk holds from its sample until its next one; after its last one, to the end of the video. The former are looked
    up as spans, of which most are width seconds long or less, the latter add up in one running maximum.
    """
    by = W.partitionBy(*TRACK).orderBy("t", "frame")
    moved = F.hypot(F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by))
    dt = F.greatest(F.lit(0.1), F.col("t") - F.lag("t").over(by))
    rows = objects.select(*TRACK, "frame", "t", F.lead("t").over(by).alias("until"), moved.alias("moved"), dt.alias("dt"))
    rows = rows.withColumn("v", F.col("moved") / F.col("dt")).withColumn("before", F.lag("v").over(by))
    slowing = (F.col("before") - F.col("v")) / F.col("dt")
    risk = F.least(F.lit(config.braking_most), config.braking_least + (slowing - config.braking_from) / 100)
    rows = rows.filter((slowing >= config.braking_from) & (F.col("before") >= config.braking_speed)).select("video_id", "t", "until", risk.alias("risk"))
    ended = rows.filter("until IS NULL").groupBy("video_id", "t").agg(F.max("risk").alias("risk"))
    running = F.max("risk").over(W.partitionBy("video_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    left = samples.join(ended, ["video_id", "t"], "left").select("video_id", "t", running.alias("risk"))
    spans = rows.filter("until IS NOT NULL").select("video_id", F.col("t").alias("since"), "until", "risk")
    held = point_join(samples, materialize(spans, "braking_spans"), ["video_id"], width, "t", "since", "until").filter("t < until").select("video_id", "t", "risk")
    return left.unionByName(held).groupBy("video_id", "t").agg(F.max("risk").alias("braking")).filter("braking IS NOT NULL")


def violation(objects: DataFrame, signals: DataFrame, scene: Scene, config: RiskConfig = RiskConfig()) -> DataFrame:
    """video_id, frame and rule, while the signal is red: a vehicle moves in the junction, or against the near approach."""
    at = (F.col("x"), F.col("y"))
    along = (F.col("vx") * scene.directions["near"][0] + F.col("vy") * scene.directions["near"][1]) / F.greatest("speed", F.lit(1e-6))
    against = geo.inside(*at, scene.carriageways["near"]) & (along < -0.6)
    risk = F.when(geo.inside(*at, scene.junction), config.on_red).when(against, config.wrong_way)
    rows = objects.filter((F.col("cls") != 0) & (F.col("speed") >= config.moving)).withColumn("rule", risk).filter("rule IS NOT NULL")
    best = rows.groupBy("video_id", "frame", "t").agg(F.max("rule").alias("rule"))
    return backward(best, signals, "state").filter("state = 'R'").select("video_id", "frame", "rule")


def sample_scores(tracks: DataFrame, signals: DataFrame, scene: Scene, source_size: tuple[int, int], config: RiskConfig = RiskConfig()) -> DataFrame:
    """video_id, frame, t and score of each frame that has tracks: the greatest of the three signs, 0 if there is none."""
    objects = causal_motion(tracks, scene, source_size)
    samples = tracks.select("video_id", "frame", "t").distinct()
    out = samples.join(collision(objects, config), ["video_id", "frame"], "left").join(violation(objects, signals, scene, config), ["video_id", "frame"], "left")
    out = out.join(braking(objects, samples.select("video_id", "t"), config), ["video_id", "t"], "left")
    return out.select("video_id", "frame", "t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest("ttc", "rule", "braking", F.lit(0.0)))).alias("score"))


def risk_curve(ticks: DataFrame, samples: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """ticks (video_id, t) with the score of the last sample at or before them, faded since; 0 before the first."""
    last = backward(ticks, samples.select("video_id", "t", F.struct("t", "score").alias("last")), "last")
    faded = F.col("last.score") * F.exp(-(F.col("t") - F.col("last.t")) / config.fade)
    return last.withColumn("score", F.coalesce(faded, F.lit(0.0))).drop("last")
