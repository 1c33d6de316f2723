"""Tracks to map-space features: position, membership of shapes, distances to the stop line, motion. One shuffle by track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.sources.scene import Scene

# The classes of the detector that are vehicles, and those that a person may ride.
VEHICLES, RIDDEN = (1, 2, 3, 5, 7), (1, 3)


def to_scene(tracks: DataFrame, scene: Scene, source_size: tuple[int, int]) -> DataFrame:
    """Adds scale_x, scale_y, cx, cy, foot_x and foot_y."""
    sx, sy = scene.size[0] / source_size[0], scene.size[1] / source_size[1]
    cx = (F.col("x1") + F.col("x2")) * 0.5 * sx
    return tracks.withColumns({"scale_x": F.lit(sx), "scale_y": F.lit(sy), "cx": cx, "cy": (F.col("y1") + F.col("y2")) * 0.5 * sy, "foot_x": cx, "foot_y": F.col("y2") * sy})


def membership(rows: DataFrame, scene: Scene) -> DataFrame:
    """Adds road_id, lane_id, crosswalk_id, in_queue, in_junction and in_road of the foot point."""
    x, y = F.col("__x"), F.col("__y")  # never null: what isn't null needs less code
    rows = rows.withColumns({f"__{c}": F.coalesce(f"foot_{c}", F.lit(float("nan"))) for c in "xy"})
    on_island = F.lit(False)
    for name, polygon in scene.islands.items():
        if name.startswith("island_") and len(polygon) >= 3:
            on_island = on_island | geo.inside(x, y, polygon, 8.0)
    rows = rows.withColumns({
        "road_id": geo.first_of(x, y, scene.carriageways, 8.0), "lane_id": geo.first_of(x, y, scene.lanes), "crosswalk_id": geo.first_of(x, y, scene.crosswalks, 10.0),
        "in_queue": geo.inside(x, y, scene.queue, 12.0), "in_junction": geo.inside(x, y, scene.junction, 8.0), "__island": on_island,
    })
    far = geo.inside(x, y, scene.carriageways["far"], 8.0) if "far" in scene.carriageways else F.lit(False)
    lane = F.coalesce("lane_id", F.when(far, geo.far_lane(x, y, scene.dashed_lines, scene.directions["far"])))
    return rows.withColumns({"lane_id": lane, "in_road": F.col("road_id").isNotNull() & ~F.col("__island")}).drop("__island", "__x", "__y")


def body_axis(rows: DataFrame, scene: Scene) -> DataFrame:
    """Adds front and rear points: the foot point moved by half the box along the road's direction, for vehicles."""
    near = ~F.coalesce(F.col("lane_id").startswith("far_"), F.lit(False)) & ~F.coalesce(F.col("road_id") == "far", F.lit(False))
    vehicle = F.col("cls").isin(*VEHICLES)

    def unit(name: str) -> tuple[float, float]:
        x, y = scene.directions[name]
        norm = max((x * x + y * y) ** 0.5, 1e-9)
        return x / norm, y / norm

    n, f = unit("near"), unit("far")
    dx, dy = F.when(near, n[0]).otherwise(f[0]), F.when(near, n[1]).otherwise(f[1])
    extent = (F.abs(dx) * (F.col("x2") - F.col("x1")) * F.col("scale_x") + F.abs(dy) * (F.col("y2") - F.col("y1")) * F.col("scale_y")) * 0.5
    mx, my = (F.when(vehicle, d * extent).otherwise(0.0) for d in (dx, dy))
    return rows.withColumns({"front_x": F.col("foot_x") + mx, "front_y": F.col("foot_y") + my, "rear_x": F.col("foot_x") - mx, "rear_y": F.col("foot_y") - my})


def stop_line(rows: DataFrame, scene: Scene) -> DataFrame:
    """Adds stopline_signed and front_stopline_signed, positive beyond the line."""
    d = scene.directions["near"]
    return rows.withColumns({f"{p}stopline_signed": geo.signed_along(F.col(f"{q}_x"), F.col(f"{q}_y"), scene.stop_line, d) for p, q in (("", "foot"), ("front_", "front"))})


def motion(rows: DataFrame) -> DataFrame:
    """Adds speed (median of three central differences) and heading_rad; a track of one row stands still.

    A difference that is null, not a number or infinite counts as no motion.
    """
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).otherwise(0.0)
    by = W.partitionBy("video_id", "id").orderBy("t", "frame")
    step = {c: F.coalesce(F.lead(c).over(by), F.col(c)) - F.coalesce(F.lag(c).over(by), F.col(c)) for c in ("cx", "cy", "t")}
    rows = rows.withColumns({f"__d{c}": d for c, d in step.items()}).withColumn("__n", F.count("*").over(W.partitionBy("video_id", "id")))
    dt = F.greatest(F.when(F.col("__n") == 1, 0.1).otherwise(F.col("__dt")), F.lit(1e-3))
    rows = rows.withColumn("__raw", F.sqrt(F.col("__dcx") * F.col("__dcx") + F.col("__dcy") * F.col("__dcy")) / dt)
    rows = rows.withColumn("__turn", F.atan2("__dcy", "__dcx"))
    rows = rows.withColumns({"__speed": finite("__raw"), "heading_rad": finite("__turn")})
    rows = rows.withColumns({"__before": F.lag("__speed").over(by), "__after": F.lead("__speed").over(by)})
    # Not percentile() over the window: it builds a map of values for each row.
    a, b, c = F.col("__before"), F.col("__speed"), F.col("__after")
    two = F.coalesce(a, c) * 0.5 + b * 0.5
    three = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    rows = rows.withColumn("speed", F.when(F.col("__n") == 1, b).when(a.isNull() | c.isNull(), two).otherwise(three))
    return rows.drop("__dcx", "__dcy", "__dt", "__n", "__raw", "__turn", "__speed", "__before", "__after")


def extract_features(tracks: DataFrame, scene: Scene, source_size: tuple[int, int]) -> DataFrame:
    """All of the above. Rows whose coordinates are null have null positions and belong to no shape."""
    return motion(stop_line(body_axis(membership(to_scene(tracks, scene, source_size), scene), scene), scene))
