"""Queries over tracks: scalar functions, pairs, windows, summaries and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.operators import motion
from trajlake.plans import rules
from trajlake.plans.catalog_features import features, rounded
from trajlake.plans.features import VEHICLES, to_scene
from trajlake.plans.oracle import segments, sql, within
from trajlake.sources import adapters
from trajlake.sources.scene import crossroads

SCENE = crossroads()
_t, _f = adapters.tracks, features
_feet = lambda s, d: to_scene(_t(s, d), SCENE, adapters.SOURCE_SIZE)
_KEY = ["video_id", "id", "frame"]
_k = "video_id, id, frame"
_by = "PARTITION BY video_id, id ORDER BY t, frame"
H = [1.02, 0.03, -4.0, -0.01, 0.98, 6.0, 0.00001, 0.00002, 1.0]


def detections(tracks: DataFrame) -> DataFrame:
    """One row a frame with parallel arrays, as detectors give them."""
    rows = F.sort_array(F.collect_list(F.struct("id", "cls", "conf", F.array("x1", "y1", "x2", "y2").alias("xyxy"))))
    return tracks.groupBy("video_id", "frame").agg(rows.alias("r")).select("video_id", "frame", F.lit(30.0).alias("fps"), F.lit(0.5).alias("scale"), *(F.col(f"r.{c}").alias(c) for c in ("id", "cls", "conf", "xyxy")))


def flatten_detections(rows: DataFrame) -> DataFrame:
    """Parallel arrays to a row a box, times the scale; frames without ids give none; fps and scale must be positive."""
    ok = F.assert_true((F.col("fps") > 0) & (F.col("scale") > 0), F.lit("fps and scale must be positive"))
    flat = rows.withColumn("ok", ok).filter("ok IS NULL AND id IS NOT NULL").select("video_id", "frame", "fps", "scale", F.inline(F.arrays_zip("id", "cls", "conf", "xyxy")))
    return flat.select("video_id", "frame", (F.col("frame") / F.col("fps")).alias("t"), "id", "cls", "conf", *((F.col("xyxy")[i] * F.col("scale")).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


def resize_plan(frames: DataFrame, most: int = 1920) -> DataFrame:
    """The width and height to process frames (width, height) at, and the scale back; heights round half to even."""
    w = F.least("width", F.lit(most))
    return frames.withColumns({"target_width": w, "target_height": F.greatest(F.lit(1), F.bround(F.col("height") * w / F.col("width")).cast("int")), "coordinate_scale": F.col("width") / w})


_seg = lambda mask, gap, least: segments("SELECT * FROM lagged", "video_id, id", mask, gap, least)
_inside = {name: within("r.foot_x", "r.foot_y", "crosswalks", name) for name in SCENE.crosswalks}

QUERIES = {
    "detections_flatten": (lambda s, d: rounded(flatten_detections(detections(_t(s, d)))), sql(f"SELECT {_k}, round(frame / 30.0::DOUBLE, 6) AS t, cls, round(conf, 6) AS conf, round(x1 * 0.5, 6) AS x1, round(y1 * 0.5, 6) AS y1, round(x2 * 0.5, 6) AS x2, round(y2 * 0.5, 6) AS y2 FROM tracks")),
    "stride_sample": (lambda s, d: _t(s, d).filter(F.col("frame") % 12 == 0).select(*_KEY), sql(f"SELECT {_k} FROM tracks WHERE frame % 12 = 0")),
    "class_filter": (lambda s, d: _t(s, d).filter(F.col("cls").isin(*VEHICLES) & (F.col("conf") >= 0.4)).select(*_KEY, "cls"), sql(f"SELECT {_k}, cls FROM tracks WHERE cls IN (1, 2, 3, 5, 7) AND conf >= 0.4")),
    "resize_plan": (
        lambda s, d: rounded(resize_plan(_t(s, d).select("video_id", F.expr("CAST(640 + 37 * (id % 100) AS INT)").alias("width"), F.expr("CAST(360 + 11 * (id % 100) AS INT)").alias("height")).distinct())),
        sql("SELECT *, least(width, 1920) AS target_width, greatest(1, round_even(height * least(width, 1920) / width, 0)::INT) AS target_height, round(width / least(width, 1920), 6) AS coordinate_scale FROM (SELECT DISTINCT video_id, (640 + 37 * (id % 100))::INT AS width, (360 + 11 * (id % 100))::INT AS height FROM tracks) x"),
    ),
    "scale_to_ref": (lambda s, d: rounded(_feet(s, d).select(*_KEY, "cx", "cy", "foot_x", "foot_y"), 5), sql(f"SELECT {_k}, round(cx, 5) AS cx, round(cy, 5) AS cy, round(foot_x, 5) AS foot_x, round(foot_y, 5) AS foot_y FROM feet")),
    "point_in_polygon": (lambda s, d: _feet(s, d).select(*_KEY, geo.inside(F.col("foot_x"), F.col("foot_y"), SCENE.junction).alias("hit")), sql(f"SELECT {_k}, {within('r.foot_x', 'r.foot_y', 'zones', 'junction')} AS hit FROM feet r")),
    "point_in_polygon_margin": (lambda s, d: _feet(s, d).select(*_KEY, geo.inside(F.col("foot_x"), F.col("foot_y"), SCENE.junction, 15.0).alias("hit")), sql(f"SELECT {_k}, {within('r.foot_x', 'r.foot_y', 'zones', 'junction', 15.0)} AS hit FROM feet r")),
    "signed_side_and_dist": (
        lambda s, d: rounded(_feet(s, d).select(*_KEY, geo.side_and_distance(F.col("foot_x"), F.col("foot_y"), SCENE.stop_line).alias("q")).select(*_KEY, "q.side", "q.distance"), 5),
        sql(f"""SELECT {_k}, round(arg_min(((bx - ax) * (foot_y - ay) - (by_ - ay) * (foot_x - ax)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), (d2, i)), 5) AS side, round(sqrt(min(d2)), 5) AS distance FROM (
          SELECT *, (foot_x - (ax + u * (bx - ax))) ** 2 + (foot_y - (ay + u * (by_ - ay))) ** 2 AS d2 FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((foot_x - ax) * (bx - ax) + (foot_y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS u FROM feet, edges WHERE grp = 'stop_lines') a) b GROUP BY {_k}"""),
    ),
    "homography_apply": (
        lambda s, d: rounded(_feet(s, d).select(*_KEY, geo.homography(F.col("foot_x"), F.col("foot_y"), H).alias("q")).select(*_KEY, "q.x", "q.y"), 5),
        sql(f"SELECT {_k}, round(({H[0]}::DOUBLE * foot_x + {H[1]}::DOUBLE * foot_y + {H[2]}::DOUBLE) / w, 5) AS x, round(({H[3]}::DOUBLE * foot_x + {H[4]}::DOUBLE * foot_y + {H[5]}::DOUBLE) / w, 5) AS y FROM (SELECT *, {H[6]!r}::DOUBLE * foot_x + {H[7]!r}::DOUBLE * foot_y + 1.0::DOUBLE AS w FROM feet) f"),
    ),
    "direction_hue": (lambda s, d: rounded(_f(s, d).select(*_KEY, F.pmod(F.degrees("heading_rad"), F.lit(360.0)).alias("hue"), F.format_string("%d:%02d", F.floor(F.col("t") / 60), (F.floor("t") % 60)).alias("clock")), 4), sql(f"SELECT {_k}, round(CASE WHEN heading_rad < 0 THEN degrees(heading_rad) + 360 ELSE degrees(heading_rad) END, 4) AS hue, (floor(t / 60)::BIGINT)::VARCHAR || ':' || lpad((floor(t)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM features")),
    "frame_pair_join": (
        lambda s, d: rounded(rules.frame_pairs(_t(s, d).filter(F.col("cls").isin(*VEHICLES)), ["x1", "y1", "x2", "y2"]).select("video_id", "frame", "a_id", "b_id", geo.box_overlap("a_", "b_").alias("overlap"))),
        sql("SELECT a.video_id, a.frame, a.id AS a_id, b.id AS b_id, round(greatest(0.0::DOUBLE, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0::DOUBLE, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least(greatest(1.0::DOUBLE, (a.x2 - a.x1) * (a.y2 - a.y1)), greatest(1.0::DOUBLE, (b.x2 - b.x1) * (b.y2 - b.y1))), 6) AS overlap FROM tracks a JOIN tracks b ON a.video_id = b.video_id AND a.frame = b.frame AND a.id < b.id WHERE a.cls <> 0 AND b.cls <> 0"),
    ),
    "sample_step": (lambda s, d: rounded(motion.steps(_t(s, d))), sql("SELECT video_id, id, round(coalesce(quantile_cont(dt, 0.5), 0.1), 6) AS step FROM (SELECT video_id, id, t - lag(t) OVER (PARTITION BY video_id, id ORDER BY t) AS dt FROM (SELECT DISTINCT video_id, id, t FROM tracks) a) b GROUP BY video_id, id")),
    "lagged_speed": (lambda s, d: rounded(motion.lagged_speed(_feet(s, d)).select(*_KEY, "v"), 5), sql(f"SELECT {_k}, round(sqrt((cx - lag(cx, 10) OVER w) ** 2 + (foot_y - lag(foot_y, 10) OVER w) ** 2) / (t - lag(t, 10) OVER w), 5) AS v FROM feet WINDOW w AS ({_by})")),
    "projected_velocity": (lambda s, d: rounded(motion.projected_velocity(_feet(s, d), SCENE.directions["near"]).select(*_KEY, "v"), 5), sql(f"SELECT {_k}, round(((cx - lag(cx, 10) OVER w) * 0.96::DOUBLE + (foot_y - lag(foot_y, 10) OVER w) * 0.28::DOUBLE) / (t - lag(t, 10) OVER w), 5) AS v FROM feet WINDOW w AS ({_by})")),
    "track_summary": (
        lambda s, d: rounded(motion.track_summary(_f(s, d)), 5),
        sql("SELECT video_id, id, arg_max(cls, (c, -cls)) AS cls, any_value(n) AS n, round(any_value(t0), 5) AS t0, round(any_value(t1), 5) AS t1, round(any_value(d), 5) AS displacement, round(any_value(v), 5) AS speed FROM (SELECT video_id, id, cls, count(*) AS c FROM features GROUP BY ALL) m JOIN (SELECT video_id, id, count(*) AS n, min(t) AS t0, max(t) AS t1, sqrt((arg_max(cx, (t, frame)) - arg_min(cx, (t, frame))) ** 2 + (arg_max(cy, (t, frame)) - arg_min(cy, (t, frame))) ** 2) AS d, quantile_cont(speed, 0.5) AS v FROM features GROUP BY video_id, id) q USING (video_id, id) GROUP BY video_id, id"),
    ),
    "track_filter_having": (
        lambda s, d: rounded(_feet(s, d).groupBy("video_id", "id").agg(F.count("*").alias("n"), *(f(c).alias(f"{x}_{c}") for x, f in (("min", F.min), ("max", F.max)) for c in ("cx", "foot_y")), (F.max("t") - F.min("t")).alias("span")).filter("n >= 10 AND span >= 1.2").drop("span"), 5),
        sql("SELECT video_id, id, count(*) AS n, round(min(cx), 5) AS min_cx, round(min(foot_y), 5) AS min_foot_y, round(max(cx), 5) AS max_cx, round(max(foot_y), 5) AS max_foot_y FROM feet GROUP BY video_id, id HAVING count(*) >= 10 AND max(t) - min(t) >= 1.2"),
    ),
    "quantile_rows": (
        lambda s, d: motion.quantile_rows(_t(s, d)).select(*_KEY),
        sql(f"SELECT {_k} FROM (SELECT *, row_number() OVER ({_by}) - 1 AS i, count(*) OVER (PARTITION BY video_id, id) AS n FROM tracks) x WHERE i IN (0, n // 4, n // 2, 3 * n // 4, n - 1)"),
    ),
    "every_kth_row": (lambda s, d: motion.every_kth(_t(s, d), 12).select(*_KEY), sql(f"SELECT {_k} FROM (SELECT *, row_number() OVER ({_by}) - 1 AS i, count(*) OVER (PARTITION BY video_id, id) AS n FROM tracks) x WHERE i % greatest(1, n // 12) = 0")),
    "lane_counts": (lambda s, d: _f(s, d).filter("lane_id IS NOT NULL").groupBy("video_id", "lane_id").agg(F.count("*").alias("n")), sql("SELECT video_id, lane_id, count(*) AS n FROM features WHERE lane_id IS NOT NULL GROUP BY ALL")),
    "queue_counts": (lambda s, d: _f(s, d).groupBy("video_id").agg(F.count_if("in_queue").alias("n")), sql("SELECT video_id, count(*) FILTER (in_queue) AS n FROM features GROUP BY ALL")),
    "density_grid": (
        lambda s, d: motion.density_grid(_feet(s, d), SCENE.size),
        sql("SELECT row, col, round(n / greatest(1, max(n) OVER ()), 3) AS density FROM (SELECT least(17, floor(foot_y / 60))::INT AS row, least(31, floor(cx / 60))::INT AS col, count(*) AS n FROM feet WHERE cx BETWEEN 0 AND 1920 AND foot_y BETWEEN 0 AND 1080 GROUP BY 1, 2) x"),
    ),
    "queue_series": (
        lambda s, d: motion.queue_series(_feet(s, d), SCENE.queue),
        sql(f"SELECT video_id, round_even(t, 0)::BIGINT AS sec, count(DISTINCT id) AS total, count(*) FILTER (v < 5) // 9 AS stationary FROM (SELECT *, sqrt((cx - lag(cx, 10) OVER w) ** 2 + (foot_y - lag(foot_y, 10) OVER w) ** 2) / (t - lag(t, 10) OVER w) AS v FROM feet WHERE cls <> 0 WINDOW w AS ({_by})) r WHERE {within('r.cx', 'r.foot_y', 'zones', 'queue')} GROUP BY 1, 2"),
    ),
    "hit_segments": (
        lambda s, d: motion.slow_segments(_feet(s, d)),
        sql(f'SELECT * FROM ({_seg("v < 5", 0.5, 1.0)}) z', lagged=f"SELECT *, sqrt((cx - lag(cx, 10) OVER w) ** 2 + (foot_y - lag(foot_y, 10) OVER w) ** 2) / (t - lag(t, 10) OVER w) AS v FROM feet WINDOW w AS ({_by})"),
    ),
}
