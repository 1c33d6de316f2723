"""Queries over signal samples and lamp pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.operators import asof
from trajlake.operators.lamps import bright_counts, classify_counts, classify_lamps, classify_phase, lamp_counts
from trajlake.plans.catalog_features import rounded
from trajlake.plans.oracle import sql
from trajlake.sources import adapters


def _points(s: SparkSession, d: str) -> DataFrame:
    return adapters.tracks(s, d).select("video_id", "t").distinct()


def change_points(signals: DataFrame) -> DataFrame:
    """Samples whose state differs from the one before, and each video's first."""
    by = W.partitionBy("video_id").orderBy("t")
    return signals.withColumn("before", F.lag("state").over(by)).filter(~F.col("state").eqNullSafe(F.col("before"))).select("video_id", "t", "state")


def phase_at(points: DataFrame, signals: DataFrame) -> DataFrame:
    """points with is_green: whether green, as 0 or 1 linear between samples and level beyond them, is over one half."""
    ticks = signals.select("video_id", "t", F.struct("t", F.when(F.col("state") == "G", 1.0).otherwise(0.0).alias("v")).alias("s"))
    both = asof.forward(asof.backward(points, ticks, "s").withColumnRenamed("s", "a"), ticks, "s").withColumnRenamed("s", "b")
    line = F.when(F.col("b.t") > F.col("a.t"), F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))).otherwise(F.col("a.v"))
    return both.withColumn("is_green", F.coalesce(line, "a.v", "b.v") > 0.5).drop("a", "b")


_pts = "SELECT DISTINCT video_id, t FROM tracks"
_r = "video_id, round(t, 6) AS t"
_lit, _bright = "s >= 50 AND v >= 60", "v > 150 AND s > 90"
_hue = {"r": "(h <= 12 OR h >= 168)", "y": "h BETWEEN 13 AND 35", "g": "h BETWEEN 38 AND 100"}
_lamps = ", ".join(f"count(*) FILTER ({_lit} AND {x}) AS {c}" for c, x in _hue.items())
_slices = ", ".join(f"count(*) FILTER (slice = {i} AND {_lit} AND {_hue[c]}) AS {c}" for i, c in enumerate("ryg"))
_sizes = ", ".join(f"count(*) FILTER (slice = {i}) AS n{c}" for i, c in enumerate("ryg"))

QUERIES = {
    "asof_nearest": (lambda s, d: rounded(asof.nearest_state(_points(s, d), adapters.signals(s, d))), sql(f"SELECT p.video_id, round(p.t, 6) AS t, coalesce(arg_min(s.state, (abs(s.t - p.t), s.t)) FILTER (WHERE abs(s.t - p.t) <= 0.22), '?') AS state FROM pts p LEFT JOIN signals s ON s.video_id = p.video_id AND s.t BETWEEN p.t - 0.23 AND p.t + 0.23 GROUP BY p.video_id, p.t", pts=_pts)),
    "signal_majority_window": (
        lambda s, d: rounded(asof.stable_state(_points(s, d), adapters.signals(s, d))),
        sql("""SELECT video_id, round(t, 6) AS t, CASE WHEN r + y + g = 0 THEN coalesce(nearest, '?') WHEN r + y + g = 1 OR (greatest(r, y, g) >= 2 AND (r = greatest(r, y, g))::INT + (y = greatest(r, y, g))::INT + (g = greatest(r, y, g))::INT = 1)
          THEN CASE greatest(r, y, g) WHEN r THEN 'R' WHEN y THEN 'Y' ELSE 'G' END ELSE '?' END AS state FROM looked""", pts=_pts,
          looked="""SELECT a.video_id, a.t, coalesce(sum((s.t >= a.t - 0.18::DOUBLE AND s.t <= a.t + 0.18::DOUBLE AND s.state = 'R')::INT), 0) AS r, coalesce(sum((s.t >= a.t - 0.18::DOUBLE AND s.t <= a.t + 0.18::DOUBLE AND s.state = 'Y')::INT), 0) AS y,
          coalesce(sum((s.t >= a.t - 0.18::DOUBLE AND s.t <= a.t + 0.18::DOUBLE AND s.state = 'G')::INT), 0) AS g, arg_min(s.state, (abs(s.t - a.t), s.t)) FILTER (WHERE abs(s.t - a.t) <= 0.22) AS nearest
          FROM pts a LEFT JOIN signals s ON s.video_id = a.video_id AND s.t BETWEEN a.t - 0.23 AND a.t + 0.23 GROUP BY a.video_id, a.t"""),
    ),
    "asof_backward": (
        lambda s, d: rounded(asof.backward(_points(s, d), change_points(adapters.signals(s, d)), "state", F.lit("?"))),
        sql(f"SELECT p.video_id, round(p.t, 6) AS t, coalesce(c.state, '?') AS state FROM pts p ASOF LEFT JOIN changes c ON c.video_id = p.video_id AND c.t <= p.t", pts=_pts, changes="SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY video_id ORDER BY t) AS before FROM signals) x WHERE before IS DISTINCT FROM state"),
    ),
    "asof_forward_green": (
        lambda s, d: rounded(asof.forward(_points(s, d), asof.sustained_green(adapters.signals(s, d)), "green_t")),
        sql("SELECT p.video_id, round(p.t, 6) AS t, round(c.t, 6) AS green_t FROM pts p ASOF LEFT JOIN greens c ON c.video_id = p.video_id AND c.t >= p.t", pts=_pts, greens="SELECT video_id, t FROM (SELECT *, coalesce(lead(t, 2) OVER w, lead(t, 1) OVER w) AS upto FROM signals WHERE state = 'G' WINDOW w AS (PARTITION BY video_id ORDER BY t)) x WHERE upto - t <= 0.35"),
    ),
    "sustained_green": (lambda s, d: rounded(asof.sustained_green(adapters.signals(s, d)).select("video_id", "t")), sql("SELECT video_id, round(t, 6) AS t FROM (SELECT *, coalesce(lead(t, 2) OVER w, lead(t, 1) OVER w) AS upto FROM signals WHERE state = 'G' WINDOW w AS (PARTITION BY video_id ORDER BY t)) x WHERE upto - t <= 0.35")),
    "change_points": (lambda s, d: rounded(change_points(adapters.signals(s, d))), sql(f"SELECT {_r}, state FROM (SELECT *, lag(state) OVER (PARTITION BY video_id ORDER BY t) AS before FROM signals) x WHERE before IS DISTINCT FROM state")),
    "phase_interpolate": (
        lambda s, d: rounded(phase_at(_points(s, d), adapters.signals(s, d))),
        sql("""SELECT p.video_id, round(p.t, 6) AS t, coalesce(CASE WHEN b.t > a.t THEN a.v + (b.v - a.v) * (p.t - a.t) / (b.t - a.t) ELSE a.v END, a.v, b.v) > 0.5 AS is_green
          FROM pts p ASOF LEFT JOIN ph a ON a.video_id = p.video_id AND a.t <= p.t ASOF LEFT JOIN ph b ON b.video_id = p.video_id AND b.t >= p.t""", pts=_pts, ph="SELECT video_id, t, (state = 'G')::INT::DOUBLE AS v FROM signals"),
    ),
    "phase_counts": (lambda s, d: adapters.signals(s, d).groupBy("video_id", "state").agg(F.count("*").alias("n")), sql("SELECT video_id, state, count(*) AS n FROM signals GROUP BY ALL")),
    "classify_counts": (
        lambda s, d: adapters.signals(s, d).select("video_id", "frame", classify_counts(F.col("red"), F.col("amber"), F.col("green")).alias("state")),
        sql("""SELECT video_id, frame, CASE WHEN b < 5 OR (c2 > 0 AND b < c2 * 1.5) THEN '?' WHEN amber = b THEN 'Y' WHEN red = b THEN 'R' ELSE 'G' END AS state FROM (
          SELECT *, greatest(red, amber, green) AS b, list_sort([red, amber, green])[2] AS c2 FROM signals) x"""),
    ),
    "classify_phase_alt": (
        lambda s, d: adapters.signals(s, d).select("video_id", "frame", classify_phase(F.col("red"), F.col("amber"), F.col("green")).alias("state")),
        sql("SELECT video_id, frame, CASE WHEN red >= 25 AND red > 1.5 * green THEN 'R' WHEN green >= 25 AND green > 1.5 * red THEN 'G' WHEN amber >= 18 AND amber > greatest(red, green) THEN 'Y' ELSE '?' END AS state FROM signals"),
    ),
    "lamp_pixel_counts": (lambda s, d: lamp_counts(adapters.pixels(s, d)), sql(f"SELECT video_id, frame, {_lamps} FROM pixels GROUP BY ALL")),
    "lamp_counts_bright": (
        lambda s, d: bright_counts(adapters.pixels(s, d)),
        sql(f"SELECT video_id, frame, red, amber, green, CASE WHEN green > red THEN 'G' ELSE 'R' END AS ped FROM (SELECT video_id, frame, count(*) FILTER ({_bright} AND (h <= 10 OR h BETWEEN 170 AND 180)) AS red, count(*) FILTER ({_bright} AND h BETWEEN 11 AND 30) AS amber, count(*) FILTER ({_bright} AND h BETWEEN 60 AND 95) AS green FROM pixels GROUP BY video_id, frame) x"),
    ),
    "classify_lamp_position": (
        lambda s, d: classify_lamps(adapters.pixels(s, d)),
        sql(f"""SELECT video_id, frame, CASE WHEN b < mb OR (c2 >= least(mr, my, mg) AND b < c2 * 2.0) THEN '?' ELSE st END AS state FROM (
          SELECT *, greatest(r, y, g) AS b, list_sort([r, y, g])[2] AS c2, CASE greatest(r, y, g) WHEN y THEN 'Y' WHEN r THEN 'R' ELSE 'G' END AS st, CASE greatest(r, y, g) WHEN y THEN my WHEN r THEN mr ELSE mg END AS mb FROM (
          SELECT video_id, frame, r, y, g, greatest(1, least(5, ceil(0.01 * 3 * nr))) AS mr, greatest(1, least(5, ceil(0.01 * 3 * ny))) AS my, greatest(1, least(5, ceil(0.01 * 3 * ng))) AS mg FROM (
          SELECT video_id, frame, {_slices}, {_sizes} FROM (SELECT *, CASE WHEN row < base + (rest > 0)::INT THEN 0 WHEN row < 2 * base + (rest > 0)::INT + (rest > 1)::INT THEN 1 ELSE 2 END AS slice FROM (
          SELECT *, n // 3 AS base, n % 3 AS rest FROM (SELECT *, max(row) OVER (PARTITION BY video_id, frame) + 1 AS n FROM pixels) p0) p1) p2 GROUP BY video_id, frame) p3) p4) p5"""),
    ),
}
