"""Queries of the risk scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajlake.operators import risk
from trajlake.plans.catalog_features import rounded
from trajlake.plans.oracle import sql, within
from trajlake.sources import adapters
from trajlake.sources.scene import ALONG, crossroads

SCENE = crossroads()


def _objects(s: SparkSession, d: str) -> DataFrame:
    return risk.causal_motion(adapters.tracks(s, d), SCENE, adapters.SOURCE_SIZE)


def _samples(s: SparkSession, d: str) -> DataFrame:
    return risk.sample_scores(adapters.tracks(s, d), adapters.signals(s, d), SCENE, adapters.SOURCE_SIZE)


def _times(s: SparkSession, d: str) -> DataFrame:
    return adapters.tracks(s, d).select("video_id", "t").distinct()


_w = "WINDOW w AS (PARTITION BY video_id, id ORDER BY t, frame)"
CTES = {
    "obj": f"""SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (
      SELECT video_id, id, frame, t, cls, cx AS x, foot_y AS y, greatest(6.0::DOUBLE, 0.25 * sqrt(pow((x2 - x1) * 0.5, 2) + pow((y2 - y1) * 0.5, 2))) AS radius,
        coalesce((cx - lag(cx) OVER w) / greatest(1e-3::DOUBLE, t - lag(t) OVER w), 0) AS vx,
        coalesce((foot_y - lag(foot_y) OVER w) / greatest(1e-3::DOUBLE, t - lag(t) OVER w), 0) AS vy
      FROM feet WHERE cls IN (0, 1, 2, 3, 5, 7) {_w}) o0""",
    "meets": """SELECT a.video_id, a.frame, a.radius + b.radius AS radii, b.x - a.x AS dx, b.y - a.y AS dy, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy
      FROM obj a JOIN obj b ON a.video_id = b.video_id AND a.frame = b.frame AND a.id < b.id WHERE a.speed >= 3 AND b.speed >= 3 AND NOT (a.cls = 0 AND b.cls = 0)""",
    "closing": "SELECT *, -(dx * dvx + dy * dvy) / (dvx * dvx + dvy * dvy) AS after FROM meets WHERE dvx * dvx + dvy * dvy >= 1e-5",
    "gaps": "SELECT *, sqrt(pow(dx + dvx * after, 2) + pow(dy + dvy * after, 2)) - radii AS gap FROM closing WHERE after > 0 AND after <= 5",
    "ttcs": """SELECT video_id, frame, max(0.9 / (1 + exp(least(40, greatest(-40, (gap - 4) / 5)))) * exp(-after / 4)) AS ttc
      FROM gaps WHERE gap <= 25 GROUP BY ALL""",
    "moved": f"""SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / greatest(0.1::DOUBLE, t - lag(t) OVER w) AS v,
      greatest(0.1::DOUBLE, t - lag(t) OVER w) AS dt, lead(t) OVER w AS until FROM obj {_w}""",
    "slowed": f"SELECT *, lag(v) OVER w AS before FROM moved {_w}",
    "brakes": "SELECT video_id, t, until, least(0.8::DOUBLE, 0.52 + ((before - v) / dt - 30) / 100) AS risk FROM slowed WHERE (before - v) / dt >= 30 AND before >= 12",
    "times": "SELECT DISTINCT video_id, frame, t FROM tracks",
    "braked": """SELECT s.video_id, s.t, max(b.risk) AS braking FROM times s JOIN brakes b ON b.video_id = s.video_id AND b.t <= s.t AND (b.until IS NULL OR s.t < b.until)
      GROUP BY ALL""",
    "broke": f"""SELECT video_id, frame, t, max(CASE WHEN {within('r.x', 'r.y', 'zones', 'junction')} THEN 0.58::DOUBLE
      WHEN {within('r.x', 'r.y', 'carriageways', 'near')} AND (vx * {ALONG[0]} + vy * {ALONG[1]}) / greatest(speed, 1e-6) < -0.6 THEN 0.55::DOUBLE END) AS rule
      FROM obj r WHERE cls <> 0 AND speed >= 3 GROUP BY ALL""",
    "ruled": "SELECT b.video_id, b.frame, b.rule FROM broke b ASOF JOIN signals s ON s.video_id = b.video_id AND s.t <= b.t WHERE s.state = 'R' AND rule IS NOT NULL",
    "scored": """SELECT video_id, frame, times.t, coalesce(greatest(ttc, rule, braking), 0) AS score
      FROM times LEFT JOIN ttcs USING (video_id, frame) LEFT JOIN ruled USING (video_id, frame) LEFT JOIN braked USING (video_id, t)""",
}
QUERIES = {
    "track_velocity_causal": (
        lambda s, d: rounded(_objects(s, d).select("video_id", "id", "frame", "radius", "vx", "vy", "speed"), 4),
        sql("SELECT video_id, id, frame, round(radius, 4) AS radius, round(vx, 4) AS vx, round(vy, 4) AS vy, round(speed, 4) AS speed FROM obj", **CTES),
    ),
    "risk_ttc": (lambda s, d: rounded(risk.collision(_objects(s, d)), 5), sql("SELECT video_id, frame, round(ttc, 5) AS ttc FROM ttcs", **CTES)),
    "risk_braking": (
        lambda s, d: rounded(risk.braking(_objects(s, d), _times(s, d)), 5),
        sql("SELECT video_id, round(t, 5) AS t, round(braking, 5) AS braking FROM braked", **CTES),
    ),
    "risk_rule": (
        lambda s, d: rounded(risk.violation(_objects(s, d), adapters.signals(s, d), SCENE), 5),
        sql("SELECT video_id, frame, round(rule, 5) AS rule FROM ruled", **CTES),
    ),
    "risk_samples": (lambda s, d: rounded(_samples(s, d), 5), sql("SELECT video_id, frame, round(t, 5) AS t, round(score, 5) AS score FROM scored", **CTES)),
    "risk_curve": (
        lambda s, d: rounded(risk.risk_curve(adapters.signals(s, d).select("video_id", "frame", "t"), _samples(s, d)), 5),
        sql("""SELECT g.video_id, g.frame, round(g.t, 5) AS t, round(coalesce(s.score * exp(-(g.t - s.t) / 1.5), 0), 5) AS score
          FROM signals g ASOF LEFT JOIN scored s ON s.video_id = g.video_id AND s.t <= g.t""", **CTES),
    ),
}
