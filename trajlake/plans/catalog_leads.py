"""Queries of leads, and their SQL."""

from __future__ import annotations

from trajlake.plans import leads
from trajlake.plans.catalog_features import rounded
from trajlake.plans.features import to_scene
from trajlake.plans.oracle import segments, sql, within
from trajlake.sources import adapters
from trajlake.sources.scene import crossroads

SCENE = crossroads()
_leads = lambda s, d: leads.leads(to_scene(adapters.tracks(s, d), SCENE, adapters.SOURCE_SIZE), SCENE)
_by = "PARTITION BY video_id, id ORDER BY t, frame"
_k = "video_id, id, mode"


def _seg(src: str, kind: str, mask: str, gap: float, least: float, detail: str) -> str:
    return f"SELECT video_id, '{kind}' AS kind, start, \"end\", id AS track, mode AS cls, '{detail}' AS detail FROM ({segments(f'SELECT * FROM {src}', _k, mask, gap, least)}) z"


_xs = [p[0] for p in SCENE.stop_line]
CTES = {
    "modes": "SELECT video_id, id, arg_max(cls, (c, -cls)) AS mode, sum(c) AS rows_ FROM (SELECT video_id, id, cls, count(*) AS c FROM feet GROUP BY ALL) x GROUP BY video_id, id HAVING sum(c) >= 3",
    "placed": "SELECT r.*, mode, rows_, " + ", ".join([f"{within('r.cx', 'r.foot_y', 'crosswalks', k)} AS on_{k}" for k in SCENE.crosswalks] + [f"{within('r.cx', 'r.foot_y', 'carriageways', k)} AS road_{k}" for k in SCENE.carriageways]) + " FROM feet r JOIN modes USING (video_id, id)",
    "walking": "SELECT * FROM placed WHERE mode = 0",
    "driving": f"SELECT *, sqrt(dx * dx + dy * dy) / dt AS v, (dx * 0.96::DOUBLE + dy * 0.28::DOUBLE) / dt AS along FROM (SELECT *, cx - lag(cx, 10) OVER w AS dx, foot_y - lag(foot_y, 10) OVER w AS dy, t - lag(t, 10) OVER w AS dt FROM placed WHERE mode <> 0 WINDOW w AS ({_by})) q",
    "turned": f"""SELECT *, CASE WHEN count(step) OVER v = 10 THEN abs(sum(step) OVER v) END AS turn FROM (SELECT *, h - lag(h) OVER w - 2 * pi() * floor(round((h - lag(h) OVER w + pi()) / (2 * pi()), 9)) AS step FROM (
      SELECT *, atan2(dy, dx) AS h FROM driving WHERE rows_ >= 30) a WINDOW w AS ({_by})) b WINDOW v AS ({_by} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "fronts": "SELECT *, x2 * 0.5::DOUBLE AS fx, y2 * 0.5::DOUBLE AS fy FROM driving",
    "sided": """SELECT video_id, id, t, frame, mode, fx, arg_min(((bx - ax) * (fy - ay) - (by_ - ay) * (fx - ax)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), (d2, i)) AS side, sqrt(min(d2)) AS dist FROM (
      SELECT *, (fx - (ax + u * (bx - ax))) ** 2 + (fy - (ay + u * (by_ - ay))) ** 2 AS d2 FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((fx - ax) * (bx - ax) + (fy - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS u FROM fronts, edges WHERE grp = 'stop_lines') a) b GROUP BY ALL""",
    "lined": f"SELECT video_id, 'stop_crossing' AS kind, round(t, 2) AS start, round(t, 2) AS \"end\", id AS track, mode AS cls, 'near' AS detail FROM (SELECT *, lag(side) OVER ({_by}) AS before FROM sided) s WHERE before < 0 AND side >= 0 AND dist <= 80 AND fx BETWEEN {min(_xs) - 50} AND {max(_xs) + 50}",
    "found": " UNION ALL ".join(
        [_seg("walking", "crosswalk_person", f"on_{k}", 0.5, 0.3, k) for k in SCENE.crosswalks]
        + [_seg("walking", "jaywalking", "(" + " OR ".join(f"road_{k}" for k in SCENE.carriageways) + ") AND NOT (" + " OR ".join(f"on_{k}" for k in SCENE.crosswalks) + ")", 0.6, 1.0, "road outside crossing")]
        + [_seg("driving", "crosswalk_vehicle", f"on_{k}", 0.5, 0.25, k) for k in SCENE.crosswalks]
        + ["SELECT * FROM lined", _seg("driving", "stopped_or_queue", "v < 5", 0.5, 8.0, "stands"), _seg("driving", "wrong_way", "along < -12 AND road_near", 0.5, 1.0, "near"), _seg("driving", "wrong_way", "-along < -12 AND road_far", 0.5, 1.0, "far"), _seg("turned", "turn_or_swerve", "turn > 0.65", 0.6, 0.3, "turns")]
    ),
}
_cols = 'video_id, kind, start, "end", track, cls, detail'
QUERIES = {
    "leads": (lambda s, d: rounded(_leads(s, d), 2), sql(f"SELECT {_cols} FROM found", **CTES)),
    "lead_summary": (lambda s, d: leads.lead_summary(_leads(s, d)), sql("SELECT video_id, kind, count(*) AS n FROM found GROUP BY GROUPING SETS ((video_id, kind), (video_id))", **CTES)),
    "topk_duration": (lambda s, d: rounded(leads.longest(_leads(s, d)).select("video_id", "kind", "start", "end", "track", "detail", "rank"), 2), sql('SELECT video_id, kind, start, "end", track, detail, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round("end" - start, 2) DESC, start, video_id, track, detail) AS rank FROM found) x WHERE rank <= 20', **CTES)),
    "shortlist_yield": (
        lambda s, d: rounded(leads.yield_shortlist(_leads(s, d)), 2),
        sql("SELECT c.video_id, c.detail, c.track, c.start, c.\"end\", array_to_string(list_sort(list(DISTINCT p.track)), ',') AS persons FROM found c JOIN found p ON p.video_id = c.video_id AND p.detail = c.detail AND c.kind = 'crosswalk_vehicle' AND p.kind = 'crosswalk_person' AND p.start <= c.\"end\" AND p.\"end\" >= c.start GROUP BY ALL", **CTES),
    ),
    "turn_angle": (
        lambda s, d: rounded(leads.turning(to_scene(adapters.tracks(s, d), SCENE, adapters.SOURCE_SIZE)).filter("turn IS NOT NULL").select("video_id", "id", "frame", "turn"), 4),
        sql("SELECT video_id, id, frame, round(turn, 4) AS turn FROM turned WHERE turn IS NOT NULL", **(CTES | {"driving": f"SELECT *, 99 AS rows_, cx - lag(cx, 10) OVER w AS dx, foot_y - lag(foot_y, 10) OVER w AS dy FROM feet WINDOW w AS ({_by})"})),
    ),
}
