"""Queries of the traffic rules, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.plans import rules
from trajlake.plans.catalog_features import features, rounded
from trajlake.plans.oracle import islands, merged, sql, within
from trajlake.sources import adapters
from trajlake.sources.scene import crossroads

SCENE = crossroads()
CONFIG = rules.RuleConfig()


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.tracks(spark, sf_dir).groupBy("video_id").agg((F.max("t") + 0.2).alias("duration"))


def _rule(rule: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: rounded(rule(s, d), 4)


def _out(src: str, label: str | None = None) -> str:
    named = f"'{label}' AS label" if label else "label"
    return f'SELECT video_id, round(start, 4) AS start, round("end", 4) AS "end", {named} FROM {src}'


_box = lambda a, b: (
    f"greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    f" / least(greatest(1.0::DOUBLE, ({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)), greatest(1.0::DOUBLE, ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)))"
)
_travel = lambda x, y: f"sqrt((arg_max({x}, (t, frame)) - arg_min({x}, (t, frame))) ** 2 + (arg_max({y}, (t, frame)) - arg_min({y}, (t, frame))) ** 2)"


def _stays(src: str, persons: bool) -> str:
    parts = []
    for name in SCENE.crosswalks:
        on = " OR ".join(within(f"r.{p}_x", f"r.{p}_y", "crosswalks", name, 12.0 if persons else 8.0) for p in (["foot"] if persons else ["foot", "front", "rear"]))
        parts.append(f"SELECT video_id, id, t, '{name}' AS crossing, {on} AS on_ FROM {src} r")
    return merged(islands(" UNION ALL ".join(parts), "video_id, id, crossing", "on_", 0.25), "video_id, id, crossing", 0.25, 0.15)


CTES = {
    "riders": f"SELECT DISTINCT p.video_id, p.id, p.frame FROM features p JOIN features v ON p.video_id = v.video_id AND p.frame = v.frame AND p.cls = 0 AND v.cls IN (1, 3) WHERE {_box('p', 'v')} >= 0.24",
    "walkers": "SELECT f.* FROM features f ANTI JOIN riders USING (video_id, id, frame) WHERE cls = 0",
    "congested": "SELECT video_id, round_even(t, 2) AS t, count(DISTINCT lane_id) AS lanes, count(DISTINCT id) AS vehicles FROM vehicles WHERE in_queue AND road_id = 'near' AND lane_id LIKE 'near\\_%' ESCAPE '\\' AND speed <= 8 GROUP BY 1, 2",
    "congestion": merged(islands("SELECT * FROM congested", "video_id", "lanes >= 4 AND vehicles >= 5", 0.45), "video_id", 1.0, 3.0),
    "persons": f"SELECT f.*, f.in_road AND NOT {within('f.foot_x', 'f.foot_y', 'crosswalks', None, 20.0)} AND r.id IS NULL AS jay FROM features f LEFT JOIN riders r USING (video_id, id, frame) WHERE cls = 0",
    "jay_runs": "SELECT * FROM (" + islands("SELECT * FROM persons", "video_id, id", "jay", 0.45) + ') j WHERE "end" - start >= 1.2',
    "jay_moved": f'SELECT j.video_id, j.start, j."end" FROM jay_runs j JOIN persons p ON p.video_id = j.video_id AND p.id = j.id AND p.t >= j.start - 0.2::DOUBLE AND p.t <= j."end" + 0.2::DOUBLE GROUP BY j.video_id, j.id, j.start, j."end" HAVING count(*) >= 2 AND {_travel("foot_x", "foot_y")} >= 14',
    "jaywalking": merged("SELECT * FROM jay_moved", "video_id", 1.0, 1.2),
    "ped_stays": _stays("walkers", True),
    "movers": f"SELECT video_id, id FROM vehicles GROUP BY video_id, id HAVING count(*) >= 2 AND quantile_cont(speed, 0.5) >= CASE WHEN arg_min(cls, (t, frame)) = 1 THEN 3 ELSE 12 END AND {_travel('cx', 'cy')} >= 8",
    "moving": "SELECT v.* FROM vehicles v SEMI JOIN movers USING (video_id, id)",
    "car_stays": _stays("moving", False),
    "passing": f'SELECT s.video_id, s.id, s.crossing, s.start, s."end" FROM car_stays s JOIN moving v ON v.video_id = s.video_id AND v.id = s.id AND v.t >= s.start - 0.12::DOUBLE AND v.t <= s."end" + 0.12::DOUBLE GROUP BY s.video_id, s.id, s.crossing, s.start, s."end" HAVING count(*) >= 2 AND quantile_cont(speed, 0.5) >= CASE WHEN arg_min(cls, (t, frame)) = 1 THEN 3 ELSE 12 END AND {_travel("cx", "cy")} >= 8',
    "yielding": 'SELECT * FROM passing p WHERE EXISTS (SELECT 1 FROM ped_stays q WHERE q.video_id = p.video_id AND q.crossing = p.crossing AND least(p."end", q."end") > greatest(p.start, q.start))',
    "coming": "SELECT v.*, last_t FROM vehicles v JOIN (SELECT video_id, id, max(t) AS last_t FROM vehicles GROUP BY video_id, id HAVING count(*) >= 2 AND (arg_min(coalesce(road_id, ''), (t, frame)) IN ('near', '') OR bool_or(in_queue))) k USING (video_id, id)",
    "crossed": "SELECT video_id, id, t FROM (SELECT *, lag(front_stopline_signed) OVER (PARTITION BY video_id, id ORDER BY t, frame) AS before FROM coming) c WHERE before < 12 AND front_stopline_signed >= 12",
    "past_line": "SELECT * FROM coming WHERE speed <= 4 AND front_stopline_signed BETWEEN 10 AND 48",
    "line_runs": "SELECT * FROM (" + islands("SELECT * FROM past_line", "video_id, id", "true", 0.35) + ') l WHERE "end" - start >= 0.65',
    "asked": "SELECT DISTINCT video_id, t FROM (SELECT video_id, t FROM crossed UNION ALL SELECT video_id, start AS t FROM line_runs) a",
    "looked": """SELECT a.video_id, a.t, coalesce(sum((c AND s.state = 'R')::INT), 0) AS r, coalesce(sum((c AND s.state = 'Y')::INT), 0) AS y, coalesce(sum((c AND s.state = 'G')::INT), 0) AS g, arg_min(s.state, (abs(s.t - a.t), s.t)) FILTER (WHERE abs(s.t - a.t) <= 0.22) AS nearest
      FROM asked a LEFT JOIN (SELECT *, true AS one FROM signals) s ON s.video_id = a.video_id AND s.t BETWEEN a.t - 0.23 AND a.t + 0.23, LATERAL (SELECT s.t >= a.t - 0.18::DOUBLE AND s.t <= a.t + 0.18::DOUBLE AS c) z GROUP BY a.video_id, a.t""",
    "stable": """SELECT video_id, t, CASE WHEN r + y + g = 0 THEN coalesce(nearest, '?') WHEN r + y + g = 1 OR (greatest(r, y, g) >= 2 AND (r = greatest(r, y, g))::INT + (y = greatest(r, y, g))::INT + (g = greatest(r, y, g))::INT = 1)
      THEN CASE greatest(r, y, g) WHEN r THEN 'R' WHEN y THEN 'Y' ELSE 'G' END ELSE '?' END AS state FROM looked""",
    "greens": "SELECT video_id, t FROM (SELECT *, coalesce(lead(t, 2) OVER w, lead(t, 1) OVER w) AS upto FROM signals WHERE state = 'G' WINDOW w AS (PARTITION BY video_id ORDER BY t)) x WHERE upto - t <= 0.35",
    "lasts": "SELECT DISTINCT video_id, id, last_t FROM coming",
    "stops0": """SELECT l.video_id, l.id, l.start, coalesce((SELECT min(t) FROM greens g WHERE g.video_id = l.video_id AND g.t >= l.start), least(duration, last_t + 0.1::DOUBLE)) AS "end"
      FROM line_runs l JOIN stable s ON s.video_id = l.video_id AND s.t = l.start AND s.state = 'R' JOIN lasts k ON k.video_id = l.video_id AND k.id = l.id JOIN durations d ON d.video_id = l.video_id""",
    "line_stops": """SELECT video_id, id, min(start) AS start, arg_min("end", start) AS "end" FROM stops0 s WHERE NOT EXISTS (SELECT 1 FROM coming c WHERE c.video_id = s.video_id AND c.id = s.id AND c.t >= s.start AND c.t < s."end" AND c.front_stopline_signed > 48 AND c.speed > 5) GROUP BY video_id, id""",
    "reds": """SELECT c.video_id, c.id, min(c.t) AS start FROM crossed c JOIN stable s ON s.video_id = c.video_id AND s.t = c.t AND s.state = 'R'
      WHERE EXISTS (SELECT 1 FROM coming f WHERE f.video_id = c.video_id AND f.id = c.id AND f.t >= c.t AND f.t <= c.t + 1.2::DOUBLE AND f.front_stopline_signed > 48 AND f.speed > 5) GROUP BY c.video_id, c.id""",
    "red_light": """SELECT r.video_id, r.id, r.start, greatest(r.start + 0.1::DOUBLE, least(duration, last_t + 0.1::DOUBLE)) AS "end" FROM reds r ANTI JOIN line_stops USING (video_id, id) JOIN lasts k ON k.video_id = r.video_id AND k.id = r.id JOIN durations d ON d.video_id = r.video_id""",
    "idle": "SELECT v.* FROM vehicles v JOIN (SELECT video_id, id FROM vehicles GROUP BY video_id, id HAVING avg(in_queue::INT) <= 0.15 AND avg(coalesce(road_id = 'far', false)::INT) <= 0.5) k USING (video_id, id)",
    "stopped": "SELECT s.video_id, s.start, least(duration, s.\"end\") AS \"end\" FROM (" + islands("SELECT * FROM idle", "video_id, id", "in_road AND speed <= 2.5", 0.5) + ') s JOIN durations USING (video_id) WHERE "end" - start >= 10',
    "wrong": "SELECT * FROM (" + islands(
        f"SELECT *, coalesce(lane_id IS NOT NULL AND lane_id <> 'near_curb' AND NOT in_junction AND speed > 5 AND (cos(heading_rad) * {SCENE.directions['near'][0]}::DOUBLE + sin(heading_rad) * {SCENE.directions['near'][1]}::DOUBLE) * CASE road_id WHEN 'near' THEN 1 WHEN 'far' THEN -1 END < -0.55, false) AS bad FROM vehicles",
        "video_id, id", "bad", 0.35) + ') w WHERE "end" - start >= 1.0',
    "sides": """SELECT video_id, id, t, frame, any_value(speed) AS speed, sign(arg_min(c, (d2, i))) * sqrt(min(d2)) AS d FROM (
      SELECT v.video_id, v.id, v.t, v.frame, v.speed, i, (bx - ax) * (foot_y - (ay + u * (by_ - ay))) - (by_ - ay) * (cx - (ax + u * (bx - ax))) AS c, (cx - (ax + u * (bx - ax))) ** 2 + (foot_y - (ay + u * (by_ - ay))) ** 2 AS d2
      FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx - ax) * (bx - ax) + (foot_y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS u FROM vehicles, edges WHERE grp = 'solid_lines') v) x GROUP BY video_id, id, t, frame""",
    "flips": "SELECT video_id, pt AS start, t AS \"end\" FROM (SELECT *, lag(t) OVER w AS pt, lag(d) OVER w AS pd, lag(speed) OVER w AS ps FROM sides WINDOW w AS (PARTITION BY video_id, id ORDER BY t, frame)) f WHERE pd * d < 0 AND least(abs(pd), abs(d)) <= 28 AND greatest(ps, speed) >= 5",
    "touch": f"SELECT a.video_id, round_even(a.t, 2) AS at_, {_box('a', 'b')} AS o, a.speed AS sa, b.speed AS sb FROM vehicles a JOIN vehicles b ON a.video_id = b.video_id AND a.frame = b.frame AND a.id < b.id",
    "contacts": """SELECT video_id, at_ - 0.2::DOUBLE AS start, at_ + 0.5::DOUBLE AS "end", 'accident' AS label FROM touch WHERE o >= 0.35 AND sa < 3 AND sb < 3
      UNION ALL SELECT video_id, at_ - 0.3::DOUBLE, at_ + 0.6::DOUBLE, 'near_miss' FROM touch WHERE NOT (o >= 0.35 AND sa < 3 AND sb < 3) AND o >= 0.12 AND least(sa, sb) < 4""",
    "validated": """SELECT video_id, start, "end", 'congestion' AS label FROM congestion UNION ALL SELECT video_id, start, "end", 'failure_to_yield' FROM yielding UNION ALL SELECT video_id, start, "end", 'red_light' FROM red_light""",
    "unvalidated": """SELECT * FROM validated UNION ALL SELECT video_id, start, "end", 'stopped_vehicle' FROM stopped UNION ALL SELECT video_id, start, "end", 'wrong_way' FROM wrong
      UNION ALL SELECT video_id, start, "end", 'solid_line_crossing' FROM flips UNION ALL SELECT * FROM contacts""",
}


def _generated(src: str) -> str:
    return merged(f'SELECT e.video_id, label, greatest(0.0::DOUBLE, start) AS start, least(duration, "end") AS "end" FROM {src} e JOIN durations d ON d.video_id = e.video_id', "video_id, label", 1.0, 0.5)


def rule_sql(body: str, **more: str) -> str:
    return sql(body, **CTES, **more)


_f, _s, _d = features, adapters.signals, durations
QUERIES = {
    "rider_anti_join": (lambda s, d: rules.without_riders(_f(s, d)).select("video_id", "id", "frame"), rule_sql("SELECT video_id, id, frame FROM walkers")),
    "congestion_frames": (lambda s, d: rounded(rules.congested_frames(_f(s, d))), rule_sql("SELECT video_id, round(t, 6) AS t, lanes, vehicles FROM congested")),
    "rule_congestion": (_rule(lambda s, d: rules.congestion(_f(s, d))), rule_sql(_out("congestion", "congestion"))),
    "rule_jaywalking": (_rule(lambda s, d: rules.jaywalking(_f(s, d), SCENE)), rule_sql(_out("jaywalking", "jaywalking"))),
    "crosswalk_occupancy": (_rule(lambda s, d: rules.crosswalk_occupancy(rules.without_riders(_f(s, d)), SCENE, True)), rule_sql('SELECT video_id, id, crossing, round(start, 4) AS start, round("end", 4) AS "end" FROM ped_stays')),
    "rule_failure_to_yield": (_rule(lambda s, d: rules.failure_to_yield(_f(s, d), SCENE)), rule_sql(_out("yielding", "failure_to_yield"))),
    "front_crossings": (_rule(lambda s, d: rules.front_crossings(rules.approaching(_f(s, d)))), rule_sql("SELECT video_id, id, round(t, 4) AS t FROM crossed")),
    "rule_red_light": (_rule(lambda s, d: rules.red_light(_f(s, d), _s(s, d), _d(s, d))), rule_sql(_out("red_light", "red_light"))),
    "rule_stop_line": (_rule(lambda s, d: rules.stop_line(_f(s, d), _s(s, d), _d(s, d))), rule_sql(_out("line_stops", "stop_line") + ' WHERE "end" - start >= 0.5')),
    "rule_stopped_vehicle": (_rule(lambda s, d: rules.stopped_vehicle(_f(s, d), _d(s, d))), rule_sql(_out("stopped", "stopped_vehicle"))),
    "rule_wrong_way": (_rule(lambda s, d: rules.wrong_way(_f(s, d), SCENE)), rule_sql(_out("wrong", "wrong_way"))),
    "rule_solid_line": (_rule(lambda s, d: rules.solid_line(_f(s, d), SCENE)), rule_sql(_out("flips", "solid_line_crossing"))),
    "rule_contact": (_rule(lambda s, d: rules.contact(_f(s, d))), rule_sql(_out("contacts"))),
    "generate_events": (_rule(lambda s, d: rules.generate_events(_f(s, d), _s(s, d), SCENE, _d(s, d))), rule_sql(_out("generated"), generated=_generated("validated"))),
    "generate_events_unvalidated": (
        _rule(lambda s, d: rules.generate_events(_f(s, d), _s(s, d), SCENE, _d(s, d), rules.RuleConfig(unvalidated=True))),
        rule_sql(_out("generated"), generated=_generated("unvalidated")),
    ),
}
