"""Building blocks of the SQL that states each query's result: common table expressions, joined by what they need."""

from __future__ import annotations

import re

from trajlake.sources.adapters import LABELS, SOURCE_SIZE
from trajlake.sources.scene import ACROSS, ALONG, ORIGIN, crossroads

_scene = crossroads()


def _edges() -> str:
    rows = []
    for g, shapes in _scene.groups().items():
        for k, (name, pts) in enumerate(shapes.items()):
            closed = g not in ("stop_lines", "solid_lines", "dashed_lines")
            ends = list(zip([pts[-1], *pts[:-1]], pts, strict=True)) if closed else list(zip(pts[:-1], pts[1:], strict=True))
            rows += [f"('{g}', {k}, '{name}', {i}, {a[0]!r}, {a[1]!r}, {b[0]!r}, {b[1]!r})" for i, (a, b) in enumerate(ends)]
    return "SELECT grp, k, name, i, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, by_::DOUBLE AS by_ FROM (VALUES " + ", ".join(rows) + ") t(grp, k, name, i, ax, ay, bx, by_)"


_sx, _sy = _scene.size[0] / SOURCE_SIZE[0], _scene.size[1] / SOURCE_SIZE[1]
_labels = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


#: Videos of which something is predicted.
_SEEN = "(o_custkey // 4) % 9 <> 4"


def _labelled(shift: str, where: str, more: str = "") -> str:
    start = f"greatest(0.0::DOUBLE, ((o_orderkey * 37) % 3000) / 10.0::DOUBLE + {shift})"
    return f"SELECT o_custkey // 4 AS video_id, {start} AS start, {start} + (1.0::DOUBLE + (o_orderkey % 40) / 10.0::DOUBLE) AS \"end\", {_labels}[(o_orderkey % 5 + o_custkey // 4) % 14 + 1] AS label{more} FROM orders {where}"


def merged(src: str, keys: str, gap: float, least: float, strict: bool = True) -> str:
    """Intervals of src less than gap apart (strict) or at most (else), joined."""
    op = ">=" if strict else ">"
    return f"""SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (
      SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN reach IS NULL OR start - reach {op} {gap}::DOUBLE THEN 1 ELSE 0 END AS new FROM (
          SELECT {keys}, start, "end", max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM ({src}) s0 WHERE "end" > start) s1) s2) s3 GROUP BY {keys}, run HAVING max("end") - min(start) >= {least}::DOUBLE"""


def islands(src: str, keys: str, mask: str, gap: float) -> str:
    """Runs of rows of src under mask: see mask_intervals."""
    k = [x.strip() for x in keys.split(",")]
    on = " AND ".join(f"h.{x} = p.{x}" for x in k)
    return f"""SELECT {keys}, min(t) AS start, max(t) + any_value(step) AS "end" FROM (
      SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN t - (lag(t) OVER (PARTITION BY {keys} ORDER BY t) + step) <= {gap}::DOUBLE THEN 0 ELSE 1 END AS new FROM (
          SELECT h.*, p.step FROM (SELECT {keys}, t FROM ({src}) h0 WHERE {mask}) h JOIN (
            SELECT {keys}, coalesce(quantile_cont(d, 0.5), 0.1::DOUBLE) AS step FROM (
              SELECT {keys}, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS d FROM (SELECT DISTINCT {keys}, t FROM ({src}) t0) t1) t2 GROUP BY {keys}) p ON {on}) i1) i2) i3 GROUP BY {keys}, run"""


def segments(src: str, keys: str, mask: str, gap: float, least: float) -> str:
    """Runs of rows of src under mask from the first to the last: see hit_segments."""
    return f"""SELECT {keys}, round(min(t), 2) AS start, round(max(t), 2) AS "end" FROM (
      SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT {keys}, t, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) <= {gap}::DOUBLE THEN 0 ELSE 1 END AS new FROM ({src}) g0 WHERE {mask}) g1) g2
      GROUP BY {keys}, run HAVING max(t) - min(t) >= {least}::DOUBLE"""


def within(x: str, y: str, group: str, name: str | None = None, margin: float = 0.0) -> str:
    """Whether a point lies in any shape of a group, or in the one named."""
    which = f"grp = '{group}'" + (f" AND name = '{name}'" if name else "")
    near = f" OR min({_d2(x, y)}) <= {margin * margin}" if margin > 0 else ""
    return f"(SELECT coalesce(bool_or(ok), false) FROM (SELECT sum({_cross(x, y)}) % 2 = 1{near} AS ok FROM edges WHERE {which} GROUP BY name) q)"


def _cross(x: str, y: str) -> str:
    return f"CASE WHEN (ay > {y}) <> (by_ > {y}) AND {x} < (bx - ax) * ({y} - ay) / (by_ - ay + 1e-12::DOUBLE) + ax THEN 1 ELSE 0 END"


def _u(x: str, y: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - ax) * (bx - ax) + ({y} - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))))"


def _d2(x: str, y: str) -> str:
    qx, qy = f"(ax + {_u(x, y)} * (bx - ax))", f"(ay + {_u(x, y)} * (by_ - ay))"
    return f"(({x} - {qx}) * ({x} - {qx}) + ({y} - {qy}) * ({y} - {qy}))"


def membership(points: str, x: str, y: str) -> str:
    """A row for each row of points and each shape: whether it lies within (0 margin) and its square distance to the outline."""
    return f"SELECT p.video_id, p.id, p.frame, grp, k, name, sum({_cross(x, y)}) % 2 = 1 AS inside, min({_d2(x, y)}) AS d2 FROM {points} p, edges GROUP BY ALL"


def along(points: str, x: str, y: str) -> str:
    """How far each row's point lies beyond the stop line."""
    qx, qy = f"(ax + {_u(x, y)} * (bx - ax))", f"(ay + {_u(x, y)} * (by_ - ay))"
    norm = (ALONG[0] ** 2 + ALONG[1] ** 2) ** 0.5
    v = f"({x} - {qx}) * {ALONG[0] / norm!r} + ({y} - {qy}) * {ALONG[1] / norm!r}"
    return f"SELECT p.video_id, p.id, p.frame, arg_min({v}, ({_d2(x, y)}, i)) AS v FROM {points} p, edges WHERE grp = 'stop_lines' GROUP BY ALL"


_far = sorted((-ALONG[0]) * y - (-ALONG[1]) * x for pts in _scene.dashed_lines.values() for x, y in [pts[1]])

CTES: dict[str, str] = {
    "ev": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CASE WHEN user_id % 8 = 4 AND user_id % 3 = 1 THEN user_id + 1 ELSE user_id END AS as_id, [2, 2, 0, 7, 0, 3, 5, 1][user_id % 8 + 1] AS cls FROM events",
    "uw": """SELECT *, as_id % 15 AS k, cls = 0 AND as_id = user_id AS walks FROM ev""",
    "place": """SELECT *, CASE WHEN walks AND user_id % 8 = 4 THEN 670.0::DOUBLE WHEN walks THEN 450.0::DOUBLE + n * 0.5::DOUBLE
      WHEN k < 9 THEN 330.0::DOUBLE + 70.0::DOUBLE * (CASE WHEN k = 8 THEN 0 ELSE k // 5 END) + 5.0::DOUBLE * least(n, 15) + 6.0::DOUBLE * greatest(n - 55, 0) + (event_id % 7) * 0.1::DOUBLE
      WHEN k = 10 THEN 540.0::DOUBLE + 6.0::DOUBLE * least(n, 10) + 8.0::DOUBLE * greatest(n - 45, 0) + (event_id % 7) * 0.1::DOUBLE
      WHEN k = 12 THEN 800.0::DOUBLE + 4.0::DOUBLE * least(n, 3) + (event_id % 7) * 0.05::DOUBLE WHEN k = 13 THEN 580.0::DOUBLE - 6.0::DOUBLE * n
      WHEN k = 14 THEN 470.0::DOUBLE + 3.0::DOUBLE * n ELSE 480.0::DOUBLE + 8.0::DOUBLE * n + (event_id % 7) * 0.1::DOUBLE END AS u,
      CASE WHEN walks THEN -30.0::DOUBLE + 4.0::DOUBLE * n WHEN k = 11 THEN -20.0::DOUBLE - 40.0::DOUBLE * (as_id % 4) WHEN k = 14 THEN 121.0::DOUBLE + 2.0::DOUBLE * n
      WHEN k = 8 THEN 140.0::DOUBLE ELSE 20.0::DOUBLE + 40.0::DOUBLE * (as_id % 5) END AS w,
      CASE cls WHEN 0 THEN 24.0::DOUBLE WHEN 5 THEN 150.0::DOUBLE WHEN 7 THEN 110.0::DOUBLE WHEN 2 THEN 84.0::DOUBLE ELSE 44.0::DOUBLE END AS bw,
      CASE cls WHEN 0 THEN 60.0::DOUBLE WHEN 5 THEN 96.0::DOUBLE WHEN 7 THEN 80.0::DOUBLE WHEN 2 THEN 56.0::DOUBLE ELSE 50.0::DOUBLE END AS bh FROM uw""",
    "tracks": f"""SELECT user_id // 15 AS video_id, 6 * n + 18 * (user_id % 7) AS frame, (6 * n + 18 * (user_id % 7)) / 30.0::DOUBLE AS t, user_id AS id, cls, 0.2::DOUBLE + (event_id % 80) / 100.0::DOUBLE AS conf,
      fx - bw / 2 AS x1, fy - bh AS y1, fx + bw / 2 AS x2, fy AS y2 FROM (SELECT *, 2.0::DOUBLE * ({ORIGIN[0]}::DOUBLE + {ALONG[0]}::DOUBLE * u + {ACROSS[0]}::DOUBLE * w) AS fx, 2.0::DOUBLE * ({ORIGIN[1]}::DOUBLE + {ALONG[1]}::DOUBLE * u + {ACROSS[1]}::DOUBLE * w) AS fy FROM place) p""",
    "signals": """SELECT video_id, frame, frame / 30.0::DOUBLE AS t, state, CASE WHEN state = 'R' THEN 30 ELSE frame % 4 END AS red, CASE WHEN state = 'Y' THEN 30 ELSE frame % 4 END AS amber, CASE WHEN state = 'G' THEN 30 ELSE frame % 4 END AS green FROM (
      SELECT *, CASE WHEN frame % 31 = 0 THEN '?' WHEN frame % 300 < 150 THEN 'R' WHEN frame % 300 < 180 THEN 'Y' ELSE 'G' END AS state FROM (SELECT video_id, unnest(range(0, max(frame) + 1, 3)) AS frame FROM tracks GROUP BY video_id) f) g""",
    "labels_raw": _labelled("0.0::DOUBLE", ""),
    "labels_gt": merged("SELECT * FROM labels_raw", "video_id, label", 0.0, 0.0),
    "pred_raw": _labelled("(o_orderkey % 9 - 4) / 10.0::DOUBLE", f"WHERE o_orderkey % 11 <> 0 AND {_SEEN}")
    + " UNION ALL " + _labelled("50.0::DOUBLE", f"WHERE o_orderkey % 13 = 0 AND {_SEEN}")
    + f" UNION ALL SELECT video_id + 100000 AS video_id, start, \"end\", label FROM ({_labelled('0.0::DOUBLE', f'WHERE o_orderkey % 29 = 0 AND {_SEEN}')}) foreign_",
    "labels_pred": merged("SELECT * FROM pred_raw", "video_id, label", 0.0, 0.0),
    "risk": "SELECT user_id AS video_id, idx, idx * 0.5::DOUBLE AS t, least(1.0::DOUBLE, value / 100.0::DOUBLE) AS score FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) e",
    "hits": """SELECT video_id, 8.0::DOUBLE + video_id % 20 + late AS start, 10.0::DOUBLE + video_id % 20 + late AS "end", k
      FROM (SELECT DISTINCT user_id AS video_id FROM events) v JOIN (VALUES (1, 0.0::DOUBLE), (2, 5.0::DOUBLE)) two(k, late) ON k = 1 OR video_id % 2 = 0""",
    "misses": "SELECT video_id, 3.0::DOUBLE + video_id % 5 AS start, 4.5::DOUBLE + video_id % 5 AS \"end\" FROM (SELECT DISTINCT user_id AS video_id FROM events) v WHERE video_id % 3 = 0",
    "numbered": f"""SELECT video_id, CASE WHEN idx % 31 = 0 THEN -0.5::DOUBLE ELSE start END AS start,
      CASE WHEN idx % 23 = 0 THEN start - 1.0::DOUBLE ELSE "end" END AS "end", label, idx FROM ({_labelled("0.0::DOUBLE", "", ", o_orderkey AS idx")}) n_""",
    "video_durations": "SELECT DISTINCT video_id, 240.0::DOUBLE + video_id % 61 AS duration FROM labels_raw",
    "risk_raw": """SELECT video_id, idx, CASE WHEN video_id % 4 = 1 AND idx = 20 + video_id % 7 THEN t - 2.0 ELSE t END AS t,
      CASE WHEN video_id % 3 = 0 AND idx % 37 = 36 THEN score + 1.0 ELSE score END AS score FROM risk""",
    "pixels": "SELECT (l_orderkey // 4) % 3 AS video_id, l_orderkey // 12 AS frame, (l_orderkey % 4) * 8 + l_linenumber - 1 AS row, l_partkey % 180 AS h, (l_suppkey * 13 + l_linenumber * 37) % 256 AS s, (l_quantity * 5)::INT AS v FROM lineitem",
    "edges": _edges(),
    "feet": f"SELECT *, (x1 + x2) * 0.5::DOUBLE * {_sx!r}::DOUBLE AS cx, (y1 + y2) * 0.5::DOUBLE * {_sy!r}::DOUBLE AS cy, (x1 + x2) * 0.5::DOUBLE * {_sx!r}::DOUBLE AS foot_x, y2 * {_sy!r}::DOUBLE AS foot_y FROM tracks",
    "mem": membership("feet", "p.foot_x", "p.foot_y"),
    "member": f"""SELECT f.*, m.* EXCLUDE (video_id, id, frame), coalesce(m.lane, CASE WHEN m.on_far THEN 'far_through_' || (1 + (lat > {_far[0]!r})::INT + (lat > {_far[1]!r})::INT + (lat > {_far[2]!r})::INT)::VARCHAR END) AS lane_id
      FROM (SELECT *, {-ALONG[0]}::DOUBLE * foot_y - {-ALONG[1]}::DOUBLE * foot_x AS lat FROM feet) f JOIN (SELECT video_id, id, frame,
      arg_min(name, k) FILTER (WHERE grp = 'carriageways' AND (inside OR d2 <= 64)) AS road_id, arg_min(name, k) FILTER (WHERE grp = 'lanes' AND inside) AS lane, arg_min(name, k) FILTER (WHERE grp = 'crosswalks' AND (inside OR d2 <= 100)) AS crosswalk_id,
      coalesce(bool_or(inside OR d2 <= 144) FILTER (WHERE grp = 'zones' AND name = 'queue'), false) AS in_queue, coalesce(bool_or(inside OR d2 <= 64) FILTER (WHERE grp = 'zones' AND name = 'junction'), false) AS in_junction,
      coalesce(bool_or(inside OR d2 <= 64) FILTER (WHERE grp = 'islands'), false) AS on_island, coalesce(bool_or(inside OR d2 <= 64) FILTER (WHERE grp = 'carriageways' AND name = 'far'), false) AS on_far
      FROM mem GROUP BY video_id, id, frame) m USING (video_id, id, frame)""",
    "bodies": f"""SELECT *, foot_x + dx AS front_x, foot_y + dy AS front_y, foot_x - dx AS rear_x, foot_y - dy AS rear_y FROM (
      SELECT *, road_id IS NOT NULL AND NOT on_island AS in_road, CASE WHEN cls <> 0 THEN sgn * {ALONG[0]}::DOUBLE * ext ELSE 0 END AS dx, CASE WHEN cls <> 0 THEN sgn * {ALONG[1]}::DOUBLE * ext ELSE 0 END AS dy FROM (
      SELECT *, CASE WHEN coalesce(lane_id LIKE 'far\\_%' ESCAPE '\\', false) OR coalesce(road_id = 'far', false) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sgn, 0.5::DOUBLE * ({ALONG[0]}::DOUBLE * (x2 - x1) * {_sx!r}::DOUBLE + {ALONG[1]}::DOUBLE * (y2 - y1) * {_sy!r}::DOUBLE) AS ext FROM member) a) b""",
    "foot_line": along("bodies", "p.foot_x", "p.foot_y"),
    "front_line": along("bodies", "p.front_x", "p.front_y"),
    "moves": """SELECT *, sqrt(dx_ * dx_ + dy_ * dy_) / greatest(1e-3::DOUBLE, CASE WHEN rows_ = 1 THEN 0.1::DOUBLE ELSE dt_ END) AS raw_speed, atan2(dy_, dx_) AS heading_rad FROM (
      SELECT *, count(*) OVER (PARTITION BY video_id, id) AS rows_, coalesce(lead(cx) OVER w, cx) - coalesce(lag(cx) OVER w, cx) AS dx_, coalesce(lead(cy) OVER w, cy) - coalesce(lag(cy) OVER w, cy) AS dy_, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS dt_
      FROM bodies WINDOW w AS (PARTITION BY video_id, id ORDER BY t, frame)) m""",
    "features": """SELECT m.*, quantile_cont(raw_speed, 0.5) OVER (PARTITION BY m.video_id, m.id ORDER BY t, m.frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS speed, a.v AS stopline_signed, b.v AS front_stopline_signed
      FROM moves m JOIN foot_line a USING (video_id, id, frame) JOIN front_line b USING (video_id, id, frame)""",
    "durations": "SELECT video_id, max(t) + 0.2::DOUBLE AS duration FROM tracks GROUP BY video_id",
    "vehicles": "SELECT * FROM features WHERE cls IN (1, 2, 3, 5, 7)",
}


def sql(body: str, **more: str) -> str:
    """The body with all common table expressions that it names, directly or not, before it; more adds or replaces some."""
    known = CTES | more
    order: list[str] = []
    begun: set[str] = set()  # an expression may name itself

    def need(text: str) -> None:
        for name in known:
            if name not in begun and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b(?!\()", text):
                begun.add(name)
                need(known[name])
                order.append(name)

    need(body)
    return ("WITH RECURSIVE " + ",\n".join(f"{name} AS ({known[name]})" for name in order) + "\n" if order else "") + body
