"""Queries of shortlists, crossings and movements, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.operators.lookups import active_at, curve_at, nearest_rows
from trajlake.plans import leads, reviews
from trajlake.plans.catalog_features import rounded
from trajlake.plans.catalog_leads import CTES as LEADS
from trajlake.plans.catalog_signals import change_points, phase_at
from trajlake.plans.features import to_scene
from trajlake.plans.oracle import sql
from trajlake.sources import adapters
from trajlake.sources.scene import crossroads, place

SCENE = crossroads()
#: The stop line from left to right, and a line that vehicles pass on their way.
STOP, ACROSS = (place(600, 200), place(600, 0)), ((400.0, 500.0), (1200.0, 540.0))
EXITS = {"down-right": "x1 > 900 AND y1 > 560", "lower-left": "x1 < 160 AND y1 > 830"}
CORNERS = [(0.0, 0.0), (1920.0, 0.0), (1920.0, 1080.0), (0.0, 1080.0), (960.0, 700.0)]
WARP = [1.01, 0.02, -3.0, -0.01, 0.99, 5.0, 0.00001, 0.00001, 1.0]


def _rows(s: SparkSession, d: str) -> DataFrame:
    rows = to_scene(adapters.tracks(s, d), SCENE, adapters.SOURCE_SIZE)
    return rows.select("video_id", "id", "frame", "t", "cls", F.col("cx").alias("x"), F.col("foot_y").alias("y"))


def _leads(s: SparkSession, d: str) -> DataFrame:
    return leads.leads(to_scene(adapters.tracks(s, d), SCENE, adapters.SOURCE_SIZE), SCENE)


def _phases(s: SparkSession, d: str) -> DataFrame:
    signals = adapters.signals(s, d)
    return reviews.confirmed_phases(change_points(signals), signals.filter("frame % 15 = 0"))


def _crossings(s: SparkSession, d: str) -> DataFrame:
    return reviews.side_crossings(_rows(s, d), *STOP)


def _moments(s: SparkSession, d: str) -> DataFrame:
    """Every five seconds of the labelled videos."""
    return adapters.video_durations(s, d).select("video_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("k")).select("video_id", (F.col("k") * 5.0).alias("t"))


def _track_times(s: SparkSession, d: str) -> DataFrame:
    first = adapters.tracks(s, d).groupBy("video_id", "id").agg(F.min("t").alias("t0"))
    return first.select("video_id", "id", F.explode(F.array(*(F.lit(0.55 * k) for k in range(6)))).alias("after"), "t0").select("video_id", "id", (F.col("t0") + F.col("after")).alias("t"))


def _curve_times(s: SparkSession, d: str) -> DataFrame:
    videos = adapters.risk(s, d).select("video_id").distinct()
    return videos.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k")).select("video_id", (F.col("k") * F.lit(0.7)).alias("t"))


def _shifts(s: SparkSession, d: str) -> DataFrame:
    """How far a projective map moves each video's control points: the corners and one within."""
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(CORNERS))))
    points = adapters.tracks(s, d).select("video_id").distinct().select("video_id", corners.alias("p"))
    return points.select("video_id", "p.k", geo.homography_shift(F.col("p.x"), F.col("p.y"), WARP).alias("shift"))


_side = f"sign({STOP[1][0] - STOP[0][0]!r} * (y - {STOP[0][1]!r}) - {STOP[1][1] - STOP[0][1]!r} * (x - {STOP[0][0]!r}))"
_line = f"({ACROSS[0][1]!r} + (x - {ACROSS[0][0]!r}) * {(ACROSS[1][1] - ACROSS[0][1])!r} / {(ACROSS[1][0] - ACROSS[0][0])!r})"
_by = "PARTITION BY video_id, id ORDER BY t, frame"
_at = "(t, frame)"
CTES = LEADS | {
    "spots": "SELECT video_id, id, frame, t, cls, cx AS x, foot_y AS y FROM feet",
    "motor": "SELECT * FROM spots WHERE cls IN (2, 3, 5, 7)",
    "walked": f"""SELECT f.video_id, f.start, f."end", f.track, count(*) AS n, arg_min(x, {_at}) AS x0, arg_min(y, {_at}) AS y0, arg_max(x, {_at}) AS x1, arg_max(y, {_at}) AS y1
      FROM found f JOIN spots p ON p.video_id = f.video_id AND p.id = f.track AND p.t >= f.start + -0.1 AND p.t <= f."end" - -0.1
      WHERE f.kind = 'jaywalking' AND f."end" - f.start >= 2 GROUP BY ALL""",
    "far_walks": "SELECT *, floor(round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6))::BIGINT AS distance FROM walked WHERE n >= 3",
    "stood": """SELECT f.video_id, f.start, f."end", f.track, floor(round(quantile_cont(x, 0.5), 6))::BIGINT AS x, floor(round(quantile_cont(y, 0.5), 6))::BIGINT AS y
      FROM found f JOIN spots p ON p.video_id = f.video_id AND p.id = f.track AND p.t >= f.start + 0.5 AND p.t <= f."end" - 0.5
      WHERE f.kind = 'stopped_or_queue' AND f."end" - f.start >= 9 GROUP BY f.video_id, f.start, f."end", f.track""",
    "changes": "SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY video_id ORDER BY t) AS before FROM signals) x WHERE before IS DISTINCT FROM state",
    "phases": """SELECT DISTINCT c.video_id, round(s.t, 2) AS t, c.state FROM (SELECT video_id, state, CASE state WHEN 'G' THEN t - 0.3 ELSE t END AS t FROM changes WHERE state IN ('R', 'G')) c
      ASOF JOIN (SELECT * FROM signals WHERE frame % 15 = 0) s ON s.video_id = c.video_id AND s.state = c.state AND s.t >= c.t""",
    "sides": f"SELECT *, lag(side) OVER ({_by}) AS before FROM (SELECT *, {_side} AS side FROM motor) s0",
    "crossed": f"SELECT video_id, id, t FROM sides WHERE x > {STOP[0][0] - 20!r} AND x < {STOP[1][0] + 60!r} AND before < 0 AND side > 0",
    "ph": "SELECT video_id, t, (state = 'G')::INT::DOUBLE AS v FROM signals",
    "lit": """SELECT p.video_id, coalesce(CASE WHEN b.t > a.t THEN a.v + (b.v - a.v) * (p.t - a.t) / (b.t - a.t) ELSE a.v END, a.v, b.v) > 0.5 AS green
      FROM crossed p ASOF LEFT JOIN ph a ON a.video_id = p.video_id AND a.t <= p.t ASOF LEFT JOIN ph b ON b.video_id = p.video_id AND b.t >= p.t""",
    "ends": f"""SELECT video_id, id, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(x, {_at}) AS x0, arg_min(y, {_at}) AS y0, arg_min(cls, {_at}) AS cls, arg_max(x, {_at}) AS x1, arg_max(y, {_at}) AS y1
      FROM motor GROUP BY ALL""",
    "came": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t0, id) AS rank FROM ends WHERE n >= 12 AND t1 - t0 >= 2 AND x0 <= 900 AND y0 <= 650 AND y1 - y0 >= 100""",
    "nth": f"SELECT *, row_number() OVER ({_by}) - 1 AS i, count(*) OVER (PARTITION BY video_id, id) AS c FROM spots",
    "five": "SELECT * FROM nth WHERE i IN (0, c // 4, c // 2, 3 * c // 4, c - 1)",
    "ways": f"""SELECT video_id, id, string_agg('(' || round_even(x, 0)::BIGINT::VARCHAR || ',' || round_even(y, 0)::BIGINT::VARCHAR || ')', ' -> ' ORDER BY t, frame) AS path FROM five GROUP BY ALL""",
    "beyond": f"SELECT *, y - {_line} AS past FROM motor",
    "over_": f"""SELECT video_id, id, min(t) AS t, arg_min(x, {_at}) AS x, arg_min(y, {_at}) AS y FROM beyond WHERE past >= 0 AND x BETWEEN {ACROSS[0][0]!r} AND {ACROSS[1][0]!r} GROUP BY ALL""",
    "begun": f"SELECT video_id, id, arg_min(past, {_at}) AS past0 FROM beyond GROUP BY ALL",
    "ids": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS a FROM (SELECT DISTINCT video_id, id FROM tracks) t",
    "valid_": "SELECT * FROM spots WHERE x BETWEEN 0 AND 1920 AND y BETWEEN 0 AND 1080",
    "chosen": """SELECT video_id, id, count(*) AS n FROM valid_ JOIN ids USING (video_id, id) WHERE k % greatest(1, a // 32) = 0 AND k // greatest(1, a // 32) < 32
      GROUP BY ALL HAVING count(*) >= 3 ORDER BY video_id, id LIMIT 72""",
    "kept_": f"""SELECT * FROM (SELECT v.*, c.n, row_number() OVER ({_by}) - 1 AS i FROM valid_ v JOIN chosen c USING (video_id, id)) q
      WHERE n <= 24 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(24)) AS j) js WHERE round_even(j * (n - 1) / 23, 0) = i)""",
    "instants": "SELECT video_id, unnest(range(61)) * 5.0::DOUBLE AS t FROM video_durations",
    "seen_": """SELECT p.video_id, p.t, e.label, min((e.start, e."end")) AS first FROM instants p JOIN labels_gt e ON e.video_id = p.video_id AND e.start <= p.t AND p.t <= e."end" GROUP BY ALL""",
    "track_times": "SELECT video_id, id, t0 + unnest([0.0, 0.55, 0.55 * 2, 0.55 * 3, 0.55 * 4, 0.55 * 5]::DOUBLE[]) AS t FROM (SELECT video_id, id, min(t) AS t0 FROM tracks GROUP BY ALL) f",
    "curve_times": "SELECT video_id, unnest(range(41)) * 0.7::DOUBLE AS t FROM (SELECT DISTINCT video_id FROM risk) v",
    "sizes": "SELECT video_id, count(*) AS n FROM risk GROUP BY video_id",
}
_warped = "sqrt(pow((1.01 * x + 0.02 * y - 3) / (0.00001 * x + 0.00001 * y + 1) - x, 2) + pow((-0.01 * x + 0.99 * y + 5) / (0.00001 * x + 0.00001 * y + 1) - y, 2))"
QUERIES = {
    "shortlist_jaywalking": (
        lambda s, d: rounded(reviews.jaywalking_shortlist(_leads(s, d), _rows(s, d)), 2),
        sql("""SELECT video_id, round(start, 2) AS start, round("end", 2) AS "end", track, distance, floor(round(x0, 6))::BIGINT AS x0, floor(round(y0, 6))::BIGINT AS y0, floor(round(x1, 6))::BIGINT AS x1, floor(round(y1, 6))::BIGINT AS y1, rank
          FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY distance DESC, start, "end", track) AS rank FROM far_walks) r WHERE rank <= 50""", **CTES),
    ),
    "shortlist_stopped": (
        lambda s, d: rounded(reviews.stopped_shortlist(_leads(s, d), _rows(s, d), beyond=(600.0, 620.0)), 2),
        sql('SELECT video_id, round(start, 2) AS start, round("end", 2) AS "end", track, x, y FROM stood WHERE x > 600 OR y > 620', **CTES),
    ),
    "topk_displacement": (
        lambda s, d: reviews.jaywalking_shortlist(_leads(s, d), _rows(s, d)).orderBy(F.col("distance").desc(), "video_id", "start", "track").limit(50).select("video_id", "track", "distance"),
        sql('SELECT video_id, track, distance FROM far_walks ORDER BY distance DESC, video_id, start, track LIMIT 50', **CTES),
    ),
    "phase_confirm": (lambda s, d: rounded(_phases(s, d), 2), sql("SELECT video_id, t, state FROM phases", **CTES)),
    "red_crossings_by_phase": (
        lambda s, d: rounded(reviews.red_crossings(_leads(s, d), _phases(s, d)), 2),
        sql("SELECT f.video_id, round(f.start, 2) AS t, f.track FROM found f ASOF JOIN phases p ON p.video_id = f.video_id AND p.t <= f.start WHERE f.kind = 'stop_crossing' AND p.state = 'R'", **CTES),
    ),
    "prev_side_cross": (lambda s, d: rounded(_crossings(s, d), 5), sql("SELECT video_id, id, round(t, 5) AS t FROM crossed", **CTES)),
    "crossings_by_signal": (
        lambda s, d: reviews.crossings_by_phase(phase_at(_crossings(s, d), adapters.signals(s, d))),
        sql("SELECT video_id, count(*) AS n, count(*) FILTER (green) AS green, count(*) FILTER (NOT green) AS red FROM lit GROUP BY video_id", **CTES),
    ),
    "movement_od": (
        lambda s, d: rounded(reviews.movements(_rows(s, d), most_x=900.0), 4),
        sql("SELECT video_id, id, round(t0, 4) AS t0, round(t1, 4) AS t1, cls, path, rank FROM came JOIN ways USING (video_id, id) WHERE rank <= 8", **CTES),
    ),
    "exit_classification": (
        lambda s, d: rounded(reviews.exits(_rows(s, d), *ACROSS, 900.0, 540.0, EXITS), 4),
        sql("""SELECT video_id, id, round(o.t, 4) AS t, round(o.x, 4) AS x, round(o.y, 4) AS y, CASE WHEN x1 > 900 AND y1 > 560 THEN 'down-right' WHEN x1 < 160 AND y1 > 830 THEN 'lower-left' ELSE 'other' END AS exit
          FROM ends JOIN begun USING (video_id, id) JOIN over_ o USING (video_id, id) WHERE n >= 15 AND x0 <= 900 AND y0 <= 540 AND past0 <= 0""", **CTES),
    ),
    "trajectory_sample": (
        lambda s, d: reviews.sampled_tracks(_rows(s, d), SCENE.size).select("video_id", "id", "n", F.explode("path").alias("p")).select("video_id", "id", "n", "p.x", "p.y"),
        sql("SELECT video_id, id, n, round(x, 1) AS x, round(y, 1) AS y FROM kept_", **CTES),
    ),
    "linspace_rows": (
        lambda s, d: reviews.linspace_rows(_rows(s, d), 28).select("video_id", "id", "frame"),
        sql("SELECT video_id, id, frame FROM nth WHERE c <= 28 OR EXISTS (SELECT 1 FROM (SELECT unnest(range(28)) AS j) js WHERE round_even(j * (c - 1) / 27, 0) = i)", **CTES),
    ),
    "zone_filter": (
        lambda s, d: reviews.in_zone(_rows(s, d).filter("cls = 0"), (500.0, 1200.0, 300.0, 900.0), 0.1, 250.0).select("video_id", "id", "frame"),
        sql("SELECT video_id, id, frame FROM spots WHERE cls = 0 AND x > 500 AND x < 1200 AND y > 300 AND y < 900 AND y > 250 + x * 0.1", **CTES),
    ),
    "homography_shift": (
        lambda s, d: rounded(_shifts(s, d), 5),
        sql(f"SELECT video_id, k, round({_warped}, 5) AS shift FROM (SELECT DISTINCT video_id FROM tracks) v, (VALUES "
            + ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(CORNERS)) + ") c(k, x, y)"),
    ),
    "review_intervals": (
        lambda s, d: reviews.reviewed(adapters.labels_gt(s, d).filter("label <> 'failure_to_yield'"), adapters.labels_pred(s, d).filter("label = 'failure_to_yield'")),
        sql("""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start, label, "end") AS n, round_even(start, 1) AS start, round_even("end", 1) AS "end", label
          FROM (SELECT * FROM labels_gt WHERE label <> 'failure_to_yield' UNION ALL SELECT * FROM labels_pred WHERE label = 'failure_to_yield') u"""),
    ),
    "active_events_at_t": (
        lambda s, d: active_at(_moments(s, d), adapters.labels_gt(s, d)),
        sql("SELECT video_id, t, string_agg(label, ',' ORDER BY first, label) AS labels FROM seen_ GROUP BY ALL", **CTES),
    ),
    "asof_row_in_window": (
        lambda s, d: rounded(nearest_rows(_track_times(s, d), adapters.tracks(s, d).select("video_id", "id", "t", "frame"), ["video_id", "id"], 0.11, "frame"), 5),
        sql("""SELECT p.video_id, p.id, round(p.t, 5) AS t, arg_min(r.frame, (abs(r.t - p.t), r.t)) AS frame FROM track_times p
          JOIN tracks r ON r.video_id = p.video_id AND r.id = p.id AND r.t >= p.t - 0.11 AND r.t <= p.t + 0.11 GROUP BY p.video_id, p.id, p.t""", **CTES),
    ),
    "risk_at_t": (
        lambda s, d: rounded(curve_at(_curve_times(s, d), adapters.risk(s, d), 2.0), 5),
        sql("""SELECT p.video_id, round(p.t, 5) AS t, r.idx, round(r.score, 5) AS score FROM curve_times p JOIN sizes z USING (video_id)
          JOIN risk r ON r.video_id = p.video_id AND r.idx = least(z.n - 1, greatest(0, round_even(p.t * 2, 0)))""", **CTES),
    ),
    "sort_stable": (
        lambda s, d: _rows(s, d).select("video_id", "id", "frame", F.row_number().over(reviews.W.partitionBy("video_id").orderBy("t", "id", "frame")).alias("place")),
        sql("SELECT video_id, id, frame, row_number() OVER (PARTITION BY video_id ORDER BY t, id, frame) AS place FROM spots", **CTES),
    ),
}
