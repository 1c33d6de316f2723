"""Queries over scenes of several cameras, raw documents, registered functions and caches, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.functions import registered
from trajlake.operators import documents, places
from trajlake.plans import oracle
from trajlake.plans.catalog_features import rounded
from trajlake.plans.features import VEHICLES, membership, to_scene
from trajlake.plans.oracle import sql
from trajlake.sources import adapters, files, labels_json
from trajlake.sources.adapters import LABELS
from trajlake.sources.scene import Scene, crossroads
from trajlake.streaming import counts

_MARGINS = {"carriageways": 8.0, "lanes": 0.0, "crosswalks": 10.0}
_COLUMNS = {"road_id": "carriageways", "lane_id": "lanes", "crosswalk_id": "crosswalks"}


def _moved(scene: Scene, dx: float, dy: float) -> Scene:
    to = lambda shapes: {k: [(x + dx, y + dy) for x, y in pts] for k, pts in shapes.items()}
    return replace(scene, carriageways=to(scene.carriageways), lanes=to(scene.lanes), crosswalks=to(scene.crosswalks))


def _places(s: SparkSession, d: str) -> DataFrame:
    """Two cameras: the second one's shapes lie 64 to the right and 32 up, and watch the videos of odd numbers."""
    cells = places.grid(places.shapes_of(s, {0: crossroads(), 1: _moved(crossroads(), 64.0, -32.0)}, _MARGINS))
    feet = to_scene(adapters.tracks(s, d), crossroads(), adapters.SOURCE_SIZE).select("video_id", "id", "frame", (F.col("video_id") % 2).alias("camera"), "foot_x", "foot_y")
    return places.assign(feet, cells, _COLUMNS, x="foot_x", y="foot_y").drop("foot_x", "foot_y")


_place = ", ".join(f"arg_min(name, k) FILTER (WHERE grp = '{g}' AND (inside OR d2 <= {_MARGINS[g] ** 2 or -1})) AS {c}" for c, g in _COLUMNS.items())

#: Breaks of raw documents, by the number of an event; the rest is as it was, some with bad times.
_EVENT = """CASE WHEN idx % 97 = 3 THEN '[1.5,2.5]' WHEN idx % 89 = 5 THEN '[true,3.0,"red_light"]' WHEN idx % 83 = 7 THEN '["1.0",3.0,"red_light"]' WHEN idx % 79 = 9 THEN '{"start":1}'
  WHEN idx % 73 = 11 THEN concat('[', start, ',', `end`, ',5]') ELSE concat('[', start, ',', `end`, ',"', label, '"]') END"""
_CURVE = """CASE video_id % 6 WHEN 0 THEN '[[0,0.5],[1,true],[2,3]]' WHEN 1 THEN '[[0,0.5],[1,0.2],[0.5,0.1]]' WHEN 2 THEN '[[0,1.5]]' WHEN 3 THEN '{"x":1}' WHEN 4 THEN '[]' ELSE '[[0,0],[0,1.0]]' END"""


def _documents(s: SparkSession, d: str) -> DataFrame:
    """Files of sixteen videos each are written, then read whole and checked."""
    events = adapters.labels_numbered(s, d).select("video_id", "idx", F.expr(_EVENT).alias("e"))
    listed = events.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "e"))), lambda x: x["e"]), ",").alias("e"))
    entry = listed.select("video_id", F.concat(F.lit('"'), "video_id", F.lit('":{"events":['), "e", F.lit('],"risk":'), F.expr(_CURVE), F.lit("}")).alias("v"))
    texts = entry.groupBy(F.expr("video_id div 16").alias("n")).agg(F.concat(F.lit('{"videos":{'), F.array_join(F.collect_list("v"), ","), F.lit("}}")).alias("value"))
    path = files.new_folder(s, "documents")
    texts.select("value").write.option("maxRecordsPerFile", 1).text(path)
    known = adapters.video_durations(s, d).select(F.col("video_id").cast("string").alias("video"), "duration")
    return documents.document_breaks(labels_json.read_text(s, path), LABELS[:10], known).select(F.col("video").cast("long").alias("video_id"), "part", "idx", "rule")


_ten = ", ".join(f"'{x}'" for x in LABELS[:10])
_BROKEN = {
    "kinds": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) - 1 AS place, CASE WHEN idx % 97 = 3 THEN 'fields' WHEN idx % 89 = 5 OR idx % 83 = 7 THEN 'number' WHEN idx % 79 = 9 THEN 'fields' END AS broken,
      NOT (idx % 97 = 3 OR idx % 89 = 5 OR idx % 83 = 7 OR idx % 79 = 9) AS fine, idx % 73 = 11 AS odd FROM numbered""",
    "good": f"SELECT *, lag(\"end\") OVER (PARTITION BY video_id, label ORDER BY start, \"end\", place) AS before FROM kinds WHERE fine AND NOT odd AND label IN ({_ten})",
}


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    """A query as text, with the registered functions."""
    registered.register(s)
    adapters.labels_gt(s, d).createOrReplaceTempView("trajlake_true_events")
    adapters.labels_pred(s, d).createOrReplaceTempView("trajlake_found_events")
    return s.sql("""SELECT g.video_id, g.label, count(*) AS n, round(max(tiou(g.start, g.end, p.start, p.end)), 4) AS best, round(sum(span_overlap(g.start, g.end, p.start, p.end)), 3) AS shared,
        round(max(box_overlap(g.start, 0D, g.end, 2D, p.start, 1D, p.end, 3D)), 4) AS boxes, sum(CAST(line_side(p.start, p.end, g.start, g.end, g.end, g.end + 1D) AS INT)) AS sides
      FROM trajlake_true_events g JOIN trajlake_found_events p ON g.video_id = p.video_id AND g.label = p.label GROUP BY g.video_id, g.label""")


def _queues(s: SparkSession, d: str) -> DataFrame:
    """Distinct vehicles in the queue zone: sketches by second of a live feed, rolled up to four seconds."""
    rows = membership(to_scene(counts.as_stream(adapters.tracks(s, d), 6.0, swap=True), crossroads(), adapters.SOURCE_SIZE), crossroads())
    queued = rows.withColumn("member", F.when(F.col("in_queue") & F.col("cls").isin(*VEHICLES), F.col("id")))
    sketches = counts.run_to_end(counts.sketched_counts(queued.select("video_id", "member", "ts"), ["video_id"], "member"), s, "append")
    second = F.unix_seconds("start") - counts.BEGIN_SECONDS
    return counts.rolled_up(sketches, ["video_id"], (second - second % 4).cast("long"))


def _cache(s: SparkSession, d: str) -> DataFrame:
    """Half of the videos are cached, all are then added, and some are written anew with other values."""
    path, rows = files.new_folder(s, "cache"), adapters.tracks(s, d)
    files.cache_tracks(rows.filter("video_id % 2 = 0"), path)
    files.cache_tracks(rows.withColumn("conf", F.col("conf") + 1.0), path)
    files.cache_tracks(rows.filter("video_id % 5 = 0").withColumn("conf", F.col("conf") + 2.0), path, overwrite=True)
    return rounded(files.read_tracks(s, path, adapters.TRACKS).select("video_id", "id", "frame", "conf"), 4)


QUERIES = {
    "places_of_cameras": (
        _places,
        sql(f"SELECT video_id, id, frame, video_id % 2 AS camera, {_place} FROM two_cameras GROUP BY video_id, id, frame",
            cameras="SELECT 0 AS camera, * FROM edges UNION ALL SELECT 1, grp, k, name, i, ax + 64.0, ay - 32.0, bx + 64.0, by_ - 32.0 FROM edges",
            two_cameras=f"""SELECT p.video_id, p.id, p.frame, grp, k, name, sum({oracle._cross('p.foot_x', 'p.foot_y')}) % 2 = 1 AS inside, min({oracle._d2('p.foot_x', 'p.foot_y')}) AS d2
              FROM feet p JOIN cameras ON camera = p.video_id % 2 GROUP BY ALL"""),
    ),
    "validate_documents": (
        _documents,
        sql("""SELECT video_id, 'events' AS part, place AS idx, broken AS rule FROM kinds WHERE broken IS NOT NULL
          UNION ALL SELECT video_id, 'events', place, 'time' FROM kinds WHERE fine AND NOT (start >= 0 AND start < "end")
          UNION ALL SELECT video_id, 'events', place, 'label' FROM kinds WHERE fine AND (odd OR label NOT IN (""" + _ten + """))
          UNION ALL SELECT video_id, 'events', place, 'late' FROM good JOIN video_durations USING (video_id) WHERE "end" > duration + 0.5
          UNION ALL SELECT video_id, 'events', place, 'overlap' FROM good WHERE start < before
          UNION ALL SELECT DISTINCT video_id, 'risk', CASE video_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END, CASE video_id % 6 WHEN 0 THEN 'sample' WHEN 1 THEN 'back' WHEN 2 THEN 'range' ELSE 'list' END
            FROM numbered WHERE video_id % 6 < 4""", **_BROKEN),
    ),
    "udf_geometry": (
        _overlaps,
        sql("""SELECT video_id, label, count(*) AS n, round(max(x / ((ge - gs) + (pe - ps) - x)), 4) AS best, round(sum(x), 3) AS shared, round(max(x * 1.0 / least(greatest(1, (ge - gs) * 2), greatest(1, (pe - ps) * 2))), 4) AS boxes,
            sum(sign((ge - gs) * (pe - ge) - (ge + 1 - ge) * (ps - gs)))::BIGINT AS sides
          FROM (SELECT g.video_id, g.label, g.start AS gs, g."end" AS ge, p.start AS ps, p."end" AS pe, greatest(0.0::DOUBLE, least(g."end", p."end") - greatest(g.start, p.start)) AS x
            FROM labels_gt g JOIN labels_pred p ON g.video_id = p.video_id AND g.label = p.label) q GROUP BY video_id, label"""),
    ),
    "stream_queue_sketch": (_queues, sql("SELECT video_id, ((frame // 30) // 4 * 4)::BIGINT AS start, count(DISTINCT id) AS members FROM member WHERE in_queue AND cls IN (1, 2, 3, 5, 7) GROUP BY ALL")),
    "sink_tracks_overwrite": (_cache, sql("SELECT video_id, id, frame, round(conf + CASE WHEN video_id % 5 = 0 THEN 2 WHEN video_id % 2 = 0 THEN 0 ELSE 1 END, 4) AS conf FROM tracks")),
}
