import json
import random

import pytest
from pyspark.sql import functions as F

from trajlake.functions import geometry, registered
from trajlake.operators import documents, places
from trajlake.sources import adapters, files, labels_json
from trajlake.sources.scene import crossroads
from trajlake.streaming import counts


def test_a_grid_gives_what_literal_shapes_give(spark):
    scene, r = crossroads(), random.Random(1)
    margins = {"carriageways": 8.0, "lanes": 0.0, "crosswalks": 10.0, "islands": 8.0}
    cells = places.grid(places.shapes_of(spark, {4: scene}, margins), 50.0)
    rows = [(4, i, r.uniform(-50, 1400), r.uniform(-50, 1100)) for i in range(1500)] + [(4, 2000, *scene.lanes["near_curb"][0]), (4, 2001, None, 5.0), (5, 2002, 600.0, 500.0)]
    points = spark.createDataFrame(rows, "camera long, i long, x double, y double")
    names = {"road": "carriageways", "lane": "lanes", "walk": "crosswalks", "island": "islands"}
    found = places.assign(points, cells, names, 50.0)
    literal = points.withColumns({c: geometry.first_of(F.col("x"), F.col("y"), scene.groups()[g], margins[g]) for c, g in names.items()})
    got, want = ({x.i: tuple(x[c] for c in names) for x in df.collect()} for df in (found, literal))
    assert got[2001] == got[2002] == (None,) * 4
    assert {k: v for k, v in got.items() if k < 2001} == {k: v for k, v in want.items() if k < 2001}
    assert len({v for v in got.values()}) > 8
    cells_of = cells.groupBy().agg(F.max(F.size("shapes"))).first()[0]
    assert cells_of < 12


DOCS = [
    {"videos": {
        "a": {"events": [[1, 2, "x"], [1.5, 3, "x"], [True, 2, "x"], ["1", 2, "x"], [1, 2], "no", None, [3, 2, "x"], [0, 1e2, "x"], [5, 6, "q"], [5, 6, 7]], "risk": [[0, 0.5], [0, 1], [1, 2], [0.5, 0.1]]},
        "b": {"events": [], "risk": [[0, 0.5], [1, True]]}, "c": {"events": [], "risk": [[2, 0.5], [1, 0.5]]}, "d": {"events": [], "risk": {}}, "e": {"events": []}, "f": {"events": 5}, "g": 3, "h": {"events": [], "risk": [[-2, 0.5]]},
    }},
    {"videos": []}, [1], "x",
]


def test_breaks_of_raw_documents_in_files(spark, tmp_path):
    for i, d in enumerate([*map(json.dumps, DOCS), "{broken", ""]):
        (tmp_path / f"{i}.json").write_text(d)
    known = spark.createDataFrame([("a", 50.0)], "video string, duration double")
    found = documents.document_breaks(labels_json.read_text(spark, f"file://{tmp_path}"), ("x",), known)
    assert sorted((r.video, r.part, -1 if r.idx is None else r.idx, r.rule) for r in found.collect()) == sorted([
        ("a", "events", 1, "overlap"), ("a", "events", 0, "overlap"), ("a", "events", 2, "number"), ("a", "events", 3, "number"), ("a", "events", 4, "fields"), ("a", "events", 5, "fields"), ("a", "events", 6, "fields"),
        ("a", "events", 7, "time"), ("a", "events", 8, "late"), ("a", "events", 9, "label"), ("a", "events", 10, "label"), ("a", "risk", 2, "range"),
        ("b", "risk", 1, "sample"), ("c", "risk", 1, "back"), ("d", "risk", -1, "list"), ("h", "risk", 0, "back"),
    ])


def test_registered_functions(spark):
    registered.register(spark)
    row = spark.sql("SELECT tiou(0D, 2D, 1D, 3D) AS a, tiou(1D, 1D, 1D, 1D) AS b, span_overlap(0D, 1D, 2D, 3D) AS c, box_overlap(0D, 0D, 10D, 10D, 5D, 5D, 10D, 15D) AS d, line_side(0D, 1D, 0D, 0D, 1D, 0D) AS e").first()
    assert tuple(row) == (1 / 3, 0.0, 0.0, 0.5, 1.0)


def test_a_failed_write_is_done_again(spark, tmp_path):
    rows = [(v, f, f / 30, 1, 2, 0.5, 0.0, 0.0, 1.0, 1.0) for v in (1, 2) for f in range(300)]
    tracks, path = spark.createDataFrame(rows, adapters.TRACKS), f"file://{tmp_path}/cache"
    part = tracks.filter("video_id = 2 AND frame < 100").withColumn("conf", F.lit(0.1))
    part.write.partitionBy("video_id").parquet(path)  # what a job has left that failed half-way
    files.cache_tracks(tracks.filter("video_id = 1"), path)
    failing = tracks.withColumn("conf", F.when(F.col("frame") == 299, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.9))
    with pytest.raises(Exception, match="lost"):
        files.cache_tracks(failing, path)
    assert [r.video_id for r in files.cached_videos(spark, path).collect()] == [1]
    files.cache_tracks(tracks, path)
    found = files.read_tracks(spark, path, adapters.TRACKS)
    assert found.count() == 600 and found.filter("conf <> 0.5").isEmpty()
    files.cache_tracks(tracks.filter("video_id = 1 AND frame < 7").withColumn("conf", F.lit(0.7)), path, overwrite=True)
    assert {(r.video_id, r.n, r.c) for r in files.read_tracks(spark, path, adapters.TRACKS).groupBy("video_id").agg(F.count("*").alias("n"), F.max("conf").alias("c")).collect()} == {(1, 7, 0.7), (2, 300, 0.5)}


def test_sketches_roll_up_within_their_error(spark):
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("k"), (F.col("id") % 20_000).alias("member"), (F.col("id") % 7).cast("double").alias("t"))
    stream = counts.as_stream(rows, 4.0, swap=True)
    sketches = counts.run_to_end(counts.sketched_counts(stream, ["k"], "member"), spark, "append")
    assert sketches.count() == 7
    total = counts.rolled_up(sketches, ["k"], F.lit(0)).first().members
    assert abs(total - 20_000) < 3 * 0.0163 * 20_000
