import json
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from trajlake.functions import intervals
from trajlake.operators import checks, lookups, matching, risk
from trajlake.operators.asof import forward
from trajlake.operators.lamps import lamp_counts
from trajlake.plans import reviews
from trajlake.plans.features import extract_features, motion
from trajlake.sources import adapters, files, labels_json
from trajlake.sources.scene import crossroads
from trajlake.streaming import counts, state
from trajlake.streaming.ordered import PROVIDER

EVENT = "video_id long, start double, end double, label string"


def test_track_cache_keeps_what_it_has(spark, tmp_path):
    rows = [(v, f, f / 30, 1, 2, 0.5, 0.0, 0.0, 1.0, 1.0) for v in (1, 2) for f in range(3)]
    tracks = spark.createDataFrame(rows, adapters.TRACKS)
    path = f"file://{tmp_path}/cache"
    assert files.cached_videos(spark, path).count() == 0
    files.cache_tracks(tracks.filter("video_id = 1"), path)
    files.cache_tracks(tracks.withColumn("conf", F.lit(0.9)), path)
    found = {(r.video_id, r.frame): r.conf for r in files.read_tracks(spark, path, adapters.TRACKS).collect()}
    assert found == {(v, f): 0.5 if v == 1 else 0.9 for v in (1, 2) for f in range(3)}


def test_list_videos(spark, tmp_path):
    for name in ("b.MP4", "A.mp4", "c.txt", "c.Mp4"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in files.list_videos(spark, f"file://{tmp_path}").collect()] == ["A.mp4", "b.MP4", "c.Mp4"]


def test_prediction_documents_are_json(spark):
    events = spark.createDataFrame([(1, 2.0, 3.5, "jay\"walking"), (1, 0.5, 1.0, "red_light")], EVENT)
    curve = spark.createDataFrame([(1, 1, 0.5, 0.25), (1, 0, 0.0, 0.0), (2, 0, 0.0, 1.0)], "video_id long, idx long, t double, score double")
    logs = spark.createDataFrame([(2, 10.0, 4.0)], "video_id long, duration double, total_sec double")
    docs = labels_json.predictions_to_json(events, curve, logs, "a \"team\"")
    one, two = (json.loads(r.value) for r in docs.orderBy("video").collect())
    assert one == {"team": 'a "team"', "videos": {"1": {"events": [[0.5, 1.0, "red_light"], [2.0, 3.5, 'jay"walking']], "risk": [[0.0, 0.0], [0.5, 0.25]]}}}
    assert two == {"team": 'a "team"', "videos": {"2": {"events": [], "risk": [[0.0, 1.0]]}}, "log": {"2": {"duration": 10.0, "total_sec": 4.0}}}
    found, risk_, log = labels_json.predictions_from_text(docs.select("value"))
    assert {(r.video, r.start, r.label) for r in found.filter("label IS NOT NULL").collect()} == {("1", 0.5, "red_light"), ("1", 2.0, 'jay"walking')}
    assert risk_.count() == 3 and [(r.video, r.total_sec) for r in log.collect()] == [("2", 4.0)]


def test_structure_of_documents(spark):
    docs = ['{"videos": []}', '[1]', '{"team": "x", "videos": {"a/b": {"events": 1}, "c": {"events": [], "risk": [[0, 1]]}}}', '{"videos": {"d": {"events": []}}}']
    found = checks.structure_breaks(labels_json.structure(spark.createDataFrame([(x,) for x in docs], "value string")), spark.createDataFrame([("c",), ("e",)], "video string"))
    got = sorted((r.video or "", r.level, r.rule) for r in found.collect())
    assert got == sorted([("", "error", "shape"), ("", "error", "shape"), ("a/b", "error", "path"), ("a/b", "error", "events"), ("d", "warning", "risk"), ("", "warning", "team"), ("e", "error", "missing"), ("a/b", "warning", "extra"), ("d", "warning", "extra")])


def test_near_duplicates_as_a_loop(spark):
    r = random.Random(3)
    known = [(v, r.randrange(40) / 20, r.randrange(60, 90) / 20, "x") for v in range(5) for _ in range(6)]
    new = [(r.randrange(5), r.randrange(400) / 200, r.randrange(600, 900) / 200, "x", i) for i in range(300)]
    kept = []
    for v, s, e, label, i in new:
        if not any(a == v and abs(b - s) < 0.05 and abs(c - e) < 0.05 for a, b, c, *_ in [*known, *kept]):
            kept.append((v, s, e, label, i))
    found = lookups.not_near_duplicates(spark.createDataFrame(new, EVENT + ", idx long"), spark.createDataFrame(known, EVENT))
    assert {x.idx for x in found.collect()} == {k[4] for k in kept} and len(kept) < len(new)


def test_clean_events_keeps_the_input_order_of_ties(spark):
    rows = [(1, 1.0, 5.0, "a", 0), (1, 1.0, 2.0, "a", 1), (1, 3.0, 4.0, "a", 2), (1, 5.0, 99.0, "a", 3), (1, 5.0, 6.0, "zz", 4)]
    found = matching.clean_events(spark.createDataFrame(rows, EVENT + ", idx long"), ("a",), 10.0)
    assert sorted((r.start, r.end) for r in found.collect()) == [(1.0, 5.0), (5.0, 10.0)]


def test_videos_outside_the_truth_count_nothing(spark):
    truth = spark.createDataFrame([(1, 0.0, 2.0, "a")], EVENT)
    assert matching.score_a(matching.match_segments(truth, truth.unionByName(truth.withColumn("video_id", F.lit(9).cast("long"))))).first().score_a == 1.0
    more = truth.unionByName(spark.createDataFrame([(9, 0.0, 2.0, "b")], EVENT))
    assert matching.score_a(matching.match_segments(truth, more)).first().score_a == 0.5


def test_lamps_are_counted_by_video(spark):
    rows = [(v, 0, i, 0, 200, 200) for v in (1, 2) for i in range(v)]
    found = lamp_counts(spark.createDataFrame(rows, "video_id long, frame long, row int, h int, s int, v int"))
    assert {r.video_id: r.r for r in found.collect()} == {1: 1, 2: 2}


def test_motion_that_is_no_number_counts_as_none(spark):
    rows = [(1, 1, f, f / 10, float("nan") if f == 2 else float(f), 0.0) for f in range(5)]
    found = motion(spark.createDataFrame(rows, "video_id long, id long, frame long, t double, cx double, cy double")).collect()
    assert all(math.isfinite(r.speed) and math.isfinite(r.heading_rad) for r in found)


def test_forward_takes_the_next_tick(spark):
    points = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 1.5, 9.0)], "video_id long, t double")
    ticks = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (2, 9.5, "c")], "video_id long, t double, v string")
    assert {r.t: r.v for r in forward(points, ticks, "v").collect()} == {0.0: "a", 1.0: "a", 1.5: "b", 9.0: None}


def test_braking_of_a_vanished_track_goes_on(spark):
    moves = [(1, 1, 0, 0.0, 0.0), (1, 1, 1, 1.0, 50.0), (1, 1, 2, 2.0, 55.0), (1, 2, 3, 3.0, 0.0), (1, 2, 4, 9.0, 0.0)]
    objects = spark.createDataFrame([(*m, 0.0) for m in moves], "video_id long, id long, frame long, t double, x double, y double")
    found = risk.braking(objects, objects.select("video_id", "t").distinct())
    assert {r.t: round(r.braking, 6) for r in found.collect()} == {2.0: 0.67, 3.0: 0.67, 9.0: 0.67}


def test_sampled_tracks_are_bounded(spark):
    rows = [(v, i, f, f / 10, 2, float(f), float(i)) for v in range(4) for i in range(70) for f in range(30)]
    found = reviews.sampled_tracks(spark.createDataFrame(rows, "video_id long, id long, frame long, t double, cls int, x double, y double"), crossroads().size).collect()
    assert len(found) == 72 and all(len(r.path) == 24 and r.path[0].x == 0 and r.path[-1].x == 29 for r in found)


def _feed(spark, tmp_path, schema, *batches, t="t"):
    """A stream of files that come one after another, the last one without values but far later."""
    path = f"file://{tmp_path}/feed-{len(list(tmp_path.iterdir()))}"
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", counts.at_time(t)).coalesce(1).write.mode("append").parquet(path)
    beat = spark.createDataFrame([(50_000.0,)], "x double").withColumn("ts", counts.at_time("x")).drop("x")
    spark.createDataFrame([], schema).withColumn("ts", F.lit(None).cast("timestamp")).unionByName(beat, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def test_changes_of_a_stream_that_comes_in_any_order(spark, tmp_path):
    one, two, three = [(1, 1.0, "R"), (1, 2.0, "R"), (2, 1.0, "G")], [(1, 1.5, "G"), (1, 30.0, "R"), (1, 40.0, "G")], [(1, 35.0, "Y"), (1, 3.0, "Y")]
    feed = _feed(spark, tmp_path, "video_id long, t double, state string", one, two, [(1, 41.0, None)], three)
    found = counts.run_to_end(state.change_points(feed), spark, "append")
    assert sorted((r.video_id, r.t, r.state or "") for r in found.collect()) == [(1, 1.0, "R"), (1, 1.5, "G"), (1, 2.0, "R"), (1, 35.0, "Y"), (1, 40.0, "G"), (1, 41.0, ""), (2, 1.0, "G")]


def test_alarms_of_a_stream(spark, tmp_path):
    scores = [0.9, 0.9, 0.1, 0.9, 0.1, 0.1, 0.1, 0.1, 0.6, 0.7]
    rows = [(1, i * 0.5, x) for i, x in enumerate(scores)]
    feed = _feed(spark, tmp_path, "video_id long, t double, score double", rows[2:5], rows[:2] + rows[5:])
    assert sorted(r.t for r in counts.run_to_end(state.alarms(feed), spark, "append").collect()) == [0.0, 4.0]


def test_sessions_keep_just_the_gap_apart(spark, tmp_path):
    r = random.Random(11)
    rows = [(r.randrange(3), s / 4, s / 4 + r.randrange(5) / 4) for s in (r.randrange(240) for _ in range(60))]
    rows = sorted(rows, key=lambda x: x[1] + r.random() * 4)
    schema = "video_id long, start double, end double"
    feed = _feed(spark, tmp_path, schema, rows[:20], rows[20:40], rows[40:], t="start")
    found = counts.run_to_end(state.sessions_of(feed, ["video_id"], 0.5), spark, "append")
    want = intervals.merge_intervals(spark.createDataFrame(rows, schema), ["video_id"], 0.5, 0.0)
    assert sorted((x.video_id, x.start, x.end) for x in found.collect()) == sorted((x.video_id, x.start, x.end) for x in want.collect())
    assert found.agg(F.sum("n")).first()[0] == sum(e > s for _, s, e in rows)


def _moves(n=4, frames=40):
    """Tracks of two videos that stop, vanish and come back, some with a row or two."""
    r, rows = random.Random(5), []
    for v in (1, 2):
        for k in range(n):
            x, speed = r.randrange(900, 2500), r.randrange(20, 120)
            for f in range(k, 1 if k == 0 and v == 1 else frames, r.choice([2, 2, 3])):
                speed = 0 if r.random() < 0.1 else r.randrange(200) if r.random() < 0.2 else speed
                x += speed
                if r.random() < 0.85:
                    rows.append((v, f * 3, f / 10, k, [2, 0, 3, 7][k % 4], 0.9, float(x), 900.0 + 40 * k, x + 90.0, 990.0 + 40 * k))
    return rows


def _scattered(rows, stretch, seed):
    """The rows in batches, many of them out of order, none more than two stretches."""
    r = random.Random(seed)
    by = sorted(rows, key=lambda x: x[2] + r.random() * 1.5 * stretch)
    return [by[k::1][: len(by) // 4] if k + len(by) // 4 < len(by) else by[k:] for k in range(0, len(by), len(by) // 4)]


def test_features_of_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = _moves()
    feed = _feed(spark, tmp_path, adapters.TRACKS, *_scattered(rows, 1.0, 1))
    found = counts.run_to_end(state.stream_features(feed, crossroads(), adapters.SOURCE_SIZE), spark, "append")
    want = extract_features(spark.createDataFrame(rows, adapters.TRACKS), crossroads(), adapters.SOURCE_SIZE)
    names = sorted(want.columns)
    assert sorted(found.columns) == names
    near = lambda df: sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select("video_id", "id", "frame", *names).collect()), key=lambda r: r[:3])
    assert near(found) == near(want)


def test_risk_of_a_stream_is_that_of_the_table(spark, tmp_path):
    rows, lamps = _moves(), [(v, f, f / 30, "GRRR?"[f // 24 % 5], 0, 0, 0) for v in (1, 2, 3) for f in range(0, 120, 2)]
    tracks, signals = spark.createDataFrame(rows, adapters.TRACKS), spark.createDataFrame(lamps, adapters.SIGNALS)
    scores = risk.sample_scores(tracks, signals, crossroads(), adapters.SOURCE_SIZE)
    want = {(r.video_id, r.frame): r.score for r in risk.risk_curve(signals.select("video_id", "frame", "t"), scores).collect()}
    live = state.stream_risk(
        _feed(spark, tmp_path, adapters.TRACKS, *_scattered(rows, 1.0, 2)), _feed(spark, tmp_path, adapters.SIGNALS, *_scattered(lamps, 1.0, 3)), crossroads(), adapters.SOURCE_SIZE
    )
    found = {(r.video_id, r.frame): r.score for r in counts.run_to_end(live, spark, "append").collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert len({round(x, 6) for x in want.values()}) > 10 and {r.braking for r in risk.braking(risk.causal_motion(tracks, crossroads(), adapters.SOURCE_SIZE), signals.select("video_id", "t")).collect()}


def test_windows_are_told_once_and_late_rows_dropped(spark, tmp_path):
    day = 86_400.0
    schema = "event_id long, t double, user_id long, event_type string, value double"
    row = lambda k, t: (k, t, 1, "x", 1.0)
    feed = _feed(spark, tmp_path, schema, [row(1, 0.0), row(2, 5 * day)], [row(3, 9 * day)], [row(4, 10.0), row(5, 20 * day)])
    found = counts.run_to_end(counts.tumbling_counts(feed), spark, "append")
    assert sorted((r.start.day, r.n) for r in found.collect()) == [(1, 1), (6, 1), (10, 1)]


def test_truth_files_are_written_by_many_tasks(spark, tmp_path):
    """Small files are dealt to as many tasks as a shuffle has, not put into one by their few bytes."""
    rows = spark.createDataFrame([(v, 0.0, 1.0, "a") for v in range(40)], "video_id long, start double, end double, label string")
    labels_json.write_truth(rows, str(tmp_path / "truth"), F.col("video_id"))
    names = [p.name for p in (tmp_path / "truth").glob("file_no=*/part-*.txt")]
    assert len(names) == 40
    assert len({n.split("-")[1] for n in names}) > 1


def test_state_of_features_is_by_video(spark, tmp_path):
    """Rows that wait are a value by video and batch, not by track; tracks end one by one, and nulls come back."""
    rows = [(1, 3 * f, f / 10, k, 2, None if k == 3 else 0.9, None if (k, f) == (2, 4) else 900.0 + 9 * f * k, 900.0, 990.0 + 9 * f * k, 990.0) for k in range(12) for f in range(6 if k == 5 else 40)]
    later = [(1, 3000 + 3 * f, 100 + f / 10, k, 2, 0.9, 900.0 + f, 900.0, 990.0 + f, 990.0) for k in (5, 6) for f in range(3)]
    others = [[(2, 30 * t, float(t), 1, 2, 0.9, 900.0, 900.0, 990.0, 990.0)] for t in (60, 61)]
    feed = _feed(spark, tmp_path, adapters.TRACKS, rows[::2], rows[1::2], *others, later)
    stream, seen = state.stream_features(feed, crossroads(), adapters.SOURCE_SIZE, silence=30_000), []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    done = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(b.collect())).start()
    done.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress) <= 4
    apart = [(1, f, t, k + (50 if t >= 100 else 0), *x) for _, f, t, k, *x in rows + later]
    want = extract_features(spark.createDataFrame(apart, adapters.TRACKS), crossroads(), adapters.SOURCE_SIZE).withColumn("id", F.col("id") % 50)
    names = sorted(want.columns)
    near = lambda found: sorted((tuple(round(r[c], 7) if isinstance(r[c], float) else r[c] for c in ("id", "frame", *names)) for r in found if r.video_id == 1), key=lambda r: r[:2])
    assert near(seen) == near(want.collect())


def test_files_of_a_feed_grow_with_its_stretches(spark):
    """Stretches of many rows are dealt to several files, all of them in one batch."""
    rows = spark.range(50_000).select((F.col("id") % 20 / 10.0).alias("t"), "id")
    feed, batches = counts.as_stream(rows, 1.0), []
    done = feed.writeStream.trigger(availableNow=True).foreachBatch(lambda b, _: batches.append((b.count(), len(b.filter("id IS NOT NULL").select(F.floor("t")).distinct().collect()), len(b.inputFiles())))).start()
    done.awaitTermination()
    assert [b[:2] for b in batches] == [(25_000, 1), (25_000, 1), (1, 0)]
    assert [len(p["sources"]) for p in done.recentProgress if p["numInputRows"]] == [1, 1, 1] and batches[0][2] == 2


def test_rows_of_a_batch_wait_as_one_value():
    """Whatever the rows of a key and a batch, risk puts one value into state."""

    class State:
        def __init__(self):
            self.put, self.timers = [], []

        appendValue, registerTimer = (lambda s, v: s.put.append(v)), (lambda s, t: s.timers.append(t))
        getListState = getMapState = getValueState = lambda s, *_: s

    handle = State()
    op = state.Risk(["video_id", "ts", "at", "nulls", "t"], {"t": 0}, 1000, risk.RiskConfig(), (1.0, 0.0))
    op.init(handle)
    assert not list(op.handleInputRows((1,), iter([pd.DataFrame([(1, None, k, 0, k / 1000) for k in range(500)])]), None))
    assert len(handle.put) == 1 and handle.timers == [499]
