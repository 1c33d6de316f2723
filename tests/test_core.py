import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.functions.intervals import alarm_runs, mask_intervals, merge_events, merge_intervals, overlap_join, touching_merge
from trajlake.operators import asof, matching
from trajlake.operators.lamps import classify_counts
from trajlake.plans import catalog, catalog_labels

EVENT = "video_id long, start double, end double, label string"


def spans(df):
    return sorted((round(r.start, 6), round(r.end, 6)) for r in df.collect())


def merge(iv, gap, least):
    out = []
    for s, e in sorted(x for x in iv if x[1] > x[0]):
        if out and s - out[-1][1] < gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted((s, e) for s, e in out if e - s >= least)


def test_merge_with_gap_and_minimum(spark):
    rows = [(1, 0.0, 0.2), (1, 1.0, 2.0), (1, 2.5, 3.5), (1, 5.0, 5.3)]
    assert spans(merge_intervals(spark.createDataFrame(rows, "video_id long, start double, end double"), ["video_id"], 0.6, 0.5)) == [(1.0, 3.5)]


def test_merge_is_by_label(spark):
    rows = [(1, 1.0, 3.0, "red_light"), (1, 2.0, 4.0, "red_light"), (1, 2.5, 3.5, "jaywalking")]
    found = {(r.label, r.start, r.end) for r in merge_events(spark.createDataFrame(rows, EVENT), F.lit(10.0), 0.0, 0.0).collect()}
    assert found == {("red_light", 1.0, 4.0), ("jaywalking", 2.5, 3.5)}


@pytest.mark.parametrize("gap", [0.0, 0.5, 1.0])
def test_merge_intervals_as_a_loop(spark, gap):
    r = random.Random(7)
    rows = [(v, s := r.randrange(60) / 2, s + r.randrange(0, 8) / 2) for v in range(40) for _ in range(r.randrange(0, 9))]
    found = merge_intervals(spark.createDataFrame(rows, "video_id long, start double, end double"), ["video_id"], gap, 0.5)
    expected = sorted(x for v in range(40) for x in merge([(s, e) for k, s, e in rows if k == v], gap, 0.5))
    assert spans(found) == expected


def test_mask_intervals_as_a_loop(spark):
    r = random.Random(8)
    rows = [(v, t / 8, r.random() < 0.6) for v in range(40) for t in sorted(r.sample(range(80), r.randrange(1, 30)))]
    expected = []
    for v in range(40):
        mine = [(t, m) for k, t, m in rows if k == v]
        diffs = sorted(b[0] - a[0] for a, b in zip(mine[:-1], mine[1:], strict=True))
        n = len(diffs)
        step, runs = ((diffs[(n - 1) // 2] + diffs[n // 2]) / 2 if n else 0.1), []
        for t, m in mine:
            if m and runs and t - runs[-1][1] <= 0.375:
                runs[-1][1] = t + step
            elif m:
                runs.append([t, t + step])
        expected += [(round(a, 6), round(b, 6)) for a, b in runs]
    found = mask_intervals(spark.createDataFrame(rows, "video_id long, t double, m boolean"), ["video_id"], F.col("m"), gap=0.375)
    assert spans(found) == sorted(expected)


def test_intervals_that_touch(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 2.5, 3.0)], "video_id long, start double, end double")
    assert spans(merge_intervals(df, ["video_id"], 0.0, 0.0)) == [(0.0, 1.0), (1.0, 2.0), (2.5, 3.0)]
    assert spans(touching_merge(df, ["video_id"], 10.0)) == [(0.0, 2.0), (2.5, 3.0)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], EVENT)
    assert merge_intervals(none, ["video_id"]).count() == 0 and overlap_join(none, none, ["video_id"], 2.0).count() == 0
    assert matching.match_segments(none, none).count() == 0
    assert alarm_runs(spark.createDataFrame([], "video_id long, idx long, t double, score double")).count() == 0


def test_alarms_split_below_the_threshold(spark):
    scores = [0.6, 0.4, 0.6, 0.1, 0.1, 0.1, 0.1, 0.1, 0.9]
    df = spark.createDataFrame([(1, i, i * 0.5, s) for i, s in enumerate(scores)], "video_id long, idx long, t double, score double")
    assert spans(alarm_runs(df)) == [(0.0, 1.0), (4.0, 4.0)]


@pytest.mark.parametrize("closed", [False, True])
def test_overlap_join_gives_each_pair_once(spark, closed):
    r = random.Random(9)
    make = lambda: [(v, s := r.randrange(40) / 2, s + r.randrange(1, 30) / 2, "x") for v in range(5) for _ in range(12)]
    a, b = make(), make()
    meet = (lambda x, y: min(x[2], y[2]) >= max(x[1], y[1])) if closed else (lambda x, y: min(x[2], y[2]) > max(x[1], y[1]))
    expected = sorted((x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and meet(x, y))
    found = overlap_join(spark.createDataFrame(a, EVENT), spark.createDataFrame(b, EVENT).drop("label"), ["video_id"], 3.0, closed=closed)
    assert sorted((x.start, x.end, x.r_start, x.r_end) for x in found.collect()) == expected


def test_matching_is_greedy(spark):
    r = random.Random(10)
    make = lambda: [(v, s := r.randrange(60) / 2, s + r.randrange(1, 12) / 2, "x") for v in range(20) for _ in range(r.randrange(1, 7))]
    truth, found = make(), make()
    got = {(x.video_id, x.tau): (x.tp, x.fp, x.fn) for x in matching.match_segments(spark.createDataFrame(truth, EVENT), spark.createDataFrame(found, EVENT)).collect()}
    for v in range(20):
        g, p = (sorted(x[1:3] for x in side if x[0] == v) for side in (truth, found))
        for tau in matching.THRESHOLDS:
            pairs = []
            for i, (a, b) in enumerate(g):
                for j, (c, d) in enumerate(p):
                    inter = max(0.0, min(b, d) - max(a, c))
                    union = b - a + d - c - inter
                    if inter > 0 and inter / union >= tau:
                        pairs.append((inter / union, i, j))
            left, right = set(), set()
            for _, i, j in sorted(pairs, reverse=True):
                if i not in left and j not in right:
                    left.add(i)
                    right.add(j)
            assert got[v, tau] == (len(left), len(p) - len(left), len(g) - len(left))


def test_point_in_polygon(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    points = spark.createDataFrame([(5.0, 5.0), (11.0, 5.0), (12.5, 5.0), (-1.0, -1.0)], "x double, y double")
    got = [tuple(r) for r in points.select(geo.inside(F.col("x"), F.col("y"), square), geo.inside(F.col("x"), F.col("y"), square, 2.0), geo.inside(F.col("x"), F.col("y"), square[:2], 2.0)).collect()]
    assert got == [(True, True, False), (False, True, False), (False, False, False), (False, True, False)]


def test_counts_to_states(spark):
    rows = spark.createDataFrame([(3, 0, 0), (12, 10, 0), (30, 0, 5), (10, 10, 10), (0, 9, 1)], "r int, y int, g int")
    assert [x.s for x in rows.select(classify_counts(F.col("r"), F.col("y"), F.col("g")).alias("s")).collect()] == ["?", "?", "R", "?", "Y"]


def test_asof_at_equal_times(spark):
    points = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 9.0), (2, 1.0)], "video_id long, t double")
    ticks = spark.createDataFrame([(1, 1.0, "a"), (1, 2.5, "b")], "video_id long, t double, state string")
    back = sorted((r.video_id, r.t, r.state) for r in asof.backward(points, ticks, "state", F.lit("?")).collect())
    assert back == [(1, 1.0, "a"), (1, 2.0, "a"), (1, 9.0, "b"), (2, 1.0, "?")]
    ahead = sorted((r.video_id, r.t, r.state or "-") for r in asof.forward(points, ticks, "state").collect())
    assert ahead == [(1, 1.0, "a"), (1, 2.0, "b"), (1, 9.0, "-"), (2, 1.0, "-")]


def test_clean_events_keeps_what_the_last_kept_allows(spark):
    rows = [(1, 0.0, 5.0, "a"), (1, 4.0, 6.0, "a"), (1, 5.0, 20.0, "a"), (1, 1.0, 1.0, "a"), (1, 2.0, 3.0, "z")]
    found = matching.clean_events(spark.createDataFrame(rows, EVENT), ("a",), 10.0)
    assert spans(found) == [(0.0, 5.0), (5.0, 10.0)]


def test_imports_without_the_corpus_operators(tmp_path):
    root = Path(__file__).parents[1]
    code = f"import sys; sys.path.insert(0, {str(root)!r}); sys.modules['trajlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


LABELLED = "video_id long, label string, start double, end double"


def test_pooled_all_has_micro_and_agnostic(spark):
    truth = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 20.0, 30.0), (2, "a", 0.0, 4.0)], LABELLED)
    found = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "a", 20.0, 30.0), (2, "b", 50.0, 54.0)], LABELLED)
    rows = {(r.kind, r.label): (r.tp, r.fp, r.fn) for r in matching.pooled_all(truth, found, (0.5,)).collect()}
    assert rows == {("class", "a"): (1, 1, 1), ("class", "b"): (0, 1, 1), ("micro", None): (1, 2, 2), ("agnostic", None): (2, 1, 1)}


def test_confusion_pool_is_whole(spark, tmp_path):
    """The query has the sums over all labels and the matching without labels, as its SQL has."""
    import duckdb

    spark.range(1, 400).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    run, sql = catalog.QUERIES["confusion_pool"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    rows = [tuple(r) for r in run(spark, str(tmp_path)).collect()]
    assert {r[0] for r in rows} == {"class", "micro", "agnostic"}
    assert sorted(rows, key=str) == sorted(con.execute(sql).fetchall(), key=str)


def test_event_histogram_bins_keeps_zeros(spark):
    events = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "a", 25.0, 31.0), (1, "other", 3.0, 4.0), (2, "b", 0.0, 0.0)], LABELLED)
    rows = {(r.video_id, r.label, r.bin): r.n for r in catalog_labels.event_histogram_bins(events, ("a", "b")).collect()}
    one = {(1, x, k): int(x == "a" and k in (0, 2)) for x in "ab" for k in range(4)}
    assert rows == one | {(2, "a", 0): 0, (2, "b", 0): 1}


def test_risk_breaks_allows_scores_up_to_one(spark):
    curve = spark.createDataFrame([(1, 0, 0.0, 0.95), (1, 1, 1.0, 1.0), (2, 0, 0.0, 0.5), (2, 1, 1.0, 1.01)], "video_id long, idx long, t double, score double")
    assert [tuple(r) for r in catalog_labels.risk_breaks(curve).collect()] == [(2, 1)]
