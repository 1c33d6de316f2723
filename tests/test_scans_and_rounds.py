import random
import statistics

import pytest
from pyspark.sql import functions as F

from trajlake.functions import intervals
from trajlake.functions.intervals import sample_step
from trajlake.operators import lookups, matching
from trajlake.operators.asof import backward, forward
from trajlake.plans.features import motion
from trajlake.sources.files import materialize

EVENT = "video_id long, start double, end double, label string"


def test_scans_go_on_over_segments(spark, monkeypatch):
    """A feed of many segments gives the rows of one, and no window holds more than a segment of a group."""
    r = random.Random(1)
    rows = [(k, round(t * 0.25, 2), r.choice([None, 1.0, 2.0, 3.0])) for k in (1, 2, None) for t in range(400) if r.random() < 0.6]
    df = spark.createDataFrame(rows, "k long, t double, v double").withColumn("__seg", F.floor(F.col("t") / 7.0))
    df = materialize(df, "scan_test")
    out = df
    for how in ("sum", "max", "last"):
        for before in (False, True):
            out = intervals.scanned(out, ["k"], ["t"], f"{how}_{before}", F.col("v"), how, before)
    got = {(x.k, x.t): x for x in out.collect()}
    for k in (1, 2, None):
        seen = []
        for _, t, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            for before in (True, False):
                if not before:
                    seen.append(v)
                known = [x for x in seen if x is not None]
                x = got[k, t]
                assert x[f"sum_{before}"] == sum(known)
                assert x[f"max_{before}"] == (max(known) if known else None)
                assert x[f"last_{before}"] == (known[-1] if known else None)


def test_lookups_and_islands_over_segments(spark):
    r = random.Random(2)
    points = [(v, r.randrange(40_000) / 4) for v in (1, 2) for _ in range(80)]
    ticks = [(v, r.randrange(4_000) * 2.5, i) for v in (1, 3) for i in range(60)]
    ticks = list({x[:2]: x for x in ticks}.values())
    p, s = spark.createDataFrame(points, "video_id long, t double").distinct(), spark.createDataFrame(ticks, "video_id long, t double, v long")
    of = lambda v: sorted(x[1:] for x in ticks if x[0] == v)
    back, ahead, after = ({(x.video_id, x.t): x.v for x in df.collect()} for df in (backward(p, s, "v"), forward(p, s, "v"), forward(p, s, "v", strict=True)))
    for v, t in set(points):
        assert back[v, t] == next((x for u, x in reversed(of(v)) if u <= t), None)
        assert ahead[v, t] == next((x for u, x in of(v) if u >= t), None)
        assert after[v, t] == next((x for u, x in of(v) if u > t), None)
    spans = [(v, a / 2, a / 2 + r.randrange(1, 40) / 2) for v in (1, 2) for a in (r.randrange(20_000) for _ in range(150))] + [(1, 100.0, 9000.0)]
    found = intervals.merge_intervals(spark.createDataFrame(spans, "v long, start double, end double"), ["v"], 3.0, 0.0)
    want = []
    for v in (1, 2):
        open_ = None
        for _, a, b in sorted(x for x in spans if x[0] == v):
            if open_ and a - open_[2] < 3.0:
                open_ = (v, open_[1], max(open_[2], b))
            else:
                want += [open_] * bool(open_)
                open_ = (v, a, b)
        want.append(open_)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)


@pytest.mark.parametrize("closed", [True, False])
def test_long_intervals_make_few_rows(spark, closed):
    r = random.Random(3)
    spans = [(1, float(a), float(a + r.choice([0, 1, 3, 9, 1000, 70_000]))) for a in (r.randrange(50_000) for _ in range(150))] + [(1, 0.0, 1e7), (2, 0.0, 1e7)]
    left, right = spans[::2] + [(2, 5.0, 6.0)], spans[1::2]
    schema = "k long, start double, end double"
    found = intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 4.0, closed=closed)
    got = sorted(tuple(x) for x in found.select("k", "start", "end", "r_start", "r_end").collect())
    meet = (lambda a, b: min(a[2], b[2]) >= max(a[1], b[1])) if closed else (lambda a, b: min(a[2], b[2]) > max(a[1], b[1]))
    assert got == sorted((a[0], a[1], a[2], b[1], b[2]) for a in left for b in right if a[0] == b[0] and meet(a, b))
    semi = intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 4.0, "left_semi", closed)
    assert semi.count() == sum(any(a[0] == b[0] and meet(a, b) for b in right) for a in left)
    points = spark.createDataFrame([(1, 5.0), (1, 2e6)], "k long, t double")
    one = materialize(spark.createDataFrame([(1, 0.0, 1e7)], schema), "one_span")
    plan = intervals.point_join(points, one, ["k"], 1.0)
    assert plan.count() == 2
    cells = one.withColumn("n", F.lit(1))
    assert intervals.point_join(cells.select("k", F.col("start").alias("t")), one, ["k"], 1.0).count() == 1


def _greedy(pairs):
    used_i, used_j, out = set(), set(), set()
    for w, i, j in sorted(pairs, reverse=True):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.add((i, j))
    return out


def test_rounds_are_the_greedy_matching(spark):
    r = random.Random(4)
    chain = [(20 - k, k // 2 + k % 2, k // 2) for k in range(12)]  # each pair has a better neighbour
    cases = {1: chain, 2: list({(i, j): (r.randrange(6), i, j) for i, j in ((r.randrange(15), r.randrange(15)) for _ in range(90))}.values()), 3: [(1, i, j) for i in range(5) for j in range(5)]}
    rows = [(k, *p) for k, pairs in cases.items() for p in pairs]
    found = matching.mutual_best(spark.createDataFrame(rows, "k long, w long, i long, j long"), ["k", "i"], ["k", "j"], F.struct("w", "i", "j"))
    got = {(x.k, x.i, x.j) for x in found.collect()}
    assert got == {(k, i, j) for k, pairs in cases.items() for i, j in _greedy(pairs)}


def test_many_overlapping_events_match_in_rounds(spark):
    spans = spark.range(330).select(F.lit(1).cast("long").alias("video_id"), (F.col("id") * 0.01).alias("start"), (F.col("id") * 0.01 + 20).alias("end"), F.lit("a").alias("label"))
    row = matching.match_segments(spans, spans, (0.5,)).first()  # about 100,000 pairs
    assert (row.tp, row.fp, row.fn) == (330, 0, 0)


def test_alarms_as_a_loop(spark):
    r = random.Random(6)
    curve, accidents, want = [], [], []
    for v in range(6):
        t = 0.0
        highs = set()
        while t < 150:
            highs.add(round(t, 1))
            t += r.choice([2.1, 2.5, 3.0, 7.0, 20.0])
        for i in range(1500):
            curve.append((v, i, i / 10, 0.9 if i / 10 in highs else 0.1))
        starts = sorted(r.choice([20, 25, 25, 31, 60, 61, 62, 63, 100, 141]) + r.random() for _ in range(9))
        accidents += [(v, s, s + 0.05, "accident") for s in starts]
        alarms = sorted(t for t in highs if not any(s <= t <= s + 0.05 for s in starts))
        for s in starts:
            free = [a for a in alarms if s - 10 <= a < s]
            want.append((v, round(s, 9), round(s - free[0], 6) if free else 0.0))
            alarms = [a for a in alarms if not free or a != free[0]]
    found = matching.match_alarms(spark.createDataFrame(curve, "video_id long, idx long, t double, score double"), spark.createDataFrame(accidents, EVENT))
    assert sorted((x.video_id, round(x.start, 9), round(x.tta, 6)) for x in found.collect()) == sorted(want)
    assert 0 < sum(w[2] > 0 for w in want) < len(want)


def test_clean_events_as_a_loop(spark):
    r = random.Random(7)
    rows = [(v, a / 4, a / 4 + r.randrange(1, 30) / 4, r.choice("ab"), i) for v in (1, 2) for i, a in enumerate(r.randrange(300) for _ in range(160))]
    rows += [(3, float(k), k + 1.0, "a", k) for k in range(100)]  # a long chain
    found = matching.clean_events(spark.createDataFrame(rows, EVENT + ", idx long"), ("a", "b"), 150.0)
    want, last = [], {}
    for v, s, e, label, _ in sorted(rows, key=lambda x: (x[0], x[3], x[1], x[4])):
        if s >= last.get((v, label), 0.0):
            want.append((v, label, s, min(e, 150.0)))
            last[v, label] = min(e, 150.0)
    assert sorted((x.video_id, x.label, x.start, x.end) for x in found.collect()) == sorted(want)


def test_near_duplicates_of_a_long_chain(spark):
    rows = [(1, k * 0.04, 5 + k * 0.04, "x", k) for k in range(40)] + [(2, 1.0, 2.0, "x", k) for k in range(30)]
    found = lookups.not_near_duplicates(spark.createDataFrame(rows, EVENT + ", idx long"), spark.createDataFrame([(9, 0.0, 1.0, "x")], EVENT))
    kept = []
    for v, s, e, _, i in rows:
        if not any(a == v and abs(b - s) < 0.05 and abs(c - e) < 0.05 for a, b, c, _ in kept):
            kept.append((v, s, e, i))
    assert sorted((x.video_id, x.idx) for x in found.collect()) == sorted((k[0], k[3]) for k in kept)


def test_tied_rows_share_a_run(spark):
    """Of equal intervals one may open a run; the others belong to it wherever a second sort leaves them."""
    rows = spark.createDataFrame([(1, 0, 5.0, 7.0, 0), (1, 0, 5.0, 7.0, 1), (1, 0, 1.0, 2.0, 1)], "k long, __seg long, start double, end double, new long").coalesce(1)
    runs = intervals.scanned(rows, ["k"], ["start", "end"], "run", F.col("new"), "sum", peers=True)
    assert sorted((r.start, r.run) for r in runs.collect()) == [(1.0, 1), (5.0, 2), (5.0, 2)]


def test_matching_of_each_threshold_in_one_pass(spark, monkeypatch):
    """Each threshold's counts are those of a loop by falling overlap, and a pair is matched once, not once a threshold."""
    r = random.Random(11)
    sides = [[(v, a / 4, a / 4 + r.randrange(4, 30) / 4, r.choice("ab")) for v in (1, 2) for a in (r.randrange(160) for _ in range(40))] for _ in range(2)]
    passed = []
    write = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, name: (passed.append((name, df.count())), write(df, name))[1])
    got = {(x.video_id, x.label, x.tau): (x.tp, x.fp, x.fn) for x in matching.match_segments(*(spark.createDataFrame(x, EVENT) for x in sides)).collect()}
    pairs = 0
    for v in (1, 2):
        for label in "ab":
            a, b = (sorted((s, e) for w, s, e, x in side if (w, x) == (v, label)) for side in sides)
            inter = {(i, j): min(p[1], q[1]) - max(p[0], q[0]) for i, p in enumerate(a) for j, q in enumerate(b)}
            ranked = sorted(((o / (a[i][1] - a[i][0] + b[j][1] - b[j][0] - o), i, j) for (i, j), o in inter.items() if o > 0), reverse=True)
            pairs += sum(x[0] >= 0.3 for x in ranked)
            for tau in matching.THRESHOLDS:
                used_a, used_b = set(), set()
                for iou, i, j in ranked:
                    if iou >= tau and i not in used_a and j not in used_b:
                        used_a.add(i)
                        used_b.add(j)
                assert got[v, label, tau] == (len(used_a), len(b) - len(used_a), len(a) - len(used_a))
    assert next(n for name, n in passed if name == "matched_pairs") == pairs


def test_sampling_steps_come_from_one_shuffle(spark):
    nan = float("nan")
    rows = [(1, 1, t) for t in (0.0, 0.5, 0.5, 2.0, 1.0)] + [(1, 2, 3.0), (1, 2, 3.0), (2, 1, None), (2, 1, 1.0), (2, 1, 1.25), (3, 1, 1.0), (3, 1, 3.0), (3, 1, nan), (3, 1, nan)]
    found = sample_step(spark.createDataFrame(rows, "video_id long, id long, t double").repartition(3), ["video_id", "id"])
    steps = {(r.video_id, r.id): r.step for r in found.collect()}
    assert steps.pop((3, 1)) != 2.0  # the step to what is no number counts once
    assert steps == {(1, 1): 0.5, (1, 2): 0.1, (2, 1): 0.25}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_speed_is_the_median_of_up_to_three_differences(spark):
    rows = [(1, i, i / 10.0, 1, x, 0.0) for i, x in enumerate([0.0, 1.0, 5.0, 5.5, 4.0])] + [(2, 0, 0.0, 1, 7.0, 0.0)] + [(3, i, i / 10.0, 1, 3.0 * i, 0.0) for i in range(2)]
    found = motion(spark.createDataFrame(rows, "video_id long, frame long, t double, id long, cx double, cy double").repartition(3))
    raw = {1: [10.0, 25.0, 22.5, 5.0, 15.0], 2: [0.0], 3: [30.0, 30.0]}
    for r in found.collect():
        near = raw[r.video_id][max(0, r.frame - 1) : r.frame + 2]
        assert r.speed == pytest.approx(statistics.median(near))
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
