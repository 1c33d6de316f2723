"""Matching of predicted to true events, and of alarms to accidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions.intervals import alarm_runs, overlap_join, point_join, scanned, segment, tiou
from trajlake.operators.asof import forward
from trajlake.sources.files import materialize

#: Overlaps from which a match counts.
THRESHOLDS = (0.3, 0.5, 0.7)


def _numbered(events: DataFrame) -> DataFrame:
    return events.withColumn("i", F.row_number().over(W.partitionBy("video_id", "label").orderBy("start", "end")))


def _round(pairs: DataFrame, left: list[str], right: list[str], rank: Column) -> DataFrame:
    """One round: open pairs that rank first on both their sides are taken, and what they touch is closed."""
    by_left, by_right = W.partitionBy(*left), W.partitionBy(*right)
    best = F.when(F.col("__open"), rank)
    out = pairs.withColumn("__best_l", F.max(best).over(by_left)).withColumn("__best_r", F.max(best).over(by_right))
    first = F.col("__open") & (rank == F.col("__best_l")) & (rank == F.col("__best_r"))
    out = out.withColumn("__taken", F.col("__taken") | first)
    out = out.withColumn("__hit_r", F.max("__taken").over(by_right)).withColumn("__hit_l", F.max("__taken").over(by_left))
    return out.withColumn("__open", F.col("__open") & ~F.col("__hit_l") & ~F.col("__hit_r")).drop("__best_l", "__best_r", "__hit_l", "__hit_r")


def mutual_best(pairs: DataFrame, left: list[str], right: list[str], rank: Column) -> DataFrame:
    """The pairs of a greedy one-to-one matching by falling rank, which must differ between pairs that share a side.

    left and right are the columns that tell the two sides' members. A pair that ranks first among those of its left member and
    among those of its right one is in the matching whatever happens elsewhere; so all of these are taken at once, and the pairs
    they touch go, until none is left. No task holds more than the pairs of one member. There are as many rounds as the longest
    chain of pairs in which each has a better neighbour that falls away; two rounds are made for each table that is written. Pairs
    are dealt by the columns that both sides have, so that both rounds get along with one shuffle.
    """
    # Windows have another form of doubles (one zero, one NaN), by which rows would be dealt again.
    shared = [c for c, kind in pairs.dtypes if c in left and c in right and kind not in ("double", "float")]
    dealt = lambda df: df.repartition(*shared) if shared else df
    taken, left_over = None, pairs.withColumns({"__open": F.lit(True), "__taken": F.lit(False)})
    while True:
        left_over = dealt(left_over)
        done = materialize(_round(_round(left_over, left, right, rank), left, right, rank), "matched_pairs")
        found = done.filter("__taken").drop("__open", "__taken")
        taken = found if taken is None else taken.unionByName(found)
        left_over = done.filter("__open")
        if left_over.isEmpty():
            return taken


def match_segments(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """video_id, label, tau, tp, fp and fn of each label of a video that either side has.

    Only overlapping pairs meet; they are matched by falling overlap, then falling numbers, in rounds of mutual_best(). Whether a
    pair is taken depends only on pairs of more overlap, so the matching of a threshold is what it holds of the least one's. What
    is found in videos that the truth lacks counts nothing, but its labels have a row.
    """
    truth, found = materialize(_numbered(truth), "true_events"), materialize(_numbered(found), "found_events")
    pairs = overlap_join(truth, found, ["video_id", "label"], 8.0)
    pairs = pairs.withColumn("iou", tiou(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).filter(F.col("iou") >= min(thresholds))
    keys = ["video_id", "label"]
    taken = mutual_best(pairs.select(*keys, "iou", "i", "r_i"), [*keys, "i"], [*keys, "r_i"], F.struct("iou", "i", "r_i"))
    taken = taken.withColumn("tau", F.explode(F.array(*map(F.lit, thresholds)))).filter("iou >= tau")
    tp = taken.groupBy(*keys, "tau").agg(F.count("*").alias("tp"))
    known = truth.select("video_id").distinct().withColumn("known", F.lit(1))
    real = truth.select("video_id", "label", F.lit(1).alias("n_true"), F.lit(0).alias("n_found"))
    rest = found.join(known, "video_id", "left").select("video_id", "label", F.lit(0).alias("n_true"), F.coalesce("known", F.lit(0)).alias("n_found"))
    sizes = real.unionByName(rest).groupBy("video_id", "label").agg(F.sum("n_true").alias("n_true"), F.sum("n_found").alias("n_found"))
    every = sizes.withColumn("tau", F.explode(F.array(*map(F.lit, thresholds))))
    tp_ = F.coalesce("tp", F.lit(0))
    return every.join(tp, ["video_id", "label", "tau"], "left").select("video_id", "label", "tau", tp_.alias("tp"), (F.col("n_found") - tp_).alias("fp"), (F.col("n_true") - tp_).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def pooled(matches: DataFrame) -> DataFrame:
    """By label and tau over all videos: tp, fp, fn, precision, recall and f1; zero where nothing divides.

    What scores by label need; the whole pool, with the sums over labels and the matching without them, is pooled_all().
    """
    return _rates(matches.groupBy("label", "tau").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def pooled_all(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """kind, label, tau and what pooled() has: each `class`, `micro` (its sums over all labels) and `agnostic`.

    The last is a matching of its own, in which events meet whatever their labels. label is null but for classes.
    """
    truth, found = materialize(truth, "true_events"), materialize(found, "found_events")  # both matchings read them
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    kind = F.when(F.grouping("label") == 1, "micro").otherwise("class").alias("kind")
    by_label = match_segments(truth, found, thresholds).groupingSets([["label", "tau"], ["tau"]], "label", "tau").agg(kind, *sums)
    alike = [df.withColumn("label", F.lit("")) for df in (truth, found)]
    agnostic = match_segments(*alike, thresholds).groupBy("tau").agg(*sums).withColumns({"kind": F.lit("agnostic"), "label": F.lit(None).cast("string")})
    return _rates(by_label.unionByName(agnostic).select("kind", "label", "tau", "tp", "fp", "fn"))


def score_a(matches: DataFrame) -> DataFrame:
    """The mean over labels of the mean over tau of f1."""
    return pooled(matches).groupBy("label").agg(F.avg("f1").alias("f1")).agg(F.avg("f1").alias("score_a"))


def metrics_table(pool: DataFrame, tau: float = 0.5) -> DataFrame:
    """label, precision, recall, f1, tp, fp and fn of pooled() at one tau."""
    return pool.filter(F.col("tau") == tau).select("label", "precision", "recall", "f1", "tp", "fp", "fn")


def ablation(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """The metrics of one label in two pools, a row each (run: before, after)."""
    rows = [metrics_table(pool).filter(F.col("label") == label).withColumn("run", F.lit(run)) for run, pool in (("before", before), ("after", after))]
    return rows[0].unionByName(rows[1]).drop("label")


def model_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """score_a, score_b and model_score: seven parts of the first and three of the second, or the first where there is no second."""
    both = a.withColumn("one", F.lit(1)).join(b.select("score_b", F.lit(1).alias("one")), "one", "left").drop("one")
    return both.withColumn("model_score", F.coalesce(0.7 * F.col("score_a") + 0.3 * F.col("score_b"), F.col("score_a")))


def frame_labels(curve: DataFrame, accidents: DataFrame, horizon: float = 5.0) -> DataFrame:
    """curve with label: 1 up to horizon before an accident, null within one or around a near miss, else 0.

    Within an accident counts first, then before one, then a near miss.
    """
    a = accidents.select("video_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("label").alias("kind"))
    a = materialize(a.withColumn("s_before", F.col("s") - horizon), "accident_spans")
    t = F.col("t")
    hit = F.col("kind") == "accident"
    flags = point_join(curve, a, ["video_id"], 4 * horizon, "t", "s_before", "e").groupBy("video_id", "idx").agg(
        F.max(hit & t.between(F.col("s"), F.col("e"))).alias("during"), F.max(hit & (t >= F.col("s") - horizon) & (t < F.col("s"))).alias("ahead"), F.max(~hit & t.between(F.col("s") - horizon, F.col("e"))).alias("near")
    )
    label = F.when(F.coalesce("during", F.lit(False)), None).when(F.coalesce("ahead", F.lit(False)), 1).when(F.coalesce("near", F.lit(False)), None).otherwise(0)
    return curve.join(flags, ["video_id", "idx"], "left").select("video_id", "idx", "t", "score", label.alias("label"))


def average_precision(scored: DataFrame, cells: int = 4096) -> DataFrame:
    """One row: n, positives, ap (equal scores as one step) and ap over chance; labels that are null don't count.

    Scores are first summed up. The running sums are those over cells of the range 0 to 1, of which there are few, and those
    within each cell, so no window holds all scores.
    """
    steps = scored.filter("label IS NOT NULL").groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    steps = steps.withColumn("cell", F.greatest(F.lit(0), F.least(F.lit(cells), F.floor(F.col("score") * cells))))
    above = W.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy("cell").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = sums.select("cell", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("p", "n")))
    by = W.partitionBy("cell").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = steps.join(F.broadcast(sums), "cell").select("p", "n", (F.sum("p").over(by) + F.col("p_above")).alias("tp"), (F.sum("n").over(by) + F.col("n_above")).alias("all"))
    total = run.agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("area"))
    rate = F.col("positives") / F.col("n")
    ap = F.when(F.col("positives") > 0, F.col("area") / F.col("positives")).otherwise(0.0)
    return total.select("n", "positives", ap.alias("ap"), F.when(rate < 1, F.greatest(F.lit(0.0), (ap - rate) / (1 - rate))).otherwise(0.0).alias("ap_over_chance"))


def chain(nodes: DataFrame, keys: list[str], node: str, following: str) -> DataFrame:
    """The nodes (keys and node) on the path that begins at each group's least node and goes on to `following` (null: it ends).

    By pointer doubling: with each round the pointers lead twice as far, and what they reach from the path joins it, so a path
    of n nodes takes log(n) rounds of two joins by node, whatever the size of a group.
    """
    jumps = materialize(nodes.select(*keys, F.col(node).alias("__at"), F.col(following).alias("__to")), "pointers")
    path = jumps.groupBy(*keys).agg(F.min("__at").alias("__at"))
    while True:
        far = jumps.filter("__to IS NOT NULL")
        reached = path.join(far, [*keys, "__at"]).select(*keys, F.col("__to").alias("__at"))
        path = materialize(path.unionByName(reached), "path")
        ahead = far.select(*keys, F.col("__at").alias("__to"), F.col("__to").alias("__next"))
        jumps = materialize(far.join(ahead, [*keys, "__to"]).select(*keys, "__at", F.col("__next").alias("__to")), "pointers")
        if jumps.isEmpty():
            return path.withColumnRenamed("__at", node)


def _counted(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number in their video, from 1, by order, whose first column is a time; a table."""
    rows = materialize(rows.withColumns({"__seg": segment(order[0]), "__one": F.lit(1)}), "counted")
    return materialize(scanned(rows, ["video_id"], order, name, F.col("__one"), "sum").drop("__seg", "__one"), "counted")


def match_alarms(curve: DataFrame, accidents: DataFrame, lead: float = 10.0) -> DataFrame:
    """video_id, start and tta of accidents: seconds from the alarm each gets, 0 without one.

    Accidents in order each take the earliest alarm left within lead seconds before them; alarms in ignored frames don't count.

    The windows move on with the accidents, so the alarms taken do too. Of accidents with an alarm in their window, the one after
    the k-th, which took alarm n, that gets another is the first one later than k that begins after alarm n + 1, and it takes
    n + 1 or the first alarm of its window. So each pair of an accident and an alarm of its window points to another such pair,
    and the matching is the path from the first.
    """
    alarms = _counted(valid_alarms(curve, accidents).distinct(), ["t"], "n")
    hits = accidents.filter("label = 'accident'").select("video_id", F.col("start").cast("double").alias("start")).withColumn("tie", F.monotonically_increasing_id())
    hits = materialize(hits, "accidents")
    width = 2 * lead
    cells = F.array_distinct(F.array(F.floor((F.col("start") - lead) / width), F.floor(F.col("start") / width)))
    ahead = hits.withColumn("cell", F.explode(cells)).join(alarms.withColumn("cell", F.floor(F.col("t") / width)), ["video_id", "cell"])
    ahead = materialize(ahead.filter((F.col("t") >= F.col("start") - lead) & (F.col("t") < F.col("start"))).drop("cell"), "alarms_ahead")
    served = _counted(ahead.groupBy("video_id", "start", "tie").agg(F.min("n").alias("first")), ["start", "tie"], "k")
    # For each alarm the first accident after it, under the number of the alarm before.
    after = forward(alarms, served.groupBy("video_id", F.col("start").alias("t")).agg(F.min("k").alias("k_after")), "k_after", strict=True)
    after = after.select("video_id", (F.col("n") - 1).alias("n"), "k_after")
    pairs = ahead.join(served.select("video_id", "tie", "k"), ["video_id", "tie"]).join(after, ["video_id", "n"], "left")
    pairs = pairs.withColumn("k_next", F.when(F.col("k_after").isNotNull(), F.greatest(F.col("k") + 1, "k_after")))
    following = served.select("video_id", F.col("k").alias("k_next"), F.col("first").alias("first_next"))
    pairs = pairs.join(following, ["video_id", "k_next"], "left").withColumn("node", F.struct("k", "n"))
    target = F.when(F.col("first_next").isNotNull(), F.struct(F.col("k_next").alias("k"), F.greatest("first_next", F.col("n") + 1).alias("n")))
    taken = chain(pairs.withColumn("target", target), ["video_id"], "node", "target").select("video_id", "node.*")
    got = taken.join(served.select("video_id", "tie", "k"), ["video_id", "k"]).join(alarms, ["video_id", "n"]).select("video_id", "tie", F.col("t").alias("alarm"))
    return hits.join(got, ["video_id", "tie"], "left").select("video_id", "start", F.coalesce(F.col("start") - F.col("alarm"), F.lit(0.0)).alias("tta"))


def valid_alarms(curve: DataFrame, accidents: DataFrame) -> DataFrame:
    """video_id and t of the alarms that don't begin in an ignored frame."""
    begun = alarm_runs(curve).select("video_id", F.col("start").alias("t"))
    return frame_labels(curve, accidents).filter("label IS NOT NULL").select("video_id", "t").join(begun, ["video_id", "t"], "left_semi")


def score_b(curve: DataFrame, accidents: DataFrame) -> DataFrame:
    """One row: the weighted sum of ap over chance, alarm f1 and mean time to accident, and its parts."""
    found = match_alarms(curve, accidents).agg(F.count("*").alias("accidents"), F.count_if(F.col("tta") > 0).alias("matched"), F.avg("tta").alias("mtta"))
    alarms = valid_alarms(curve, accidents).agg(F.count("*").alias("alarms"))
    ap = average_precision(frame_labels(curve, accidents)).select("ap_over_chance")
    one = lambda df: df.withColumn("__one", F.lit(1))
    row = one(found).join(one(alarms), "__one").join(one(ap), "__one")
    f1 = ratio(2 * F.col("matched"), F.col("alarms") + F.col("accidents"))
    score = F.when(F.col("accidents") > 0, 0.4 * F.col("ap_over_chance") + 0.4 * f1 + 0.2 * F.least(F.lit(1.0), F.col("mtta") / 10))
    return row.select("accidents", "alarms", "matched", "mtta", "ap_over_chance", f1.alias("f1_alarm"), score.alias("score_b"))


def clean_events(events: DataFrame, labels: tuple[str, ...], duration: float) -> DataFrame:
    """Valid events cut to the duration, to 3 decimals; of a label's overlapping ones those that begin before the last kept ends go.

    Events that begin together rank by idx, their place in the input, if there is such a column, else by end.
    """
    cut = events.filter(F.col("label").isin(*labels)).withColumn("end", F.least(F.col("end"), F.lit(duration))).filter("start >= 0 AND start < end")
    rank = F.col("idx").cast("double") if "idx" in events.columns else F.round("end", 3)
    cut = cut.select("video_id", "label", F.round("start", 3).alias("start"), rank.alias("rank"), F.round("end", 3).alias("end"))
    keys = ["video_id", "label"]
    node = F.struct("start", "rank", "end").alias("node")
    nodes = cut.select(*keys, node).distinct()  # of equal events, one can be kept
    ticks = nodes.groupBy(*keys, F.col("node.start").alias("t")).agg(F.min("node").alias("following"))
    nodes = forward(nodes.withColumn("t", F.col("node.end")), ticks, "following", keys)
    return chain(nodes, keys, "node", "following").select(*keys, "node.start", "node.end")
