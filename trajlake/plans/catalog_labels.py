"""Queries over labelled and predicted events and risk curves."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions.intervals import alarm_runs, merge_events, overlap_join, tiou, touching_merge
from trajlake.operators import matching
from trajlake.operators.checks import broken_rules, risk_breaks
from trajlake.plans.catalog_features import rounded
from trajlake.plans.oracle import merged, sql
from trajlake.sources import adapters
from trajlake.sources.adapters import LABELS
from trajlake.sources.files import list_videos, new_folder
from trajlake.sources.labels_json import read_text, truth_from_text, write_truth

_gt, _pred, _raw, _risk, _acc = adapters.labels_gt, adapters.labels_pred, adapters.labels_raw, adapters.risk, adapters.labels_accident
_matches = lambda s, d: matching.match_segments(_gt(s, d), _pred(s, d))
_iou = '(least(a."end", b."end") - greatest(a.start, b.start)) / ((a."end" - a.start) + (b."end" - b.start) - (least(a."end", b."end") - greatest(a.start, b.start)))'
_or = 'round(start, 3) AS start, round("end", 3) AS "end"'


def _truth_files(s, d, videos: int) -> str:
    """A new folder of truth files with so many videos each."""
    path = new_folder(s, "truth")
    write_truth(_gt(s, d), path, F.expr(f"video_id DIV {videos}"))
    return path


def rated(src: str) -> str:
    return f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM {src}"


MATCH = {
    "gtn": 'SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY start, "end") AS i FROM labels_gt',
    "prn": 'SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY start, "end") AS i FROM labels_pred',
    "taus": "SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE]) AS tau",
    "cand": f'SELECT * FROM (SELECT a.video_id, a.label, a.i, b.i AS j, {_iou} AS iou FROM gtn a JOIN prn b ON a.video_id = b.video_id AND a.label = b.label AND least(a."end", b."end") > greatest(a.start, b.start)) x JOIN taus ON iou >= tau',
    "ranks": "SELECT *, row_number() OVER (PARTITION BY video_id, label, tau ORDER BY iou DESC, i DESC, j DESC) AS rn FROM cand",
    # A step looks at each group's next pair, which is taken if neither side is in the lists of those taken before.
    "steps": """SELECT video_id, label, tau, rn, [i] AS used_i, [j] AS used_j FROM ranks WHERE rn = 1 UNION ALL
      SELECT c.video_id, c.label, c.tau, c.rn, CASE WHEN list_contains(used_i, i) OR list_contains(used_j, j) THEN used_i ELSE list_append(used_i, i) END,
        CASE WHEN list_contains(used_i, i) OR list_contains(used_j, j) THEN used_j ELSE list_append(used_j, j) END
      FROM steps f JOIN ranks c ON c.video_id = f.video_id AND c.label = f.label AND c.tau = f.tau AND c.rn = f.rn + 1""",
    "tps": "SELECT video_id, label, tau, max(len(used_i)) AS tp FROM steps GROUP BY ALL",
    "sides": """SELECT video_id, label, sum(g) AS g, sum(p) AS p FROM (SELECT video_id, label, 1 AS g, 0 AS p FROM labels_gt
      UNION ALL SELECT video_id, label, 0, (video_id IN (SELECT video_id FROM labels_gt))::INT FROM labels_pred) u GROUP BY ALL""",
    "matched": "SELECT s.video_id, s.label, taus.tau, coalesce(tp, 0) AS tp, (p - coalesce(tp, 0))::BIGINT AS fp, (g - coalesce(tp, 0))::BIGINT AS fn FROM sides s CROSS JOIN taus LEFT JOIN tps ON tps.video_id = s.video_id AND tps.label = s.label AND tps.tau = taus.tau",
    "pool": "SELECT label, tau, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM matched GROUP BY ALL",
    "pooled": rated("pool"),
}
RISK = {
    "flags": """SELECT r.video_id, r.idx, r.t, r.score, bool_or(r.t BETWEEN h.start AND h."end") AS during, bool_or(r.t >= h.start - 5 AND r.t < h.start) AS ahead, coalesce(bool_or(r.t BETWEEN m.start - 5 AND m."end"), false) AS near
      FROM risk r JOIN hits h USING (video_id) LEFT JOIN misses m USING (video_id) GROUP BY ALL""",
    "framed": "SELECT *, CASE WHEN during THEN NULL WHEN ahead THEN 1 WHEN near THEN NULL ELSE 0 END AS label FROM flags",
    "apsteps": "SELECT score, sum(label) AS p, count(*) AS n FROM framed WHERE label IS NOT NULL GROUP BY score",
    "aprun": "SELECT *, sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS a FROM apsteps",
    "ap_row": "SELECT n, positives, ap, greatest(0, (ap - positives / n) / (1 - positives / n)) AS ap_over_chance FROM (SELECT sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, sum(p * tp / a) / sum(p) AS ap FROM aprun) x",
    "runs": """SELECT video_id, min(t) AS start, max(t) AS "end" FROM (SELECT *, idx - row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k FROM risk WHERE score >= 0.5) x GROUP BY video_id, k""",
    "alarms": merged('SELECT video_id, start, "end" + 1e-9::DOUBLE AS "end" FROM runs', "video_id", 2.0 - 1e-9, 0.0).replace('max("end") AS "end"', 'max("end") - 1e-9::DOUBLE AS "end"'),
    "valid": "SELECT a.video_id, a.start AS t FROM alarms a JOIN framed f ON f.video_id = a.video_id AND f.t = a.start WHERE f.label IS NOT NULL",
    # A video has two accidents at most; the second takes the earliest alarm that the first has left.
    "tta1": "SELECT h.video_id, h.start, min(v.t) AS t FROM hits h LEFT JOIN valid v ON v.video_id = h.video_id AND v.t >= h.start - 10 AND v.t < h.start WHERE h.k = 1 GROUP BY h.video_id, h.start",
    "tta2": """SELECT h.video_id, h.start, min(v.t) FILTER (v.t IS DISTINCT FROM o.t) AS t FROM hits h JOIN tta1 o ON o.video_id = h.video_id
      LEFT JOIN valid v ON v.video_id = h.video_id AND v.t >= h.start - 10 AND v.t < h.start WHERE h.k = 2 GROUP BY h.video_id, h.start""",
    "ttas": "SELECT video_id, start, coalesce(start - t, 0) AS tta FROM (SELECT * FROM tta1 UNION ALL SELECT * FROM tta2) b",
}

_ten = ", ".join(f"'{x}'" for x in LABELS[:10])
CLEAN = {
    "cut": f"""SELECT video_id, label, round(start, 3) AS start, round(least(250.0::DOUBLE, "end"), 3) AS "end", idx FROM numbered WHERE label IN ({_ten}) AND start >= 0 AND start < least(250.0::DOUBLE, "end")""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY start, idx) AS rn FROM cut",
    # A step takes of each label the next event that doesn't begin before the end of the last one taken.
    "picked": """SELECT * FROM ranked WHERE rn = 1 UNION ALL SELECT video_id, label, start, "end", idx, rn FROM (
      SELECT o.*, row_number() OVER (PARTITION BY o.video_id, o.label ORDER BY o.rn) AS nth
      FROM picked p JOIN ranked o ON o.video_id = p.video_id AND o.label = p.label AND o.rn > p.rn AND o.start >= p."end") n WHERE nth = 1""",
}
_width = "CASE WHEN duration > 240 THEN 15 ELSE 10 END"
GRID = f"""SELECT * FROM (SELECT video_id, width, unnest(range(greatest(1, ceil(duration / width))::BIGINT)) AS bin FROM (SELECT *, {_width} AS width FROM (SELECT video_id, max("end") AS duration FROM labels_gt GROUP BY video_id) q) w) b
  CROSS JOIN (SELECT unnest([{", ".join(f"'{x}'" for x in LABELS)}]) AS label) l"""



def event_histogram(events):
    """By video, label and bin of 10 s (15 s beyond four minutes): how many events begin in it."""
    dur = events.groupBy("video_id").agg(F.max("end").alias("duration"))
    width = F.when(F.col("duration") > 240, 15).otherwise(10)
    return events.join(dur, "video_id").groupBy("video_id", "label", F.floor(F.col("start") / width).alias("bin")).agg(F.count("*").alias("n"))


def event_histogram_bins(events, labels):
    """By video, label and bin as in event_histogram: how many events begin in it, with a row for each label and bin, also of zero.

    Bins go up to the video's last end; a video has one bin at least. Events of other labels don't count.
    """
    width = F.when(F.col("duration") > 240, 15).otherwise(10)
    bins = events.groupBy("video_id").agg(F.max("end").alias("duration")).select("video_id", F.greatest(F.lit(1), F.ceil(F.col("duration") / width)).alias("bins"), width.alias("width"))
    grid = bins.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin")).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    at = F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor(F.col("start") / F.col("width"))))
    counts = events.join(bins, "video_id").groupBy("video_id", "label", at.alias("bin")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["video_id", "label", "bin"], "left").select("video_id", "label", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(events, *more):
    """left and width of each event as a share of its video's duration, in per cent; width 0.7 at least. more are columns to keep."""
    dur = events.groupBy("video_id").agg(F.greatest(F.max("end"), F.lit(1.0)).alias("d"))
    left = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("start") / F.col("d") * 100))
    width = F.greatest(F.lit(0.7), F.least(F.lit(100.0) - left, (F.col("end") - F.col("start")) / F.col("d") * 100))
    return events.join(dur, "video_id").select("video_id", "label", left.alias("left"), width.alias("width"), *more)


def timeline_rows(events, labels):
    """timeline() with i, each event's number in its row (a video and label) by time, and n, how many events the row has.

    Each video has a row of each of labels; one without events is a single row with n 0 and else nulls. Other labels have none.
    """
    placed = timeline(events, "start", "end").filter(F.col("label").isin(*labels))
    row = W.partitionBy("video_id", "label")
    placed = placed.withColumn("i", F.row_number().over(row.orderBy("start", "end"))).withColumn("n", F.count("*").over(row)).drop("start", "end")
    every = events.select("video_id").distinct().withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    return every.join(placed, ["video_id", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overlaps(events):
    """Consecutive events of a label of which the second begins before the first ends."""
    nxt = events.withColumn("next", F.lead("start").over(W.partitionBy("video_id", "label").orderBy("start", "end")))
    return nxt.filter("next < end").groupBy("video_id", "label").agg(F.count("*").alias("n"))




QUERIES = {
    "class_counts": (lambda s, d: _gt(s, d).groupBy("label").agg(F.count("*").alias("n")), sql("SELECT label, count(*) AS n FROM labels_gt GROUP BY label")),
    "video_class_counts": (lambda s, d: _gt(s, d).groupBy("video_id", "label").agg(F.count("*").alias("n")), sql("SELECT video_id, label, count(*) AS n FROM labels_gt GROUP BY ALL")),
    "video_class_pivot": (
        lambda s, d: _gt(s, d).groupBy("video_id").pivot("label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0),
        sql("SELECT video_id, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in LABELS) + " FROM labels_gt GROUP BY video_id"),
    ),
    "merge_events": (lambda s, d: rounded(merge_events(_raw(s, d), F.lit(200.0)), 3), sql(f"SELECT video_id, label, {_or} FROM (" + merged('SELECT video_id, label, start, least(200.0::DOUBLE, "end") AS "end" FROM labels_raw', "video_id, label", 1.0, 0.5) + ") m")),
    "touching_merge": (lambda s, d: rounded(touching_merge(_raw(s, d), ["video_id", "label"], 200.0), 2), sql('SELECT video_id, label, round(start, 2) AS start, round("end", 2) AS "end" FROM (' + merged('SELECT video_id, label, start, least(200.0::DOUBLE, "end") AS "end" FROM labels_raw', "video_id, label", 0.0, 0.0, strict=False) + ") m")),
    "event_histogram": (lambda s, d: event_histogram(_gt(s, d)), sql(f'SELECT video_id, label, floor(start / {_width})::BIGINT AS bin, count(*) AS n FROM labels_gt JOIN (SELECT video_id, max("end") AS duration FROM labels_gt GROUP BY video_id) q USING (video_id) GROUP BY ALL')),
    "event_histogram_bins": (
        lambda s, d: event_histogram_bins(_gt(s, d), LABELS),
        sql("SELECT g.video_id, g.label, g.bin, count(e.label) AS n FROM grid g LEFT JOIN labels_gt e ON e.video_id = g.video_id AND e.label = g.label AND floor(e.start / g.width) = g.bin GROUP BY ALL", grid=GRID),
    ),
    "timeline_positions": (
        lambda s, d: rounded(timeline(_gt(s, d)), 4),
        sql('SELECT video_id, label, round(l, 4) AS "left", round(greatest(0.7, least(100 - l, ("end" - start) / d * 100)), 4) AS width FROM (SELECT *, greatest(0, least(100, start / d * 100)) AS l FROM labels_gt JOIN (SELECT video_id, greatest(max("end"), 1) AS d FROM labels_gt GROUP BY video_id) q USING (video_id)) x'),
    ),
    "timeline_rows": (
        lambda s, d: rounded(timeline_rows(_gt(s, d), LABELS), 4),
        sql("""SELECT video_id, label, round(l, 4) AS "left", CASE WHEN n > 0 THEN round(greatest(0.7, least(100 - l, ("end" - start) / d * 100)), 4) END AS width, i::INT AS i, coalesce(n, 0) AS n FROM (
          SELECT DISTINCT video_id, label, d FROM grid JOIN (SELECT video_id, greatest(max("end"), 1) AS d FROM labels_gt GROUP BY video_id) q USING (video_id)) r LEFT JOIN (
          SELECT video_id, label, start, "end", greatest(0, least(100, start / greatest(max("end") OVER (PARTITION BY video_id), 1) * 100)) AS l,
            row_number() OVER (PARTITION BY video_id, label ORDER BY start, "end") AS i, count(*) OVER (PARTITION BY video_id, label) AS n FROM labels_gt) x USING (video_id, label)""", grid=GRID),
    ),
    "tiou": (
        lambda s, d: rounded(overlap_join(_gt(s, d), _pred(s, d), ["video_id", "label"], 8.0).select("video_id", "label", "start", "r_start", tiou(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")).alias("iou")), 5),
        sql(f'SELECT a.video_id, a.label, round(a.start, 5) AS start, round(b.start, 5) AS r_start, round({_iou}, 5) AS iou FROM labels_gt a JOIN labels_pred b ON a.video_id = b.video_id AND a.label = b.label AND least(a."end", b."end") > greatest(a.start, b.start)'),
    ),
    "interval_overlap_join": (
        lambda s, d: rounded(overlap_join(_gt(s, d), _pred(s, d).drop("label"), ["video_id"], 8.0, "left_semi"), 3),
        sql(f'SELECT video_id, label, {_or} FROM labels_gt a WHERE EXISTS (SELECT 1 FROM labels_pred b WHERE a.video_id = b.video_id AND least(a."end", b."end") > greatest(a.start, b.start))'),
    ),
    "interval_overlap_closed_join": (
        lambda s, d: overlap_join(_gt(s, d), _pred(s, d), ["video_id"], 8.0, closed=True).groupBy("video_id", "label").agg(F.array_join(F.array_sort(F.collect_set("r_label")), ",").alias("partners")),
        sql('SELECT a.video_id, a.label, string_agg(DISTINCT b.label, \',\' ORDER BY b.label) AS partners FROM labels_gt a JOIN labels_pred b ON a.video_id = b.video_id AND b.start <= a."end" AND b."end" >= a.start GROUP BY a.video_id, a.label'),
    ),
    "anti_missing_videos": (
        lambda s, d: _gt(s, d).select("video_id").distinct().join(_pred(s, d).select("video_id").distinct(), "video_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(_pred(s, d).select("video_id").distinct().join(_gt(s, d).select("video_id").distinct(), "video_id", "left_anti").withColumn("side", F.lit("extra"))),
        sql("SELECT video_id, 'missing' AS side FROM (SELECT video_id FROM labels_gt EXCEPT SELECT video_id FROM labels_pred) a UNION ALL SELECT video_id, 'extra' FROM (SELECT video_id FROM labels_pred EXCEPT SELECT video_id FROM labels_gt) b"),
    ),
    "match_segments": (_matches, sql("SELECT * FROM matched", **MATCH)),
    "score_a": (lambda s, d: rounded(matching.score_a(_matches(s, d))), sql("SELECT round(avg(f), 6) AS score_a FROM (SELECT label, avg(f1) AS f FROM pooled GROUP BY label) x", **MATCH)),
    "class_gate": (
        lambda s, d: matching.pooled(_matches(s, d)).filter("tau = 0.5 AND precision >= 0.7").select("label"),
        sql("SELECT label FROM pooled WHERE tau = 0.5 AND precision >= 0.7", **MATCH),
    ),
    "frame_label": (lambda s, d: matching.frame_labels(_risk(s, d), _acc(s, d)).select("video_id", "idx", "label"), sql("SELECT video_id, idx, label FROM framed", **RISK)),
    "average_precision": (lambda s, d: rounded(matching.average_precision(matching.frame_labels(_risk(s, d), _acc(s, d)))), sql("SELECT n, positives, round(ap, 6) AS ap, round(ap_over_chance, 6) AS ap_over_chance FROM ap_row", **RISK)),
    "alarm_runs": (lambda s, d: rounded(alarm_runs(_risk(s, d)), 3), sql(f"SELECT video_id, {_or} FROM alarms", **RISK)),
    "match_alarms": (lambda s, d: rounded(matching.match_alarms(_risk(s, d), _acc(s, d)), 4), sql("SELECT video_id, round(start, 4) AS start, round(tta, 4) AS tta FROM ttas", **RISK)),
    "score_b": (
        lambda s, d: rounded(matching.score_b(_risk(s, d), _acc(s, d)), 5),
        sql("""SELECT accidents, alarms, matched, round(mtta, 5) AS mtta, round(ap_over_chance, 5) AS ap_over_chance, round(2 * matched / (alarms + accidents), 5) AS f1_alarm, round(0.4 * ap_over_chance + 0.4 * 2 * matched / (alarms + accidents) + 0.2 * least(1, mtta / 10), 5) AS score_b
          FROM (SELECT count(*) AS accidents, count(*) FILTER (tta > 0) AS matched, avg(tta) AS mtta FROM ttas) x, (SELECT count(*) AS alarms FROM valid) y, ap_row""", **RISK),
    ),
    "clean_events": (
        lambda s, d: rounded(matching.clean_events(adapters.labels_numbered(s, d), LABELS[:10], 250.0), 3),
        sql(f'SELECT video_id, label, {_or} FROM picked', **CLEAN),
    ),
    "validate_events": (
        lambda s, d: broken_rules(adapters.labels_numbered(s, d), adapters.video_durations(s, d), LABELS[:10]),
        sql(f"""SELECT e.video_id, idx, unnest(list_filter([CASE WHEN NOT (start >= 0 AND start < "end") THEN 'time' END, CASE WHEN label NOT IN ({_ten}) THEN 'label' END,
          CASE WHEN label IN ({_ten}) AND "end" > duration + 0.5 THEN 'late' END], lambda x: x IS NOT NULL)) AS rule FROM numbered e JOIN video_durations USING (video_id)"""),
    ),
    "validate_overlap": (lambda s, d: overlaps(_raw(s, d)), sql('SELECT video_id, label, count(*) AS n FROM (SELECT *, lead(start) OVER (PARTITION BY video_id, label ORDER BY start, "end") AS nx FROM labels_raw) x WHERE nx < "end" GROUP BY ALL')),
    "validate_risk": (
        lambda s, d: risk_breaks(adapters.risk_raw(s, d)),
        sql("SELECT video_id, min(idx) AS idx FROM (SELECT *, lag(t) OVER (PARTITION BY video_id ORDER BY idx) AS before FROM risk_raw) r WHERE score < 0 OR score > 1 OR t < coalesce(before, -1) GROUP BY video_id"),
    ),
    "validate_risk_full": (lambda s, d: risk_breaks(_risk(s, d)), sql("SELECT video_id, min(idx) AS idx FROM risk WHERE score < 0 OR score > 1 GROUP BY video_id")),
    "scan_labels_json": (
        lambda s, d: rounded(truth_from_text(read_text(s, _truth_files(s, d, 8))).select(F.col("video").cast("long").alias("video_id"), "start", "end", "label"), 3),
        sql(f"SELECT video_id, {_or}, label FROM labels_gt"),
    ),
    "list_videos": (
        lambda s, d: list_videos(s, _truth_files(s, d, 1), "TXT").select(F.element_at(F.split("path", "/"), -2).alias("folder")),
        sql("SELECT DISTINCT 'file_no=' || video_id AS folder FROM labels_gt"),
    ),
    "label_union": (lambda s, d: _gt(s, d).select("label").union(_pred(s, d).select("label")).distinct(), sql("SELECT label FROM labels_gt UNION SELECT label FROM labels_pred")),
    "distinct_ids": (lambda s, d: adapters.tracks(s, d).groupBy("video_id").agg(F.count_distinct("id").alias("n")), sql("SELECT video_id, count(DISTINCT id) AS n FROM tracks GROUP BY video_id")),
}
