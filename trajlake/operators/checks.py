"""Checks of labelled and predicted events and curves, each a table of what breaks a rule, and what a run log allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions.intervals import overlap_join


def _broken(**rules: Column) -> Column:
    return F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule")


def broken_rules(events: DataFrame, durations: DataFrame, labels: tuple[str, ...], slack: float = 0.5) -> DataFrame:
    """video_id, idx and rule for each rule that an event breaks: time, label, or late (ends over slack after the video).

    Whether an event of a label that isn't known ends late is not looked at, nor that of videos without a duration.
    """
    known = F.col("label").isin(*labels)
    late = known & (F.col("end") > F.col("duration") + slack)
    time = ~F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")), F.lit(False))
    rows = events.join(durations, "video_id", "left")
    return rows.select("video_id", "idx", _broken(time=time, label=~F.coalesce(known, F.lit(False)), late=F.coalesce(late, F.lit(False))))


def risk_breaks(curve: DataFrame) -> DataFrame:
    """The first sample of each video that is out of the range 0 to 1 or goes back in time."""
    before = F.lag("t").over(W.partitionBy("video_id").orderBy("idx"))
    ok = (F.col("t") >= F.coalesce(before, F.lit(-1.0))) & F.col("score").between(0.0, 1.0)
    bad = curve.withColumn("ok", F.coalesce(ok, F.lit(False))).filter(~F.col("ok"))
    return bad.groupBy("video_id").agg(F.min("idx").alias("idx"))


def label_breaks(events: DataFrame, durations: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """video_id, idx and rule of labelled events: time (0 <= start < end <= duration), label, overlap (with any other of its
    label and a lower idx), order (begins before the one with the next lower idx)."""
    time = ~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("duration")))
    before = F.lag("start").over(W.partitionBy("video_id").orderBy("idx"))
    rows = events.join(durations, "video_id").withColumn("before", before)
    single = rows.select("video_id", "idx", _broken(time=time, label=~F.col("label").isin(*labels), order=F.coalesce(F.col("start") < F.col("before"), F.lit(False))))
    spans = events.filter("start < end")
    both = overlap_join(spans, spans, ["video_id", "label"], 8.0).filter("r_idx < idx")
    return single.unionByName(both.select("video_id", "idx", F.lit("overlap").alias("rule")).distinct())


def structure_breaks(videos: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """video, level and rule of prediction documents as labels_json.structure() reads them.

    Errors: no `videos` object (shape), a path for a key (path), no list of events (events), a true video that is missing
    (missing). Warnings: no team (team), no risk curve (risk), a video that isn't in the truth (extra).
    """
    errors = {"shape": ~F.col("has_videos"), "path": F.coalesce(F.col("video").rlike(r"[/\\\\]"), F.lit(False)), "events": F.col("has_videos") & F.col("video").isNotNull() & ~F.col("has_events")}
    warnings = {"team": F.col("has_videos") & ~F.col("has_team"), "risk": F.col("has_events") & (F.col("n_risk") == 0)}
    found = videos.select("video", F.lit("error").alias("level"), _broken(**errors))
    found = found.unionByName(videos.select("video", F.lit("warning").alias("level"), _broken(risk=warnings["risk"])))
    team = videos.filter(warnings["team"]).select(F.lit(None).cast("string").alias("video"), F.lit("warning").alias("level"), F.lit("team").alias("rule"))
    found = found.unionByName(team.distinct())
    if truth is None:
        return found
    named, true = videos.filter("video IS NOT NULL").select("video").distinct(), truth.select("video").distinct()
    missing = true.join(named, "video", "left_anti").select("video", F.lit("error").alias("level"), F.lit("missing").alias("rule"))
    extra = named.join(true, "video", "left_anti").select("video", F.lit("warning").alias("level"), F.lit("extra").alias("rule"))
    return found.unionByName(missing).unionByName(extra)


def unofficial(labels: DataFrame, official: tuple[str, ...]) -> DataFrame:
    """The labels (label) that aren't in the official list."""
    return labels.select("label").distinct().filter(~F.col("label").isin(*official))


def with_logs(videos: DataFrame, logs: DataFrame) -> DataFrame:
    """videos with total_sec, part_a_sec, part_b_sec and errors of their run; nulls and no errors where there is no log."""
    out = videos.join(logs.select("video_id", "total_sec", "part_a_sec", "part_b_sec", "errors"), "video_id", "left")
    return out.withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def within_budget(rows: DataFrame, logs: DataFrame, factor: float = 3.0) -> DataFrame:
    """The rows (events or risk samples) but for those of videos whose run took over factor times their duration."""
    over = logs.filter(F.col("total_sec") > factor * F.col("duration")).select("video_id")
    return rows.join(over, "video_id", "left_anti")


def budget_use(logs: DataFrame, factor: float = 3.0) -> DataFrame:
    """video_id and percent of the time budget that its run took."""
    return logs.select("video_id", (F.col("total_sec") * 100 / F.greatest(F.lit(1.0), F.col("duration") * factor)).alias("percent"))
