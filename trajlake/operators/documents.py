"""Checks of raw prediction documents, whose values may be of any type: JSON as VARIANT, which keeps a boolean apart from a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(kind), F.lit(False))


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def entries(texts: DataFrame) -> DataFrame:
    """video, events and risk (VARIANT) of the videos of documents (value) that have a list of events; what is no JSON has none."""
    videos = texts.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.videos", "map<string,variant>")).alias("video", "entry"))
    got = videos.select("video", *(F.try_variant_get("entry", f"$.{c}", "variant").alias(c) for c in ("events", "risk")))
    return got.filter(_is(F.col("events"), "^ARRAY"))


def event_breaks(videos: DataFrame, labels: tuple[str, ...], durations: DataFrame | None = None, slack: float = 0.5) -> DataFrame:
    """video, part, idx and rule of what each event of entries() breaks, the first kind that holds and time:

    fields (no list of three), number (a start or end that is none; a boolean isn't), time (not 0 <= start < end), label (unknown, or
    no string), late (ends over slack after the video, where durations has it), overlap (with the event of its label before it).
    """
    e = videos.select("video", F.posexplode(_items(F.col("events"))).alias("idx", "e")).withColumn("f", _items(F.col("e")))
    at = lambda k: F.get("f", F.lit(k))
    e = e.withColumn("three", F.coalesce(F.size("f") == 3, F.lit(False)))
    e = e.withColumn("timed", F.col("three") & _is(at(0), _NUMBER) & _is(at(1), _NUMBER))
    e = e.withColumns({"start": F.when(F.col("timed"), _number(at(0))), "end": F.when(F.col("timed"), _number(at(1))), "label": F.when(F.col("timed") & _is(at(2), "^STRING$"), F.try_variant_get(at(2), "$", "string"))})
    e = e.withColumn("known", F.coalesce(F.col("label").isin(*labels), F.lit(False)))
    late = F.lit(False)
    if durations is not None:
        e = e.join(durations.select("video", "duration"), "video", "left")
        late = F.coalesce(F.col("known") & (F.col("end") > F.col("duration") + slack), F.lit(False))
    rules = {"fields": ~F.col("three"), "number": F.col("three") & ~F.col("timed"), "time": F.col("timed") & ~((F.col("start") >= 0) & (F.col("start") < F.col("end"))), "label": F.col("timed") & ~F.col("known"), "late": late}
    listed = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    single = e.select("video", F.lit("events").alias("part"), "idx", F.explode(listed).alias("rule"))
    before = F.lag("end").over(W.partitionBy("video", "label").orderBy("start", "end", "idx"))
    again = e.filter("known").withColumn("before", before).filter("start < before")
    return single.unionByName(again.select("video", F.lit("events").alias("part"), "idx", F.lit("overlap").alias("rule")))


def curve_breaks(videos: DataFrame) -> DataFrame:
    """video, part, idx and rule of the first break of each risk curve of entries(): list (no list, no idx), sample (not two
    numbers), back (earlier than the one before), range (not 0 to 1). A video without a curve breaks nothing."""
    there = videos.filter(F.col("risk").isNotNull())
    none = there.filter(~_is(F.col("risk"), "^ARRAY")).select("video", F.lit("risk").alias("part"), F.lit(None).cast("int").alias("idx"), F.lit("list").alias("rule"))
    s = there.select("video", F.posexplode(_items(F.col("risk"))).alias("idx", "e")).withColumn("f", _items(F.col("e")))
    at = lambda k: F.get("f", F.lit(k))
    s = s.withColumn("ok", F.coalesce(F.size("f") == 2, F.lit(False)) & _is(at(0), _NUMBER) & _is(at(1), _NUMBER))
    s = s.withColumns({"t": F.when(F.col("ok"), _number(at(0))), "score": F.when(F.col("ok"), _number(at(1)))})
    before = F.coalesce(F.lag("t").over(W.partitionBy("video").orderBy("idx")), F.lit(-1.0))
    rule = F.when(~F.col("ok"), "sample").when(F.col("t") < before, "back").when(~F.col("score").between(0.0, 1.0), "range")
    first = s.withColumn("rule", rule).filter("rule IS NOT NULL").groupBy("video").agg(F.min("idx").alias("idx"), F.min_by("rule", "idx").alias("rule"))
    return none.unionByName(first.select("video", F.lit("risk").alias("part"), "idx", "rule"))


def document_breaks(texts: DataFrame, labels: tuple[str, ...], durations: DataFrame | None = None) -> DataFrame:
    """What the events and curves of prediction documents (value) break: event_breaks() and curve_breaks()."""
    videos = entries(texts)
    return event_breaks(videos, labels, durations).unionByName(curve_breaks(videos))
