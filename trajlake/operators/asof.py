"""As-of lookups by union and a scan in segments of time, and lookups in a window of time by buckets: no unkeyed range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions.intervals import scanned, segment
from trajlake.sources.files import materialize


def _looked_up(points: DataFrame, ticks: DataFrame, value: str, keys: list[str], way: int, strict: bool) -> DataFrame:
    left = points.withColumns({"__tick": F.lit(0), "__v": F.lit(None).cast(ticks.schema[value].dataType)})
    right = ticks.select(*keys, "t", F.lit(1).alias("__tick"), F.col(value).alias("__v"))
    both = left.unionByName(right, allowMissingColumns=True).withColumns({"__at": F.col("t") * way, "__late": F.col("__tick") * (1 if strict else -1)})
    both = materialize(both.withColumn("__seg", segment("__at")), "side_by_side")
    found = scanned(both, keys, ["__at", "__late"], "__found", F.col("__v"), "last")
    return found.filter("__tick = 0").withColumn(value, F.col("__found")).drop("__tick", "__v", "__at", "__late", "__seg", "__found")


def backward(points: DataFrame, ticks: DataFrame, value: str, default: Column | None = None) -> DataFrame:
    """points with the value of the last tick of their video at or before their time, else the default."""
    out = _looked_up(points, ticks, value, ["video_id"], 1, False)
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def forward(points: DataFrame, ticks: DataFrame, value: str, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """points with the value of the first tick of their video (or keys) at or after their time, or after it (strict), else null."""
    return _looked_up(points, ticks, value, keys or ["video_id"], -1, strict)


def within(points: DataFrame, ticks: DataFrame, reach: float) -> DataFrame:
    """Pairs of points and ticks (their columns with s_) of a video at most reach apart."""
    width = 2 * reach
    p = points.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((F.col("t") - reach) / width), F.floor((F.col("t") + reach) / width)))))
    s = ticks.select("video_id", *(F.col(c).alias(f"s_{c}") for c in ticks.columns if c != "video_id")).withColumn("__b", F.floor(F.col("s_t") / width))
    return p.join(s, ["video_id", "__b"]).drop("__b").filter((F.col("s_t") >= F.col("t") - reach) & (F.col("s_t") <= F.col("t") + reach))


def nearest_state(points: DataFrame, signals: DataFrame, reach: float = 0.22) -> DataFrame:
    """points with the state of the nearest signal sample at most reach away, the earlier of two; else `?`.

    The points' columns must tell them apart.
    """
    near = within(points, signals.select("video_id", "t", "state"), reach + 1e-9).filter(F.abs(F.col("s_t") - F.col("t")) <= reach)
    found = near.groupBy(*points.columns).agg(F.min_by("s_state", F.struct(F.abs(F.col("s_t") - F.col("t")), "s_t")).alias("state"))
    return points.join(found, points.columns, "left").withColumn("state", F.coalesce("state", F.lit("?")))


def stable_state(points: DataFrame, signals: DataFrame, around: float = 0.18, reach: float = 0.22) -> DataFrame:
    """points with the state that most known samples around them have, else `?`; without a known sample, the nearest one.

    One known sample decides alone; of more, two at least and more than of any other state. The points' columns must tell
    them apart. Both lookups share one join, as the window lies within the reach.
    """
    near = within(points, signals.select("video_id", "t", "state"), reach + 1e-9)
    close = (F.col("s_t") >= F.col("t") - around) & (F.col("s_t") <= F.col("t") + around)
    counts = {x: F.sum(F.when(close & (F.col("s_state") == x), 1).otherwise(0)) for x in "RYG"}
    at = F.when(F.abs(F.col("s_t") - F.col("t")) <= reach, F.struct(F.abs(F.col("s_t") - F.col("t")), "s_t"))
    found = near.groupBy(*points.columns).agg(*(c.alias(f"n_{x}") for x, c in counts.items()), F.min_by("s_state", at).alias("nearest"))
    known = F.col("n_R") + F.col("n_Y") + F.col("n_G")
    most = F.greatest("n_R", "n_Y", "n_G")
    alone = F.size(F.filter(F.array("n_R", "n_Y", "n_G"), lambda c: c == F.greatest("n_R", "n_Y", "n_G"))) == 1
    winner = F.when(F.col("n_R") == most, "R").when(F.col("n_Y") == most, "Y").otherwise("G")
    state = F.when(known == 0, F.coalesce("nearest", F.lit("?"))).when((known == 1) | ((most >= 2) & alone), winner).otherwise("?")
    return points.join(found.select(*points.columns, state.alias("state")), points.columns, "left").withColumn("state", F.coalesce("state", F.lit("?")))


def sustained_green(signals: DataFrame, span: float = 0.35) -> DataFrame:
    """Green samples (video_id, t, green_t) from which the next one or two green ones lie within the span."""
    by = W.partitionBy("video_id").orderBy("t")
    green = signals.filter("state = 'G'").select("video_id", "t", F.coalesce(F.lead("t", 2).over(by), F.lead("t", 1).over(by)).alias("upto"))
    return green.filter(F.col("upto") - F.col("t") <= span).select("video_id", "t", F.col("t").alias("green_t"))
