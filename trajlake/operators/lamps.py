"""Signal states from lamp pixels (video_id, frame, row, h, s, v) and from colour counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _lit() -> Column:
    return (F.col("s") >= 50) & (F.col("v") >= 60)


def _hues() -> dict[str, Column]:
    h = F.col("h")
    return {"r": (h <= 12) | (h >= 168), "y": h.between(13, 35), "g": h.between(38, 100)}


def lamp_counts(pixels: DataFrame) -> DataFrame:
    """By video and frame, how many lit pixels are red, amber and green."""
    return pixels.groupBy("video_id", "frame").agg(*(F.count_if(_lit() & x).alias(c) for c, x in _hues().items()))


def _second(*counts: Column) -> Column:
    return F.element_at(F.sort_array(F.array(*counts)), -2)


def classify_counts(red: Column, amber: Column, green: Column, least: int = 5, dominance: float = 1.5) -> Column:
    """The colour with most pixels, unknown (?) if those are too few or don't dominate; of equal counts Y, then R."""
    best, second = F.greatest(red, amber, green), _second(red, amber, green)
    unknown = (best < least) | ((second > 0) & (best < second * dominance))
    return F.when(unknown, "?").when(amber == best, "Y").when(red == best, "R").otherwise("G")


def classify_phase(red: Column, amber: Column, green: Column) -> Column:
    """The looser thresholds used on smoothed counts."""
    return F.when((red >= 25) & (red > green * 1.5), "R").when((green >= 25) & (green > red * 1.5), "G").when((amber >= 18) & (amber > F.greatest(red, green)), "Y").otherwise("?")


def bright_counts(pixels: DataFrame) -> DataFrame:
    """By video and frame, bright red, amber and green pixels, and the state of a two-lamp head."""
    bright, h = (F.col("v") > 150) & (F.col("s") > 90), F.col("h")
    counts = pixels.groupBy("video_id", "frame").agg(
        F.count_if(bright & ((h <= 10) | h.between(170, 180))).alias("red"), F.count_if(bright & h.between(11, 30)).alias("amber"), F.count_if(bright & h.between(60, 95)).alias("green")
    )
    return counts.withColumn("ped", F.when(F.col("green") > F.col("red"), "G").otherwise("R"))


def classify_lamps(pixels: DataFrame, most_needed: int = 5, dominance: float = 2.0) -> DataFrame:
    """By video and frame, the state of a head of three lamps, one above the other: each slice counts only its own lamp's colour.

    The rows of a frame are cut into three slices, upper ones taking what is left over. A lamp needs one in a hundred of its
    slice's values (three a pixel), five at most, and must dominate the second if that reaches the least need.
    """
    n = F.max("row").over(W.partitionBy("video_id", "frame")) + 1
    base, rest = F.floor(F.col("n") / 3), F.col("n") % 3
    first = base + (rest > 0).cast("int")
    cut = pixels.withColumn("n", n).withColumn("slice", F.when(F.col("row") < first, 0).when(F.col("row") < first + base + (rest > 1).cast("int"), 1).otherwise(2))
    hues = _hues()
    counts = cut.groupBy("video_id", "frame").agg(
        *(F.count_if((F.col("slice") == i) & _lit() & hues[c]).alias(c) for i, c in enumerate("ryg")),
        *(F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(F.count_if(F.col("slice") == i) * 3 * 0.01))).alias(f"m{c}") for i, c in enumerate("ryg")),
    )
    best, second = F.greatest("r", "y", "g"), _second(F.col("r"), F.col("y"), F.col("g"))
    state = F.when(F.col("y") == best, F.struct(F.lit("Y").alias("s"), F.col("my").alias("m"))).when(F.col("r") == best, F.struct(F.lit("R").alias("s"), F.col("mr").alias("m"))).otherwise(F.struct(F.lit("G").alias("s"), F.col("mg").alias("m")))
    unknown = (best < state["m"]) | ((second >= F.least("mr", "my", "mg")) & (best < second * dominance))
    return counts.select("video_id", "frame", F.when(unknown, "?").otherwise(state["s"]).alias("state"))
