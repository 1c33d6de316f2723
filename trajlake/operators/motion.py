"""Motion and summaries of tracks, by windows over a track's rows in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.functions import geometry as geo
from trajlake.functions.intervals import hit_segments, sample_step
from trajlake.sources.scene import Points

TRACK = ["video_id", "id"]
_by = lambda: W.partitionBy(*TRACK).orderBy("t", "frame")


def steps(tracks: DataFrame) -> DataFrame:
    return sample_step(tracks, TRACK)


def _since(c: str, n: int = 10):
    return F.col(c) - F.lag(c, n).over(_by())


def lagged_speed(rows: DataFrame, n: int = 10) -> DataFrame:
    """Adds v, the speed of the foot point since the nth row before; null where there is none."""
    dx, dy = _since("cx", n), _since("foot_y", n)
    return rows.withColumn("v", F.sqrt(dx * dx + dy * dy) / _since("t", n))


def projected_velocity(rows: DataFrame, direction: tuple[float, float], n: int = 10) -> DataFrame:
    """Adds v, the speed along a direction since the nth row before."""
    return rows.withColumn("v", (_since("cx", n) * F.lit(direction[0]) + _since("foot_y", n) * F.lit(direction[1])) / _since("t", n))


def slow_segments(rows: DataFrame) -> DataFrame:
    return hit_segments(lagged_speed(rows), TRACK, F.col("v") < 5, 0.5, 1.0)


def track_summary(rows: DataFrame) -> DataFrame:
    """By track: its most frequent class (of equals the least), rows, times, displacement and median speed."""
    at = F.struct("t", "frame")
    dx, dy = (F.max_by(c, at) - F.min_by(c, at) for c in ("cx", "cy"))
    return rows.groupBy(*TRACK).agg(F.mode("cls", True).alias("cls"), F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.sqrt(dx * dx + dy * dy).alias("displacement"), F.expr("percentile(speed, 0.5)").alias("speed"))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"__i": F.row_number().over(_by()) - 1, "__n": F.count("*").over(W.partitionBy(*TRACK))})


def quantile_rows(rows: DataFrame) -> DataFrame:
    """Of each track the first and last row and those at the quarters between."""
    return _numbered(rows).filter(F.expr("__i IN (0, __n div 4, __n div 2, 3 * __n div 4, __n - 1)")).drop("__i", "__n")


def every_kth(rows: DataFrame, k: int) -> DataFrame:
    """About k rows of each track, evenly spaced from the first."""
    return _numbered(rows).filter(F.expr(f"__i % greatest(1, __n div {int(k)}) = 0")).drop("__i", "__n")


def density_grid(rows: DataFrame, size: tuple[int, int], cell: int = 60) -> DataFrame:
    """row, col and density (share of the fullest cell, 3 decimals) of the foot points within the frame."""
    w, h = size
    inside = rows.filter(F.col("cx").between(0, w) & F.col("foot_y").between(0, h))
    place = lambda c, n: F.least(F.lit(n // cell - 1), F.floor(F.col(c) / cell)).cast("int")
    cells = inside.groupBy(place("foot_y", h).alias("row"), place("cx", w).alias("col")).agg(F.count("*").alias("n"))
    return cells.select("row", "col", F.round(F.col("n") / F.greatest(F.lit(1), F.max("n").over(W.partitionBy())), 3).alias("density"))


def queue_series(rows: DataFrame, queue: Points) -> DataFrame:
    """By second, vehicles in the queue and how many of them stand (nine slow samples count as one)."""
    moving = lagged_speed(rows.filter("cls <> 0")).filter(geo.inside(F.col("cx"), F.col("foot_y"), queue))
    return moving.groupBy("video_id", F.bround("t").cast("long").alias("sec")).agg(F.count_distinct("id").alias("total"), F.expr("count_if(v < 5) div 9").alias("stationary"))
