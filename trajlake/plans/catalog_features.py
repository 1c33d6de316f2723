"""Queries over track features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.plans.features import extract_features
from trajlake.plans.oracle import sql
from trajlake.sources import adapters
from trajlake.sources.files import materialize
from trajlake.sources.scene import crossroads


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as a table, as every rule reads some of its columns, and some rules several times."""
    return materialize(extract_features(adapters.tracks(spark, sf_dir), crossroads(), adapters.SOURCE_SIZE), "features")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# The names of the feature columns.
_COLUMNS = ["cx", "cy", "foot_x", "foot_y", "front_x", "front_y", "rear_x", "rear_y", "speed", "heading_rad", "stopline_signed", "front_stopline_signed"]
_KEEP = ["video_id", "id", "frame", "road_id", "lane_id", "crosswalk_id", "in_queue", "in_junction", "in_road"]


def q_extract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extract_features(adapters.tracks(spark, sf_dir), crossroads(), adapters.SOURCE_SIZE).select(*_KEEP, *_COLUMNS), 5)


QUERIES = {
    "scan_tracks": (lambda s, d: rounded(adapters.tracks(s, d)), sql("SELECT video_id, frame, round(t, 6) AS t, id, cls, round(conf, 6) AS conf, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM tracks")),
    "extract_features": (q_extract_features, sql("SELECT " + ", ".join(_KEEP + [f"round({c}, 5) AS {c}" for c in _COLUMNS]) + " FROM features")),
}
