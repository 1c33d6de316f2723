"""Files of the library: the cache of tracks, lists of candidates, and what videos a folder holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATES = "video_id long, kind string, start double, end double, track long, cls int, detail string"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it may be unset, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: what several jobs read is computed once, and survives a lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tracks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tracks from a cache, of which each video is a folder; filters on video_id read no other one's files."""
    return spark.read.schema(schema).parquet(path)


def _finished(path: str) -> str:
    return path.rstrip("/") + "-finished"


def cached_videos(spark: SparkSession, path: str) -> DataFrame:
    """video_id of the videos that a cache has in full, by its list of finished ones; none where there is no cache."""
    try:
        return spark.read.schema("video_id long").parquet(_finished(path)).distinct()
    except AnalysisException:
        return spark.createDataFrame([], "video_id long")


def cache_tracks(tracks: DataFrame, path: str, overwrite: bool = False) -> None:
    """Add to a cache the tracks of the videos that it lacks, or with overwrite of all that tracks has. A large video may be several
    files.

    The folders of the videos written are replaced as the job ends, others stay. Only then do the videos join the list of finished
    ones, so what a failed job has left counts as missing, and is replaced by the next one.
    """
    spark = tracks.sparkSession
    rows = tracks if overwrite else tracks.join(cached_videos(spark, path), "video_id", "left_anti")
    rows = materialize(rows, "tracks_to_cache")  # the list must name what was written
    spread = rows.repartition("video_id", F.floor(F.col("frame") / 100_000)).sortWithinPartitions("video_id", "frame")
    spread.write.partitionBy("video_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    rows.select("video_id").distinct().coalesce(1).write.mode("append").parquet(_finished(path))


def write_candidates(found: DataFrame, path: str) -> None:
    """Candidates as CSV files with a header."""
    found.select(*(f.split()[0] for f in CANDIDATES.split(", "))).write.option("header", True).csv(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDIDATES).option("header", True).option("enforceSchema", False).csv(path)


def list_videos(spark: SparkSession, folder: str, ending: str = "mp4") -> DataFrame:
    """path and name of the files in a folder with the ending, in either case, by lower-case name; their content isn't read."""
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{either}").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.distinct().withColumn("name", name).orderBy(F.lower("name"), "name")
