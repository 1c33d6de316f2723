"""Structured Streaming over event tables: counts by window, and sessions of a key.

In append mode a window is told when the watermark has passed its end; rows that are later than the watermark are dropped and
the state of closed windows goes. In complete mode all windows are kept and told each time, and no row is late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.sources.files import materialize, new_folder
from trajlake.streaming.ordered import PROVIDER


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n and total value of each window."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """user_id, start, end and n of each user's sessions: events less than the gap apart (or just the gap, which merges)."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sketched_counts(rows: DataFrame, keys: list[str], member: str, width: str = "1 second", late: str = "10 seconds", lg_k: int = 12) -> DataFrame:
    """keys, start and sketch of each window of a stream: a HyperLogLog sketch of its distinct members, told in append mode.

    State is a sketch of a few KB at most for each window that is open, however many members it has.
    """
    by = rows.withWatermark("ts", late).filter(F.col(member).isNotNull() | F.col("ts").isNull()).groupBy(*keys, F.window("ts", width).alias("w"))
    return by.agg(F.hll_sketch_agg(member, lg_k).alias("sketch")).select(*keys, F.col("w.start").alias("start"), "sketch")


def rolled_up(sketches: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """keys, start and members: the estimate of distinct members of several windows, from their sketches alone.

    With lg_k of 12 the standard error is 1.6 % (1.04 / 64); few members, up to some hundreds, are counted nearly exactly.
    """
    return sketches.groupBy(*keys, start.alias("start")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("members"))


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Drive a stream over what is there and return its result as a table of the shared folder.

    Each batch replaces (complete) or adds its own folder, so a batch that is run again after a failure is written once.
    """
    out = new_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    schema, provider = stream.schema, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, PROVIDER)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(schema).parquet(f"{out}/rows").select(*schema.names)


#: Microseconds at which a feed begins (2020-01-01): a time of 0 would be late before the first watermark.
_BEGIN = 1_577_836_800_000_000
BEGIN_SECONDS = _BEGIN // 1_000_000


def at_time(t: str) -> Column:
    """The time of an event from its seconds since the feed's beginning."""
    return F.timestamp_micros(F.lit(_BEGIN) + F.round(F.col(t) * 1_000_000).cast("long"))


#: Rows of a stretch for which it gets another file.
_FILE_ROWS = 10_000


def as_stream(rows: DataFrame, seconds: float, t: str = "t", swap: bool = False) -> DataFrame:
    """A stream of rows with ts, the time that t tells, from the files of a stretch of so many seconds, one stretch a batch.

    Stretches are counted from 0, so feeds of the same seconds go on together. A last file has a row without values three hours
    later, as other cameras would send it, which moves the watermark past all rows. With swap, stretches 1 and 2, 3 and 4, ...
    change places for every other row, as rows of a bad connection come late or early.

    All stretches have the same number of files, as a batch is so many: one for each 10,000 rows of the smallest stretch, but no
    more than a shuffle has partitions. Then rows dealt out in turn leave no file empty.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "feed")
    rows = rows.withColumn("ts", at_time(t))
    schema, stretch = rows.schema, F.floor(F.col(t) / seconds).cast("long")
    if swap:
        stretch = F.when((stretch > 0) & (F.crc32(F.col(t).cast("string")) % 2 == 0), stretch + F.when(stretch % 2 == 1, 1).otherwise(-1)).otherwise(stretch)
    rows = materialize(rows.withColumn("__stretch", stretch), "feed_rows", "__stretch")
    sizes = {r[0]: r[1] for r in rows.filter("__stretch >= 0").groupBy("__stretch").agg(F.count("*")).collect()}
    last = rows.agg(F.max(t)).first()[0]
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sizes.values(), default=0) // _FILE_ROWS))
    for k in range(max(sizes, default=-1) + 1):
        # A stretch without rows is a batch without any: files of no rows, one by one.
        for part in [rows.filter(F.col("__stretch") == k).repartition(files)] if k in sizes else [spark.createDataFrame([], schema)] * files:
            (part if files > 1 and k in sizes else part.coalesce(1)).select(*schema.names).write.mode("append").parquet(path)
    beat = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "ts"), F.timestamp_micros(F.lit(_BEGIN + int(((last or 0) + 10_800) * 1_000_000))).alias("ts"))
    beat.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
