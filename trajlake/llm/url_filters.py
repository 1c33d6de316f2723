"""URL filters with dates: list entries become validity intervals, and each capture meets those active at its fetch time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.llm._shared import materialize


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, valid_from and valid_to (null: still active) from dated entries (pattern, action, since).

    An entry holds from its date to the next one of its pattern; only those that add are active. Of entries with the same
    pattern and date one that removes counts. Entries without a pattern or date, or with another action, are ignored.
    """
    known = entries.filter(F.col("pattern").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("add", "remove"))
    dated = known.groupBy("pattern", "since").agg(F.max("action").alias("action"))
    held = dated.withColumn("valid_to", F.lead("since").over(W.partitionBy("pattern").orderBy("since")))
    return held.filter(F.col("action") == "add").select("pattern", F.col("since").alias("valid_from"), "valid_to")


def host_of(url: F.Column) -> F.Column:
    """The host in lower case, without port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.when(host != "", host)


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, blocked, n_entries and pattern of captures (page_id, url, fetched).

    An entry matches a host that equals its pattern or ends in a dot and the pattern. n_entries counts the matching entries
    active at the fetch time (from its valid_from on, before its valid_to), pattern is the longest one's.

    A null url, one without a host, or a null fetch time matches nothing. Null page_ids and repeated rows are rows of their
    own. No entries block nothing, no captures give no rows. Other columns are ignored.
    """
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    active = materialize(intervals(entries), "list_intervals")
    # Verdicts are the same for captures of a host at a time, so those are joined once, and one host's captures not at all.
    asked = rows.filter("host IS NOT NULL AND fetched IS NOT NULL").select("host", "fetched").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = asked.select("host", "fetched", F.explode(suffix).alias("pattern"))
    met = keyed.join(active, "pattern").filter("fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)")
    found = met.groupBy("host", "fetched").agg(F.count("*").alias("n_entries"), F.max_by("pattern", F.length("pattern")).alias("pattern"))
    able = F.col("host").isNotNull() & F.col("fetched").isNotNull()
    unable = rows.filter(~able).withColumns({"n_entries": F.lit(None).cast("long"), "pattern": F.lit(None).cast("string")})
    judged = rows.filter(able).join(found, ["host", "fetched"], "left").unionByName(unable)
    return judged.select("page_id", "host", "fetched", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "pattern")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time or list: fetches are an hour of page_id apart, over a year, and every host of pages is listed
    from a day given by its length, off for some weeks after, and on again; hosts without a www or m label list all below."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    after = lambda days: start + F.make_dt_interval(days)
    captures = pages.select("page_id", "url", (start + F.make_dt_interval((F.col("page_id") % 366).cast("int"), (F.col("page_id") % 24).cast("int"))).alias("fetched"))
    hosts = pages.select(F.regexp_replace(host_of(F.col("url")), r"^(www|m)\.", "").alias("pattern")).filter("pattern IS NOT NULL").distinct()
    n = F.length("pattern")
    entries = hosts.select("pattern", F.explode(F.array(
        F.struct(F.lit("add").alias("action"), after(n * 3).alias("since")),
        F.struct(F.lit("remove").alias("action"), after(n * 3 + 40).alias("since")),
        F.struct(F.lit("add").alias("action"), after(n * 9).alias("since")),
    )).alias("e")).select("pattern", "e.*")
    return url_filter(captures, entries)


SQL = r"""
WITH h AS (SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '') AS host,
  TIMESTAMP '2024-01-01' + to_days((page_id % 366)::INT) + to_hours(page_id % 24) AS fetched FROM pages),
p AS (SELECT DISTINCT regexp_replace(host, '^(www|m)\.', '') AS pattern FROM h WHERE host IS NOT NULL),
e AS (SELECT pattern, 'add' AS action, TIMESTAMP '2024-01-01' + to_days((length(pattern) * 3)::INT) AS since FROM p
  UNION ALL SELECT pattern, 'remove', TIMESTAMP '2024-01-01' + to_days((length(pattern) * 3 + 40)::INT) FROM p
  UNION ALL SELECT pattern, 'add', TIMESTAMP '2024-01-01' + to_days((length(pattern) * 9)::INT) FROM p),
g AS (SELECT pattern, since, max(action) AS action FROM e GROUP BY pattern, since),
i AS (SELECT pattern, action, since AS valid_from, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS valid_to FROM g),
m AS (SELECT h.page_id, count(*) AS n, arg_max(i.pattern, length(i.pattern)) AS pattern FROM h JOIN i ON (h.host = i.pattern OR ends_with(h.host, '.' || i.pattern))
  AND i.action = 'add' AND h.fetched >= i.valid_from AND (i.valid_to IS NULL OR h.fetched < i.valid_to) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.fetched, m.n IS NOT NULL AS blocked, coalesce(m.n, 0)::BIGINT AS n_entries, m.pattern FROM h LEFT JOIN m ON m.page_id = h.page_id
"""
