"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Each document of a source expects target / source size copies. Documents are laid end to end by those expectations, the
long ones of a source first, moved by one offset a source, and a document is taken once for each integer it crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.llm._shared import materialize

WEIGHTS = (3, 1, 2)


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds each source's target: share of all sizes by weight, at most cap times its own, the excess shared again.

    sources has a row a source, so the windows over all of it are as small as the list of sources. The sources that stop at
    their cap are the first ones by cap / weight, hence one pass of running sums finds the level at which the rest share.
    """
    listed = sources.withColumn("ordinal", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "ordinal")
    before, every = by_level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - so_far("most")) / (F.sum("weight").over(every) - so_far("weight"))
    levels = listed.withColumn("level", level).withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    shared = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), "ordinal"))).over(every)
    return levels.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * shared)).select("source", "source_size", "n_docs", "target")


def _offset(source: F.Column) -> F.Column:
    """From 0 to 1, a fixed one for each source."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, and copies, how often the mix takes it.

    Size is the number of words of the whole text; null or empty text has size 0 and may be taken, as 0 words. A null source
    is a source, the last. Documents of a source and size are in the order of doc_id, null first; rows equal in all of it
    share out their copies in any order, which changes no row of the result. No rows give no rows. Other columns are ignored.
    """
    return _mixed(materialize(_sized(docs), "mix_sizes")).drop("__row")


def _sized(docs: DataFrame, *more: F.Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *more)


def _mixed(sized: DataFrame) -> DataFrame:
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id").asc_nulls_first()]
    spread = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(spread, "mix_order").withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    # A row for each partition: how many rows stand before it. One for each source: how many stand in other sources before it.
    parts = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    sources = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    sources = sources.withColumn("__first", F.coalesce(F.sum("n_docs").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sources = materialize(sources, "mix_sources")  # so that the join sees how small it is
    sources = sources.select(F.col("source").alias("__source"), "source_size", "target", "__first")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("__at") + F.col("__before") - F.col("__first")
    crossed = F.floor((rank + 1) * F.col("__ratio") + F.col("__offset")) - F.floor(rank * F.col("__ratio") + F.col("__offset"))
    return (
        placed.join(F.broadcast(parts), "__part")  # as many rows as the shuffle has partitions
        .join(sources, F.col("source").eqNullSafe(F.col("__source")))
        .withColumns({"__ratio": ratio, "__offset": _offset(F.col("source"))})
        .withColumn("copies", F.least(crossed, F.ceil("__ratio")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(c for c in sized.columns if c == "__row"))
    )


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents, all columns, as many times as mix() takes each; mix_copy counts from 1.

    A column named mix_copy is replaced. Otherwise as for mix().
    """
    kept = [c for c in docs.columns if c != "mix_copy"]
    mixed = _mixed(_sized(docs, F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"))).filter(F.col("copies") > 0)
    return mixed.select("__row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT *, most <= level * weight AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE weight * (SELECT arg_min(level, (most / weight, k)) FROM c WHERE NOT capped) END AS target FROM c),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
  ('0x' || substr(md5(coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
  row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(n * ratio + u) - floor((n - 1) * ratio + u), ceil(ratio)) * size)::BIGINT AS taken FROM r
"""
