"""Interval algebra: gaps and islands by scans in segments of time. Rules about equality at the gap are each operator's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajlake.sources.files import materialize


#: Seconds of a segment: what is ordered at once of a group.
SEGMENT = 600.0


def segment(t: str, width: float = SEGMENT) -> Column:
    return F.floor(F.col(t) / width)


def scanned(rows: DataFrame, keys: list[str], order: list, name: str, value: Column, how: str, before: bool = False, peers: bool = False) -> DataFrame:
    """rows with a running aggregate of value in a group's order: how is sum, max or last (the last that isn't null).

    With before, a row's own value isn't in; with peers, those of all rows that tie with it are, so that ties get one result
    however a sort leaves them.

    rows has __seg, a stretch of the order. Each stretch of a group is scanned on its own, its total is carried to those after it
    by a second pass over one row a stretch, and both are put together; so no task holds more than a stretch, or a group's list
    of stretches. Groups with null keys are groups. rows are read twice: give a table.
    """
    agg = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    in_order = W.partitionBy(*keys, "__seg").orderBy(*order)
    frame = in_order.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else in_order.rowsBetween(W.unboundedPreceding, -1 if before else 0)
    inner = agg(value).over(frame)
    if how == "last":
        place = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order))
        total = F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), place))
    else:
        total = agg(value)
    earlier = W.partitionBy(*keys).orderBy("__seg").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__seg").agg(total.alias("__total")).withColumn("__carry", agg("__total").over(earlier))
    totals = totals.select(*(F.col(c).alias(f"__k_{c}") for c in keys), F.col("__seg").alias("__k_seg"), "__carry")
    same = reduce(lambda a, b: a & b, [*(F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys), F.col("__seg") == F.col("__k_seg")])
    both = rows.withColumn("__inner", inner).join(totals, same, "left").drop(*(f"__k_{c}" for c in keys), "__k_seg")
    joined = {"sum": F.coalesce("__inner", F.lit(0)) + F.coalesce("__carry", F.lit(0)), "max": F.greatest("__inner", "__carry"), "last": F.coalesce("__inner", "__carry")}[how]
    return both.withColumn(name, joined).drop("__inner", "__carry")


def sample_step(rows: DataFrame, keys: list[str], fallback: float = 0.1) -> DataFrame:
    """keys and step: the median difference of a group's distinct times."""
    before = F.lag("t").over(W.partitionBy(*keys).orderBy("t"))
    diff = rows.select(*keys, "t").withColumn("before", before).withColumn("d", F.when(F.col("t") != F.col("before"), F.col("t") - F.col("before")))
    return diff.groupBy(*keys).agg(F.coalesce(F.expr("percentile(d, 0.5)"), F.lit(fallback)).alias("step"))


def mask_intervals(rows: DataFrame, keys: list[str], mask: Column, gap: float = 0.35, steps: DataFrame | None = None) -> DataFrame:
    """keys, start and end of runs of rows under mask: a row opens a new run if it lies over gap behind the last one's end.

    A run ends a sampling step after its last row. Rows that aren't under the mask count for the step but split nothing.
    steps has step by some of the keys, where it is known.
    """
    steps = sample_step(rows, keys) if steps is None else steps
    hits = rows.withColumn("hit", mask).filter("hit").select(*keys, "t").join(steps, [c for c in keys if c in steps.columns]).withColumn("__seg", segment("t"))
    hits = materialize(hits, "mask_hits")
    last = scanned(hits, keys, ["t"], "__last", F.col("t"), "max", before=True)
    new = F.when(F.col("t") - (F.col("__last") + F.col("step")) <= gap, 0).otherwise(1)
    runs = scanned(last.withColumn("__new", new), keys, ["t"], "run", F.col("__new"), "sum", peers=True)
    return runs.groupBy(*keys, "run").agg(F.min("t").alias("start"), (F.max("t") + F.first("step")).alias("end")).drop("run")


def _joined(rows: DataFrame, keys: list[str], opens) -> DataFrame:
    order = ["start", "end"]
    rows = materialize(rows.withColumn("__seg", segment("start")), "spans")
    reach = scanned(rows, keys, order, "__reach", F.col("end"), "max", before=True)
    new = F.when(F.col("__reach").isNull() | opens(F.col("start"), F.col("__reach")), 1).otherwise(0)
    runs = scanned(reach.withColumn("__new", new), keys, order, "run", F.col("__new"), "sum", peers=True)
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def merge_intervals(rows: DataFrame, keys: list[str], max_gap: float = 1.0, min_duration: float = 0.5) -> DataFrame:
    """Union of the intervals of a group that lie less than max_gap apart; those of min_duration at least stay."""
    merged = _joined(rows.filter(F.col("end") > F.col("start")).select(*keys, "start", "end"), keys, lambda start, reach: start - reach >= max_gap)
    return merged.filter(F.col("end") - F.col("start") >= min_duration)


def merge_events(events: DataFrame, duration: Column, max_gap: float = 1.0, min_duration: float = 0.5) -> DataFrame:
    """Events cut to a video's duration and merged by label."""
    cut = events.select("video_id", "label", F.greatest(F.lit(0.0), F.col("start")).alias("start"), F.least(duration, F.col("end")).alias("end"))
    return merge_intervals(cut, ["video_id", "label"], max_gap, min_duration)


def touching_merge(rows: DataFrame, keys: list[str], duration: float) -> DataFrame:
    """Intervals cut to 0..duration, merged also where they only touch, to 2 decimals."""
    cut = rows.select(*keys, F.greatest(F.lit(0.0), F.col("start")).alias("start"), F.least(F.lit(duration), F.col("end")).alias("end")).filter("end > start")
    merged = _joined(cut, keys, lambda start, reach: start > reach)
    return merged.select(*keys, F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


def hit_segments(rows: DataFrame, keys: list[str], mask: Column, max_gap: float = 0.4, min_duration: float = 0.2) -> DataFrame:
    """Runs of rows under mask at most max_gap apart, from the first to the last, of min_duration at least; 2 decimals."""
    by = W.partitionBy(*keys).orderBy("t")
    hits = rows.withColumn("hit", mask).filter("hit").select(*keys, "t")
    new = hits.withColumn("new", F.when(F.col("t") - F.lag("t").over(by) <= max_gap, 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    found = runs.groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("run")
    return found.filter(F.col("end") - F.col("start") >= min_duration).select(*keys, F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


def alarm_runs(curve: DataFrame, threshold: float = 0.5, max_gap: float = 2.0) -> DataFrame:
    """video_id, start and end of alarms: unbroken samples at the threshold or above, those less than max_gap apart joined."""
    by = W.partitionBy("video_id").orderBy("t", "idx")
    high = F.col("score") >= threshold
    marked = curve.withColumn("high", high).withColumn("new", F.when(high & ~F.coalesce(F.lag(high).over(by), F.lit(False)), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0))).filter("high")
    spans = runs.groupBy("video_id", "run").agg(F.min("t").alias("start"), F.max("t").alias("end")).drop("run")
    return _joined(spans, ["video_id"], lambda start, reach: start - reach >= max_gap)


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals, 0 if the union is empty."""
    inter = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], width: float, at: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of points and spans that agree in keys and in which the point lies in the span, ends included.

    A span goes to the one or two cells that it touches on the level where cells are as long as it is, cells being width long on the
    lowest level and four times longer on each further one. A point is looked up in its cell on every level that any span has.
    So a span makes two rows at most however long it is, and each pair meets once. spans are read twice: give a table.
    """
    length = F.col(end) - F.col(start)
    level = F.when(length > width, F.ceil(F.log(4.0, length / width))).otherwise(0).cast("int")
    cell = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(4.0), F.col("__level"))))
    levels = spans.agg(F.collect_set(level)).scalar()
    p = points.withColumn("__level", F.explode(levels)).withColumn("__cell", cell(at))
    s = spans.withColumn("__level", level).withColumn("__cell", F.explode(F.sequence(cell(start), cell(end))))
    return p.join(s, [*keys, "__level", "__cell"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__level", "__cell")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, how: str = "inner", closed: bool = False) -> DataFrame:
    """Pairs, or with left_semi the left rows, of intervals that overlap and agree in keys; the right side's columns get r_.

    Of two that overlap, the one that begins later begins in the other; so each side's starts are looked up in the other side's
    intervals, and each pair meets once. width is about the length of most intervals; longer ones cost no more.
    """
    names = [c for c in right.columns if c not in keys]
    left = materialize(left.withColumn("__id", F.monotonically_increasing_id()), "left_spans")
    right = materialize(right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in names)), "right_spans")
    later_right = point_join(right, left, keys, width, "r_start").filter("r_start >= start")
    later_left = point_join(left, right, keys, width, "start", "r_start", "r_end").filter("start > r_start")
    both = later_right.unionByName(later_left)
    both = both.filter((F.least("end", "r_end") >= F.greatest("start", "r_start")) if closed else (F.least("end", "r_end") > F.greatest("start", "r_start")))
    if how == "left_semi":
        both = both.dropDuplicates(["__id"]).select(*left.columns)
    return both.drop("__id")
