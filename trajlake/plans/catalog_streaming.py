"""Queries that run as streams to the end of their input, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.plans import reviews
from trajlake.plans.catalog_features import _COLUMNS, _KEEP, rounded
from trajlake.plans.catalog_features import QUERIES as FEATURES
from trajlake.plans.catalog_labels import RISK
from trajlake.plans.catalog_reviews import CTES as REVIEWS
from trajlake.plans.catalog_reviews import STOP, _rows
from trajlake.plans.catalog_risk import CTES as SCORES
from trajlake.plans.oracle import sql
from trajlake.sources import adapters
from trajlake.sources.scene import crossroads
from trajlake.streaming import counts, state


def _signals(s: SparkSession, d: str) -> DataFrame:
    return counts.as_stream(adapters.signals(s, d).select("video_id", "t", "state"), 6.0)


def _tracks(s: SparkSession, d: str) -> DataFrame:
    """Detections, some of them a stretch late or early."""
    return counts.as_stream(adapters.tracks(s, d), 6.0, swap=True)


def _samples(s: SparkSession, d: str) -> DataFrame:
    return counts.as_stream(adapters.signals(s, d).select("video_id", "frame", "t", "state"), 6.0)


def _sightings(s: SparkSession, d: str) -> DataFrame:
    """Of every third frame or so, a while at each detection in which its class counts as seen; times in quarters of a second."""
    rows = adapters.tracks(s, d).filter("frame % 5 < 2 AND id % 3 = 0").select("video_id", F.col("cls").alias("kind"), F.expr("(frame div 3) * 0.25D").alias("start"), F.expr("(frame div 3) * 0.25D + 0.25D + id % 4 * 0.25D").alias("end"))
    return counts.as_stream(rows, 12.0, "start", swap=True)


def _crossings(s: SparkSession, d: str) -> DataFrame:
    return counts.as_stream(reviews.side_crossings(_rows(s, d), *STOP), 6.0)


def _told(stream: DataFrame, s: SparkSession) -> DataFrame:
    return rounded(counts.run_to_end(stream, s, "append"), 5)


QUERIES = {
    "stream_tumbling_counts": (
        lambda s, d: counts.run_to_end(counts.tumbling_counts(counts.read_events(s, d)), s, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total")),
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
    "stream_sessions": (
        lambda s, d: counts.run_to_end(counts.sessions(counts.read_events(s, d)), s, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n")),
        "SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS n FROM (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events) x GROUP BY user_id",
    ),
    "stream_change_points": (
        lambda s, d: _told(state.change_points(_signals(s, d)), s),
        sql("SELECT video_id, round(t, 5) AS t, state FROM (SELECT *, lag(state) OVER (PARTITION BY video_id ORDER BY t) AS before FROM signals) x WHERE before IS DISTINCT FROM state"),
    ),
    "stream_alarms": (
        lambda s, d: _told(state.alarms(counts.as_stream(adapters.risk(s, d).select("video_id", "t", "score"), 16.0)), s),
        sql("SELECT video_id, round(start, 5) AS t FROM alarms", **RISK),
    ),
    "stream_features": (
        lambda s, d: rounded(counts.run_to_end(state.stream_features(_tracks(s, d), crossroads(), adapters.SOURCE_SIZE), s, "append").select(*_KEEP, *_COLUMNS), 5),
        FEATURES["extract_features"][1],
    ),
    "stream_risk": (
        lambda s, d: _told(state.stream_risk(_tracks(s, d), _samples(s, d), crossroads(), adapters.SOURCE_SIZE), s),
        sql("""SELECT g.video_id, g.frame, round(g.t, 5) AS t, round(coalesce(s.score * exp(-(g.t - s.t) / 1.5), 0), 5) AS score
          FROM signals g ASOF LEFT JOIN scored s ON s.video_id = g.video_id AND s.t <= g.t""", **SCORES),
    ),
    "stream_sightings": (
        lambda s, d: counts.run_to_end(state.sessions_of(_sightings(s, d), ["video_id", "kind"], 0.5, "15 seconds"), s, "append"),
        sql("""SELECT video_id, kind, min(start) AS start, max("end") AS "end", count(*) AS n FROM (
            SELECT *, sum(CASE WHEN start - reach < 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id, kind ORDER BY start, "end", id) AS run FROM (
              SELECT *, max("end") OVER (PARTITION BY video_id, kind ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
                SELECT video_id, cls AS kind, id, (frame // 3) * 0.25::DOUBLE AS start, (frame // 3) * 0.25::DOUBLE + 0.25 + id % 4 * 0.25 AS "end" FROM tracks WHERE frame % 5 < 2 AND id % 3 = 0) s0) s1) s2
          GROUP BY video_id, kind, run"""),
    ),
    "stream_signal_join": (
        lambda s, d: _told(state.signals_near(_crossings(s, d), _signals(s, d)), s),
        sql("SELECT c.video_id, c.id, round(c.t, 5) AS t, round(g.t, 5) AS s_t, g.state FROM crossed c JOIN signals g ON g.video_id = c.video_id AND g.t BETWEEN c.t - 0.18 AND c.t + 0.18", **REVIEWS),
    ),
}
