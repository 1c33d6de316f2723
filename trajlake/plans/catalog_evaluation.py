"""Queries of scores, run logs, checks and files, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.operators import checks, matching
from trajlake.operators.lookups import not_near_duplicates
from trajlake.plans import leads
from trajlake.plans.catalog_features import rounded
from trajlake.plans.catalog_labels import MATCH, RISK, rated
from trajlake.plans.catalog_leads import CTES as LEADS
from trajlake.plans.features import to_scene
from trajlake.plans.oracle import sql
from trajlake.sources import adapters, files, labels_json
from trajlake.sources.adapters import LABELS
from trajlake.sources.scene import crossroads

OFFICIAL = LABELS[:10]
SCENE = crossroads()


def _matches(s: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    return matching.match_segments(adapters.labels_gt(s, d), adapters.labels_pred(s, d) if found is None else found)


def _early(s: SparkSession, d: str) -> DataFrame:
    return adapters.labels_pred(s, d).filter("start < 150")


def _logs(s: SparkSession, d: str) -> DataFrame:
    """What the runs of most labelled videos report; some take too long."""
    rows = adapters.video_durations(s, d).filter("video_id % 10 <> 3")
    rows = rows.withColumns({"total_sec": F.expr("duration * (video_id % 8) * 0.5D"), "part_a_sec": F.expr("duration * (video_id % 8) * 0.375D"), "part_b_sec": F.expr("duration * (video_id % 8) * 0.125D")})
    return rows.withColumns({"budget_sec": F.expr("duration * 3"), "errors": F.expr("IF(video_id % 8 = 7, array('over time budget'), array())").cast("array<string>")})


def _documents(s: SparkSession, d: str) -> DataFrame:
    """Prediction documents as text, some of them broken."""
    docs = labels_json.predictions_to_json(adapters.labels_pred(s, d), adapters.risk(s, d).filter("video_id % 5 <> 2"), _logs(s, d), "a team")
    v = F.col("video").cast("long")
    value = F.when(v % 50 == 7, F.lit('{"team":"a team","videos":[]}')).when(v % 50 == 9, F.regexp_replace("value", '"events":\\[.*\\],"risk"', '"events":null,"risk"'))
    value = value.when(v % 50 == 11, F.regexp_replace("value", f'"videos":\\{{"', '"videos":{"a/')).when(v % 50 == 13, F.regexp_replace("value", '"team":"a team",', ""))
    return docs.select(F.coalesce(value, F.col("value")).alias("value"))


def _structure(s: SparkSession, d: str) -> DataFrame:
    truth = adapters.labels_gt(s, d).select(F.col("video_id").cast("string").alias("video")).distinct()
    return checks.structure_breaks(labels_json.structure(_documents(s, d)), truth)


def _predictions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions written to files and read again."""
    path = files.new_folder(s, "predictions")
    labels_json.predictions_to_json(adapters.labels_pred(s, d), adapters.risk(s, d), _logs(s, d), "a team").select("value").write.text(path)
    return labels_json.predictions_from_text(s.read.text(path))


def _track_cache(s: SparkSession, d: str) -> DataFrame:
    """Tracks of half the videos, then of all, written to a cache and read again."""
    path, tracks = files.new_folder(s, "tracks"), adapters.tracks(s, d)
    files.cache_tracks(tracks.filter("video_id % 2 = 0"), path)
    files.cache_tracks(tracks, path)
    return files.read_tracks(s, path, adapters.TRACKS)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    path = files.new_folder(s, "candidates")
    files.write_candidates(leads.leads(to_scene(adapters.tracks(s, d), SCENE, adapters.SOURCE_SIZE), SCENE), path)
    return files.read_candidates(s, path)


def _imported(s: SparkSession, d: str) -> DataFrame:
    """Events to import: labelled ones moved by little or more, and each of them twice."""
    rows = adapters.labels_numbered(s, d).filter("start < end").withColumn("by", F.expr("(idx % 5) * 0.02D"))
    rows = rows.withColumns({"start": F.col("start") + F.col("by"), "end": F.col("end") + F.col("by")}).drop("by")
    return rows.unionByName(rows.withColumns({"idx": F.col("idx") + 100_000_000, "start": F.col("start") + 0.03}))


def _renamed(ctes: dict[str, str], names: list[str]) -> dict[str, str]:
    """The expressions under other names, which they use for one another and for the names given."""
    all_ = "|".join([*ctes, *names])
    uses = re.compile(rf"(?:(?<=FROM )|(?<=JOIN )|(?<=, ))({all_})\b(?!\()|\b({all_})(?=\.)")
    return {f"{k}_b": uses.sub(lambda m: f"{m[0]}_b", v) for k, v in ctes.items()}


_rates = "tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_EARLY = _renamed({k: v for k, v in MATCH.items() if k != "taus"}, ["labels_pred"]) | {"labels_pred_b": "SELECT * FROM labels_pred WHERE start < 150"}
_ALIKE = _renamed({k: v for k, v in MATCH.items() if k != "taus"}, ["labels_pred", "labels_gt"]) | {f"labels_{x}_b": f"""SELECT video_id, start, "end", '' AS label FROM labels_{x}""" for x in ("gt", "pred")}
_ALIKE |= {"all_labels": "SELECT tau, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM pool GROUP BY tau", "micro": rated("all_labels")}
_IMPORTED = {
    "moved": """SELECT video_id, label, idx, start + (idx % 5) * 0.02::DOUBLE AS start, "end" + (idx % 5) * 0.02::DOUBLE AS "end" FROM numbered WHERE start < "end" """,
    "imported": """SELECT * FROM moved UNION ALL SELECT video_id, label, idx + 100000000, start + 0.03::DOUBLE, "end" FROM moved""",
    "fresh": """SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY idx) AS rn FROM imported n WHERE NOT EXISTS (SELECT 1 FROM labels_raw k
      WHERE k.video_id = n.video_id AND k.label = n.label AND abs(n.start - k.start) < 0.05 AND abs(n."end" - k."end") < 0.05)""",
    # A step looks at the next event of each video and label, which is kept unless it is near one in the list of those kept before.
    "looked": """SELECT video_id, label, idx, start, "end", rn, true AS keep, [{'s': start, 'e': "end"}] AS kept FROM fresh WHERE rn = 1 UNION ALL
      SELECT video_id, label, idx, start, "end", rn, keep, CASE WHEN keep THEN list_append(kept, {'s': start, 'e': "end"}) ELSE kept END FROM (
        SELECT n.*, l.kept, len(list_filter(l.kept, lambda k: abs(n.start - k.s) < 0.05 AND abs(n."end" - k.e) < 0.05)) = 0 AS keep
        FROM looked l JOIN fresh n ON n.video_id = l.video_id AND n.label = l.label AND n.rn = l.rn + 1) q""",
}
_official = ", ".join(f"'{x}'" for x in OFFICIAL)
_LOGS = {"logs": "SELECT *, duration * (video_id % 8) * 0.5 AS total_sec FROM video_durations WHERE video_id % 10 <> 3"}
_DOCS = {
    # Videos by what their document has: of 50, number 7 has no object of videos, 9 no events, 11 a path for a key, 13 no team.
    "named": "SELECT DISTINCT video_id AS v FROM (SELECT video_id FROM labels_pred UNION ALL SELECT video_id FROM risk WHERE video_id % 5 <> 2 UNION ALL SELECT video_id FROM video_durations WHERE video_id % 10 <> 3) n",
    "docs": """SELECT v, v % 50 AS k, CASE WHEN v % 50 = 7 THEN NULL WHEN v % 50 = 11 THEN 'a/' || v ELSE v::VARCHAR END AS video,
      v IN (SELECT video_id FROM risk WHERE video_id % 5 <> 2) AS curve FROM named""",
    "true_": "SELECT DISTINCT video_id::VARCHAR AS video FROM labels_gt",
}
QUERIES = {
    "metrics_table": (
        lambda s, d: rounded(matching.metrics_table(matching.pooled(_matches(s, d)))),
        sql(f"SELECT label, {_rates} FROM pooled WHERE tau = 0.5", **MATCH),
    ),
    "ablation_diff": (
        lambda s, d: rounded(matching.ablation(matching.pooled(_matches(s, d)), matching.pooled(_matches(s, d, _early(s, d))), "failure_to_yield")),
        sql(f"SELECT 'before' AS run, {_rates} FROM pooled WHERE tau = 0.5 AND label = 'failure_to_yield' UNION ALL SELECT 'after', {_rates} FROM pooled_b WHERE tau = 0.5 AND label = 'failure_to_yield'", **(MATCH | _EARLY)),
    ),
    "model_score": (
        lambda s, d: rounded(matching.model_score(matching.score_a(_matches(s, d)), matching.score_b(adapters.risk(s, d), adapters.labels_accident(s, d))), 5),
        sql("""SELECT round(a, 5) AS score_a, round(b, 5) AS score_b, round(0.7 * a + 0.3 * b, 5) AS model_score FROM (SELECT avg(f) AS a FROM (SELECT label, avg(f1) AS f FROM pooled GROUP BY label) x) y,
          (SELECT 0.4 * ap_over_chance + 0.4 * 2 * matched / (alarms + accidents) + 0.2 * least(1, mtta / 10) AS b
          FROM (SELECT count(*) AS accidents, count(*) FILTER (tta > 0) AS matched, avg(tta) AS mtta FROM ttas) x, (SELECT count(*) AS alarms FROM valid) z, ap_row) w""", **(MATCH | RISK)),
    ),
    "runtime_budget_use": (
        lambda s, d: rounded(checks.budget_use(_logs(s, d)), 5),
        sql("SELECT video_id, round(100 * total_sec / greatest(1, 3 * duration), 5) AS percent FROM logs", **_LOGS),
    ),
    "budget_gate": (
        lambda s, d: rounded(checks.within_budget(adapters.labels_pred(s, d), _logs(s, d)), 3),
        sql('SELECT video_id, label, round(start, 3) AS start, round("end", 3) AS "end" FROM labels_pred WHERE video_id NOT IN (SELECT video_id FROM logs WHERE total_sec > 3 * duration)', **_LOGS),
    ),
    "left_join_logs": (
        lambda s, d: rounded(checks.with_logs(adapters.video_durations(s, d), _logs(s, d)).withColumn("errors", F.array_join("errors", ",")), 4),
        sql("""SELECT v.video_id, round(v.duration, 4) AS duration, round(l.total_sec, 4) AS total_sec, round(l.total_sec * 0.75, 4) AS part_a_sec, round(l.total_sec * 0.25, 4) AS part_b_sec,
          CASE WHEN l.video_id % 8 = 7 THEN 'over time budget' ELSE '' END AS errors FROM video_durations v LEFT JOIN logs l USING (video_id)""", **_LOGS),
    ),
    "validate_structure": (
        _structure,
        sql("""SELECT NULL::VARCHAR AS video, 'error' AS level, 'shape' AS rule FROM docs WHERE k = 7
          UNION ALL SELECT video, 'error', 'path' FROM docs WHERE k = 11 UNION ALL SELECT video, 'error', 'events' FROM docs WHERE k = 9
          UNION ALL SELECT video, 'warning', 'risk' FROM docs WHERE k NOT IN (7, 9) AND NOT curve
          UNION ALL SELECT DISTINCT NULL, 'warning', 'team' FROM docs WHERE k = 13
          UNION ALL SELECT video, 'error', 'missing' FROM true_ WHERE video NOT IN (SELECT video FROM docs WHERE video IS NOT NULL)
          UNION ALL SELECT DISTINCT video, 'warning', 'extra' FROM docs WHERE video IS NOT NULL AND video NOT IN (SELECT video FROM true_)""", **_DOCS),
    ),
    "validate_labels": (
        lambda s, d: checks.label_breaks(adapters.labels_numbered(s, d), adapters.video_durations(s, d), LABELS[:12]),
        sql(f"""SELECT video_id, idx, unnest(list_filter([CASE WHEN NOT (start >= 0 AND start < "end" AND "end" <= duration) THEN 'time' END, CASE WHEN label IN ({", ".join(f"'{x}'" for x in LABELS[12:])}) THEN 'label' END,
          CASE WHEN start < before THEN 'order' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT *, lag(start) OVER (PARTITION BY video_id ORDER BY idx) AS before FROM numbered JOIN video_durations USING (video_id)) q
          UNION ALL SELECT DISTINCT a.video_id, a.idx, 'overlap' FROM numbered a JOIN numbered b ON a.video_id = b.video_id AND a.label = b.label AND b.idx < a.idx
            AND a.start < a."end" AND b.start < b."end" AND a."end" > b.start AND a.start < b."end" """),
    ),
    "set_diff_classes": (
        lambda s, d: checks.unofficial(adapters.labels_raw(s, d), OFFICIAL),
        sql(f"SELECT DISTINCT label FROM labels_raw WHERE label NOT IN ({_official})"),
    ),
    "near_duplicate_anti_join": (
        lambda s, d: rounded(not_near_duplicates(_imported(s, d), adapters.labels_raw(s, d)), 4),
        sql('SELECT video_id, label, idx, round(start, 4) AS start, round("end", 4) AS "end" FROM looked WHERE keep', **_IMPORTED),
    ),
    "confusion_pool": (
        lambda s, d: rounded(matching.pooled_all(adapters.labels_gt(s, d), adapters.labels_pred(s, d))),
        sql(f"SELECT 'class' AS kind, label, tau, {_rates} FROM pooled UNION ALL SELECT 'micro', NULL, tau, {_rates} FROM micro UNION ALL SELECT 'agnostic', NULL, tau, {_rates} FROM pooled_b", **(MATCH | _ALIKE)),
    ),
    "scan_predictions_json": (
        lambda s, d: rounded(_predictions(s, d)[0].filter("label IS NOT NULL"), 4),
        sql("""SELECT video_id::VARCHAR AS video, (row_number() OVER (PARTITION BY video_id ORDER BY start, "end", label) - 1)::INT AS i, round(start, 4) AS start, round("end", 4) AS "end", label FROM labels_pred"""),
    ),
    "sink_predictions_json": (
        lambda s, d: rounded(_predictions(s, d)[1], 6),
        sql("SELECT video_id::VARCHAR AS video, idx::INT AS i, round(t, 6) AS t, round(score, 6) AS score FROM risk"),
    ),
    "scan_logs_json": (
        lambda s, d: rounded(_predictions(s, d)[2].withColumn("errors", F.size("errors")), 4),
        sql("""SELECT video_id::VARCHAR AS video, round(duration, 4) AS duration, round(3 * duration, 4) AS budget_sec, round(total_sec * 0.75, 4) AS part_a_sec, round(total_sec * 0.25, 4) AS part_b_sec,
          round(total_sec, 4) AS total_sec, (video_id % 8 = 7)::INT AS errors FROM logs""", **_LOGS),
    ),
    "sink_tracks": (
        lambda s, d: rounded(_track_cache(s, d)),
        sql("SELECT video_id, frame, round(t, 6) AS t, id, cls, round(conf, 6) AS conf, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM tracks"),
    ),
    "sink_candidates": (lambda s, d: rounded(_candidates(s, d), 2), sql('SELECT video_id, kind, start, "end", track, cls, detail FROM found', **LEADS)),
}
QUERIES["confusion_pool_all"] = QUERIES["confusion_pool"]
QUERIES["scan_candidates"] = QUERIES["sink_candidates"]
