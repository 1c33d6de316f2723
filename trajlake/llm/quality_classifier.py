"""Quality classifier: a Bradley-Terry model of which of two documents is better, learned from labelled pairs.

A document's score is linear in features of its whole text. A pair of a good and a bad document is a preference; the loss is
the logistic one on the difference of their features, summed over pairs by Spark at each Newton step. The threshold is the
quantile of the labelled documents' scores at their share of bad ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import materialize
from trajlake.llm.quality_rules import _SYMBOL, _repeats

#: Rows whose pairs are made together, partners of a row, Newton steps, ridge, and the score at the threshold.
GROUP, PARTNERS, STEPS, RIDGE, AT_THRESHOLD = 4096, 4, 8, 1e-3, 0.3
#: How many rows of the rarer kind a group has on average, if there are that many; the odds of a group without any are below 1e-13.
RARE = 32

_UPPER = _text._class(lambda b: 65 <= b <= 90)
_DIGIT = _text._class(lambda b: 48 <= b <= 57)
_STOP = _text._class(lambda b: chr(b) in "!?")
_LETTER = _text._class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_LEAD = _text._class(lambda b: not 0x80 <= b < 0xC0)
N_FEATURES = 22


def _features(texts: pa.Array) -> np.ndarray:
    """A row of features a text; shares come with their square roots, as a little junk already matters."""
    data, bounds = _text.raw(texts)
    low = _text.LOWER[data]
    starts, ends, first = _text.spans(low, bounds, _text.NOT_SPACE)
    owner, words = _text.owners(first), _text.hashes(low, starts, ends)
    n = np.maximum(1, np.diff(first)).astype(float)
    chars = np.maximum(1, _text.counted((_LEAD & _text.NOT_SPACE)[data], bounds)).astype(float)
    shares = [_text.counted(kind[data], bounds) / chars for kind in (_SYMBOL, _UPPER, _DIGIT, _STOP, ~_LETTER & _text.NOT_SPACE)]
    order, same = _repeats(words, owner)
    distinct = (np.diff(first) - np.bincount(owner[order[same]], minlength=len(n))) / n
    next_same = np.zeros(len(words), bool)
    next_same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    runs = _text.windows(words, 5)
    inside = np.flatnonzero(owner[: len(runs)] == owner[4:]) if len(runs) else np.zeros(0, np.int64)
    order, same = _repeats(runs[inside], owner[inside])
    twice = same.copy()
    twice[:-1] |= same[1:]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    lead = np.concatenate([[0], np.cumsum(_LEAD[data])])
    lengths = lead[ends] - lead[starts]
    shares += [
        _text.counted(next_same, first) / n,
        _text.counted(_text.covered(inside[order[twice]], 5, len(words)), first) / n,
        _text.counted(letters[ends] == letters[starts], first) / n,
        _text.counted(lengths <= 3, first) / n,
    ]
    columns = [*shares, *(np.sqrt(x) for x in shares), np.log1p(np.diff(first)), np.log(chars / n), np.sqrt(distinct), np.log1p(_text.counted(data == 10, bounds))]
    return np.stack(columns, 1)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            x = _features(piece.column("text"))
            at = pa.array(np.arange(0, x.size + 1, N_FEATURES).astype(np.int32))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, x array<double>")


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the pairs' loss at w, and their number; x: differences, good less bad."""
    p = 1 / (1 + np.exp(np.clip(x @ w, -50, 50)))
    return np.concatenate([-(x * p[:, None]).sum(0), (x.T @ (x * (p * (1 - p))[:, None])).ravel(), [len(x)]])


def _step(mean: np.ndarray, spread: np.ndarray, w: np.ndarray):
    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", key=lambda c: pd.util.hash_array(c.to_numpy()))
        x = (np.stack(rows["x"]) - mean) / spread
        good, bad = x[rows["quality"] == 1], x[rows["quality"] == 0]
        total = np.zeros(N_FEATURES * (N_FEATURES + 1) + 1)
        if len(good) and len(bad):
            few, many, sign = (good, bad, 1) if len(good) <= len(bad) else (bad, good, -1)
            i = np.arange(max(len(many), min(PARTNERS, len(many)) * len(few)))
            at = i % len(many)  # each round over the commoner kind moves on by one of the rarer, so no pair comes twice
            total = _sums(sign * (few[(at + i // len(many)) % len(few)] - many[at]), w)
        return pd.DataFrame({"i": np.arange(len(total)), "v": total})

    return step


def _each(table: DataFrame) -> DataFrame:
    """A row for each of a row's copies, numbered from 1 by copy."""
    return table.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))


def deal(table: DataFrame, n: int, good: int) -> DataFrame:
    """table (doc_id, x, quality, copies) with g: its n rows, of which good are, in groups of about GROUP that have both kinds.

    The commoner kind is dealt into groups by a hash. The rarer one is dealt into parts of about RARE rows, and each part joins
    every group whose number leaves its own; so a rare row may meet several groups, and what is shuffled for it stays below
    RARE rows a group. Copies of a row are dealt one by one, so none makes a group large.
    """
    groups, rarer = max(1, round(n / GROUP)), 1 if good <= n - good else 0
    parts = min(groups, max(1, min(good, n - good) // RARE))
    each = _each(table).withColumn("h", F.xxhash64("doc_id", "copy"))
    part = F.pmod("h", F.lit(parts).cast("long"))
    of = F.when(F.col("quality") == rarer, F.sequence(part, F.lit(groups - 1).cast("long"), F.lit(parts).cast("long")))
    return each.withColumn("g", F.explode(F.coalesce(of, F.array(F.pmod("h", F.lit(groups).cast("long")))))).drop("copy", "copies", "h")


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean and spread of the features, weights and threshold, from rows (doc_id, x, quality).

    Rows are dealt into groups with both kinds, see deal(); in a group each row of the rarer kind meets about
    PARTNERS of the other, or more, so that each of these is met once. Rows that repeat count each time. Only sums go to the driver.
    """
    known = labelled.filter(F.col("quality").isin(0, 1)).select("doc_id", "x", F.col("quality").cast("int").alias("quality"))
    table = materialize(known.groupBy("doc_id", "x", "quality").agg(F.count("*").alias("copies")), "labelled")
    n, good = table.agg(F.sum("copies"), F.sum(F.col("quality") * F.col("copies"))).first()
    if not n or good in (0, n):
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0
    at = [F.col("x")[i] for i in range(N_FEATURES)]
    mean = np.array(table.agg(*(F.sum(x * F.col("copies")) for x in at)).first()) / n
    spread = np.sqrt(np.array(table.agg(*(F.sum((x - float(m)) * (x - float(m)) * F.col("copies")) for x, m in zip(at, mean, strict=True))).first()) / n)
    spread = np.where(spread > 1e-12, spread, 1.0)
    dealt = materialize(deal(table, n, good), "labelled_groups")
    w = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        rows = dealt.groupBy("g").applyInPandas(_step(mean, spread, w), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        total = rows.sort_values("i")["v"].to_numpy()
        if not total[-1]:
            break
        g, h = total[:N_FEATURES] / total[-1] + RIDGE * w, total[N_FEATURES:-1].reshape(N_FEATURES, -1) / total[-1] + RIDGE * np.eye(N_FEATURES)
        move = np.linalg.solve(h, g)
        w = w - move * min(1.0, 4.0 / (np.abs(move).max() + 1e-12))
    value = sum(F.lit(float(a / s)) * (F.col("x")[i] - F.lit(float(m))) for i, (a, s, m) in enumerate(zip(w, spread, mean, strict=True)))
    return mean, spread, w, float(_each(table).agg(F.percentile_approx(value, 1 - good / n, 100_000)).first()[0])


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels (doc_id, quality 0/1) of those held out are not used.

    score rises with the Bradley-Terry score and is AT_THRESHOLD at the threshold; predicted says which side it is on.

    Null text counts as empty, which has features and a score like any other. A null doc_id has no label and counts as held
    out. Labels that are null or neither 0 nor 1 are ignored; repeated ones count each time. Without labels of both kinds all
    scores are AT_THRESHOLD. No documents give no rows. Other columns are ignored.
    """
    x = materialize(features(docs), "quality_features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out())
    mean, spread, w, threshold = fit(x.join(known, "doc_id"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES) - mean) / spread
            s = 1 / (1 + np.exp(-np.clip(z @ w - threshold + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= AT_THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None
