"""Host-level quality rules: document rules, failure rates by host shrunk to a common beta prior, host verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import materialize

_SYMBOL = _text._class(lambda b: chr(b) in "#*$%&|<>")
_NEWLINE = _text._class(lambda b: b != 10)
_LEADS = _text._class(lambda b: not 0x80 <= b < 0xC0)

STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys of a text together, and in it which items equal the one before."""
    salted = _text.mix(keys + _text.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(salted, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = salted[order][1:] == salted[order][:-1]
    return order, same


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _text.pieces(batches):
        data, bounds = _text.raw(piece.column("text"))
        starts, ends, first = _text.spans(data, bounds, _text.NOT_SPACE)
        owner, words = _text.owners(first), _text.hashes(data, starts, ends)

        runs = _text.windows(words, 5)
        inside = np.flatnonzero(owner[: len(runs)] == owner[4:]) if len(runs) else np.zeros(0, np.int64)
        order, same = _repeats(runs[inside], owner[inside])
        twice = same.copy()
        twice[:-1] |= same[1:]
        repeated = _text.covered(inside[order[twice]], 5, len(words))

        begin, end, line = _text.spans(data, bounds, _NEWLINE)
        worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        lines, of = _text.hashes(data, begin, end)[worded], _text.owners(line)[worded]
        order, same = _repeats(lines, of)
        n_dup = np.bincount(of[order[same]], minlength=len(bounds) - 1)

        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                piece.column("host"),
                *map(
                    pa.array,
                    (
                        np.diff(first),
                        _text.counted((_LEADS & _text.NOT_SPACE)[data], bounds),
                        _text.counted(_SYMBOL[data], bounds),
                        n_dup.astype(np.int64),
                        _text.counted(repeated, first),
                    ),
                ),
            ],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its counts over the whole text (null: no text) and its host."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_stats, STATS)


def host_rates(stats: DataFrame) -> DataFrame:
    """By host: documents, failures, and the failure rate shrunk to the hosts' common beta prior.

    The prior's mean and strength are those of the hosts' own rates (by moments). If all hosts agree, or differ by
    more than a beta distribution can, the prior counts as one document at the mean rate.
    """
    hosts = stats.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    strength = mean * (1 - mean) / var - 1 if var else 0.0
    strength = strength if strength > 0 else 1.0
    return hosts.withColumn("shrunk", (F.col("failed") + F.lit((mean or 0.0) * strength)) / (F.col("n") + F.lit(strength)))


def quality_rules(docs: DataFrame, host: str = "source", min_words: int = 10, max_repeat_pct: int = 20, max_host_rate: float = 0.5) -> DataFrame:
    """Each document's counts, whether it fails the base rules, and whether it is kept.

    It is kept if it passes the base rules and its host's shrunk failure rate is max_host_rate at most.

    Null or empty text: no words, so it fails. Null doc_id: a row like any other. Null host: no host verdict, the base
    rules alone decide. Repeated rows give repeated results. No rows give no rows. Other columns are ignored.
    """
    stats = materialize(
        document_stats(docs, host).withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))),
        "quality_stats",
    )
    bad = host_rates(stats).filter(F.col("shrunk") > max_host_rate).select("host", F.lit(True).alias("host_failed"))
    return stats.join(bad, "host", "left").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM h),
p AS (SELECT mu, CASE WHEN v > 0 AND mu * (1 - mu) / v - 1 > 0 THEN mu * (1 - mu) / v - 1 ELSE 1 END AS k FROM m),
bad AS (SELECT source FROM h, p WHERE (f + mu * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM b
"""
