"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

A document's score is that of its single words plus, for each longer n-gram of it that counts, what this adds to the score of the
n-gram without its first word. So each order has a table of counts by n-gram hash, kept where the count is high enough, joined to
the table of the order below, and joined in turn to the documents' n-grams, a row for each distinct one of a document, which are
summed by document. What is found in this way of the longer orders is a small part of all n-grams, and only that is kept.

The longer orders are counted in rounds, a share of all n-grams by hash in each: each reads all texts again, but shuffles only its share.
On the way n-grams lie in arrays, one for each block of texts and range of hashes, and become rows again where they meet.
N-grams that make up a fixed part of the corpus, of which there can't be many, are told to all tasks and not joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import drop, materialize, scratch, setting, shuffles_freed

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
# Rounds in which each order beyond single words is counted, words of the corpus for a range of hashes, and the part of all words from
# which an n-gram is told to all tasks (so there are at most as many of an order; all of them go the same way to the same score).
ROUNDS, RANGE, COMMON = 2, 1 << 20, 1 << 22


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, its text, and its place in the text."""
    data, bounds = _text.raw(texts)
    starts, ends, first = _text.spans(data, bounds, _text.NOT_SPACE)
    text = _text.owners(first)
    return _text.hashes(data, starts, ends), text, np.arange(len(starts)) - first[:-1][text]


def _joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those without the last and without the first word."""
    return _text.mix(context * _text._BASE + suffix)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, from those of its context and suffix."""
    return words if n == 1 else _joined(*(lambda g: (g[:-1], g[1:]))(_grams(words, n - 1)))


def _mine(gram: np.ndarray, rounds: int, turn: int) -> np.ndarray:
    """Which n-grams the round has."""
    return (gram & np.uint64(0xFFFFFFFF)) * np.uint64(rounds) >> np.uint64(32) == np.uint64(turn)


def _ranked(gram: np.ndarray) -> np.ndarray:
    """The order of the n-grams by hash, equal ones by place. Hashes that differ in their last bits only may mix."""
    low = np.uint64((1 << len(gram).bit_length()) - 1)
    return (np.sort(gram & ~low | np.arange(len(gram), dtype=np.uint64)) & low).astype(np.int64)


def _range(gram: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes that each n-gram is of."""
    return ((gram >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    differ = reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))
    return np.flatnonzero(np.concatenate([[True], differ])) if len(columns[0]) else np.zeros(0, np.int64)


def _arrays(part: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part, which are in order, with its values as arrays."""
    new = _new(part)
    bounds = pa.array(np.append(new, len(part)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(c.view(np.int64) if c.dtype == np.uint64 else c)) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(part[new]), *lists], names=["part", *columns])


def ngram_counts(docs: DataFrame, n: int, rounds: int = 1, turn: int = 0, ranges: int = 1, least: int = 1) -> DataFrame:
    """context, suffix, count and gram of every n-gram of the texts with a count of least or more: n consecutive words, as 64-bit hashes.

    context is the n-gram without its last word, suffix that without its first; of one word, context is 0 and suffix the word.
    Of several rounds, one has the n-grams of its share. Null or empty texts and texts of fewer words have none.
    Blocks of texts bring counts of their own, which are summed up for each range of hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            words, _, place = _words(piece.column("text"))
            shorter = _grams(words, max(1, n - 1))
            gram = words if n == 1 else _joined(shorter[:-1], shorter[1:])
            at = np.flatnonzero(place >= n - 1) - n + 1
            at = at[_mine(gram[at], rounds, turn)]
            at = at[_ranked(gram[at])]
            first = _new(gram[at])
            times = np.diff(np.append(first, len(at))).astype(np.int32)
            at = at[first]
            context, suffix = (shorter[at], shorter[at + 1]) if n > 1 else (np.zeros(len(at), np.uint64), gram[at])
            yield _arrays(_range(gram[at], ranges), context=context, suffix=suffix, count=times)

    def total(table: pa.Table) -> pa.Table:
        context, suffix = (pc.list_flatten(table.column(c)).to_numpy().view(np.uint64) for c in ("context", "suffix"))
        gram = _joined(context, suffix) if n > 1 else suffix
        ranked = np.argsort(gram)
        first = _new(gram[ranked])
        counts = np.add.reduceat(pc.list_flatten(table.column("count")).to_numpy()[ranked], first, dtype=np.int64)
        at, counts = ranked[first][counts >= least], counts[counts >= least]
        return pa.table({"context": context[at].view(np.int64), "suffix": suffix[at].view(np.int64), "count": counts, "gram": gram[at].view(np.int64)})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part int, context array<long>, suffix array<long>, count array<int>")
    return rows.groupBy("part").applyInArrow(total, "context long, suffix long, count long, gram long")


def ngram_gains(docs: DataFrame, order: int, alpha: float, min_count: int) -> Iterator[DataFrame]:
    """For each order a table of gram, gain and count: for single words the log of their share of all words, for longer n-grams with
    a count of min_count or more what the log of count / count of context is beyond log alpha and the score of the suffix.

    The suffix of an n-gram that counts has no smaller count, so its score is the log of its count / count of its context.
    A table lasts until the next is asked for, that of single words until the one after that.
    """
    words = materialize(ngram_counts(docs, 1, ranges=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("gram", "count"), "ngram_counts")
    total = words.agg(F.sum("count")).first()[0] or 1
    lower = words.select("gram", "count", F.lit(total).cast("long").alias("before"))
    yield lower.select("gram", F.log(F.col("count") / F.col("before")).alias("gain"), "count")
    held = words
    for n in range(2, order + 1):
        parts = [materialize(ngram_counts(docs, n, ROUNDS, k, -(-total // (RANGE * ROUNDS)), min_count), "ngram_counts") for k in range(ROUNDS)]
        lower = lower.filter(F.col("count") >= min_count)  # as all have that are a part of an n-gram that counts
        context = lower.select(F.col("gram").alias("context"), F.col("count").alias("before"))
        suffix = lower.select(F.col("gram").alias("suffix"), F.col("count").alias("shorter"), F.col("before").alias("shorter_before"))
        table = reduce(DataFrame.unionByName, parts).join(context, "context").join(suffix, "suffix")
        table = materialize(table.select("gram", "count", "before", "shorter", "shorter_before"), "ngram_gains")  # whole numbers take less room than logs
        drop(*parts, *[held] * (n > 2))
        gain = F.log(F.col("count") / F.col("before")) - math.log(alpha) - F.log(F.col("shorter") / F.col("shorter_before"))
        yield table.select("gram", gain.alias("gain"), "count")
        drop(*[held] * (n == 2))
        lower = held = table


def _found(gram: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each n-gram would stand among the common ones, which are in order, and whether it is one."""
    at = np.minimum(np.searchsorted(common, gram), len(common) - 1)
    return at, common[at] == gram if len(common) else np.zeros(len(gram), bool)


def document_ngrams(docs: DataFrame, common: dict[int, np.ndarray], ranges: int) -> DataFrame:
    """part, gram, key and times: the distinct n-grams of each text but for common ones, which are given in order by number of words.

    part is the range of hashes, by which the rows are dealt. key is a hash of doc_id and text. Rows equal in both bring their
    n-grams once each.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            words, text, place = _words(piece.column("text"))
            keys = piece.column("key").to_numpy()
            for n, known in common.items():
                ends = np.flatnonzero(place >= n - 1)
                gram = _grams(words, n)[ends - n + 1]
                ranked = _ranked(gram)
                ranked = ranked[~_found(gram[ranked], known)[1]]
                gram, owner = gram[ranked], text[ends[ranked]]
                new = _new(gram, owner)
                times = np.diff(np.append(new, len(gram))).astype(np.int32)
                yield _arrays(_range(gram[new], ranges), gram=gram[new], key=keys[owner[new]], times=times)

    rows = docs.select(_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(explode, "part int, gram array<long>, key array<long>, times array<int>")
    rows = rows.repartition("part").select("part", F.posexplode("gram").alias("at", "gram"), "key", "times")
    return rows.select("part", "gram", F.get("key", F.col("at")).alias("key"), F.get("times", F.col("at")).alias("times"))


def _sizes(docs: DataFrame, common: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """doc_id, key and n_words of every row, and what it gains by common n-grams: of each order these in order and their gains."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            words, text, place = _words(piece.column("text"))
            known, gram = np.zeros(len(piece)), words
            for n, (grams, gains) in common.items():
                gram = gram if n == 1 else _joined(gram[:-1], gram[1:])
                ends = np.flatnonzero(place >= n - 1)
                ends = ends[_ranked(gram[ends - n + 1])]
                at, found = _found(gram[ends - n + 1], grams)
                known += np.bincount(text[ends[found]], gains[at[found]], len(piece))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(np.bincount(text, minlength=len(piece))), pa.array(known)], names=["doc_id", "key", "n_words", "known"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, key long, n_words long, known double")


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words and log_score of every document: the sum over its words of the log of their stupid-backoff scores.

    A word scores count(n-gram) / count(context) for the longest n-gram ending in it, of order words at most and not beyond
    the text, with a count of min_count or more; each word that the n-gram falls short costs a factor of alpha. Single words
    always count: count / all words. Counts are over all the documents given, words are runs of other than ASCII white space.

    Null, empty or blank text: n_words 0, log_score 0. Null doc_ids and repeated rows are rows of their own, and all count.
    No rows give no rows. Other columns are ignored.
    """
    spark, sums, common, waiting = docs.sparkSession, [], {}, {}
    # Ranges of hashes deal both sides of the join below, which is by range and hash.
    # Small batches, as ten thousand texts at once would be held by Spark and by Python.
    with shuffles_freed(spark), setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", False), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", 1000):
        for n, gains in enumerate(ngram_gains(docs, order, alpha, min_count), 1):
            if n == 1:
                total = gains.agg(F.sum("count")).first()[0] or 1
            often = F.col("count") * COMMON >= total
            known = gains.filter(often).select("gram", "gain").toArrow()
            grams = known.column("gram").to_numpy().view(np.uint64)
            ranked = np.argsort(grams)
            common[n] = grams[ranked], known.column("gain").to_numpy()[ranked]
            waiting[n] = gains.filter(~often).select("gram", "gain")
            if n == 1 < order:  # goes with pairs of words
                continue
            ranges = -(-total // RANGE)
            part = F.shiftright(F.shiftrightunsigned("gram", 32) * F.lit(ranges).cast("long"), 32).cast("int")
            rest = reduce(DataFrame.unionByName, waiting.values()).withColumn("part", part)
            found = document_ngrams(docs, {k: common[k][0] for k in waiting}, ranges).join(rest, ["gram", "part"])
            sums.append(materialize(found.groupBy("key").agg(F.sum(F.col("times") * F.col("gain")).alias("gain")), "document_gains"))
            waiting = {}
        rows = materialize(_sizes(docs, common), "document_sizes")
    found = reduce(DataFrame.unionByName, sums).groupBy("key").agg(F.sum("gain").alias("gain"))
    # Rows equal in doc_id and text were summed up together.
    found = found.join(rows.groupBy("key").agg(F.count("*").alias("copies")), "key").select("key", (F.col("gain") / F.col("copies")).alias("gain"))
    m, last = F.col("n_words"), order - 1
    short = F.when(m > last, last * (last - 1) // 2 + last * (m - last)).otherwise(m * (m - 1) / 2)  # words that all n-grams fall short, if all are single words
    gain = F.col("known") + F.coalesce("gain", F.lit(0.0))
    return rows.join(found, "key", "left").select("doc_id", "n_words", F.when(m > 0, gain + short * math.log(alpha)).otherwise(0.0).alias("log_score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        scores = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("log_score", F.round("log_score", 4))
        return materialize(scores, "lm_scores", keep=True)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)),
u AS (SELECT c, count(*) AS n FROM t GROUP BY c),
g AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
h AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
x AS (SELECT doc_id, CASE
    WHEN h.n IS NOT NULL THEN ln(h.n / gc.n)
    WHEN g.n >= 2 THEN ln(g.n / ub.n) + CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(u.n / (SELECT count(*) FROM t)) + CASE WHEN t.b IS NULL THEN 0 WHEN t.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS v
  FROM t JOIN u ON u.c = t.c LEFT JOIN u ub ON ub.c = t.b LEFT JOIN g ON g.b = t.b AND g.c = t.c
  LEFT JOIN g gc ON gc.b = t.a AND gc.c = t.b LEFT JOIN h ON h.a = t.a AND h.b = t.b AND h.c = t.c),
s AS (SELECT doc_id, sum(v) AS v FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, round(coalesce(v, 0), 4) AS log_score FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
