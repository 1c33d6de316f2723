"""Language ID: multinomial naive Bayes over hashed character n-grams of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import _text
from trajlake.llm._shared import drop, materialize

#: Buckets of the hashed n-grams, and languages of a model: more of them make several models, one scored after the other.
BUCKETS, BLOCK = 1 << 15, 128
SIZES = (1, 2, 3)
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: its lower case, or 0 if it is no letter."""
    if not _tables:
        low = np.zeros(0x110000, np.uint32)
        for c in range(len(low)):
            if (x := chr(c)).isalpha():
                low[c] = ord(y) if len(y := x.lower()) == 1 else c
        _tables.append(low)
    return _tables[0]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of a piece's texts with their text's number, and each text's count of letters.

    What isn't a letter counts as one blank a run, so that n-grams see where words begin and end.
    """
    texts = texts.fill_null("").to_pylist()
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(x) + 1 for x in texts)]) - 1  # a text and the blank after it
    c = _letters()[code]
    n_letters = np.bincount(owner[c > 0], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] > 0) | (c[:-1] > 0)
    c, owner = c[keep].astype(np.uint64), owner[keep]
    found, of = [], []
    for n in SIZES:
        h = np.zeros(max(0, len(c) - n + 1), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[j : j + len(h)]
        of_h = owner[n // 2 : n // 2 + len(h)]
        solid = (c[n // 2 : n // 2 + len(h)] > 0) if n % 2 else of_h >= 0  # so none reaches into the next text
        found.append((_text.mix(h * np.uint64(2 * n + 1)) % np.uint64(BUCKETS)).astype(np.int64)[solid])
        of.append(of_h[solid])
    return np.concatenate(found), np.concatenate(of), n_letters


def fit(docs: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Models of BLOCK languages at most, in order: the languages and their log-probabilities by bucket, over all rows of theirs.

    Each model is counted when it is asked for; counting is a sum over partitions of BUCKETS rows a language at most, whatever
    the input. There is one model at least, without languages if no row has one.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    names, last = labelled.select("lang").distinct().orderBy("lang"), None
    while True:
        rest = names if last is None else names.filter(F.col("lang") > last)
        langs = sorted(rest.limit(BLOCK).toArrow().column("lang").to_pylist())
        if langs or last is None:
            yield langs, _log_probabilities(labelled, langs)
        if len(langs) < BLOCK:
            return
        last = langs[-1]


def _log_probabilities(labelled: DataFrame, langs: list[str]) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in _text.pieces(batches):
            bucket, of, _ = _grams(piece.column("text"))
            lang = piece.column("lang").dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
            both = np.bincount(code[of].astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names, both, strict=True):
                total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["lang", "bucket", "n"])

    matrix = np.full((len(langs), BUCKETS), 0.5)
    if not langs:
        return matrix
    within = labelled.filter(F.col("lang").between(langs[0], langs[-1]))
    rows = within.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    number = {x: i for i, x in enumerate(langs)}
    np.add.at(matrix, ([number[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()), rows.column("n").to_numpy())
    return np.log(matrix / matrix.sum(1, keepdims=True))


def _scored(rows: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """rows with the state of their scores after one more model: pred, top (the best log-likelihood) and total (the sum of all
    likelihoods so far, the best being 1); nulls where there is no letter or no language."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logp.T, np.float32))
    later = "pred" in rows.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _text.pieces(batches):
            bucket, of, letters = _grams(piece.column("text"))
            n, model = piece.num_rows, shared.value
            each = np.stack([np.bincount(of, model[bucket, i], n) for i in range(len(langs))], 1) if langs else np.zeros((n, 1))
            best, top = each.argmax(1), each.max(1)
            total = np.exp(each - top[:, None]).sum(1)
            known = (letters > 0) & bool(langs)
            pred = np.array([*langs, None], object)[np.where(known, best, len(langs))]
            if later:
                before, sums = (np.nan_to_num(piece.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("top", "total"))
                stays, highest = before >= top, np.maximum(before, top)
                pred = np.where(stays, np.array(piece.column("pred").to_pylist(), object), pred)
                total, top = sums * np.exp(before - highest) + total * np.exp(top - highest), highest
            names = [c for c in piece.schema.names if c not in ("pred", "top", "total")]
            state = [pa.array(pred, pa.string()), pa.array(top, mask=~known), pa.array(total, mask=~known)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *state], names=[*names, "pred", "top", "total"])

    schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("pred", "top", "total")]
    return rows.mapInArrow(score, ", ".join([*schema, "pred string", "top double", "total double"]))


def predict(docs: DataFrame, models: Iterator[tuple[list[str], np.ndarray]], with_text: bool = False) -> DataFrame:
    """The columns of docs as c0, c1 and so on (text only on demand, as text), pred and score.

    score is the posterior of the predicted language among those of all models, with even priors. Without a letter or a
    language: `und` and 0. A pass is made over docs for each model; after each but the last the rows are written with their state.
    """
    named = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    rows, waiting = docs.toDF(*named), None
    for model in models:
        if waiting is not None:
            before, rows = rows, materialize(_scored(rows, *waiting), "language_scores")
            if "pred" in before.columns:
                drop(before)
        waiting = model
    known = F.col("pred").isNotNull()
    kept = [c for c in named if with_text or c != "text"]
    return _scored(rows, *waiting).select(*kept, F.coalesce("pred", F.lit("und")).alias("pred"), F.when(known, 1 / F.col("total")).otherwise(0.0).alias("score"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def language_id(docs: DataFrame) -> DataFrame:
    """Each document's predicted language, learned from text and non-null lang of the documents not held out.

    Held out: crc32(doc_id as text) mod 4 is 2; a null doc_id can't be told apart from them, so it is not learned from.

    Null text, empty text or one without a letter: `und` with score 0, and so is all if no row has a language. Ties go to
    the language that sorts first. Repeated rows count each time. No rows give no rows. Other columns are ignored.
    """
    model = fit(docs.filter(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(True)), F.col("text").cast("string").alias("text"))
    return predict(rows, model).toDF("doc_id", "held_out", "lang_pred", "score")


def language_filter(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is known and has a posterior of min_score at least.

    Null text and text without a letter go, as do all if no row has a language. Rows without a doc_id are judged but not
    learned from; repeated rows stay or go together. No rows give no rows.
    """
    scored = predict(docs, fit(docs.filter(~held_out())), with_text=True)
    return scored.filter((F.col("pred") != "und") & (F.col("score") >= min_score)).drop("pred", "score").toDF(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
