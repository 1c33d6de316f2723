"""Language-model scores of repeated rows, null ids, very long texts and hot words, by value."""

import time
from collections import Counter
from math import log
from pathlib import Path

import numpy as np
import pytest

from trajlake.llm import _text, lm_scoring


def brute(texts, order=3, alpha=0.4, least=2):
    split = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in split for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, split))

    def score(gram):
        if len(gram) == 1:
            return log(counts[gram] / total)
        return log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else log(alpha) + score(gram[1:])

    return [(len(w), sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for w in split]


def test_repeats_null_ids_and_long_texts_by_value(spark):
    long = " ".join(f"w{i % 977} the w{i % 13}" for i in range(60_000))
    rows = [(1, "a b c a b d"), (1, "a b c a b d"), (None, "a b c a b d"), (None, None), (None, None), (2, ""), (1, "a b x"), (3, long), (4, long + " end"), (5, "the " * 5000), (6, "one"), (7, "two\n words")]
    found = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = sorted(((k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in found), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-9 * max(1, abs(b[2]))


def test_rounds_share_the_ngrams_and_tables_keep_only_what_counts(spark):
    docs = spark.createDataFrame([(1, "a b c a b d"), (2, "a b c x"), (3, None)], "doc_id long, text string")
    once = sorted(map(tuple, lm_scoring.ngram_counts(docs, 2).collect()))
    shares = [list(map(tuple, lm_scoring.ngram_counts(docs, 2, 2, k).collect())) for k in range(2)]
    assert sorted(sum(shares, [])) == once and sum(r[2] for r in once) == 8
    assert [t.count() for t in lm_scoring.ngram_gains(docs, 3, 0.4, 2)] == [5, 2, 1]


def test_shuffle_files_go_with_their_step(spark):
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {f for f in local.rglob("shuffle_*.data")}
    before = files()
    lm_scoring.lm_scores(spark.createDataFrame([(k, f"a b c w{k}") for k in range(50)], "doc_id long, text string").repartition(4))
    for _ in range(40):
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before


@pytest.mark.parametrize("common", [1, 40, 1 << 40])
def test_common_and_other_ngrams_by_value(spark, monkeypatch, common):
    """None are common, some or all; ranges of hashes of a few words each."""
    monkeypatch.setattr(lm_scoring, "COMMON", common)
    monkeypatch.setattr(lm_scoring, "RANGE", 50)
    texts = [" ".join(f"w{(i * k) % 23} the x{i % 5}" for i in range(40)) for k in range(9)] + ["the the the the", None, " ", "the", "rare one"]
    rows = [(k % 11, t) for k, t in enumerate([*texts, texts[3]])]
    found = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = sorted(((k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows]), strict=True)), key=str)
    assert len(found) == len(want)
    for a, b in zip(sorted(map(tuple, found), key=lambda r: (str(r[0]), r[1:])), sorted(want, key=lambda r: (str(r[0]), r[1:])), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-9 * max(1, abs(b[2]))


def test_counts_by_ranges_and_rows_without_common_ngrams(spark):
    docs = spark.createDataFrame([(k, f"a b c a b w{k}") for k in range(30)], "doc_id long, text string").repartition(4)
    once = sorted(map(tuple, lm_scoring.ngram_counts(docs, 2).collect()))
    assert sorted(map(tuple, lm_scoring.ngram_counts(docs, 2, ranges=7).collect())) == once
    often = sorted(map(tuple, lm_scoring.ngram_counts(docs, 2, ranges=7, least=2).collect()))
    assert often == [r for r in once if r[2] >= 2] and sorted(r[2] for r in often) == [30, 30, 60]
    grams = np.sort(np.array([r[3] for r in often], np.int64).view(np.uint64))
    rows = lm_scoring.document_ngrams(docs, {2: np.zeros(0, np.uint64)}, 7)
    assert rows.count() == 30 * 4 and rows.agg({"times": "sum"}).first()[0] == 30 * 5
    assert lm_scoring.document_ngrams(docs, {2: grams}, 7).count() == 30  # only those with the word of its own


def test_hashes_in_blocks_are_those_of_the_bytes(monkeypatch):
    data = np.frombuffer(b"ab " * 50_000 + b"x" * 200_000 + b" ab " + b"y" * 3_000_000 + b" ab", np.uint8)
    starts, ends, _ = _text.spans(data, np.array([0, len(data)]), _text.NOT_SPACE)
    found = _text.hashes(data, starts, ends)
    monkeypatch.setattr(_text, "_BLOCK", 1 << 20)
    assert (found == _text.hashes(data, starts, ends)).all() and len(set(found.tolist())) == 3
